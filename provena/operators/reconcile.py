"""Keys on two sides, numbers and their blocks, attempts, tiers, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provena.functions.text import any_glob, percent, source_ref
from provena.operators.storage import kept

BLOCK = 100
#: Keys that a task takes at once.
ROWS_A_TASK = 1 << 20


def exactly_once(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """expected with `times` that actual has the key, and `state`: missing, once or duplicate."""
    n = actual.groupBy(key).agg(F.count("*").alias("times"))
    out = expected.join(n, key, "left").withColumn("times", F.coalesce("times", F.lit(0).cast("long")))
    return out.withColumn("state", F.when(F.col("times") == 0, "missing").when(F.col("times") == 1, "once").otherwise("duplicate"))


def both_ways(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, side) of keys that one side alone has.

    Both sides are one table of keys in as many tasks as it has stretches of ROWS_A_TASK rows, whatever they take
    as bytes: keys compress so well that tasks cut by bytes would hold ever more of them.
    """
    tasks = -(-(left.count() + right.count()) // ROWS_A_TASK)
    rows = [x.where(F.col(key).isNotNull()).select(key, F.lit(side).alias("side")) for x, side in ((left, "left"), (right, "right"))]
    each = rows[0].unionByName(rows[1]).repartition(max(1, tasks), key)
    sides = each.groupBy(key).agg(F.bool_or(F.col("side") == "left").alias("_left"), F.bool_or(F.col("side") == "right").alias("_right"))
    return sides.where(F.col("_left") != F.col("_right")).select(key, F.when(F.col("_left"), "left").otherwise("right").alias("side"))


def used(numbers: DataFrame, number: str, place: str) -> DataFrame:
    """(number, place, times): where each number is used, a row a place."""
    return numbers.groupBy(number, F.col(place).cast("string").alias("place")).agg(F.count("*").alias("times"))


def collisions(numbers: DataFrame, number: str, place: str) -> DataFrame:
    """Numbers used more than once, how often, and in which places in order.

    The places are one text a number: few, as a place counts once; used() has them as rows, whatever their number.
    """
    return numbers.groupBy(number).agg(F.count("*").alias("times"), F.array_join(F.array_sort(F.collect_set(F.col(place).cast("string"))), ",").alias("places")).where("times > 1")


def next_block(number: Column) -> Column:
    """The first number of the block after the one that the largest number is in; 1 if there is none."""
    top = F.max(number)
    return F.coalesce(F.floor((top - 1) / BLOCK) * BLOCK + BLOCK + 1, F.lit(1)).cast("long")


def dense(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number`, from 0 in order: numbers within ranges come first, then the ranges' offsets, so no task sees all."""
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Numbers of parts are read twice, so the parts are kept.
    new = kept(rows.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted((r["_part"], r["count"]) for r in new.groupBy("_part").count().collect()):
        before += [F.lit(part), F.lit(total).cast("long")]
        total += n
    offset = F.element_at(F.create_map(*before), F.col("_part")) if before else F.lit(0).cast("long")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return new.withColumn("number", offset + rank - 1).drop("_part")


def assigned_blocks(modules: DataFrame, key: str, own: str, start: int) -> DataFrame:
    """modules with `block`: their own first number, or one block after the other from `start`, in order of key, for those without."""
    new = dense(modules.where(F.col(own).isNull()), key)
    numbered = new.withColumn("block", (F.lit(start) + BLOCK * F.col("number")).cast("long")).drop("number")
    return modules.where(F.col(own).isNotNull()).withColumn("block", F.col(own).cast("long")).unionByName(numbered)


def planned(inventory: DataFrame, exclude: list[str], least: int | None = None, *by: str) -> DataFrame:
    """(by, pos, path): the modules of inventories (modules: array of variants, each an object with path and approx_size, or a bare string).

    Entries without a path, those that a glob excludes and those that say they have fewer than `least` lines are left out; a size that is no number excludes nothing.
    """
    each = inventory.select(*by, F.posexplode("modules").alias("pos", "m"))
    is_object = F.startswith(F.schema_of_variant("m"), F.lit("OBJECT"))
    path = F.when(is_object, F.try_variant_get("m", "$.path", "string")).otherwise(F.try_variant_get("m", "$", "string"))
    size = F.when(is_object, F.try_variant_get("m", "$.approx_size", "int"))
    out = each.select(*by, "pos", path.alias("path"), size.alias("size")).where("path <> ''").where(~any_glob(F.col("path"), exclude))
    return (out if least is None else out.where(F.col("size").isNull() | (F.col("size") >= least))).drop("size")


def objects(elements: Column) -> Column:
    """Of an array of variants those that are objects."""
    return F.filter(elements, lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT")))


def doc_failure(ran: Column, output: Column, expected: Column) -> Column:
    """How an example of the documentation failed: it doesn't run, it says something else, or it says nothing where it should; null if it didn't."""
    said = F.coalesce(F.trim(output), F.lit(""))
    return F.when(~ran, "does not run").when((said == "") & (F.trim(expected) != ""), "says nothing").when(said != F.trim(expected), "says something else")


def stops(traced: DataFrame, capabilities: DataFrame, most: float = 30.0) -> DataFrame:
    """One row: traced files (changed: boolean) and capabilities (touched: boolean), how many of each are changed, and whether that is too much to go on from: over `most` percent of files, or over half of the capabilities."""
    f = traced.agg(F.count("*").alias("traced"), F.count_if("changed").alias("changed"))
    c = capabilities.agg(F.count("*").alias("capabilities"), F.count_if("touched").alias("touched"))
    over = (100.0 * F.col("changed") > most * F.col("traced")) | (2 * F.col("touched") > F.col("capabilities"))
    return f.join(F.broadcast(c)).withColumn("stop", over)


def to_run(tasks: DataFrame, outputs: DataFrame, found: DataFrame, force: bool = False) -> DataFrame:
    """tasks (tag) with `state`: skipped if an output (tag, path) is there and none of its findings (tag, severity) is an error, else run; with force all run."""
    there = outputs.select("tag").distinct().withColumn("_there", F.lit(True))
    bad = found.where("severity = 'error'").select("tag").distinct().withColumn("_bad", F.lit(True))
    out = tasks.join(there, "tag", "left").join(bad, "tag", "left")
    fine = F.col("_there").isNotNull() & F.col("_bad").isNull() & F.lit(not force)
    return out.withColumn("state", F.when(fine, "skipped").otherwise("run")).drop("_there", "_bad")


def not_written(expected: DataFrame, outputs: DataFrame) -> DataFrame:
    """(tag, paths) of the tasks none of whose expected files (tag, path) is there; paths are a task's own, in order."""
    there = expected.join(outputs.select("tag", "path").distinct(), ["tag", "path"], "left_semi").select("tag").distinct()
    return expected.join(there, "tag", "left_anti").groupBy("tag").agg(F.array_join(F.array_sort(F.collect_set("path")), " | ").alias("paths"))


def referenced(rules: DataFrame, files: DataFrame) -> DataFrame:
    """files (path) that some rule's source speaks of."""
    said = rules.select(source_ref(F.col("source"))["file"].alias("path")).where("path is not null").distinct()
    return files.join(said, "path", "left_semi")


def tier_of(modules: DataFrame, path: str, tiers: DataFrame, default: str) -> DataFrame:
    """modules with `tier`: that of the longest prefix (prefix, tier, ord) that is the path or a folder above it; of equal ones the last; else the default.

    A path is cut into its own prefixes, which makes this an equi join at any number of tiers.
    """
    t = tiers.select(F.rtrim("prefix", F.lit("/")).alias("_p"), "tier", "ord").groupBy("_p").agg(F.max_by("tier", "ord").alias("tier"))
    bare = F.rtrim(path, F.lit("/"))
    parts = F.split(bare, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keys = modules.select(path).distinct().select(path, F.explode(F.array_distinct(above)).alias("_p"))
    best = keys.join(t, "_p").groupBy(path).agg(F.max_by("tier", F.length("_p")).alias("tier"))
    return modules.join(best, path, "left").withColumn("tier", F.coalesce("tier", F.lit(default)))


# Ranks of tiers, and the tier from which a stage runs.
TIER_RANK = {"L0": 0, "L1": 1, "L2": 2}
STAGE_MIN_TIER = {"0": "L0", "1": "L0", "2": "L1", "3": "L1", "4": "L2", "5": "L2", "6": "L2", "7": "L2", "89": "L2", "90": "L2", "92": "L2"}


def tier_rank(tier: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in TIER_RANK.items() for x in kv]), tier)


def stage_allowed(stage: Column, tier: Column) -> Column:
    """Whether a stage runs at a tier; a stage that isn't known needs the highest."""
    least = F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_MIN_TIER.items() for x in kv]), stage)
    return tier_rank(tier) >= tier_rank(F.coalesce(least, F.lit("L2")))


def outcomes(attempts: DataFrame, key: str, order: str, ok: str, retries: int = 2) -> DataFrame:
    """For each task: its status (ok or escalated), the retries it took and the tokens of the attempts that counted (null if none are known).

    The first clean attempt of the first retries + 1 ends a task.
    """
    w = Window.partitionBy(key).orderBy(order)
    tried = attempts.withColumn("_n", F.row_number().over(w) - 1).where(F.col("_n") <= retries)
    first = F.min(F.when(F.col(ok), F.col("_n"))).over(Window.partitionBy(key))
    tried = tried.withColumn("_first", first).where(F.col("_first").isNull() | (F.col("_n") <= F.col("_first")))
    tokens = F.sum("tokens") if "tokens" in attempts.columns else F.lit(None).cast("long")
    return tried.groupBy(key).agg(F.when(F.max("_first").isNull(), "escalated").otherwise("ok").alias("status"), F.max("_n").cast("long").alias("retries"), F.nullif(tokens, F.lit(0)).alias("tokens"))


def acceptance(verdicts: DataFrame, verdict: str, accepted: str, threshold: float, by: list[str] | None = None) -> DataFrame:
    """Share of verdicts that are the accepted one, and whether it reaches the threshold."""
    out = verdicts.groupBy(*(by or [])).agg(F.count("*").alias("total"), F.count_if(F.trim(verdict) == accepted).alias("confirmed"))
    out = out.where("total > 0").withColumn("share", percent(F.col("confirmed"), F.col("total"), 0.0))
    return out.withColumn("accepted", 100.0 * F.col("confirmed") / F.col("total") >= threshold)


def differences(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, verdict): unchanged, modified, added or removed."""
    a, b = old.select(key, F.col(value).alias("_a"), F.lit(1).alias("_in_a")), new.select(key, F.col(value).alias("_b"), F.lit(1).alias("_in_b"))
    verdict = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.equal_null("_a", "_b"), "unchanged").otherwise("modified")
    return a.join(b, key, "full_outer").select(key, verdict.alias("verdict"))


def impact(changed: DataFrame, trace: DataFrame, file: str, rule: str) -> DataFrame:
    """Changed files (file, deleted) with the number of rules that trace to them and what follows: suspect, deleted or not covered."""
    n = trace.groupBy(file).agg(F.count_distinct(rule).alias("rules"))
    out = changed.join(n, file, "left").withColumn("rules", F.coalesce("rules", F.lit(0).cast("long")))
    return out.withColumn("effect", F.when(F.col("rules") == 0, "not covered").when(F.col("deleted"), "deleted").otherwise("suspect"))


def largest_remainder(groups: DataFrame, size: str, quota: int) -> DataFrame:
    """groups with `seats`: the quota in proportion to size, whole numbers, what is left to the largest remainders (then by key order)."""
    key = groups.columns[0]
    total = groups.agg(F.sum(size)).first()[0] or 1
    exact = F.col(size) * F.lit(quota).cast("double") / F.lit(total)
    out = groups.withColumn("_floor", F.floor(exact)).withColumn("_rest", F.bround(exact - F.floor(exact), 9))
    left = quota - (out.agg(F.sum("_floor")).first()[0] or 0)
    top = out.orderBy(F.desc("_rest"), key).limit(left).select(key, F.lit(1).alias("_more"))
    return out.join(top, key, "left").select(*groups.columns, (F.col("_floor") + F.coalesce("_more", F.lit(0))).cast("long").alias("seats"))
