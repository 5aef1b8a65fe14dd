"""Reads artefacts and source trees as tables, and writes what was made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provena.functions.text import any_glob, lines, without_fence
from provena.operators.storage import kept

# Which files are sources, which folders never are, which files are manifests.
SUFFIXES = [".py", ".pyi", ".js", ".ts", ".tsx", ".go", ".java", ".kt", ".rb", ".rs", ".c", ".h", ".cpp", ".cs", ".php", ".sql", ".sh", ".yaml", ".yml", ".toml", ".cfg", ".ini", ".json", ".md", ".rst", ".txt"]
SKIPPED = [".git", "__pycache__", "node_modules", ".venv", "venv", "dist", "build", ".tox"]
MANIFESTS = ["pyproject.toml", "setup.py", "setup.cfg", "requirements*.txt", "package.json", "go.mod", "pom.xml", "Cargo.toml", "Dockerfile*", "docker-compose*", "README*", ".github/workflows/*.yml", ".github/workflows/*.yaml"]
#: Folders that a listing leaves out, and the most files it has.
UNLISTED = [*SKIPPED, ".pytest_cache"]
LISTED = 5000
#: Fixed value: how an output marks a file.
_BLOCK = r"(?s)===\s*FILE:\s*([^=\n]+?)\s*===\s*\n(.*?)\n?===\s*END\s*FILE\s*==="


def below(path: Column, root: str) -> Column:
    """The path without the folder it is read from."""
    bare, start = F.regexp_replace(path, r"^[a-z0-9]+:/*", "/"), "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(F.startswith(bare, F.lit(start)), F.substring(bare, len(start) + 1, 1 << 30)).otherwise(bare)


def text_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path below root, text, bytes) of all files; bytes that aren't UTF-8 are replaced. Empty files, which Spark's scan leaves out, are listed and have an empty text."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    found = (reader.option("pathGlobFilter", glob) if glob else reader).load(root)
    out = found.select(below(F.col("path"), root).alias("path"), F.expr("make_valid_utf8(string(content))").alias("text"), F.col("content").alias("bytes"))
    empty = empty_files(spark, root, glob)
    return out.unionByName(empty.select("path", F.lit("").alias("text"), F.lit(b"").alias("bytes")))


def place(folder: str):
    """The file system of a folder, and the folder's path there, for code in tasks; ArrowInvalid where Arrow doesn't know the scheme."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    if "://" not in folder:
        return LocalFileSystem(), folder.rstrip("/")
    fs, root = FileSystem.from_uri(folder)
    return fs, root.rstrip("/")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes) of all files below root, or of root itself where it is a file; of what isn't there, none.

    Folders are listed by tasks, a level of the tree a job, so neither names nor calls pass through the driver.
    A scheme that Arrow can't open is listed by Hadoop's own recursive listing, on the driver.
    """
    import pyarrow as pa
    from pyarrow.fs import FileType

    try:
        fs, top = place(root)
    except pa.ArrowInvalid:
        return spark.createDataFrame(_walked(spark, root), "path string, bytes long")
    here = fs.get_file_info(top)
    if here.type != FileType.Directory:
        return spark.createDataFrame([(top, here.size)] if here.type == FileType.File else [], "path string, bytes long")

    def run(batches):
        from pyarrow.fs import FileSelector

        fs, _ = place(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                inside = [x for x in fs.get_file_info(FileSelector(folder, allow_not_found=True)) if x.type in (FileType.File, FileType.Directory)]
                sizes = [x.size if x.type == FileType.File else None for x in inside]
                yield pa.RecordBatch.from_arrays([pa.array([x.path for x in inside], pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])

    level, out = spark.createDataFrame([(top,)], "path string"), None
    while True:
        seen = kept(level.mapInArrow(run, "path string, bytes long"))
        found = seen.where("bytes is not null")
        out = found if out is None else out.unionByName(found)
        folders = seen.where("bytes is null").select("path")
        if folders.isEmpty():
            return out
        level = folders.repartition("path")


def _walked(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    jvm, sc = spark._jvm, spark.sparkContext
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs, out = top.getFileSystem(sc._jsc.hadoopConfiguration()), []
    if fs.exists(top):
        files = fs.listFiles(top, True)
        while files.hasNext():
            f = files.next()
            out.append((f.getPath().toString(), f.getLen()))
    return out


def empty_files(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path) of the files without bytes."""
    out = listed(spark, root).where("bytes = 0").select(below(F.col("path"), root).alias("path"))
    return out.where(any_glob(F.element_at(F.split("path", "/", -1), -1), [glob])) if glob else out


def in_skipped(path: Column, folders: list[str] = SKIPPED) -> Column:
    return F.exists(F.split(path, "/", -1), lambda p: p.isin(folders))


def sources(files: DataFrame) -> DataFrame:
    """Files with a source's suffix that are in no skipped folder."""
    return files.where(F.regexp_extract("path", r"(\.[^./]+)$", 1).isin(SUFFIXES) & ~in_skipped(F.col("path")))


def manifests(files: DataFrame) -> DataFrame:
    return files.where(any_glob(F.col("path"), MANIFESTS))


def source_lines(files: DataFrame) -> DataFrame:
    """(path, n, line), n from 1."""
    return files.select("path", F.posexplode(lines(F.col("text"))).alias("p", "line")).select("path", (F.col("p") + 1).alias("n"), "line")


def listing(files: DataFrame, most: int = LISTED) -> DataFrame:
    """(path, lines) by parts of paths, lines counted as a file's are: line feeds, and what is after the last; of more than `most` files a marker row stands for the rest."""
    text = F.coalesce("text", F.lit(""))
    n_lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)
    kept = files.where(~in_skipped(F.col("path"), UNLISTED)).select("path", n_lines.cast("long").alias("lines"))
    n = kept.count()
    out = kept.orderBy(F.split("path", "/", -1)).limit(most)
    if n <= most:
        return out
    return out.unionByName(files.sparkSession.createDataFrame([(f"… {n - most} more", None)], "path string, lines long"))


def csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all strings."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def csv_cells(texts: DataFrame, id_col: str = "path") -> DataFrame:
    """(id, n, cells) of the records of CSV texts (id, text): quoted cells may have commas, doubled quotes and line breaks; records that are blank have no row but count in n, from 0."""

    def run(batches):
        import csv
        import io

        import pyarrow as pa

        csv.field_size_limit(1 << 62)
        for batch in batches:
            ids, ns, cells = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for n, row in enumerate(csv.reader(io.StringIO(text or "", newline=""))):
                    if any(c.strip() for c in row):
                        ids.append(i)
                        ns.append(n)
                        cells.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(ns, pa.int32()), pa.array(cells, pa.list_(pa.string()))], [id_col, "n", "cells"])

    kind = texts.schema[id_col].dataType.simpleString()
    return texts.select(id_col, "text").mapInArrow(run, f"`{id_col}` {kind}, n int, cells array<string>")


def csv_header(template: str) -> list[str]:
    """The columns of a template's first line, quoted or not."""
    import csv

    return next(csv.reader([template.splitlines()[0]]), []) if template else []


def csv_problems(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """(problem, row) of one CSV file."""
    return csv_text_problems(text_files(spark, path), header).select("problem", "row")


def csv_text_problems(texts: DataFrame, header: list[str], id_col: str = "path") -> DataFrame:
    """(id, problem, row) of CSV texts: a header that isn't just this one, and records of another width; blank records don't count."""
    return cell_problems(csv_cells(texts, id_col), texts.select(id_col), header, id_col)


def cell_problems(raw: DataFrame, ids: DataFrame, header: list[str], id_col: str) -> DataFrame:
    """(id, problem, row) of records (id, n, cells), with ids of those that may have none."""
    head = raw.where("n = 0").select(id_col, "cells")
    wrong = ids.join(head, id_col, "left").where(~F.equal_null("cells", F.array(*map(F.lit, header)))).select(id_col, F.lit("header").alias("problem"), F.lit(0).alias("row"))
    return wrong.unionByName(raw.where((F.col("n") > 0) & (F.size("cells") != len(header))).select(id_col, F.lit("width").alias("problem"), F.col("n").alias("row")))


def yaml_documents(files: DataFrame) -> DataFrame:
    """files (path, text) with `document`, the YAML as JSON text, and `problem`: why it couldn't be read, or that it is empty."""

    def run(batches):
        import json

        import yaml

        for pdf in batches:
            out = []
            for text in pdf["text"]:
                try:
                    x = yaml.safe_load(text)
                    out.append((None if x is None else json.dumps(x, ensure_ascii=False, default=str), "empty document" if x is None else None))
                except yaml.YAMLError as e:
                    out.append((None, str(e)[:200]))
            pdf["document"], pdf["problem"] = [o[0] for o in out], [o[1] for o in out]
            yield pdf

    schema = T.StructType([*files.select("path", "text").schema, T.StructField("document", T.StringType()), T.StructField("problem", T.StringType())])
    return files.select("path", "text").mapInPandas(run, schema)


def file_blocks(output: Column) -> Column:
    """The FILE blocks of an output as a map from path to body; the last of a path holds."""
    found = F.arrays_zip(F.regexp_extract_all(output, F.lit(_BLOCK), 1).alias("path"), F.regexp_extract_all(output, F.lit(_BLOCK), 2).alias("body"))
    last = F.filter(found, lambda x, i: ~F.exists(F.slice(found, i + 2, F.size(found)), lambda y: F.trim(y["path"]) == F.trim(x["path"])))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.trim(x["path"]).alias("key"), x["body"].alias("value"))))


def accepted_blocks(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """(tag, path, body) of the blocks of outputs (tag, output) for expected paths (tag, path): by full path, else by file name.

    An output without blocks is the one expected file itself, its code fence taken off.
    """
    blocks = outputs.select("tag", F.explode(file_blocks(F.col("output"))).alias("said", "body"))
    name = lambda c: F.element_at(F.split(c, "/", -1), -1)
    full = blocks.join(expected, (blocks["tag"] == expected["tag"]) & (blocks["said"] == expected["path"])).select(blocks["tag"], "path", "body", "said")
    rest = blocks.join(full.select("tag", "said"), ["tag", "said"], "left_anti")
    by_name = rest.join(expected, (rest["tag"] == expected["tag"]) & (name(rest["said"]) == name(expected["path"]))).select(rest["tag"], "path", "body")
    sole = expected.groupBy("tag").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    bare = outputs.where((F.size(file_blocks(F.col("output"))) == 0) & (F.trim("output") != "")).join(sole, "tag").select("tag", "path", without_fence(F.col("output")).alias("body"))
    return full.select("tag", "path", "body").unionByName(by_name).unionByName(bare)


def write_texts(texts: DataFrame, folder: str, by: str = "path") -> None:
    """Texts (by, text) as text files, a folder for each value of `by`."""
    texts.select(by, "text").write.mode("overwrite").partitionBy(by).text(folder)


def append_log(lines_: DataFrame, folder: str) -> None:
    """Messages with their time in front, after those that are there."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    lines_.select(F.concat_ws(" ", stamp, "message").alias("value")).write.mode("append").text(folder)
