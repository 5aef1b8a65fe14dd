"""Operators on small fixtures: the cases that the tables don't have."""

from pyspark.sql import functions as F

from provena.functions import text as X
from provena.operators import code, completeness, containment, contracts, findings, masking, reconcile, spans
from provena.plans import suite
from provena.sources import files


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def test_squash_and_lines(spark):
    assert one(spark, X.squash, " a\t\x0b\u00a0 b\x1f\n") == "a b"
    assert one(spark, X.squash, None) == ""
    assert one(spark, X.lines, "a\r\nb\x0bc\u2028d\n") == ["a", "b", "c", "d"]
    assert one(spark, X.line_count, " \n ") == 0
    assert one(spark, X.line_count, "a\nb\n") == 2


def test_source_ref(spark):
    assert tuple(one(spark, X.source_ref, "a:b.py:3-9")) == ("a:b.py", 3, 9)
    assert tuple(one(spark, X.source_ref, "a.py:3")) == ("a.py", 3, 3)
    for bad in ("a.py", "a.py:", ":3x", None):
        assert one(spark, X.source_ref, bad) is None


def test_placeholders(spark):
    rows = spark.createDataFrame([("wait <N> s (max)", "wait 1_000.5 s (max)"), ("at < число > o", "at 7 o"), ("a.b", "axb")], "p string, t string")
    got = [r.m for r in rows.select(F.regexp_like("t", X.needle_pattern(F.col("p"))).alias("m")).collect()]
    assert got == [True, True, False]


def test_percent_rounds_to_even(spark):
    rows = spark.createDataFrame([(1, 16), (0, 0), (2, 3)], "c int, t int")
    assert [r.p for r in rows.select(X.percent(F.col("c"), F.col("t"), 100.0).alias("p")).collect()] == [6.2, 100.0, 66.7]


def test_names_and_globs(spark):
    assert one(spark, X.module_name, "a/b.c.py/") == "b.c"
    assert one(spark, X.module_name, "a/.env") == ".env"
    assert one(spark, lambda c: X.any_glob(c, ["**/test_*.py", "x[ab]?"]), "q/test_a/b.py") is True
    assert one(spark, lambda c: X.any_glob(c, ["x[ab]?"]), "xbz") is True
    assert one(spark, lambda c: X.any_glob(c, ["x[!ab]?"]), "xbz") is False
    assert one(spark, lambda c: X.padded(c, 3), 1001, "int") == "1001"
    assert one(spark, X.without_fence, "```yaml\na: 1\n```") == "a: 1"
    assert one(spark, lambda c: X.filled("{A} of {B}", {"A": c, "B": F.lit("n")}), "x") == "x of n"


def test_mask_is_idempotent_and_a_hole(spark):
    text = 'password = "hunter2hunter"\nurl = db://me:s3cret@host/x\ntoken: abcdefgh12'
    once = one(spark, masking.masked, text)
    assert "hunter2" not in once and "s3cret" not in once and "@host/x" in once and "abcdefgh12" not in once
    assert one(spark, masking.masked, once) == once
    assert one(spark, masking.kinds, text) == {"private key": 0, "connection string": 1, "password": 1, "token": 1}
    rows = spark.createDataFrame([("k = ***MASKED***;", "a k = zzz; b"), ("k = ***MASKED***;", "k = z\n;")], "q string, w string")
    assert [r.m for r in rows.select(X.quoted_in(F.col("q"), F.col("w")).alias("m")).collect()] == [True, False]


def test_innermost_takes_the_later_of_equal_spans(spark):
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 50)], "id int, k string, at int")
    s = spark.createDataFrame([("f", 1, 9, "outer", 0), ("f", 4, 6, "first", 1), ("f", 3, 5, "second", 2)], "k string, start int, end int, name string, ord int")
    assert {r.id: r.name for r in spans.innermost(points, s, "k", "at", "id", "name", "ord").collect()} == {1: "second", 2: None}


def test_overlaps_in_any_bucket(spark):
    items = spark.createDataFrame([("f", 1, 1), ("f", 5000, 5000), ("g", 1, 1)], "k string, start int, end int")
    r = spark.createDataFrame([("f", 4000, 4997)], "k string, start int, end int")
    assert spans.overlaps(items, r, "k", 3).count() == 1
    assert spans.overlaps(items, r, "k", 2).count() == 0
    assert spans.overlaps(items, r, "k", 3, "left_anti").count() == 2


def test_nearest_preceding_needs_less_indent(spark):
    text = ["def a():", "  x", "def b():", "    if y:", "", "      z", "  def c():", "   w"]
    lines = spark.createDataFrame([("f", i + 1, t, len(t) - len(t.lstrip())) for i, t in enumerate(text)], "k string, n int, line string, indent int")
    targets = spark.createDataFrame([("f", 2), ("f", 6), ("f", 8), ("f", 1)], "k string, n int")
    got = {r.n: r.name for r in spans.nearest_preceding(targets, lines, "k", code.function_name(F.col("line"))).collect()}
    assert got == {2: "a", 6: "b", 8: "c", 1: None}


def test_blocks(spark):
    n = spark.createDataFrame([(1,), (100,)], "n int")
    assert n.agg(reconcile.next_block(F.col("n")).alias("b")).first().b == 101
    assert n.limit(0).agg(reconcile.next_block(F.col("n")).alias("b")).first().b == 1
    m = spark.createDataFrame([("a", None), ("b", 5), ("c", None)], "k string, own int")
    assert {r.k: r.block for r in reconcile.assigned_blocks(m, "k", "own", 101).collect()} == {"a": 101, "b": 5, "c": 201}


def test_tier_of_whole_folders_only(spark):
    tiers = spark.createDataFrame([("src", "L1", 0), ("src/a/", "L2", 1), ("src/a", "L0", 2)], "prefix string, tier string, ord int")
    m = spark.createDataFrame([("src/x",), ("src2",), ("src/a/b/",), ("src",)], "path string")
    assert {r.path: r.tier for r in reconcile.tier_of(m, "path", tiers, "L9").collect()} == {"src/x": "L1", "src2": "L9", "src/a/b/": "L0", "src": "L1"}


def test_outcomes(spark):
    a = spark.createDataFrame([("x", i, ok, 5) for i, ok in enumerate([False, True, False])] + [("y", i, False, 0) for i in range(5)], "t string, o int, ok boolean, tokens long")
    got = {r.t: (r.status, r.retries, r.tokens) for r in reconcile.outcomes(a, "t", "o", "ok").collect()}
    assert got == {"x": ("ok", 1, 10), "y": ("escalated", 2, None)}


def test_contracts(spark):
    rows = spark.createDataFrame(
        [("A-R-001", contracts.VERDICTS[0], "ok", "a.py:1", "s", None), ("bad", contracts.VERDICTS[1], "", "a.py", "s", None), ("A-R-002", "maybe", "ok", "a.py:1-2", "s", "ran")],
        "req_id string, verdict string, layer1 string, source string, statement string, checked_with string",
    )
    found = contracts.violations(rows.withColumn("i", F.monotonically_increasing_id()), contracts.validation_rules(), F.lit("v.csv"), F.col("req_id"))
    assert sorted(r.path for r in found.collect()) == ["[A-R-002].verdict", "[bad].checked_with", "[bad].layer1", "[bad].req_id", "[bad].source"]
    assert findings.summary(found).first().n_errors == 5
    both = contracts.exactly_one("req_id", "one", [F.lit(True), F.lit(None).cast("boolean")])
    assert contracts.violations(rows, [both], F.lit("v"), F.lit(0)).count() == 0


def test_python_items_and_errors(spark):
    source = "class A:\n  @d\n  def f(self):\n    def g():\n      raise X\n    if a: pass\n    elif b: pass\n"
    got = code.python_items(spark.createDataFrame([("a.py", source), ("b.py", "def (")], "path string, text string")).collect()
    assert sorted((r.what, r.name, r.line) for r in got if r.path == "a.py" and r.what != "branch") == [("function", "A.f", 3), ("function", "A.f.g", 4), ("span", "A.f", 2), ("span", "A.g", 4)]
    assert sorted((r.name, r.line) for r in got if r.what == "branch") == [("if", 6), ("if", 7), ("raise", 5)]
    assert [r.what for r in got if r.path == "b.py"] == ["error"]


def test_branches_by_line_and_kind(spark, monkeypatch):
    monkeypatch.setattr(code, "BATCH_ROWS", 2)
    source = "def f(x):\n  raise A\nif a:\n  if b: raise C\n  match x:\n    case 1: pass\n"
    sources = spark.createDataFrame([(1, source), (2, "def ("), (3, None), (4, "if a: raise B")], "path long, text string").coalesce(1)
    got = [tuple(r) for r in code.python_branches(sources).orderBy("path", "number").collect()]
    assert got == [(1, 0, "raise", 2, 2), (1, 1, "if", 3, 6), (1, 2, "if", 4, 4), (1, 3, "raise", 4, 4), (1, 4, "match", 5, 6), (4, 0, "if", 1, 1), (4, 1, "raise", 1, 1)]


def test_sources(spark, tmp_path):
    for name, text in {"a/x.py": "a\nb\n", "a/node_modules/y.py": "", "README.md": "r", "z.bin": "q", "d.yaml": "a: [1", "e.yaml": "\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.text_files(spark, str(tmp_path))
    assert {r.path for r in files.sources(found).collect()} == {"a/x.py", "README.md", "d.yaml", "e.yaml"}
    assert [r.path for r in files.manifests(found).collect()] == ["README.md"]
    assert {r.path: r.lines for r in files.listing(found).collect()}["a/x.py"] == 2
    assert files.listing(found, 2).count() == 3
    got = {r.path: r.problem for r in files.yaml_documents(found.where("path like '%.yaml'")).collect()}
    assert got["e.yaml"] == "empty document" and got["d.yaml"]
    (tmp_path / "t.csv").write_text('a,b\n1,"x,y"\n\n1,2,3\n')
    assert [(r.problem, r.row) for r in files.csv_problems(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()] == [("width", 3)]
    assert files.csv_problems(spark, str(tmp_path / "t.csv"), ["a"]).where("problem = 'header'").count() == 1


def test_file_blocks_last_one_holds(spark):
    out = spark.createDataFrame([("t", "=== FILE: a/x ===\n1\n=== END FILE ===\n=== FILE: a/x ===\n2\n=== END FILE ===\n=== FILE: q ===\n3\n=== END FILE ==="), ("u", "```\nbody\n```")], "tag string, output string")
    expected = spark.createDataFrame([("t", "a/x"), ("u", "b/y")], "tag string, path string")
    assert sorted(map(tuple, files.accepted_blocks(out, expected).collect())) == [("t", "a/x", "2"), ("u", "b/y", "body")]


def test_stream_gate(spark, tmp_path):
    from provena.streaming import gate

    rows = [("x", 1, False), ("x", 2, True), ("y", 1, False), ("y", 2, False), ("y", 3, False)]
    spark.createDataFrame(rows, "k string, s long, ok boolean").select("k", F.timestamp_seconds("s").alias("ts"), "ok").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp, ok boolean").parquet(str(tmp_path / "in"))
    q = gate.gated(stream, "ts", "k", "ok").writeStream.format("memory").queryName("gated").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.task, r.status, r.tries) for r in spark.table("gated").collect()) == [("x", "ok", 2), ("y", "escalated", 3)]


def test_mask_documents_takes_every_document(spark, tmp_path):
    texts = ["password = hunter2hunter", "TOKEN = abcdefgh12", "go to db://me:s3cret@host/x", "-----BEGIN RSA PRIVATE KEY-----\nabcd\n-----END RSA PRIVATE KEY-----", "API_KEY: abcdefgh12", "nothing", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.text for r in suite.queries()["mask_documents"](spark, str(tmp_path)).collect()}
    assert sorted(got) == list(range(7)) and got[5] == "nothing" and got[6] is None
    assert all("***MASKED***" in got[i] for i in range(5)) and not any(x in got[i] for i in range(5) for x in ("hunter2", "abcdefgh12", "s3cret", "abcd"))


def test_retry_text_by_artifact(spark):
    made = spark.createDataFrame([("b", "q"), ("a", "y"), ("a", "x"), ("c", "z")], "a string, p string")
    found = made.select(*findings.finding("k", F.col("a"), F.col("p"), F.lit("1"), F.lit("2"), severity=F.when(F.col("a") == "c", "warning").otherwise("error")))
    row = lambda a, p: f"- {a} at {p}\n  expected: 1\n  got: 2"
    got = {(r.check, r.artifact): r.text for r in findings.retry_text(found, "check", "artifact").collect()}
    assert got == {("k", "a"): row("a", "x") + "\n" + row("a", "y"), ("k", "b"): row("b", "q")}
    assert findings.retry_text(found).columns == ["check", "text"]
    assert len(suite.oracle_sql()["blank_row_keys"]) and "collect_list" not in suite.queries()["blank_row_keys"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_containing_takes_placeholders_and_short_passages_in_parts(spark, monkeypatch):
    monkeypatch.setattr(containment, "SHORT_BYTES", 8)
    passages = spark.createDataFrame([(1, "Wait <N> s until all the lights go out"), (2, "at <n> o"), (3, "a <num> b <n> c"), (4, "go out"), (5, "of <N> men we saw none come back"), (6, "")], "p long, text string")
    texts = spark.createDataFrame([(1, "so wait 1_000.5 s  until all the lights go out now"), (2, "at 7 o'clock, a 1 b 2.5 c"), (3, "wait x s until all the lights go out; of men we saw none come back"), (4, None)], "d long, text string")
    assert sorted(map(tuple, containment.containing(passages, texts, "p", "d").collect())) == [(1, 1), (2, 2), (3, 2), (4, 1), (4, 3)]


def test_paths_lose_their_root_alone(spark):
    d = spark.createDataFrame([("file:/q/x/q/f.py",), ("hdfs://n/q/a.py",), ("/other/f.py",)], "path string")
    assert [r[0] for r in d.select(files.below(F.col("path"), "file:///q")).collect()] == ["x/q/f.py", "/n/q/a.py", "/other/f.py"]


def test_empty_files_are_listed(spark, tmp_path):
    (tmp_path / "a.py").write_text("")
    (tmp_path / "b.py").write_text("x\ny")
    (tmp_path / ".pytest_cache").mkdir()
    (tmp_path / ".pytest_cache" / "c.md").write_text("z")
    found = files.text_files(spark, str(tmp_path), "*.py")
    assert {r.path: r.text for r in found.collect()} == {"a.py": "", "b.py": "x\ny"}
    assert {r.path: r.lines for r in files.listing(files.text_files(spark, str(tmp_path))).collect()} == {"a.py": 0, "b.py": 2}


def test_csv_texts(spark):
    text = 'a,"b ""c"""\r\n1,"two\nlines, and a comma"\n\n , \n1\n'
    d = spark.createDataFrame([("t", text), ("e", ""), ("n", None)], "path string, text string")
    assert [(r.path, r.n, r.cells) for r in files.csv_cells(d).collect()] == [("t", 0, ["a", 'b "c"']), ("t", 1, ["1", "two\nlines, and a comma"]), ("t", 4, ["1"])]
    assert sorted(map(tuple, files.csv_text_problems(d, files.csv_header('a,"b ""c"""')).collect())) == [("e", "header", 0), ("n", "header", 0), ("t", "width", 4)]


def test_nearest_preceding_over_blank_and_tabbed_lines(spark):
    source = "def a\n\t \n    x\n\n  def b\n    y\n\t\nz\n  w".split("\n")
    d = spark.createDataFrame([("f", i + 1, t, len(t) - len(t.lstrip())) for i, t in enumerate(source)], "k string, n int, line string, indent int")
    got = spans.nearest_preceding(d.select("k", "n"), d, "k", F.nullif(F.regexp_extract("line", r"def (\w)", 1), F.lit("")))
    assert {r.n: r.name for r in got.collect()} == {1: None, 2: "a", 3: "a", 4: None, 5: "a", 6: "b", 7: "a", 8: None, 9: None}


def test_rows_for_what_has_nothing(spark):
    items = spark.createDataFrame([("a", 3, 3), ("a", 9, 9)], "path string, line int, end int")
    ranges = code.rule_ranges(spark.createDataFrame([("a:2", "if x:\n  raise\n"), ("a:x", "q"), (None, None)], "source string, evidence string"))
    assert [tuple(r) for r in ranges.collect()] == [("a", 2, 3)]
    paths = spark.createDataFrame([("a",), ("b",)], "path string")
    assert {tuple(r) for r in code.coverage(items, ranges, 0, paths).collect()} == {("a", 2, 1, 50.0), ("b", 0, 0, 100.0)}
    found = spark.createDataFrame([(1, "x", "t"), (2, "x", None)], "i int, g string, found_in string")
    rules = spark.createDataFrame([("x",), ("y",)], "rule string")
    got = containment.confirmed(found, F.col("g"), F.col("i").cast("string"), rules)
    assert {tuple(r) for r in got.collect()} == {("x", 2, 1, "2", 50.0), ("y", 0, 0, "", 0.0)}


def test_placeholders_in_passages(spark):
    texts = spark.createDataFrame([(1, "if Retries > 3 times, wait 12.5 s and then stop"), (2, "wait a s"), (3, None), (4, "costs 7")], "doc int, text string")
    said = [(1, "retries > <n> times,  wait <N> s"), (2, "wait < число > s"), (3, "wait"), (4, "<n>"), (5, " "), (6, "then stop and"), (7, "s and then st")]
    p = spark.createDataFrame(said, "item int, text string")
    assert {tuple(r) for r in containment.containing(p, texts, "item", "doc").collect()} == {(1, 1), (2, 1), (3, 1), (3, 2), (4, 1), (4, 4), (7, 1)}


def _documents(spark, *texts):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "artifact string, t string")
    return d.select("artifact", F.try_parse_json("t").alias("document"))


def test_contracts_of_all_kinds(spark):
    def problems(kind, *texts):
        return sorted((r.artifact, r.path, r.expected) for r in contracts.check_documents(_documents(spark, *texts), contracts.KINDS[kind], kind).collect())

    good = {
        "inventory": '{"repo":"r","repo_path":"/r","modules":[{"path":"a","approx_size":3},{"path":"b","approx_size":"some"}],"frameworks":null}',
        "module": '{"module":"m","purpose":"p","public_interface":[{"name":"f","kind":"function","source":"a:1"}],"confidence":"low"}',
        "domain": '{"entities":[{"name":"e","source":"a:1-2","attributes":[{"name":"x","type":"t","source":"a:3"}]}],"confidence":"high","relations":[{"from":"a","to":"b","cardinality":"1:N","evidence":"e","source":"a:1"}]}',
        "interface": '{"openapi":"3.1","paths":{}}',
        "rules": '{"repo":"r","module":"m","rules":[]}',
        "validation": '[{"req_id":"X-R-001","verdict":"ПОДТВЕРЖДЕНО","layer1":"l","source":"a:1","statement":"s"}]',
        "predictions": '{"capability":"c","predictions":[{"rule_id":"X-R-001","expect":[{"kind":"check","text":"t"}]}]}',
    }
    for kind, text in good.items():
        assert problems(kind, text) == [], kind
    assert problems("inventory", '{"repo":1,"modules":[{"path":"a","approx_size":1.5},"bare"]}', "[]", "no json") == [
        ("0", "(document)", "required: repo, repo_path, modules"), ("0", "modules[0].approx_size", "type integer or string"), ("0", "modules[1]", "type object"), ("0", "repo", "type string"),
        ("1", "(document)", "type object"), ("2", "(document)", "a document"),
    ]
    assert problems("domain", '{"entities":[{"name":"e","source":"a:1","attributes":[{"name":"","type":"t","source":"here"}]}],"confidence":"sure"}') == [
        ("0", "confidence", "one of: high, medium, low"), ("0", "entities[0].attributes[0].name", "text that isn't empty"), ("0", "entities[0].attributes[0].source", "text like ^.+:[0-9]+(-[0-9]+)?$"),
    ]
    cli = '{"openapi_applicable":false,"openapi_absence_evidence":"none","interface":"cli","commands":[{"name":"run","x-source":"a:1"}],"x-events":{"produces":[{"topic_or_queue":"q"}]}}'
    assert problems("interface", cli, '{"openapi":"3.0","paths":{},"openapi_applicable":false,"openapi_absence_evidence":"e","interface":"cli"}', cli.replace('"a:1"', '"a"')) == [
        ("0", "x-events.produces[0]", "required: topic_or_queue, source"), ("1", "(document)", "exactly one of the variants"), ("2", "(document)", "exactly one of the variants"), ("2", "x-events.produces[0]", "required: topic_or_queue, source"),
    ]
    assert problems("predictions", '{"capability":"c","predictions":[{"rule_id":"X-R-01","expect":[]},{"rule_id":"X-R-001"}]}') == [
        ("0", "predictions[0].expect", "at least 1 items"), ("0", "predictions[0].rule_id", r"text like ^[A-Za-z0-9_.\-]+-R-[0-9]{3,}$"), ("0", "predictions[1]", "required: rule_id, expect"),
    ]
    ordered = contracts.in_order(contracts.check_documents(_documents(spark, '{"repo":"r","module":"m","rules":[' + ",".join(["1"] * 11) + "]}"), contracts.KINDS["rules"], "c")).collect()
    assert [r.path for r in ordered][:4] == ["rules[0]", "rules[1]", "rules[10]", "rules[2]"]


def test_occurrences_have_no_left_boundary(spark):
    rules = spark.createDataFrame([("A-R-001",), ("B.A-R-001",), ("R-R-0012",)], "rule_id string")
    table = spark.createDataFrame([("  | A-R-001 | x",), ("| B.A-R-001, zA-R-001.",), ("| A-R-001-x A-R-0011",), ("A-R-001",), ("| R-R-0012_",)], "line string")
    assert {r.rule_id: r.times for r in completeness.occurrences(rules, table).collect()} == {"A-R-001": 3, "B.A-R-001": 1, "R-R-0012": 0}
