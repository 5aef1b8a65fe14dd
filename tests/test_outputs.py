import os

import pytest

from provena.sources import files, outputs


def _tree(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), encoding="utf-8").read() for d, _, names in os.walk(folder) for f in names}


def _texts(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_files_are_written_whole_and_replaced(spark, tmp_path):
    folder = str(tmp_path / "out")
    outputs.write_files(_texts(spark, ("a/b.md", "one"), ("a/b.md", "one"), ("c.md", None), ("d.md", "ü\n" * 50_000)), folder)
    assert _tree(folder) == {"a/b.md": "one", "c.md": "", "d.md": "ü\n" * 50_000}
    outputs.write_files(_texts(spark, ("a/b.md", "two")).selectExpr("path", "text", "1 AS job"), "file:" + folder)
    assert _tree(folder)["a/b.md"] == "two" and sorted(os.listdir(folder)) == ["a", "c.md", "d.md"]
    outputs.write_files(_texts(spark), folder)
    assert len(_tree(folder)) == 3


@pytest.mark.parametrize("bad", [("../x", "t"), ("/x", "t"), ("a//b", "t"), ("", "t"), (None, "t"), ("_staging-1/x", "t"), ("good0.md", "another")])
def test_a_failed_task_leaves_no_file(spark, tmp_path, bad):
    folder = str(tmp_path / "out")
    with pytest.raises(Exception, match="no path below a folder|two texts"):
        outputs.write_files(_texts(spark, *[(f"good{i}.md", "t") for i in range(20)], bad), folder)
    assert _tree(folder) == {} and not os.path.exists(str(tmp_path / "x"))


def test_blocks_for_expected_paths_alone(spark, tmp_path):
    said = "=== FILE: a.md ===\nA\n=== END FILE ===\n=== FILE: else/b.md ===\nB\n=== END FILE ===\n=== FILE: evil.md ===\nE\n=== END FILE ==="
    made = spark.createDataFrame([(1, said), (2, "```\nbare\n```"), (3, ""), (4, None)], "tag int, output string")
    expected = spark.createDataFrame([(1, "a.md"), (1, "x/b.md"), (2, "c.md"), (3, "d.md"), (4, "e.md")], "tag int, path string")
    outputs.write_blocks(made, expected, str(tmp_path / "out"))
    assert _tree(str(tmp_path / "out")) == {"a.md": "A\n", "x/b.md": "B\n", "c.md": "bare\n"}
    assert [tuple(r) for r in outputs.foreign_blocks(made, expected).collect()] == [(1, "evil.md")]


def test_listing_by_tasks_equals_a_walk(spark, tmp_path):
    for name, text in {"a/b/c/d.txt": "x", "a/e.txt": "", "f.txt": "yy", "g/_h.txt": ""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "empty/er").mkdir(parents=True)
    root = str(tmp_path)
    bare = lambda rows: sorted((str(p).split(":", 1)[-1], n) for p, n in rows)
    assert bare(files.listed(spark, "file:" + root).collect()) == bare(files._walked(spark, root)) and len(files._walked(spark, root)) == 4
    assert [tuple(r) for r in files.listed(spark, root + "/f.txt").collect()] == [(root + "/f.txt", 2)]
    assert files.listed(spark, root + "/none").count() == 0
    assert sorted(r.path for r in files.empty_files(spark, root, "e*").collect()) == ["a/e.txt"]
