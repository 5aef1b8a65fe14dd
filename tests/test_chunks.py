import csv
import io
import random

import pytest

from provena.sources import chunks, files

ALPHABET = ['"', '"', ",", "\n", "\r", "\r\n", "a", "ü", " ", '""', 'x"y', '"q,\n"']


def _rows(text):
    csv.field_size_limit(1 << 62)
    return [(n, row) for n, row in enumerate(csv.reader(io.StringIO(text, newline=""))) if any(c.strip() for c in row)]


def test_states_compose_at_every_border():
    r = random.Random(3)
    for _ in range(400):
        data = "".join(r.choice(ALPHABET) for _ in range(r.randint(1, 14))).encode()
        whole = chunks.effect(data)
        for at in range(len(data) + 1):
            (a, n), (b, m) = chunks.effect(data[:at]), chunks.effect(data[at:])
            assert ([b[x] for x in a], [k + m[x] for k, x in zip(n, a, strict=True)]) == whole, (data, at)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_files_in_chunks_are_files_as_one(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(chunks, "GROUP", 5)
    r = random.Random(size)
    texts = {f"d/t{k}.csv": "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 9 * min(size, 64)))) for k in range(8)}
    texts |= {"e.csv": "", "long.csv": 'a,"' + "x\n,y" * (100 if size < 64 else 60_000) + '"\n1,2\r\n\r\n,\nlast', "no.txt": "1,2\n"}
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    got = {}
    for x in chunks.csv_file_cells(spark, str(tmp_path), "*.csv", size).collect():
        got.setdefault(x.path, []).append((x.n, x.cells))
    assert {p: sorted(rows) for p, rows in got.items()} == {p: rows for p, rows in ((p, _rows(t)) for p, t in texts.items() if p != "no.txt") if rows}


def test_widths_of_long_cells(spark, tmp_path):
    long = "y" * 300_000
    texts = {"a.csv": f'h,"i"\n1,{long}\n\n1,"{long}\n",3\n', "b.csv": "i,h\n1\n", "c.csv": ""}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    want = [("a.csv", "width", 3), ("b.csv", "header", 0), ("b.csv", "width", 1), ("c.csv", "header", 0)]
    assert sorted(map(tuple, chunks.csv_file_problems(spark, str(tmp_path), ["h", "i"], "*.csv", 1 << 16).collect())) == want
    frame = spark.createDataFrame(list(texts.items()), "path string, text string")
    assert sorted(map(tuple, files.csv_text_problems(frame, ["h", "i"]).collect())) == want
