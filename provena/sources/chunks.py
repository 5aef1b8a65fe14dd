"""CSV files of any size in chunks: which state a chunk begins in is told by composing what all chunks before it do to each state."""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.functions.text import any_glob
from provena.operators.storage import kept
from provena.sources.files import below, cell_problems, listed, place

#: Bytes of a chunk.
CHUNK_BYTES = 4 << 20
#: Chunks whose effects one task composes; of those a file has fewer than its chunks by this.
GROUP = 4096
#: Bytes of cells in an Arrow batch, about.
BATCH_BYTES = 1 << 20

# States between two bytes: a record begins; a cell begins; in a bare cell; in a quoted one; after a quote in a
# quoted one; after a carriage return that ended a record. Each is where these bytes lead from a record's beginning.
_RECORD, _RETURN = 0, 5
_LEADS = (b"", b",", b"x", b'"', b'"x"', b"")
# Possessive throughout: a cell that begins with a quote ends its quoted piece at the first quote that isn't doubled.
_CELL = rb'(?:"[^"]*+(?:""[^"]*+)*+"?+)?+[^,\r\n]*+'
_ONE = re.compile(rb"(?:" + _CELL + rb",)*+" + _CELL + rb"(?:\r\n|\r|\n)")
_FIRST = re.compile(rb"(?:" + _CELL + rb",)*+")
_QUOTED = re.compile(rb'"[^"]*+(?:""[^"]*+)*+')


def _enter(data: bytes, state: int) -> tuple[bytes, int]:
    """The bytes from a record's beginning that make the same of data, and how many of them aren't data's."""
    if state == _RETURN:
        return (data[1:], -1) if data[:1] == b"\n" else (data, 0)
    return _LEADS[state] + data, len(_LEADS[state])


def _left(data: bytes, at: int) -> int:
    """The state after data's last bytes, from `at`, where a record begins that doesn't end."""
    if at == len(data):
        return _RETURN if data[-1:] == b"\r" else _RECORD
    cell = _FIRST.match(data, at).end()
    if cell == len(data):
        return 1
    quoted = _QUOTED.match(data, cell)
    if not quoted:
        return 2
    return 3 if quoted.end() == len(data) else 4 if quoted.end() == len(data) - 1 else 2


def _ends(data: bytes, known: array | None = None) -> tuple[array, int | None]:
    """Where records end in data, up to a place of `known`, which is given then."""
    out, at = array("q"), 0
    while m := _ONE.match(data, at):
        at = m.end()
        out.append(at)
        if known is not None:
            k = bisect_left(known, at)
            if k < len(known) and known[k] == at:
                return out, k
    return out, None


def effect(data: bytes) -> tuple[list[int], list[int]]:
    """For each state that data may begin in: the state after it, and how many records end in it."""
    if not data:
        return list(range(len(_LEADS))), [0] * len(_LEADS)
    base, _ = _ends(data)
    after, n = [_left(data, base[-1] if base else 0)], [len(base)]
    for state in range(1, len(_LEADS)):
        own, lead = _enter(data, state)
        known = array("q", (x + lead for x in base)) if lead else base
        ends, met = _ends(own, known)
        if met is None:
            # A line feed alone, after a carriage return, leaves a record's beginning.
            after.append(_left(own, ends[-1] if ends else 0) if own else _RECORD)
            n.append(len(ends))
        else:
            after.append(after[_RECORD])
            n.append(len(ends) + len(base) - met - 1)
    return after, n


def _read(fs, path: str, start: int, size: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)


def _rest(fs, path: str, start: int, size: int, state: int) -> list[bytes]:
    """What comes from `start` until the record ends that goes on there in this state."""
    out = []
    while piece := _read(fs, path, start, size):
        own, lead = _enter(piece, state)
        m = _ONE.match(own)
        if m:
            return [*out, piece[: m.end() - lead]]
        out.append(piece)
        state, start = _left(own, 0), start + len(piece)
    return out


def _prefixes(keys: list[str]):
    """applyInPandas over groups of chunks in order: the state and the record's number before each, from that of the group."""

    def run(pdf):
        pdf = pdf.sort_values("k")
        state, n, states, ns = int(pdf["state"].iloc[0]), int(pdf["n"].iloc[0]), [], []
        for after, records in zip(pdf["after"], pdf["records"], strict=True):
            states.append(state)
            ns.append(n)
            state, n = int(after[state]), n + int(records[state])
        pdf["state"], pdf["n"] = states, ns
        return pdf[[*keys, "k", "state", "n"]]

    return run


def _composed(pdf):
    """One row for a group of chunks: what they do together."""
    pdf = pdf.sort_values("k")
    states, ns = list(range(len(_LEADS))), [0] * len(_LEADS)
    for after, records in zip(pdf["after"], pdf["records"], strict=True):
        ns = [n + int(records[s]) for n, s in zip(ns, states, strict=True)]
        states = [int(after[s]) for s in states]
    out = pdf[["path", "g"]].head(1).copy()
    out["after"], out["records"] = [states], [ns]
    return out


def csv_file_cells(spark: SparkSession, root: str, glob: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, n, cells) of the records of the CSV files below root, as files.csv_cells has them of texts; a file is read by as many tasks as it has chunks.

    A record is read by the task of the chunk that it begins in, whatever its length. Bytes that aren't UTF-8
    are replaced. Files are read twice: for what each chunk does to each state, and for its records. An empty
    file has no row. Arrow must know the file system.
    """
    import pyarrow as pa

    files = listed(spark, root).where("bytes > 0")
    files = files.where(any_glob(F.element_at(F.split("path", "/", -1), -1), [glob])) if glob else files
    places = files.select("path", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / chunk_bytes).cast("long"))).alias("k"))
    places = kept(places.repartition(F.col("path"), F.col("k")))

    def tell(batches):
        fs, _ = place(root)
        for batch in batches:
            for path, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                after, n = effect(_read(fs, path, k * chunk_bytes, chunk_bytes))
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([after], pa.list_(pa.int32())), pa.array([n], pa.list_(pa.int64()))], ["path", "k", "after", "records"])

    told = kept(places.mapInArrow(tell, "path string, k long, after array<int>, records array<long>").withColumn("g", F.floor(F.col("k") / GROUP).cast("long")))
    groups = told.groupBy("path", "g").applyInPandas(_composed, "path string, g long, after array<int>, records array<long>")
    first = groups.select("path", F.col("g").alias("k"), "after", "records", F.lit(_RECORD).alias("state"), F.lit(0).cast("long").alias("n"))
    first = first.groupBy("path").applyInPandas(_prefixes(["path"]), "path string, k long, state int, n long").withColumnRenamed("k", "g")
    known = told.join(first, ["path", "g"]).groupBy("path", "g").applyInPandas(_prefixes(["path"]), "path string, k long, state int, n long")

    def parse(batches):
        import csv
        import io

        csv.field_size_limit(1 << 62)
        fs, _ = place(root)
        for batch in batches:
            for path, k, state, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = _read(fs, path, k * chunk_bytes, chunk_bytes)
                own, lead = _enter(data, state)
                begin = 0 if state == _RECORD else max(0, -lead)
                if state not in (_RECORD, _RETURN):
                    m = _ONE.match(own)
                    if not m:
                        continue
                    # The record that goes on here has the number before.
                    begin, n = m.end() - lead, n + 1
                if begin >= len(data):
                    continue
                last = effect_of(data[begin:])
                body = [data[begin:], *(_rest(fs, path, (k + 1) * chunk_bytes, chunk_bytes, last) if last not in (_RECORD, _RETURN) else [])]
                ns, cells, size = [], [], 0
                for row in csv.reader(io.StringIO(b"".join(body).decode("utf-8", "replace"), newline="")):
                    if any(c.strip() for c in row):
                        ns.append(n)
                        cells.append(row)
                        size += sum(map(len, row)) + 8 * len(row)
                    n += 1
                    if size > BATCH_BYTES:
                        yield made(path, ns, cells)
                        ns, cells, size = [], [], 0
                yield made(path, ns, cells)

    def effect_of(data: bytes) -> int:
        at = 0
        while m := _ONE.match(data, at):
            at = m.end()
        return _left(data, at)

    def made(path, ns, cells):
        return pa.RecordBatch.from_arrays([pa.array([path] * len(ns), pa.string()), pa.array(ns, pa.int64()), pa.array(cells, pa.list_(pa.string()))], ["path", "n", "cells"])

    known = kept(known.select("path", "k", "state", "n").repartition(F.col("path"), F.col("k")))
    return known.mapInArrow(parse, "path string, n long, cells array<string>").select(below(F.col("path"), root).alias("path"), "n", "cells")


def csv_file_problems(spark: SparkSession, root: str, header: list[str], glob: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(path, problem, row) of the CSV files below root, as files.csv_text_problems has them of texts."""
    cells = csv_file_cells(spark, root, glob, chunk_bytes)
    found = listed(spark, root).select(below(F.col("path"), root).alias("path"))
    found = found.where(any_glob(F.element_at(F.split("path", "/", -1), -1), [glob])) if glob else found
    return cell_problems(cells, found, header, "path").withColumn("row", F.col("row").cast("long"))
