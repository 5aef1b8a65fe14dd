"""Writes texts as files at their own paths: a data source whose tasks stage files and whose commit moves them into place."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from provena.sources.files import accepted_blocks, file_blocks, place

#: Folders in which files wait for their commit begin with this; no path may.
STAGING = "_staging-"
#: Files that a commit moves at once.
MOVERS = 16


def _checked(path: str | None) -> str:
    """A path below the folder, or an error: outputs come from elsewhere, so none may leave it."""
    parts = (path or "").split("/")
    if not all(parts) or any(p in (".", "..") for p in parts) or parts[0].startswith(STAGING) or "\0" in path:
        raise ValueError(f"no path below a folder: {path!r}")
    return "/".join(parts)


@dataclass
class Staged(WriterCommitMessage):
    """What a task tells the driver: where its files wait; their names are in a manifest there."""

    folder: str


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, f"{STAGING}{uuid.uuid4().hex}"

    def write(self, iterator):
        from pyspark import TaskContext

        fs, root = place(self.folder)
        task = TaskContext.get()
        stage = f"{root}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        fs.create_dir(stage)
        n, said = 0, {}
        with fs.open_output_stream(f"{stage}/manifest") as manifest:
            for batch in iterator:
                for path, text in zip(batch.column("path"), batch.column("text"), strict=True):
                    name, body = _checked(path.as_py()), (text.as_py() or "").encode()
                    digest = hashlib.sha256(body).digest()
                    if said.setdefault(name, digest) != digest:
                        raise ValueError(f"two texts for {name}")
                    with fs.open_output_stream(f"{stage}/{n}") as out:
                        out.write(body)
                    manifest.write(json.dumps([n, name]).encode() + b"\n")
                    n += 1
        return Staged(stage)

    def commit(self, messages):
        from concurrent.futures import ThreadPoolExecutor

        fs, root = place(self.folder)

        def move(stage, n, name):
            fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0])
            fs.move(f"{stage}/{n}", f"{root}/{name}")

        with ThreadPoolExecutor(MOVERS) as pool:
            for message in filter(None, messages):
                with fs.open_input_stream(f"{message.folder}/manifest") as manifest:
                    # Of a path that comes twice, with one text, the later file stays in the staging folder.
                    named = {name: n for n, name in map(json.loads, manifest.read().splitlines())}
                list(pool.map(lambda x, stage=message.folder: move(stage, x[1], x[0]), named.items()))
        self._clear(fs, root)

    def abort(self, messages):
        self._clear(*place(self.folder))

    def _clear(self, fs, root):
        from pyarrow.fs import FileType

        if fs.get_file_info(f"{root}/{self.job}").type == FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class TextOutputs(DataSource):
    """Rows (path, text) as a file each, below the folder that the data is saved to. Files there of other paths stay."""

    @classmethod
    def name(cls) -> str:
        return "provena_outputs"

    def writer(self, schema, overwrite: bool):
        if overwrite:
            raise ValueError("files replace those of their paths; mode('append') says so")
        if set(schema.names) != {"path", "text"}:
            raise ValueError("columns must be path and text")
        return _Writer(self.options["path"])


def write_files(texts: DataFrame, folder: str) -> None:
    """Texts (path, text) as a file each below folder, which driver and executors must share.

    A task writes to a staging folder; files are moved into place, each at once and whole, when all tasks are
    done, so a task or a job that fails leaves none. A job that dies within its commit has moved some: run it
    again. A null text is an empty file; a null or empty path, one with . or .., and an absolute one are errors,
    as are two texts for one path (the same text twice is one file). Rows of one path meet in one task for that.
    """
    texts.sparkSession.dataSource.register(TextOutputs)
    texts.select("path", "text").repartition("path").write.format(TextOutputs.name()).mode("append").save(folder)


def write_blocks(outputs: DataFrame, expected: DataFrame, folder: str) -> None:
    """The accepted FILE blocks of outputs (tag, output) for expected paths (tag, path), each ended by a line feed, at folder/path."""
    body = F.when(F.endswith("body", F.lit("\n")), F.col("body")).otherwise(F.concat("body", F.lit("\n")))
    write_files(accepted_blocks(outputs, expected).select("path", body.alias("text")), folder)


def foreign_blocks(outputs: DataFrame, expected: DataFrame) -> DataFrame:
    """(tag, path) of the blocks that name no expected file of their tag, neither by path nor by file name; they are not written."""
    name = lambda c: F.element_at(F.split(c, "/", -1), -1)
    said = outputs.select("tag", F.explode(F.map_keys(file_blocks(F.col("output")))).alias("path"))
    files = expected.select("tag", name(F.col("path")).alias("name")).distinct()
    return said.withColumn("name", name(F.col("path"))).join(files, ["tag", "name"], "left_anti").select("tag", "path")


def log_messages(foreign: DataFrame) -> DataFrame:
    """(message) for files.append_log, one for each foreign block."""
    return foreign.select(_message(F.col("tag"), F.col("path")).alias("message"))


def _message(tag: Column, path: Column) -> Column:
    return F.concat(F.lit("["), tag.cast("string"), F.lit("] a block for another path, left out: "), path)
