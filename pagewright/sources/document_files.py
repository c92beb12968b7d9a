"""A Spark data source that writes exactly one file per document, with commit and abort, and reads them whole.

Tasks stream their documents into files of a staging folder, one after another, with a list of their names. When all tasks are done the
driver moves the files into place; if one fails for good nothing appears and the staging folder goes. A task that runs twice stages
twice, but only the attempt that was reported is moved. A document's lines must come from one task, in order: see ``document_rows``.

The driver never holds the names of all files: it takes the lists ``STEP`` names at a time, and keeps them in the folder ``LISTS`` of the
output, hidden from Spark's readers. Reading goes by these lists, some for each task, so no folder of millions of files is listed.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from pagewright.functions.errors import ExportError

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

NAME = "document_files"
SCHEMA = "output string, value string"
#: The folder of the lists of names, and the name of a task's list before it goes there: neither can be a document's name.
LISTS, LIST = ".names", ".names"
#: Names the driver holds at a time, and bytes of files a task reads before it gives them on.
STEP, BATCH_BYTES = 100_000, 8 << 20


def _store(path: str):
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _checked(name: str | None) -> str:
    if not name or "/" in name or "\\" in name or name.startswith((".", "_")):
        raise ValueError(f"not a file name: {name!r}")
    return name


@dataclass
class Staged(WriterCommitMessage):
    """What one task attempt wrote: its folder, which holds the list of its names, and how many there are."""

    folder: str
    files: int = 0


def _names(fs, path: str) -> Iterator[str]:
    """The names of a list, read bit by bit; they hold no slash, which ends each."""
    rest = b""
    with fs.open_input_stream(path) as f:
        while some := f.read(1 << 16):
            *whole, rest = (rest + some).split(b"/")
            yield from (n.decode() for n in whole)


def _parts(names: Iterator[str]) -> Iterator[list[str]]:
    part = []
    for name in names:
        part.append(name)
        if len(part) == STEP:
            yield part
            part = []
    if part:
        yield part


def _lists(fs, root: str) -> list[str]:
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{LISTS}", allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, line_end: str):
        self.path, self.overwrite, self.line_end = path, overwrite, line_end
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        fs, root = _store(self.path)
        context = TaskContext.get()
        folder = f"{root}/{self.staging}/{context.partitionId() if context else 0}-{context.taskAttemptId() if context else 0}"
        done, name, out, names = Staged(folder), None, None, None
        try:
            for batch in iterator:
                for run, lines in self._runs(batch):
                    if out is None or run != name:
                        if out is None:
                            fs.create_dir(folder, recursive=True)
                            names = fs.open_output_stream(f"{folder}/{LIST}")
                        else:
                            out.close()
                        name = _checked(run)
                        out = fs.open_output_stream(f"{folder}/{name}")
                        names.write(f"{name}/".encode())
                        done.files += 1
                    out.write(lines)
        finally:
            for f in (out, names):
                if f is not None:
                    f.close()
        return done

    def _runs(self, batch: pa.RecordBatch) -> Iterator[tuple[str | None, memoryview]]:
        """(name, its lines' bytes) of every run of rows of one name, without a step for each line."""
        if not batch.num_rows:
            return
        output, value = (batch.column(i).cast(pa.large_string()) for i in (0, 1))
        text = lambda x: pa.scalar(x, pa.large_string())
        lines = pc.fill_null(pc.binary_join_element_wise(value, text(self.line_end), text("")), text(""))
        new = pc.fill_null(pc.not_equal(output[1:], output[:-1]), True)  # a null name is refused as soon as it is met
        starts = np.concatenate(([0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1, [batch.num_rows]))
        offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset:lines.offset + batch.num_rows + 1][starts]
        data = memoryview(lines.buffers()[2] or b"")
        for name, lo, hi in zip(output.take(starts[:-1]).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
            yield name, data[lo:hi]

    def commit(self, messages: list[Staged | None]) -> None:
        fs, root = _store(self.path)
        tasks = [m for m in messages if m and m.files]
        if twice := self._written_twice(fs, tasks):
            self.abort(messages)
            raise ExportError(f"{twice} was written in more than one piece; nothing was committed")
        fs.create_dir(f"{root}/{LISTS}", recursive=True)
        if self.overwrite:
            self._empty(fs, root)
        elif tasks:
            self._drop_replaced(fs, root, tasks)
        with ThreadPoolExecutor(16) as pool:  # a rename per document
            for i, m in enumerate(tasks):
                for part in _parts(_names(fs, f"{m.folder}/{LIST}")):
                    for _ in pool.map(lambda n: fs.move(f"{m.folder}/{n}", f"{root}/{n}"), part):
                        pass
                fs.move(f"{m.folder}/{LIST}", f"{root}/{LISTS}/{self.staging[9:]}-{i:06d}")
        self._clear(fs, root)
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def _some(self, fs, paths: list[str], of: int, k: int) -> Iterator[str]:
        """The names of these lists that fall in share ``k`` of ``of`` by a hash."""
        return (n for p in paths for n in _names(fs, p) if of == 1 or zlib.crc32(n.encode()) % of == k)

    def _written_twice(self, fs, tasks: list[Staged]) -> str | None:
        """A name that stands in the lists more than once, found share by share."""
        paths, shares = [f"{m.folder}/{LIST}" for m in tasks], -(-sum(m.files for m in tasks) // STEP)
        for k in range(shares):
            seen = set()
            for name in self._some(fs, paths, shares, k):
                if name in seen:
                    return name
                seen.add(name)
        return None

    def _empty(self, fs, root: str) -> None:
        """Delete the folder's files: those of its lists some at a time, then what else lies there."""
        with ThreadPoolExecutor(16) as pool:
            for path in _lists(fs, root):
                for part in _parts(_names(fs, path)):
                    there = [f.path for f in fs.get_file_info([f"{root}/{n}" for n in part]) if f.type == pafs.FileType.File]
                    for _ in pool.map(fs.delete_file, there):
                        pass
                fs.delete_file(path)
        for f in fs.get_file_info(pafs.FileSelector(root)):
            if f.type == pafs.FileType.File:
                fs.delete_file(f.path)

    def _drop_replaced(self, fs, root: str, tasks: list[Staged]) -> None:
        """Take the names that are written anew out of the earlier lists, so that each stands in one."""
        paths, shares = [f"{m.folder}/{LIST}" for m in tasks], -(-sum(m.files for m in tasks) // STEP)
        for k in range(shares):
            new = set(self._some(fs, paths, shares, k))
            for path in _lists(fs, root):
                if all(n not in new for n in _names(fs, path)):
                    continue
                with fs.open_output_stream(f"{path}-kept") as out:
                    for n in _names(fs, path):
                        if n not in new:
                            out.write(f"{n}/".encode())
                fs.move(f"{path}-kept", path)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*_store(self.path))

    def _clear(self, fs, root: str) -> None:
        if fs.get_file_info(f"{root}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.staging}")


@dataclass
class Listed(InputPartition):
    """A list of names."""

    path: str


class DocumentReader(DataSourceReader):
    """Every file of the lists, whole, a partition for each list. A file that is missing is an error."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Listed]:
        fs, root = _store(self.path)
        if fs.get_file_info(f"{root}/_SUCCESS").type != pafs.FileType.File:
            raise ExportError(f"no document files were committed in {self.path}")
        return [Listed(p) for p in _lists(fs, root)] or [Listed("")]

    def read(self, partition: Listed) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, root = _store(self.path)
        names, texts, size = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()).cast(pa.string())],
                                                  ["output", "value"])
        for name in _names(fs, partition.path):
            with fs.open_input_stream(f"{root}/{name}") as f:
                names.append(name)
                texts.append(f.read())
            size += len(texts[-1])
            if size > BATCH_BYTES:
                yield pack()
                names, texts, size = [], [], 0
        if names:
            yield pack()


class DocumentFiles(DataSource):
    """``df.write.format("document_files").mode(...).save(path)`` for rows (output, value), sorted by output in every task.

    Every value is a line of the file called output, ended by the option ``lineEnd`` (a newline); null values only make the file.
    ``spark.read.format("document_files").load(path)`` gives every file's name and whole text.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        found = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if found != [("output", "string"), ("value", "string")]:
            raise ExportError(f"document files need (output string, value string), not {found}")
        return DocumentWriter(self.options["path"], overwrite, self.options.get("lineEnd", "\n"))

    def reader(self, schema) -> DocumentReader:
        return DocumentReader(self.options["path"])


def document_rows(rows: DataFrame, order: list[str], key: tuple[str, ...] = ("output",)) -> DataFrame:
    """(output, value) with every document in one task, its lines in ``order``: the file is written as one stream.

    A window groups and sorts the lines, which moves no line of a document that is in one task already.
    """
    inside = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_line", F.row_number().over(inside)).filter("_line > 0").select(
        "output", F.col("value").cast("string").alias("value"))


def write_document_files(rows: DataFrame, path: str, order: list[str], overwrite: bool = True,
                         key: tuple[str, ...] = ("output",)) -> str:
    """One file per ``output`` in the folder ``path``, all of them or none; lines in ``order``.

    ``key``: the columns a file's lines are grouped by, output among them. With more than output each output must have one value of the others.
    """
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(DocumentFiles)
    document_rows(rows, order, key).write.format(NAME).mode("overwrite" if overwrite else "append").save(path)
    return path


def read_document_files(spark: SparkSession, path: str) -> DataFrame:
    """(output, value): the name and whole text of every file that ``write_document_files`` has put in the folder ``path``."""
    spark.dataSource.register(DocumentFiles)
    return spark.read.format(NAME).load(path)
