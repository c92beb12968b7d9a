"""Readers and detectors from functions of one file: an error of a file stays with that file.

A batch is one Spark job, in which an exception of a model would end the work on all files. The functions here catch it
where it happens and hand the message on as a row, so that the other files go on and the failed one keeps its place in the batch.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of the package

READ_ERROR, DETECT_ERROR = "read_error", "detect_error"
_FACTS = {"page_count": T.IntegerType(), "width": T.IntegerType(), "height": T.IntegerType()}
BOXES = "page_number int, region_ord long, x int, y int, w int, h int, confidence double"


def _said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"


def file_reader(read: Callable[[str, bytes], tuple[int, int, int]]) -> Callable[[DataFrame], DataFrame]:
    """A reader from ``read(path, content) -> (page_count, width, height)``; a file it fails on has ``read_error``."""
    def reader(files: DataFrame) -> DataFrame:
        kept = [f for f in files.schema.fields if f.name not in (*_FACTS, READ_ERROR, "content")]
        schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in _FACTS.items()], T.StructField(READ_ERROR, T.StringType())])

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for path, content in zip(frame["path"], frame["content"]):
                    try:
                        rows.append((*map(int, read(path, bytes(content))), None))
                    except Exception as e:  # whatever a user's function raises
                        rows.append((None, None, None, _said(e)))
                out = frame[[f.name for f in kept]].copy()
                for name, values in zip([*_FACTS, READ_ERROR], zip(*rows) if rows else [()] * 4):
                    out[name] = pd.Series(list(values), index=out.index, dtype="object" if name == READ_ERROR else "Int32")
                yield out

        return files.mapInPandas(run, schema)
    return reader


def file_detector(detect: Callable[[bytes, int | None], Iterable[dict]], more: str = "") -> Callable[[DataFrame], DataFrame]:
    """A detector from ``detect(content, page_count) -> boxes``, each a dict of the columns ``BOXES`` and ``more`` (as DDL).

    A file it fails on, also halfway, gives one row with ``detect_error`` and no boxes.
    """
    columns = T.StructType.fromDDL(BOXES + (f", {more}" if more else ""))

    def detector(files: DataFrame) -> DataFrame:
        schema = T.StructType([files.schema["doc_id"], *columns.fields, T.StructField(DETECT_ERROR, T.StringType())])
        names = [f.name for f in schema.fields]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                counts = frame["page_count"] if "page_count" in frame else [None] * len(frame)
                for doc, content, count in zip(frame["doc_id"], frame["content"], counts):
                    try:
                        boxes = [dict(b) for b in detect(bytes(content), None if pd.isna(count) else int(count))]
                        rows = [(doc, *(b.get(f.name) for f in columns.fields), None) for b in boxes]
                    except Exception as e:
                        rows = [(doc, *[None] * len(columns.fields), _said(e))]
                    if rows:  # a file's boxes at a time
                        yield pd.DataFrame(rows, columns=names).astype({n: "object" for n in names})

        return files.mapInPandas(run, schema)
    return detector
