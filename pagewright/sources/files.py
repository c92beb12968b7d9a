"""File sources: folders of documents, with or without their bytes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagewright.config import SUPPORTED_EXTENSIONS
from pagewright.operators.intake import is_supported_format


def _any_case_glob() -> str:
    either = lambda c: f"[{c}{c.upper()}]" if c.isalpha() else c
    names = ("".join(map(either, ext[1:])) for ext in SUPPORTED_EXTENSIONS)
    return "*.{" + ",".join(names) + "}"


def directly_in(folder: str) -> Column:
    """Whether ``path`` is the folder's own file, or the file itself; schemes and slashes may be written differently."""
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*:/+"
    root = re.sub(scheme, "/", folder).rstrip("/")
    full = F.regexp_replace("path", scheme, "/")
    parent = F.regexp_replace(full, "/[^/]*$", "")
    same = (lambda c: c == root) if root.startswith("/") or not root else (lambda c: c.endswith("/" + root))
    return same(parent) | same(full)


def is_plain(path: str) -> bool:
    """Whether ``path`` names one folder or file, not a pattern."""
    return not re.search(r"[*?\[{]", path)


def scan_documents(spark: SparkSession, path: str, content: bool = False,
                   supported_only: bool = True) -> DataFrame:
    """Files directly in a folder (or one file) as (path, length, modified[, content]).

    Bytes are read only when ``content`` is asked for and used. ``supported_only=False``
    also lists files of other types, so that intake can reject them with a reason.
    """
    # Folders below, such as earlier outputs, are neither read as documents nor taken for partitions.
    plain = is_plain(path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(plain).lower())
    if supported_only:
        reader = reader.option("pathGlobFilter", _any_case_glob())
    columns = ["path", "length", F.col("modificationTime").alias("modified")]
    loaded = reader.load(path)
    files = (loaded.filter(directly_in(path)) if plain else loaded).select(*columns, *(["content"] if content else []))
    return files.filter(is_supported_format("path")) if supported_only else files


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A manifest, region or score table in any format Spark reads."""
    return spark.read.format(fmt).options(**options).load(path)
