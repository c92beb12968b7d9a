"""Files that tasks write and read in the shared folder."""

from __future__ import annotations

import pyarrow.fs as pafs
from pyspark import TaskContext


def store(folder: str):
    """(file system, path) of a folder given as a path or URI, as executors see it."""
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder)


def put(fs, path: str, pieces) -> None:
    """Write under a name of this attempt, then move into place: a rerun task just replaces the file."""
    context = TaskContext.get()
    draft = f"{path}.{context.taskAttemptId() if context else 0}.draft"
    with fs.open_output_stream(draft) as out:
        for piece in pieces:
            out.write(piece)
    fs.move(draft, path)
