"""Files of the shared folder, read and written inside tasks by their URI (Arrow's file systems: local and mounted folders, HDFS, object stores)."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow.fs as fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark gives it; a plain path is local."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(uri[5:]).lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put(uri: str, content: bytes, attempt: int) -> None:
    """Write a small file so that it is there whole or not at all; a repeated attempt replaces it by the same name."""
    files, path = located(uri)
    with files.open_output_stream(f"{path}.attempt-{attempt}", compression=None) as out:
        out.write(content)
    files.move(f"{path}.attempt-{attempt}", path)
