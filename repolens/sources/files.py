"""File systems of Spark-style paths, for code that runs inside tasks."""

from __future__ import annotations

import re


def filesystem(uri: str):
    """A ``pyarrow.fs`` file system and the path inside it, for a Spark-style path or URI."""
    import pyarrow.fs as pafs

    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + re.sub(r"^file:/+", "", uri)
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri
