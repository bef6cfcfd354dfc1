"""Files opened from tasks and from the driver through ``pyarrow.fs``."""

from __future__ import annotations

from pyarrow import fs


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path)
