"""Files of shared stores from Python workers: listing, streams, and moves by whatever store a path names."""

from __future__ import annotations

from pyarrow import fs


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """(store, path in it, what in front of such a path makes it one for Spark)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, "file://"
    store, inner = fs.FileSystem.from_uri(path)
    if isinstance(store, fs.LocalFileSystem):
        return store, inner, "file://"
    return store, inner, path[: path.index("://") + 3]


def reachable(path: str) -> bool:
    """Whether the store is one that Python workers open themselves."""
    try:
        store_of(path)
    except (ValueError, OSError, NotImplementedError):  # pyarrow knows no such store
        return False
    return True


def files(path: str, ending: str) -> list[fs.FileInfo]:
    """The file, or the files below the folder whose names end so, by path."""
    store, inner, _ = store_of(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(ending)), key=lambda f: f.path)
