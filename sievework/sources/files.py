"""Files by path or URI, through pyarrow: on a mounted folder or on a store."""

from __future__ import annotations

import fnmatch
import re


def open_store(uri: str):
    """(file system, path) of a path or URI."""
    from pyarrow import fs
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", uri):
        return fs.FileSystem.from_uri(uri if "://" in uri else re.sub("^file:/*", "file:///", uri))
    return fs.LocalFileSystem(), uri


def joined(root: str, name: str) -> str:
    return f"{root.rstrip('/')}/{name}" if root else name


def matching(pattern: str) -> list[tuple[str, int]]:
    """(path or URI, size) of the files that a pattern names, sorted; `*` and `?` stop at no slash."""
    from pyarrow import fs
    store, path = open_store(pattern)
    prefix = pattern[:len(pattern) - len(path)] if pattern.endswith(path) else ""
    if not re.search(r"[*?\[]", path):
        info = store.get_file_info(path)
        return [(prefix + path, info.size)] if info.is_file else []
    folder = re.split(r"[*?\[]", path)[0].rpartition("/")[0] or "."
    found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and fnmatch.fnmatchcase(f.path, path))


def described(uri: str):
    """Size and time of a file; None where there is no such file."""
    store, path = open_store(uri)
    info = store.get_file_info(path)
    return info if info.is_file else None
