"""Opening files by path or URI from any executor."""

from __future__ import annotations

import pyarrow.fs as pafs


def resolve(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def open_in(path: str):
    fs, p = resolve(path)
    return fs.open_input_file(p)


def read_bytes(path: str) -> bytes:
    with open_in(path) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    fs, p = resolve(path)
    if "/" in p:
        fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(p) as f:
        f.write(data)


def move(path: str, to: str) -> None:
    fs, p = resolve(path)
    fs.move(p, resolve(to)[1])


def remove(path: str) -> None:
    """A folder and what is in it, if it is there."""
    fs, p = resolve(path)
    if fs.get_file_info(p).type == pafs.FileType.Directory:
        fs.delete_dir(p)


def size_of(path: str) -> int:
    fs, p = resolve(path)
    return fs.get_file_info(p).size or 0


def exists(path: str) -> bool:
    fs, p = resolve(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound


def listed(path: str) -> list[str]:
    """A single file, or the files of a folder in order."""
    fs, p = resolve(path)
    info = fs.get_file_info(p)
    if info.type != pafs.FileType.Directory:
        return [path]
    prefix = path.split("://")[0] + "://" if "://" in path else ""
    return sorted(prefix + i.path for i in fs.get_file_info(pafs.FileSelector(p)) if i.type == pafs.FileType.File)
