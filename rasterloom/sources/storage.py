"""Positioned reads from local files and from any store that Arrow's file systems open."""

from __future__ import annotations

import os
from dataclasses import dataclass


class FormatError(ValueError):
    """A container that breaks its format's rules: a code for programs, and the stage that found it."""

    def __init__(self, code: str, stage: str, message: str = ""):
        super().__init__(f"{stage}: {code}" + (f" ({message})" if message else ""))
        self.code, self.stage = code, stage


@dataclass
class Bytes:
    """Bounds-checked random access to a file; only what is asked for is read."""

    handle: object
    size: int
    name: str

    def at(self, offset: int, size: int, *, code: str = "read_out_of_bounds", stage: str = "read") -> bytes:
        if offset < 0 or size < 0 or offset + size > self.size:
            raise FormatError(code, stage, f"{size} bytes at {offset} of {self.size}")
        self.handle.seek(offset)
        data = self.handle.read(size)
        if len(data) != size:
            raise FormatError(code, stage, "short read")
        return data

    def __enter__(self) -> "Bytes":
        return self

    def __exit__(self, *_) -> None:
        self.handle.close()


def split_uri(path: str) -> tuple[object | None, str]:
    """An Arrow file system and the path in it; no file system for local paths."""
    if "://" in path and not path.startswith("file://"):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)
    return None, path.removeprefix("file://").removeprefix("file:")


def open_bytes(path: str) -> Bytes:
    system, local = split_uri(path)
    if system is None:
        return Bytes(open(local, "rb"), os.path.getsize(local), local)  # noqa: SIM115
    return Bytes(system.open_input_file(local), system.get_file_info(local).size, local)


def files_below(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or all files below a folder with one of the suffixes, sorted by path components."""
    system, local = split_uri(path)
    if system is None:
        if os.path.isfile(local):
            return [local]
        found = [os.path.join(d, n) for d, _, names in os.walk(local) for n in names]
    else:
        from pyarrow import fs

        info = system.get_file_info(local)
        if info.type == fs.FileType.File:
            return [path]
        scheme = path.split("://")[0]
        found = [f"{scheme}://{x.path}" for x in system.get_file_info(fs.FileSelector(local, recursive=True)) if x.type == fs.FileType.File]
    return sorted((f for f in found if f.lower().endswith(suffixes)), key=lambda f: f.split("/"))
