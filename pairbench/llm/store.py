"""Files that tasks write and read themselves, in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyarrow import fs


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> str:
    system, path = located(uri)
    system.create_dir(path, recursive=True)
    return uri


def new_file(folder: str, suffix: str) -> str:
    """A name that no other attempt of any task uses; only what a manifest names counts."""
    return os.path.join(folder, f"{uuid.uuid4().hex}{suffix}")


def write(uri: str, data: bytes) -> None:
    system, path = located(uri)
    with system.open_output_stream(path, compression=None) as out:
        out.write(data)


def read(uri: str) -> bytes:
    system, path = located(uri)
    with system.open_input_file(path) as source:
        return source.read()
