"""Files in the shared folder, from within tasks: any file system pyarrow reaches by its URI."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_file(folder: str, suffix: str, chunks) -> tuple[str, int]:
    """Write chunks to a new file of the folder; a name of its own for each attempt, so that a
    task that runs twice never touches a file another attempt wrote. Returns (URI, bytes)."""
    uri = f"{folder.rstrip('/')}/{uuid.uuid4().hex}{suffix}"
    system, path = _split(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    n = 0
    with system.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
            n += len(chunk)
    return uri, n


def open_file(uri: str):
    system, path = _split(uri)
    return system.open_input_stream(path)
