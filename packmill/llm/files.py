"""Files in the shared folder, read and written by tasks through the file system that its URI names."""

from __future__ import annotations

import uuid


def filesystem(uri: str):
    """(pyarrow file system, path in it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Attempt:
    """A file that one attempt of a task writes under a name of its own.

    The task's rows carry the name, and only rows of the attempt that Spark accepts reach anyone: a lost
    or repeated task leaves at most a file that no row names.
    """

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        fs, path = filesystem(self.uri)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self._out = fs.open_output_stream(path, compression=None)  # the default compresses by the name's ending
        self.size = 0

    def write(self, data: bytes) -> None:
        self._out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self._out.close()


def open_input(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_file(path)
