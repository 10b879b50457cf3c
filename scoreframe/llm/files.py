"""Binary files that tasks write to and read from the folder all of them share."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as pafs


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


@contextmanager
def writing(uri: str):
    """A stream into a new file; folders are made as needed.

    Names carry the task attempt, and only the files that a committed task reports are ever read, so
    what a lost executor left behind doesn't count.
    """
    fs, path = _place(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        yield out


@contextmanager
def reading(uri: str):
    fs, path = _place(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        yield stream
