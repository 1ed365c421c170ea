"""Files that Python workers write to and read from the shared folder.

The folder may be a URI of any store that ``pyarrow.fs`` knows.  A file is
written under a name of its own attempt and then moved to its final name, so
a repeated or speculative task replaces a file by an equal one.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs as pafs


def _open(uri: str):
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def writing(folder: str, name: str):
    """An output stream that becomes ``folder/name`` once all is written."""
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    draft = f"{path}/_{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(draft) as out:
            yield out
    except BaseException:
        fs.delete_file(draft)
        raise
    fs.move(draft, f"{path}/{name}")


@contextmanager
def reading(folder: str, name: str):
    """A random-access file."""
    fs, path = _open(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        yield f
