"""Files in the shared folder as Python workers reach them: opened through Arrow's file systems, published by a rename.

A task writes under a name of its own and renames the file once it is whole, so a lost executor leaves nothing half
written where readers look, and a second attempt puts the same file in the same place.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that holds path, and the path within it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


@contextmanager
def published(path: str, staging: str) -> Iterator:
    """An output stream whose bytes appear at path if the block ends well; staging is a folder of the same store."""
    system, final = store(path)
    mine = f"{store(staging)[1]}/{uuid.uuid4().hex}"
    system.create_dir(store(staging)[1], recursive=True)
    system.create_dir(final.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(mine, compression=None) as out:
        yield out
    system.move(mine, final)


def remove(path: str) -> None:
    """Delete a file that may be gone already."""
    system, place = store(path)
    if system.get_file_info(place).type != fs.FileType.NotFound:
        system.delete_file(place)
