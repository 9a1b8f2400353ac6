"""Array files in the shared folder, written by tasks and memory-mapped by workers.

A file appears under its name only when complete (written under another name
and moved), so a task may be repeated or run twice.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid

import numpy as np


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def save(folder: str, name: str, array: np.ndarray) -> None:
    from pyarrow.fs import FileType

    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    aside = f"{root}/.{name}-{uuid.uuid4().hex}"
    data = io.BytesIO()
    np.save(data, array)
    with store.open_output_stream(aside) as out:
        out.write(data.getbuffer())
    target = f"{root}/{name}.npy"
    try:
        store.move(aside, target)
    except OSError:  # a store that does not replace files, and another attempt was first
        if store.get_file_info(target).type != FileType.File:
            raise
        store.delete_file(aside)


def load(folder: str, name: str) -> np.ndarray:
    """The array, memory-mapped.  A folder that is no mounted file system is
    copied to this worker's temporary folder first, and unlinked once mapped."""
    from pyarrow import fs

    store, root = _store(folder)
    path = f"{root}/{name}.npy"
    if isinstance(store, fs.LocalFileSystem):
        return np.load(path, mmap_mode="r")
    handle, copy = tempfile.mkstemp(suffix=".npy")
    with os.fdopen(handle, "wb") as out, store.open_input_stream(path) as source:
        while piece := source.read(1 << 22):
            out.write(piece)
    mapped = np.load(copy, mmap_mode="r")
    os.unlink(copy)
    return mapped
