"""Files in the shared folder, opened from Python workers through pyarrow's file systems."""

from __future__ import annotations

import os
import pickle

import pyarrow as pa
from pyarrow import fs

#: Arrays in a file of save() begin at multiples of so many bytes.
ALIGNED = 64


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else "file://" + os.path.abspath(uri))


def replace(uri: str, write) -> None:
    """write(stream) makes a file beside its place, which it then takes: whole, and at no time missing on a local
    file system or an object store. A task that runs twice makes the same file twice."""
    system, path = resolve(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    aside = f"{path}.{os.getpid()}.{os.urandom(4).hex()}.tmp"
    with system.open_output_stream(aside) as out:
        write(out)
    if isinstance(system, fs.LocalFileSystem):
        os.replace(aside, path)
        return
    try:
        system.move(aside, path)
    except OSError:  # a file system whose rename doesn't replace
        system.delete_file(path)
        system.move(aside, path)


def save(uri: str, value) -> None:
    """A file that open_saved() reads: the pickled value, whose arrays lie behind it."""
    parts: list[pickle.PickleBuffer] = []
    head = pickle.dumps(value, protocol=5, buffer_callback=parts.append)
    arrays = [part.raw() for part in parts]
    lead = pickle.dumps((head, [a.nbytes for a in arrays]))

    def body(out) -> None:
        out.write(len(lead).to_bytes(8, "little"))
        for part in (lead, *arrays):
            out.write(part)
            out.write(b"\0" * (-out.tell() % ALIGNED))

    replace(uri, body)


def open_saved(uri: str):
    """The value of a file of save(). On a mounted file system its arrays are the file's own pages, which all
    processes of a machine share; they can't be written to."""
    system, path = resolve(uri)
    with pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path) as file:
        whole = file.read_buffer()
    at = 8 + int.from_bytes(whole[:8], "little")
    head, sizes = pickle.loads(whole[8:at])
    arrays = []
    for size in sizes:
        at += -at % ALIGNED
        arrays.append(whole.slice(at, size))
        at += size
    return pickle.loads(head, buffers=arrays)
