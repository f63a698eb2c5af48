"""Files of our own formats in any store that pyarrow can open: attempt-named, then listed in a manifest.

Executors write each file under a name of its own attempt; only the driver's commit, which sees the
attempts that succeeded, names them in the manifest. A reader that follows the manifest thus never
sees the leavings of a lost executor.
"""

from __future__ import annotations

import json
import uuid

from pyarrow import fs

MANIFEST = "_manifest.json"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or absolute local path."""
    return fs.FileSystem.from_uri(uri)


def attempt_name(partition: int, suffix: str) -> str:
    """A file name that sorts by partition and is unique to the attempt."""
    return f"part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


def write_manifest(uri: str, entries: dict) -> None:
    """Name the files that belong to the folder."""
    store, path = open_store(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/{MANIFEST}") as out:
        out.write(json.dumps(entries).encode())


def read_manifest(uri: str) -> dict | None:
    """The manifest of a folder, None where there is none."""
    store, path = open_store(uri)
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{path}/{MANIFEST}") as source:
        return json.loads(source.read())


def delete_files(uri: str, names: list[str]) -> None:
    """Delete files of an aborted write."""
    store, path = open_store(uri)
    for name in names:
        store.delete_file(f"{path}/{name}")
