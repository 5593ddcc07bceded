"""Files that Python tasks write and read on storage shared by all executors."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import WriterCommitMessage

from webstrata.session import checkpoint_root

MANIFEST = "_MANIFEST.json"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's address below the cluster's shared folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/webstrata-{name}-{uuid.uuid4().hex}"


def store(address: str) -> tuple[fs.FileSystem, str]:
    """File system and path of an address (file, hdfs, s3, gs, ... or a plain path)."""
    return fs.FileSystem.from_uri(address)


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (temporary path, final name, facts for the manifest)."""

    files: list[tuple[str, str, dict]]


def commit(address: str, job: str, messages: list[Written | None], sidecar: str = "") -> None:
    """Names the tasks' files for good, then writes the manifest.

    A reader trusts the manifest alone, so a job that stops half-way leaves no
    readable archive; what other attempts wrote goes with the temporary folder.
    """
    storage, folder = store(address)
    listed = []
    for message in messages:
        for temporary, name, facts in message.files if message else []:
            storage.move(temporary, f"{folder}/{name}")
            if sidecar:
                storage.move(temporary + sidecar, f"{folder}/{name}{sidecar}")
            listed.append({"file": name, **facts})
    listed.sort(key=lambda f: f["file"])
    with storage.open_output_stream(f"{folder}/{job}.tmp") as out:
        out.write(json.dumps({"files": listed}, sort_keys=True).encode())
    storage.move(f"{folder}/{job}.tmp", f"{folder}/{MANIFEST}")
    discard(address, job)


def discard(address: str, job: str) -> None:
    storage, folder = store(address)
    if storage.get_file_info(f"{folder}/{job}").type == fs.FileType.Directory:
        storage.delete_dir(f"{folder}/{job}")


def manifest(address: str) -> list[dict]:
    storage, folder = store(address)
    with storage.open_input_stream(f"{folder}/{MANIFEST}") as file:
        return json.loads(file.readall())["files"]
