"""Files of their own format in the shared folder, written and read by tasks."""

from __future__ import annotations

import os
import re
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

from logweave.session import shared_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's name in the shared folder, as a URI that tasks can open."""
    base = shared_dir(spark)
    if "://" not in base:
        base = "file://" + os.path.abspath(re.sub(r"^file:", "", base))
    return f"{base}/{name}-{uuid.uuid4().hex}"


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def write_once(folder: str, name: str, content: bytes) -> str:
    """Write a file under a name that no other attempt of the task takes; gives its URI.

    A reader must use the URIs that come back from finished tasks only, so
    files of attempts that were lost are never read.
    """
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    full = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/{full}") as out:
        out.write(content)
    return f"{folder}/{full}"


def read_whole(uri: str) -> bytes:
    store, path = open_store(uri)
    with store.open_input_stream(path) as source:
        return source.read()
