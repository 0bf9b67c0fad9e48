"""Files that tasks write to and read from the shared folder, by its URI, and what a worker keeps between tasks."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

from pyarrow import fs


def per_process(name: str, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by this Python worker for its later tasks."""
    state = sys.modules.setdefault("fieldscope_worker_state", types.ModuleType("fieldscope_worker_state"))
    if not hasattr(state, name):
        setattr(state, name, make())
    return getattr(state, name)


def _located(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("s3a://"):
        uri = "s3" + uri[3:]
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def fresh_name(folder: str, suffix: str) -> str:
    """A name that no other task and no other attempt of this task uses; what a lost attempt leaves is never listed."""
    return f"{folder}/{uuid.uuid4().hex}{suffix}"


def create(uri: str):
    where, path = _located(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def open_file(uri: str):
    """For reads at any place."""
    where, path = _located(uri)
    return where.open_input_file(path)
