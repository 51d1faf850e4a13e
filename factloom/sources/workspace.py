"""Workspace scan as a Python data source: regular files only, no links followed, nothing skipped by name, empty files kept."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of one input partition.
BATCH = 64
#: Managed extensions.
MANAGED = (".py", ".rs", ".c", ".h", ".cc", ".cpp", ".cxx", ".hpp", ".hh", ".hxx")


def managed_paths(root: str):
    """Relative paths of managed regular files in code-point order, directories walked without following links."""
    stack = [""]
    while stack:
        folder = stack.pop()
        with os.scandir(os.path.join(root, folder)) as entries:
            for entry in entries:
                path = f"{folder}/{entry.name}" if folder else entry.name
                if entry.is_dir(follow_symlinks=False):
                    stack.append(path)
                elif entry.is_file(follow_symlinks=False) and entry.name.endswith(MANAGED):
                    yield path


def check_paths(root: str) -> None:
    """Reject a workspace whose managed paths are no Unicode or collide once they are written with ``/`` (A10)."""
    from factloom.sources.authority import Rejection

    seen: set[bytes] = set()
    for path in managed_paths(root):
        try:
            own = path.replace("\\", "/").encode("utf-8")
        except UnicodeEncodeError as e:
            raise Rejection("scope.path", f"path is not Unicode: {os.fsencode(path)!r}") from e
        digest = hashlib.sha256(own).digest()[:16]
        if digest in seen:
            raise Rejection("scope.path", f"paths collide after normalisation: {path}")
        seen.add(digest)


class _Batch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root

    def partitions(self):
        paths = sorted(managed_paths(self.root))
        return [_Batch(paths[k : k + BATCH]) for k in range(0, len(paths), BATCH)] or [_Batch([])]

    def read(self, partition):
        for path in partition.paths:
            with open(os.path.join(self.root, path), "rb") as f:
                yield path, f.read()


class WorkspaceSource(DataSource):
    """``spark.read.format("workspace").load(directory)`` gives ``(relative_path, content)``."""

    @classmethod
    def name(cls):
        return "workspace"

    def schema(self):
        return "relative_path string, content binary"

    def reader(self, schema):
        return _Reader(self.options["path"])
