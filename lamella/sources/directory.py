"""A Python data source that scans local directory trees: ``spark.read.format("tree")``.

Each top-level entry is one input partition, so a large tree is walked by many tasks. The
root must be reachable at the same path on every executor.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, type string, mode int, uid bigint, gid bigint, size bigint, target string, skip_reason string, device bigint, mtime bigint"
LETTERS = {stat.S_IFREG: "f", stat.S_IFDIR: "d", stat.S_IFLNK: "l", stat.S_IFCHR: "c", stat.S_IFBLK: "b", stat.S_IFSOCK: "s", stat.S_IFIFO: "p"}


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options["path"], self.options.get("sockets", "false") == "true")


class TreeReader(DataSourceReader):
    def __init__(self, root: str, sockets: bool) -> None:
        self.root, self.sockets = root, sockets

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(name) for name in sorted(os.listdir(self.root))] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        pending = [partition.value]
        while pending:
            path = pending.pop()
            full = os.path.join(self.root, path)
            row, below = self._row(path, full)
            yield row
            pending += [f"{path}/{name}" for name in sorted(below, reverse=True)]

    def _row(self, path: str, full: str) -> tuple[tuple, list[str]]:
        try:
            s = os.lstat(full)
        except OSError:
            return (path, None, None, None, None, None, None, "unknown", None, None), []
        kind = LETTERS.get(stat.S_IFMT(s.st_mode), "?")
        readable = kind not in "fd" or os.access(full, os.R_OK)
        device = s.st_rdev if kind in "cb" else None
        why = None
        if not readable:
            why = "unreadable"
        elif kind in "fl" and not s.st_size:
            why = "empty"
        elif kind == "s" and not self.sockets:
            why = "socket"
        target = os.readlink(full) if kind == "l" else None
        return (path, kind, s.st_mode, s.st_uid, s.st_gid, s.st_size, target, why, device, int(s.st_mtime)), os.listdir(full) if kind == "d" and readable else []
