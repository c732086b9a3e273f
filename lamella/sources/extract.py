"""Writing a stored tree back to a folder that all executors reach at the same path.

Every block is written at its own offset of its file by whichever task holds it, so a file of
any size never meets in one row or task. Every step may be repeated: directories that exist
stay, bytes are written again at the same places, links are replaced. So a lost executor
costs only the work of its tasks.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DONE = pa.schema([("path", pa.string()), ("type", pa.string()), ("done", pa.string())])


def _each(rows: DataFrame, columns: list, act: Callable[..., tuple[str, str, str] | None]) -> DataFrame:
    """Runs ``act`` on the columns of each row and returns what it tells: path, type, done."""
    names = [f"c{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [x for x in (act(*row) for row in zip(*(batch.column(n).to_pylist() for n in names), strict=True)) if x]
            yield pa.RecordBatch.from_pylist([dict(zip(DONE.names, x, strict=True)) for x in told], schema=DONE)

    return rows.select(*(F.col(c).alias(n) for c, n in zip(columns, names, strict=True))).mapInArrow(run, "path string, type string, done string")


def local_path(path: str) -> str:
    """A folder's path for the file functions of the workers; other file systems are an error."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return path
    if scheme != "file":
        raise ValueError(f"files can only be written to a mounted file system, not to {scheme}")
    return "/" + rest.lstrip("/")


def _inside(root: str, path: str) -> str:
    """The place of a relative path below ``root``; paths that lead out of it are an error."""
    parts = [p for p in path.split("/") if p]
    if not parts or any(p in (".", "..") for p in parts) or "\0" in path:
        raise ValueError(f"not a path below the folder: {path!r}")
    return os.path.join(root, *parts)


def directories(nodes: DataFrame, root: str) -> DataFrame:
    """Makes the directories of all nodes (``path``, ``type``) and of their parents."""

    def make(path: str, kind: str):
        place = _inside(root, path)
        os.makedirs(place if kind == "d" else os.path.dirname(place), exist_ok=True)
        return (path, kind, "directory") if kind == "d" else None

    return _each(nodes.select("path", "type"), ["path", "type"], make)


def files(blocks: DataFrame, root: str) -> DataFrame:
    """Writes decoded blocks (``path``, ``blk_offset``, ``plain``, ``size`` of the file): one row per file that got bytes."""

    def put(path: str, offset: int, plain: bytes, size: int):
        handle = os.open(_inside(root, path), os.O_WRONLY | os.O_CREAT, 0o600)
        try:
            if offset + len(plain) >= size:
                os.truncate(handle, size)
            os.pwrite(handle, plain, offset)
        finally:
            os.close(handle)
        return (path, "f", "written") if offset == 0 else None

    return _each(blocks, ["path", "blk_offset", "plain", "size"], put)


def links(nodes: DataFrame, root: str) -> DataFrame:
    """Makes the symbolic links (``path``, ``target``); one that stands there already is replaced."""

    def link(path: str, target: str):
        place = _inside(root, path)
        with contextlib.suppress(FileNotFoundError):
            os.unlink(place)
        with contextlib.suppress(FileExistsError):  # another attempt at this row was faster
            os.symlink(target, place)
        return path, "l", "linked"

    return _each(nodes.where("type = 'l'"), ["path", "target"], link)


def special(nodes: DataFrame, root: str, make: bool = False) -> DataFrame:
    """Pipes are made where ``make`` asks for it; sockets and devices, which need rights, are only told."""

    def node(path: str, kind: str, mode: int):
        if not make or kind != "p":
            return path, kind, "told"
        with contextlib.suppress(FileExistsError):
            os.mkfifo(_inside(root, path), mode & 0o7777)
        return path, kind, "made"

    return _each(nodes.where("type in ('p', 's', 'c', 'b')"), ["path", "type", "mode"], node)


def metadata(nodes: DataFrame, root: str, mode: bool = True, owner: bool = False, time: bool = True) -> DataFrame:
    """Gives files and directories their mode and time, and all nodes their owner, as asked for."""

    def give(path: str, kind: str, bits: int, uid: int, gid: int, mtime: int):
        place = _inside(root, path)
        if not os.path.lexists(place):
            return path, kind, "absent"
        if owner:
            os.lchown(place, uid, gid)
        if mode and kind != "l":
            os.chmod(place, bits & 0o7777)
        if time:
            os.utime(place, (mtime, mtime), follow_symlinks=False)
        return path, kind, "set"

    return _each(nodes, ["path", "type", "mode", "uid", "gid", "mtime"], give)


def extract(nodes: DataFrame, blocks: DataFrame, root: str, mode: bool = True, owner: bool = False, time: bool = True, pipes: bool = False) -> DataFrame:
    """Writes a tree: path, type, done (written, linked, made, told or directory) of each node.

    ``nodes``: path, type, mode, uid, gid, mtime, size, target and key (of a file's content);
    ``blocks``: key, blk_offset, plain. Metadata comes last, since writing would change times
    and a read-only directory takes no files; directories after what they hold.
    """
    from lamella.plans.spool import spool

    told = [spool(directories(nodes, root), "extracted")]
    regular = nodes.where("type = 'f'").select("path", "key", "size")
    held = blocks.select(F.col("key").alias("__key"), "blk_offset", "plain")
    told.append(spool(files(regular.join(held, F.col("key") == F.col("__key")), root), "extracted"))
    told.append(spool(links(nodes, root), "extracted"))
    told.append(spool(special(nodes, root, pipes), "extracted"))
    spool(metadata(nodes.where("type <> 'd'"), root, mode, owner, time), "extracted")
    depth = F.size(F.split("path", "/"))
    deepest = nodes.where("type = 'd'").agg(F.max(depth)).first()[0] or 0
    for level in range(deepest, 0, -1):
        spool(metadata(nodes.where("type = 'd'").where(depth == level), root, mode, owner, time), "extracted")
    out = told[0]
    for part in told[1:]:
        out = out.unionByName(part)
    return out
