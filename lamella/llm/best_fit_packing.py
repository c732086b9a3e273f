"""Best-fit packing by patterns of lengths, fitted by non-negative least squares.

Documents are tokenised and cut into pieces of at most ``size`` tokens. Only the
histogram of piece lengths (at most ``size`` numbers) reaches the driver. There,
patterns of up to three lengths that fill a sequence exactly are given repeat counts
that fit the histogram (non-negative least squares, solved by accelerated projected
gradients), the counts are rounded down, and what remains is packed best fit first on
the histogram. The plan says which ranks of which length go where; it has a bounded
size, and each piece finds its place from its length and its rank among the pieces of
that length, so neither pieces nor groups of equal lengths meet in one task.

Special rows: a null or empty text is a document of one id (the end id); repeated rows
and rows with a null doc_id are packed like any other; extra columns are ignored. An
empty table gives no sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.llm.common import out_batches, rows_of, whole_text
from lamella.llm.tokenise import encoder
from lamella.plans.numbering import number_rows
from lamella.plans.spool import spool

SIZE = 1024
END = 2
#: About how many pieces of a common length are ordered together for their ranks.
PER_BUCKET = 4096

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PIECES_ARROW = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pieces(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END) -> DataFrame:
    """The pieces of each document: all of ``size`` tokens but the first, which may be shorter."""
    end_id = np.array([end], dtype="<u4").tobytes()

    def cut(batches):
        coder = encoder(vocabulary, True)

        def rows() -> Iterator[tuple]:
            for doc_id, ids in coder.encode_all(rows_of(batches, "doc_id", "text")):
                ids += end_id
                n = len(ids) // 4
                ends = range(n % size or size, n + 1, size)
                for k, stop in enumerate(ends):
                    start = 0 if k == 0 else stop - size
                    yield doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])

        yield from out_batches(rows(), PIECES_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(cut, PIECES)


def patterns(size: int) -> np.ndarray:
    """All ascending triples of lengths that add up to ``size``; a zero stands for no piece."""
    a, b = np.meshgrid(np.arange(size // 3 + 1), np.arange(size // 2 + 1), indexing="ij")
    a, b = a.ravel(), b.ravel()
    c = size - a - b
    keep = (a <= b) & (b <= c) & (b > 0) & (c < size)
    return np.stack([a[keep], b[keep], c[keep]], axis=1).astype(np.int64)


def fit(histogram: np.ndarray, shapes: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - histogram|^2, where column p of A counts pattern p's lengths."""
    size = len(histogram)
    shapes = shapes[np.all((shapes == 0) | (histogram[shapes] > 0), axis=1)]
    if not len(shapes):
        return np.zeros((0, 4))
    target = histogram.astype(float)
    scale = np.where(target > 0, 1.0 / np.maximum(target, 1.0), 0.0) ** 0.5  # rare lengths count as much as common ones

    def forward(x: np.ndarray) -> np.ndarray:
        out = sum(np.bincount(shapes[:, k], weights=x, minlength=size) for k in range(3))
        out[0] = 0
        return out * scale

    def backward(r: np.ndarray) -> np.ndarray:
        r = r * scale
        r[0] = 0
        return r[shapes[:, 0]] + r[shapes[:, 1]] + r[shapes[:, 2]]

    v = np.ones(len(shapes))
    for _ in range(20):  # the largest eigenvalue of A'A bounds the step
        v = backward(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(len(shapes))
    momentum = 1.0
    goal = target * scale
    goal[0] = 0
    for _ in range(rounds):
        after = np.maximum(0.0, y - backward(forward(y) - goal) / (norm * 1.01))
        grown = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        y = after + (momentum - 1) / grown * (after - x)
        x, momentum = after, grown
    return np.column_stack([x, shapes])


def plan(histogram: np.ndarray, size: int) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths of one sequence), so that every piece of the histogram has a place."""
    left = histogram.astype(np.int64).copy()
    out: list[tuple[int, tuple[int, ...]]] = []

    def take(times: int, lengths: tuple[int, ...]) -> None:
        for x in lengths:
            left[x] -= times
        out.append((times, lengths))

    if left[size]:
        take(int(left[size]), (size,))
    fitted = fit(left, patterns(size))
    for row in fitted[np.argsort(-fitted[:, 0], kind="stable")]:
        lengths = tuple(int(x) for x in row[1:] if x)
        most = min(int(left[x]) // lengths.count(x) for x in lengths)
        times = min(int(row[0] + 0.5), most)
        if times > 0:
            take(times, lengths)
    # Best fit on what remains: the longest piece, then the longest that still fits, until nothing does.
    while len(some := np.flatnonzero(left)):
        lengths, space = [int(some[-1])], size - int(some[-1])
        used = {lengths[0]: 1}
        at = len(some) - 1
        while space and at >= 0:
            at = min(at, int(np.searchsorted(some, space, side="right")) - 1)
            if at < 0:
                break
            x = int(some[at])
            if used.get(x, 0) < left[x]:
                used[x] = used.get(x, 0) + 1
                lengths.append(x)
                space -= x
            else:
                at -= 1
        take(min(int(left[x]) // n for x, n in used.items()), tuple(lengths))
    return out


def places(steps: list[tuple[int, tuple[int, ...]]], size: int) -> dict[str, np.ndarray]:
    """The plan by length: from which rank on which step holds the pieces, and where."""
    rows, sequence = [], 0
    ranks = np.zeros(size + 1, dtype=np.int64)
    for times, lengths in steps:
        offset = 0
        for x in sorted(set(lengths)):
            each = lengths.count(x)
            rows.append((x, int(ranks[x]), each, sequence, offset))
            ranks[x] += times * each
            offset += each * x
        sequence += times
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "each", "sequence", "offset"))}


def pack(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    counted = cut.groupBy("length").count().collect()  # at most ``size`` rows
    histogram = np.zeros(size + 1, dtype=np.int64)
    for length, n in counted:
        histogram[length] = n
    table = places(plan(histogram, size), size)
    ranked = number_rows(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank", int(histogram.sum()), max(1, len(counted)), PER_BUCKET)
    bound = int(histogram.max(initial=0)) + 1
    start_keys = table["length"] * bound + table["rank"]

    def put(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("__rank").to_numpy()
            at = np.searchsorted(start_keys, length * bound + rank, side="right") - 1
            nth = rank - table["rank"][at]
            each = table["each"][at]
            kept = [batch.column(n) for n in PIECES_ARROW.names]
            more = [pa.array(table["sequence"][at] + nth // each, pa.int64()), pa.array(table["offset"][at] + nth % each * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=[*PIECES_ARROW.names, "sequence_id", "offset"])

    return ranked.mapInArrow(put, PIECES + ", sequence_id bigint, offset bigint")


def packed(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(spool(pieces(docs, vocabulary, size), "pieces"), size)
