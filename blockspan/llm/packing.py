"""Best-fit packing of documents into sequences (operator 7).

Which lengths share a sequence depends on nothing but how many pieces there are of each
length, and lengths end at the capacity. So Spark counts the lengths, the driver turns the
histogram (``capacity`` numbers, whatever the corpus) into *patterns* with multiplicities,
and every piece finds its place by its rank among the pieces of its length. Ranks come
from counts per block of pieces, so no length, however common, meets in one task.

A pattern is made as best-two-fit makes a bin: the longest piece left, then always the
longest that still fits; then the bin's smallest piece gives way to the two unpacked
pieces that fill its gap and the remaining one more tightly, if there are such. As long as
no length runs out the next bin would be the same, so the pattern is repeated until one
does.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import keep, text_or_empty
from .words import Encoder


def _largest(left: np.ndarray) -> np.ndarray:
    """For each x the largest length <= x that is left, or 0."""
    lengths = np.where(left > 0, np.arange(len(left)), 0)
    return np.maximum.accumulate(lengths)


def one_bin(left: np.ndarray, capacity: int) -> list[int]:
    """The lengths of the next bin, longest first; ``left[n]`` pieces of length n are left."""
    left = left.copy()
    fits = _largest(left)
    items: list[int] = []
    gap = capacity
    while gap > 0 and (n := int(fits[gap])):
        take = min(int(left[n]), gap // n)
        items += [n] * take
        left[n] -= take
        gap -= n * take
        if not left[n]:
            fits = _largest(left)
    if gap and len(items) > 1:
        smallest = items[-1]
        room = gap + smallest
        first = np.flatnonzero(left[: room + 1] > 0)
        # The second of each pair: the largest that fits beside it; two of one length need two.
        second = fits[room - first]
        lone = (second == first) & (left[first] < 2)
        if lone.any():
            below = np.where(first[lone] > 0, fits[np.maximum(first[lone] - 1, 0)], 0)
            second[lone] = np.minimum(below, room - first[lone])
        sums = np.where(second > 0, first + second, 0)
        if len(sums) and sums.max() > smallest:
            k = int(sums.argmax())
            items[-1:] = [int(first[k]), int(second[k])]
    return sorted(items, reverse=True)


def patterns(counts: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """Bins and how often each is made; ``counts[n]`` is the number of pieces of length n."""
    left = counts.astype(np.int64).copy()
    left[0] = 0
    out = []
    while left.any():
        items = one_bin(left, capacity)
        lengths, uses = np.unique(items, return_counts=True)
        times = int((left[lengths] // uses).min())
        left[lengths] -= times * uses
        out.append((items, times))
    return out


def slots(made: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """For each length the ranks that a place in a pattern takes, ordered by length, then rank."""
    rows, taken, sequence = [], {}, 0
    for items, times in made:
        offset = 0
        for n in items:
            rows.append((n, taken.get(n, 0), sequence, offset))
            taken[n] = taken.get(n, 0) + times
            offset += n
        sequence += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": table[:, 0], "rank": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def place(length: np.ndarray, rank: np.ndarray, where: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by their length and their rank in it."""
    key = lambda n, r: n * (1 << 48) + r
    k = np.searchsorted(key(where["length"], where["rank"]), key(length, rank), side="right") - 1
    return where["sequence"][k] + rank - where["rank"][k], where["offset"][k]


def cut(n_tokens: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of a document; the first takes what is over."""
    first = n_tokens % capacity or min(n_tokens, capacity)
    starts = [0, *range(first, n_tokens, capacity)]
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n_tokens], strict=True)]


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None, capacity: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(vocabulary)
    end = b"" if end_id is None else np.array([end_id], encoder.dtype).tobytes()
    block, ranks = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    for batch in batches:
        out: list[list] = [[] for _ in kinds]
        for row, ids in enumerate(encoder.encode(batch["text"])):
            ids = np.frombuffer(ids + end, encoder.dtype).astype("<u4")
            for piece, (start, n) in enumerate(cut(len(ids), capacity)):
                data = ids[start : start + n].tobytes()
                for column, value in zip(out, (row, piece, start, n, zlib.crc32(data), block, ranks[n], data if with_ids else None), strict=True):
                    column.append(value)
                ranks[n] += 1
        row, *columns = (pa.array(c, k) for c, k in zip(out, kinds, strict=True))
        yield pa.RecordBatch.from_arrays([batch["id"].take(row), *columns], ["id", "piece", "start", "length", "ids_crc32", "block", "nth", "ids"])


def _placed(batches: Iterator[pa.RecordBatch], where: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    names = ["id", "piece", "start", "length", "ids_crc32", "ids"]
    for batch in batches:
        n, nth, before = (batch[c].to_numpy() for c in ("length", "nth", "before"))
        sequence, offset = place(n, nth + before, where)
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])


def pack(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    end_id: int | None = 2,
    capacity: int = 1024,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their place: id, ``piece``, ``start``, ``length``,
    ``ids_crc32``, ``sequence_id``, ``offset`` and, on request, the ``ids`` themselves.

    A document's ids are those of its text and ``end_id``. Only documents longer than
    ``capacity`` are cut, the first piece being the shorter one. Offsets run without a gap
    from 0. A null text counts as empty (one piece with the end id alone; none if there is
    no end id), a null id stays null, repeated rows are packed each for itself, other
    columns are not read; an empty table gives an empty table. ``capacity`` bounds what
    the driver and each task hold of the plan.
    """
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    columns = f"id {kind}, piece int, start long, length long, ids_crc32 long"
    pieces = source.mapInArrow(
        lambda it: _pieces(it, vocabulary, end_id, capacity, with_ids), f"{columns}, block long, nth long, ids binary"
    ).where("length > 0")
    pieces = keep(pieces)
    blocks = pieces.groupBy("length", "block").count()
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in blocks.groupBy("length").agg(F.sum("count")).collect():  # at most ``capacity`` rows
        counts[n] = c
    where = slots(patterns(counts, capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = blocks.select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    out = pieces.join(ranks, ["length", "block"]).select(*pieces.columns, "before")
    out = out.mapInArrow(lambda it: _placed(it, where), f"{columns}, ids binary, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col) if with_ids else out.drop("ids").withColumnRenamed("id", id_col)
