"""Token counts of whole texts, huge ones in overlapping chunks (operator 8).

A text of at most ``chunk_chars`` characters is encoded where it is read. A longer one is
cut into chunks that overlap; the chunks are dealt over the cluster as rows of their own
and encoded with offsets; equal long texts are one. Two neighbours are spliced at a
*stable* boundary: a pretoken boundary that both have. The splitting expression of a
byte-level vocabulary reads left to right and never looks back, so what follows a boundary
depends on the text behind it alone; and a boundary that lies ``margin`` characters before
the end of a chunk can't move when more text follows. By induction all tokens left of a
splice come from the left chunk as the whole text has them, and all right of it from the
right chunk. Where the overlap holds no such boundary (a pretoken longer than the
overlap), the texts concerned are encoded anew with chunks and overlaps four times as wide,
at last as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keep, text_or_empty
from .words import Encoder

#: What a boundary of the splitting expression may depend on beyond itself: a contraction's two letters, one character looked ahead.
LOOKAHEAD = 4
BOUNDARIES = ("head_at", "head_n", "tail_at", "tail_n")


def _count(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(vocabulary)
    for batch in batches:
        counts = [len(x) // encoder.dtype.itemsize for x in encoder.encode(batch["text"])]
        yield pa.RecordBatch.from_arrays([batch["id"], batch["n_bytes"], pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])


def _cut(batches: Iterator[pa.RecordBatch], chunk_chars: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The chunks of each text, a batch a text."""
    for batch in batches:
        for key, text in zip(batch["key"].to_pylist(), batch["text"].to_pylist(), strict=True):
            starts = range(0, max(1, len(text) - overlap), chunk_chars - overlap)
            parts = [text[s : s + chunk_chars] for s in starts]
            columns = [pa.array([key] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(list(starts), pa.int64()), pa.array(parts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "first", "text"])


def _encode(batches: Iterator[pa.RecordBatch], vocabulary: str, chunk_chars: int, overlap: int) -> Iterator[pa.RecordBatch]:
    """The count of each chunk and the boundaries that lie in its two overlaps."""
    encoder = Encoder.of(vocabulary)
    margin = LOOKAHEAD + max(map(len, encoder.added), default=0)
    for batch in batches:
        totals, found = [], [[] for _ in BOUNDARIES]
        for text, first in zip(batch["text"].to_pylist(), batch["first"].to_pylist(), strict=True):
            ends, counts = encoder.boundaries(text)
            at, n = np.r_[0, ends] + first, np.r_[0, counts]
            head = at <= first + overlap - margin
            tail = (at >= first + chunk_chars - overlap) & (at <= first + chunk_chars - margin)
            totals.append(int(n[-1]))
            for column, x in zip(found, (at[head], n[head], at[tail], n[tail]), strict=True):
                column.append(x.tolist())
        columns = [batch["key"], batch["chunk"], pa.array(totals, pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in found)]
        yield pa.RecordBatch.from_arrays(columns, ["key", "chunk", "n_tokens", *BOUNDARIES])


def splice(chunks: list[dict]) -> int | None:
    """Tokens of a text from its chunks; None where two have no stable boundary in common."""
    chunks = sorted(chunks, key=lambda c: c["chunk"])
    total, n_before = 0, 0
    for left, right in zip(chunks, chunks[1:], strict=False):
        common, i, j = np.intersect1d(left["tail_at"], right["head_at"], assume_unique=True, return_indices=True)
        if not len(common):
            return None
        total += int(left["tail_n"][i[-1]]) - n_before
        n_before = int(right["head_n"][j[-1]])
    return total + int(chunks[-1]["n_tokens"]) - n_before


def _spliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [splice(c) for c in batch["chunks"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["key"], pa.array(counts, pa.int64())], ["key", "n_tokens"])


def _long(texts: DataFrame, vocabulary: str, chunk_chars: int, overlap: int) -> DataFrame:
    """``key, n_tokens`` of the texts ``key, text``, in chunks."""
    todo, out = keep(texts), None
    entry = F.struct("chunk", "n_tokens", *BOUNDARIES)
    while True:
        chunks = todo.mapInArrow(lambda it, a=chunk_chars, b=overlap: _cut(it, a, b), "key string, chunk int, first long, text string")
        encoded = chunks.hint("rebalance", "key", "chunk").mapInArrow(
            lambda it, a=chunk_chars, b=overlap: _encode(it, vocabulary, a, b),
            "key string, chunk int, n_tokens long, " + ", ".join(f"{c} array<long>" for c in BOUNDARIES),
        )
        # As many chunks a key as its text is long.
        counted = keep(encoded.groupBy("key").agg(F.collect_list(entry).alias("chunks")).mapInArrow(_spliced, "key string, n_tokens long"))
        good = counted.where("n_tokens is not null")
        out = good if out is None else out.unionByName(good)
        failed = counted.where("n_tokens is null").select("key")
        if failed.isEmpty():
            return out
        todo = todo.join(failed, "key", "left_semi")
        chunk_chars, overlap = 4 * chunk_chars, 4 * overlap


def token_counts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = "byte_bpe_50k.json",
    limit: int = 512,
    chunk_chars: int = 65_536,
    overlap: int = 1_024,
) -> DataFrame:
    """A row for each row of ``df``: its id, ``n_bytes``, ``n_tokens``, ``over_limit``.

    Counts are those of the tokenizers library for the whole text without added special
    tokens; added tokens that the text spells out count as the library has it. A null text
    counts as empty: 0 bytes, 0 tokens. A null id stays null, repeated rows each get their
    count, other columns are not read, an empty table gives an empty table. ``vocabulary``
    names a byte-level BPE file of the tokenizers library.
    """
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = source.where(F.char_length("text") <= chunk_chars).mapInArrow(lambda it: _count(it, vocabulary), f"id {kind}, n_bytes long, n_tokens long")
    long = source.where(F.char_length("text") > chunk_chars).withColumn("key", F.sha2("text", 256))
    counts = _long(long.select("key", "text").dropDuplicates(["key"]), vocabulary, chunk_chars, overlap)
    out = short.unionByName(long.select("id", "n_bytes", "key").join(counts, "key").drop("key"))
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
