"""Line dedup by a sharded minimal perfect hash (operator 3).

1. Lines become 128-bit hashes; Spark counts, for each, the documents that hold it and the
   largest id among them (partial sums first, so a very common line is no hot key).
2. The lines in at least ``min_docs`` documents are dealt into shards by their hash. A task
   builds for each shard a minimal perfect hash (levels of bits; colliding keys go a level
   on) and, in its order, arrays of fingerprints, counts and keepers. A line outside the
   index meets a fingerprint that isn't its own.
3. Documents probe the arrays. Up to ``broadcast_bytes`` of arrays go to all workers and
   documents aren't shuffled at all. Beyond that the hashes of lines go to the shards,
   which stream through tasks; shards with very common lines are salted, and documents get
   back only the hashes that they lose.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import keep, n_tasks

STRIP = " \t\n\x0b\x0c\r"
U = np.uint64
SHARD_KEYS, KEY_BYTES = 50_000, 24
NO_ID = -(1 << 63)


def key(line: str) -> bytes:
    return line.strip(STRIP).encode().lower()  # of bytes, so A-Z alone


def hashes(keys: list[bytes]) -> np.ndarray:
    """Two 64-bit numbers for each key."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def long_lines(text: str | None, min_chars: int) -> tuple[list[str], list[int], list[bytes]]:
    """The lines of a text; which of them are long enough; those lines' keys."""
    lines = (text or "").split("\n")
    where = [i for i, x in enumerate(lines) if len(x) >= min_chars and len(x.strip(STRIP)) >= min_chars]
    return lines, where, [key(lines[i]) for i in where]


def _mix(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ U(level * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n-1."""

    def __init__(self, keys: np.ndarray, max_levels: int = 40):
        self.levels, self.before, total = [], [], 0
        while len(keys) and len(self.levels) < max_levels:
            size = max(64, -(-len(keys) * 2 // 64) * 64)
            at = _mix(keys, len(self.levels)) % U(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            self.levels.append(np.packbits(alone, bitorder="little"))
            words = np.bitwise_count(self.levels[-1].view("<u8"))
            self.before.append(total + np.r_[0, np.cumsum(words)].astype(np.int64))
            total = int(self.before[-1][-1])
            keys = keys[~alone[at.astype(np.int64)]]
        self.rest, self.n = np.sort(keys), total + len(keys)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Any number from -1 to n-1 for a key that is not of the set."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (bits, before) in enumerate(zip(self.levels, self.before, strict=True)):
            at = (_mix(keys[todo], level) % U(8 * len(bits))).astype(np.int64)
            hit = bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1
            words = bits.view("<u8")[at[hit] >> 6]
            below = words & ((U(1) << (at[hit] & 63).astype(U)) - U(1))
            out[todo[hit]] = before[at[hit] >> 6] + np.bitwise_count(below)
            todo = todo[~hit]
        if len(self.rest) and len(todo):
            k = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[k] == keys[todo], self.n - len(self.rest) + k, -1)
        return out


class Shard:
    """Fingerprint, count and keeper of each indexed line."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, counts: np.ndarray, keepers: np.ndarray):
        self.hash = PerfectHash(h1)
        order = self.hash(h1)
        self.prints, self.counts, self.keepers = np.zeros(len(h1), U), np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
        self.prints[order], self.counts[order], self.keepers[order] = h2, np.minimum(counts, 0xFFFFFFFF), keepers

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts (0: not indexed) and keepers."""
        if not len(self.prints):
            return np.zeros(len(h1), np.uint32), np.zeros(len(h1), np.int64)
        k = self.hash(h1)
        known = (k >= 0) & (self.prints[k] == h2)
        return np.where(known, self.counts[k], 0), self.keepers[k]


def shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return (h1 >> U(32)).astype(np.int64) * n_shards >> 32


def _line_rows(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, keys = [], []
        for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
            own = set(long_lines(text, min_chars)[2])
            keys += own
            ids += [NO_ID if i is None else i] * len(own)
        h = hashes(keys).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(ids, pa.int64())], ["h1", "h2", "id"])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    # Two lines whose first halves agree are told apart by nothing here; 64 bits make that a chance of n² / 2⁶⁵.
    pdf = pdf.drop_duplicates("h1")
    column = lambda c: pdf[c].to_numpy()
    shard = Shard(column("h1").view(U), column("h2").view(U), column("n"), column("keeper"))
    return pd.DataFrame({"shard": [pdf["shard"].iat[0]], "n_rows": [pdf["n"].sum()], "data": [pickle.dumps(shard)]})


class Probe:
    """All shards, in a worker that has them."""

    def __init__(self, n_shards: int, shards: dict[int, bytes]):
        self.n, self.shards = n_shards, {k: pickle.loads(v) for k, v in shards.items()}

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, keepers = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        which = shard_of(h[:, 0], self.n)
        for s in np.unique(which):
            if int(s) in self.shards:
                at = which == s
                counts[at], keepers[at] = self.shards[int(s)].probe(h[at, 0], h[at, 1])
        return counts, keepers


def _without(batch: pa.RecordBatch, texts: list[str], n_lines: list[int], n_dropped: list[int], text_col: str) -> pa.RecordBatch:
    names = [c for c in batch.schema.names if c not in ("n_lines", "n_dropped")]
    columns = [pa.array(texts, pa.string()) if c == text_col else batch[c] for c in names]
    columns += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [*names, "n_lines", "n_dropped"])


def _probe_broadcast(batches, broadcast, id_col, text_col, min_chars, min_docs):
    n_shards, shards = broadcast.value
    probe = Probe(n_shards, shards)
    for batch in batches:
        split, rows, keys = [], [], []
        for text in batch[text_col].to_pylist():
            lines, where, own = long_lines(text, min_chars)
            split.append((lines, where))
            rows.append(len(own))
            keys += own
        counts, keepers = probe(hashes(keys))
        ids = np.array([NO_ID if i is None else i for i in batch[id_col].to_pylist()], np.int64)
        gone = (counts >= min_docs) & (keepers != np.repeat(ids, rows))
        texts, dropped, at = [], [], 0
        for (lines, where), n in zip(split, rows, strict=True):
            out = {where[k] for k in np.flatnonzero(gone[at : at + n])}
            at += n
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in out) if out else "\n".join(lines))
            dropped.append(len(out))
        yield _without(batch, texts, [len(x) for x, _ in split], dropped, text_col)


def _probe_routed(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows ordered by shard and salt; a shard comes before the lines that ask it."""
    at, shard = None, None
    for batch in batches:
        h = np.stack([batch["h1"].to_numpy().view(U), batch["h2"].to_numpy().view(U)], 1)
        ids, which = batch["id"].to_numpy(), np.stack([batch["shard"].to_numpy(), batch["salt"].to_numpy()], 1)
        gone = np.zeros(len(h), bool)
        edges = np.r_[0, np.flatnonzero((which[1:] != which[:-1]).any(1)) + 1, len(h)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a == b:
                continue
            data = batch["data"][int(a)].as_py()
            if data is not None:
                at, shard = tuple(which[a]), pickle.loads(data)
                a += 1
            if shard is not None and at == tuple(which[a if a < b else a - 1]):
                counts, keepers = shard.probe(h[a:b, 0], h[a:b, 1])
                gone[a:b] = (counts >= min_docs) & (keepers != ids[a:b])
        yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array(h[gone, 0].view(np.int64)), pa.array(h[gone, 1].view(np.int64))], ["id", "h1", "h2"])


def _drop_listed(batches, text_col, min_chars):
    for batch in batches:
        texts, n_lines, n_dropped = [], [], []
        for text, listed in zip(batch[text_col].to_pylist(), batch["__gone"].to_pylist(), strict=True):
            lines, where, keys = long_lines(text, min_chars)
            out: set[int] = set()
            if listed:
                listed = {(x["h1"], x["h2"]) for x in listed}
                own = hashes(keys).view(np.int64).tolist()
                out = {i for i, x in zip(where, own, strict=True) if tuple(x) in listed}
            texts.append("\n".join(x for i, x in enumerate(lines) if i not in out))
            n_lines.append(len(lines))
            n_dropped.append(len(out))
        yield _without(batch.drop_columns(["__gone", "__key"]), texts, n_lines, n_dropped, text_col)


def line_dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    broadcast_bytes: int = 64 << 20,
    rows_per_salt: int = 1_000_000,
) -> DataFrame:
    """``df`` with repeated lines taken out of its texts, and ``n_lines``, ``n_dropped``.

    A line's key is the line without spaces, tabs, line and page breaks at its ends, A-Z
    in lower case. Keys of at least ``min_chars`` code points that at least ``min_docs``
    rows hold lose their lines everywhere but in the rows of the largest id. A null text
    is one empty line (and comes back empty), a null id is below all others, rows of the
    same id count each and keep or lose a line together. Other columns pass through;
    ``n_lines`` and ``n_dropped`` of ``df`` are replaced. An empty table stays empty. Ids
    are integers.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    lines = source.mapInArrow(lambda it: _line_rows(it, min_chars), "h1 long, h2 long, id long")
    common = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs)
    common = keep(common)
    n_keys = common.count()
    n_shards = max(1, -(-n_keys // SHARD_KEYS))
    # The upper half of h1 as an unsigned number, scaled to the shards.
    in_shard = F.shiftright(F.shiftrightunsigned("h1", 32) * n_shards, 32)
    shards = common.withColumn("shard", in_shard.cast("long")).groupBy("shard").applyInPandas(_build, "shard long, n_rows long, data binary")
    kept = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    base = df.select(*kept).withColumn(text_col, F.col(text_col).cast("string"))
    names = T.StructType([*base.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    if n_keys * KEY_BYTES <= broadcast_bytes:
        arrays = {r["shard"]: bytes(r["data"]) for r in shards.select("shard", "data").collect()}
        sent = spark.sparkContext.broadcast((n_shards, arrays))
        return base.mapInArrow(lambda it: _probe_broadcast(it, sent, id_col, text_col, min_chars, min_docs), names)
    shards = keep(shards)
    # A shard with more than its share of lines gets salts; at most 1000 shards can have that many.
    per_salt = max(rows_per_salt, (shards.agg(F.sum("n_rows")).first()[0] or 0) // 1000)
    hot = {r["shard"]: 1 + r["n_rows"] // per_salt for r in shards.where(F.col("n_rows") > per_salt).collect()}
    salts = F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]) if hot else None
    n_salts = F.coalesce(salts[F.col("shard")], F.lit(1)).cast("long") if hot else F.lit(1).cast("long")
    asked = lines.withColumn("shard", in_shard.cast("long")).withColumn("salt", F.pmod(F.xxhash64("id"), n_salts).cast("long"))
    asked = asked.withColumn("data", F.lit(None).cast("binary"))
    answering = shards.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), n_salts - 1)))
    answering = answering.select(*(F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "id")), "shard", "salt", "data")
    routed = asked.unionByName(answering).repartition(n_tasks(spark), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("data").isNull())
    gone = routed.mapInArrow(lambda it: _probe_routed(it, min_docs), "id long, h1 long, h2 long")
    gone = gone.distinct().groupBy("id").agg(F.collect_list(F.struct("h1", "h2")).alias("__gone")).withColumnRenamed("id", "__key")
    joined = base.withColumn("__row", F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)))
    joined = joined.join(gone, F.col("__row") == F.col("__key"), "left").drop("__row")
    return joined.mapInArrow(lambda it: _drop_listed(it, text_col, min_chars), names)
