"""Document fingerprints: quartile bucket digests (operator 6).

Within a window of five bytes that slides over the text, six triplets that begin at its
first byte are hashed into ``BUCKETS`` buckets. The digest has a check byte, the
logarithm of the length, the ratios of the quartiles of the bucket counts, and for each
bucket the quartile (two bits) that its count falls into. Two digests differ by a score:
a bucket's quartiles apart (three apart counts six), lengths apart, ratios apart. The
score is bounded by what digests of unrelated bytes have on average.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import tasks_for, text_or_empty

BUCKETS = 256
#: Places in the window of the two bytes that follow the first.
TRIPLETS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
NO_ID = -(1 << 63)
_APART = np.array([0, 1, 2, 6])
#: Mean of _APART over two independent quartiles, for all buckets.
BOUND = int(BUCKETS * (6 * 1 + 4 * 2 + 2 * 6) / 16)
_PEARSON = np.frombuffer(b"".join(hashlib.sha256(b"table %d" % i).digest() for i in range(8)), np.uint8)
#: A permutation of the byte values, by a fixed rule.
_PEARSON = np.argsort(_PEARSON, kind="stable").astype(np.uint8)


def bucket_counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    n = len(b) - 4
    counts = np.zeros(BUCKETS, np.int64)
    if n <= 0:
        return counts
    for salt, (i, j) in enumerate(TRIPLETS):
        h = _PEARSON[b[:n] ^ np.uint8(salt * 37 + 1)]
        h = _PEARSON[h ^ b[i : i + n]]
        counts += np.bincount(_PEARSON[h ^ b[j : j + n]], minlength=BUCKETS)
    return counts


def _length_code(n: int) -> int:
    return min(255, round(math.log(n, 1.1))) if n else 0


def digest(text: str | None) -> str:
    """The fingerprint, as hexadecimal digits; one length for all texts.

    Texts of fewer than five bytes have no triplets: their buckets are all in the lowest
    quartile, and length and check byte alone tell them apart.
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = bucket_counts(data)
    q1, q2, q3 = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    check = hashlib.blake2b(data, digest_size=1).digest()[0]
    ratios = (int(16 * q1 / q3) % 16 << 4 | int(16 * q2 / q3) % 16) if q3 else 0
    return bytes([check, _length_code(len(data)), ratios]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests; at most BOUND."""
    if a == b:
        return 0
    x, y = (np.frombuffer(bytes.fromhex(d), np.uint8) for d in (a, b))
    codes = [(z[3:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3).astype(np.int8) for z in (x, y)]
    score = int(_APART[np.abs(codes[0] - codes[1])].sum()) + int(x[0] != y[0])
    apart = abs(int(x[1]) - int(y[1]))
    score += apart if apart <= 1 else 4 * apart
    for shift in (0, 4):
        r = abs((int(x[2]) >> shift & 15) - (int(y[2]) >> shift & 15))
        r = min(r, 16 - r)
        score += r if r <= 1 else 4 * (r - 1)
    return min(score, BOUND)


def likeness(a: str, b: str) -> float:
    """1 for equal digests, 0 at the bound."""
    return 1.0 - difference(a, b) / BOUND


@F.pandas_udf(T.StringType())
def fingerprint(text: pd.Series) -> pd.Series:
    """Column function: the digest of a text (null counts as empty)."""
    return text.map(digest)


@F.pandas_udf(T.DoubleType())
def fingerprint_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Column function: likeness of two digests."""
    return pd.Series([likeness(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def _in_ranges(df: DataFrame, id_col: str, text_col: str, ranges: int) -> DataFrame:
    """``id, text, bucket, ghost``: documents by ranges of ids, and in each range once more
    the documents of the id that follows its least one in descending order, as ghosts.

    Ranges are cut at quantiles of the ids; what passes the driver is a few numbers each.
    """
    ids = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"))
    shares = [i / ranges for i in range(1, ranges)] or [1.0]
    cuts = np.unique(np.array(ids.agg(F.percentile_approx("id", shares, 5 * ranges)).first()[0] or [], np.int64))

    @F.pandas_udf("int")
    def bucket(i: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, i.to_numpy(), side="right"))

    largest = dict(ids.withColumn("bucket", bucket("id")).groupBy("bucket").agg(F.max("id")).collect())
    order = sorted(largest)
    # Before the lowest range comes the highest. A pair for each range at most.
    after = [(largest[order[i - 1]], b) for i, b in enumerate(order)]
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), text_or_empty(text_col).alias("text"))
    own = docs.withColumn("bucket", bucket("id")).withColumn("ghost", F.lit(False))
    ends = df.sparkSession.createDataFrame(after, "id long, bucket int")
    return own.unionByName(docs.join(F.broadcast(ends), "id").withColumn("ghost", F.lit(True)))


def _pairs(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document with the one behind it in its range; at most one document is held."""
    held = None
    for pdf in rows:
        out = []
        for bucket, ghost, key, text in zip(pdf["bucket"], pdf["ghost"], pdf["id"], pdf["text"], strict=True):
            fp = digest(text)
            if held and held[0] == bucket and not held[1]:
                _, _, own_key, own_text, own_fp = held
                n = len(own_text)
                edited = own_text[: n - n // 2] + text[: n // 2]
                edited_fp = digest(edited)
                sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                out.append((own_key, n, sha, own_fp, edited_fp, likeness(own_fp, edited_fp), likeness(own_fp, fp)))
            held = (bucket, ghost, key, text, fp)
        yield pd.DataFrame(out, columns=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprint_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document its fingerprint, that of its edited text, and their likeness: id,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as
    many (or all) of the next document's, in descending order of ids; after the last comes
    the first. A null text counts as empty; null ids come last; rows of one id stand in the
    order of their texts, each for itself; one document alone follows itself. Other columns
    are not read. An empty table gives an empty table. Ids are integers.
    """
    n = tasks_for(df, text_col)
    rows = _in_ranges(df, id_col, text_col, ranges or max(128, 4 * n))
    rows = rows.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "ghost", F.desc("id"), "text")
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = rows.mapInPandas(_pairs, schema)
    return out.select(F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col), *out.columns[1:])
