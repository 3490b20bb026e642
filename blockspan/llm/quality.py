"""Quality classifier: kernel ridge by random Fourier features, then isotonic calibration
(operator 1).

A document is described by statistics of its characters, words and lines, never by its
id, language or source. The statistics are standardised, and random Fourier features turn
them into a vector whose inner products approximate a Gaussian kernel. Each partition of
the labelled rows adds up its part of the normal equations; their sums (as large as the
features squared, whatever the rows) are added on Spark and solved. Scores of labelled
rows that had no part in that fit are counted in fine bins and calibrated by isotonic
regression.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import keep

_ALNUM, _UPPER, _DIGIT, _SPACE, _HIGH = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _DIGIT[48:58] = _HIGH[128:] = True
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARKS = tuple(b'.,!?;:|#%$&*@/\\<>{}[]()_=+-"\'')
_FUNCTION_WORD = 3  # bytes; the short words of running text
BINS, PARTS = 2_000, 8


def statistics(text: str | None) -> np.ndarray:
    """Numbers that describe a text, each of moderate size; a null text is an empty one."""
    data = (text or "").encode("utf-8", "surrogatepass")
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    counts = np.bincount(b, minlength=256)
    share = counts / max(1, n)
    letters = np.where(_ALNUM & ~_DIGIT & ~_UPPER, counts, 0).sum()
    upper = counts[_UPPER].sum()
    words = data.split()
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    m = max(1, len(words))
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_sizes = np.array([len(x) for x in lines] or [0])
    entropy = -(share[share > 0] * np.log2(share[share > 0])).sum()
    inside = _ALNUM[b]
    tokens = np.count_nonzero(inside[1:] & ~inside[:-1]) + int(n > 0 and inside[0])
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines)
    values = [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)), np.log1p(line_sizes.mean()),
        upper / max(1, upper + letters), share[_DIGIT].sum(), share[_SPACE].sum(), share[_HIGH].sum(), share[:32].sum() - share[[9, 10, 13]].sum(),
        1 - share[_ALNUM].sum() - share[_SPACE].sum(),
        sizes.mean() if len(words) else 0, sizes.std() if len(words) else 0, np.log1p(sizes.max(initial=0)),
        distinct / m, distinct / np.sqrt(m), (sizes <= _FUNCTION_WORD).sum() / m, (sizes == 1).sum() / m, tokens / m,
        len(set(lines)) / max(1, len(lines)), ends / max(1, len(lines)), entropy,
        sum(w[:1].isupper() for w in words) / m, sum(w.isupper() for w in words) / m,
        *(np.sqrt(share[c] * 10) for c in _MARKS),
    ]
    return np.array(values, np.float64)


N_STATISTICS = len(statistics(""))


@dataclass
class Model:
    """What scoring needs; a few hundred kilobytes."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # statistics x features
    phase: np.ndarray
    ridge: np.ndarray | None = None
    knots: tuple[np.ndarray, np.ndarray] | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.hstack([waves, 0.1 * z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def scores(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated, between 0 and 1; raw scores keep a thousandth, to order what the
        calibration makes equal."""
        raw = self.raw(stats)
        level = np.interp(raw, *self.knots)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-4 * (raw - 0.5))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the least-squares non-decreasing fit: block means by pool-adjacent-violators."""
    blocks: list[list[float]] = []  # weight, sum of y, sum of x
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([w, b * w, a * w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    out = np.array(blocks).reshape(-1, 3)
    return out[:, 2] / out[:, 0], out[:, 1] / out[:, 0]


def _sums(arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Partition sums of named arrays, as rows of their elements' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for k, v in arrays(batch).items():
                total[k] = total[k] + v if k in total else v
        yield pa.RecordBatch.from_pydict({"data": pa.array([pickle.dumps(total)] if total else [], pa.binary())})

    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total: dict[str, np.ndarray] = {}
    for data in pdf["data"]:
        for k, v in pickle.loads(data).items():
            total[k] = total[k] + v if k in total else v
    return pd.DataFrame({"data": [pickle.dumps(total)]})


def _total(df: DataFrame, arrays: Callable[[pa.RecordBatch], dict[str, np.ndarray]], fan_in: int = 32) -> dict[str, np.ndarray]:
    """Sums over all rows. Partitions' sums meet ``fan_in`` at a time before the driver."""
    n = df.rdd.getNumPartitions()
    part = df.mapInArrow(_sums(arrays), "data binary")
    while n > fan_in:
        n = -(-n // fan_in)
        part = part.withColumn("k", (F.rand(1) * n).cast("int")).groupBy("k").applyInPandas(_added, "data binary")
    total: dict[str, np.ndarray] = {}
    for row in part.collect():
        for k, v in pickle.loads(row["data"]).items():
            total[k] = total[k] + v if k in total else v
    return total


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stats = np.frombuffer(b"".join(batch["stats"].to_pylist()), np.float64).reshape(-1, N_STATISTICS)
    return stats, batch["label"].to_numpy().astype(np.float64), batch["fold"].to_numpy()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        stats = [statistics(t).tobytes() for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(stats), batch["label"], batch["fold"]], ["stats", "label", "fold"])


def fit(
    labelled: DataFrame,
    text_col: str = "text",
    label_col: str = "label",
    max_rows: int = 100_000,
    features: int = 384,
    gamma: float = 0.02,
    ridge: float = 1e-5,
    seed: int = 7,
) -> Model:
    """Learn from labelled texts. Rows without a label are left out.

    Of more than about ``max_rows`` rows a sample of that size is taken, by a hash of the
    text. A quarter of the rows calibrates, the others fit. Labels of one kind only, or
    none, give a constant score (the share of label 1; 0.5 without a row).
    """
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    rows = rows.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(seed)))
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod("h", F.lit(1_000_000)) < int(1e6 * max_rows / n))
    rows = rows.withColumn("fold", F.pmod(F.shiftright("h", 24), F.lit(4)).cast("int"))
    # At most about ``max_rows`` short rows, so a fixed number of partitions has them, and
    # as many partition sums come together, whatever the corpus.
    rows = keep(rows.select("text", "label", "fold").mapInArrow(_described, "stats binary, label int, fold int").repartition(PARTS))

    def moments(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        stats, label, _ = _matrix(batch)
        return {"n": np.float64(len(stats)), "sum": stats.sum(0), "square": (stats**2).sum(0), "ones": label.sum()}

    m = _total(rows, moments)
    count = m.get("n", 0)
    mean = m["sum"] / count if count else np.zeros(N_STATISTICS)
    scale = np.sqrt(np.maximum(m["square"] / count - mean**2, 0)) if count else np.ones(N_STATISTICS)
    r = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), r.normal(0, np.sqrt(2 * gamma), (N_STATISTICS, features)), r.uniform(0, 2 * np.pi, features))
    size = features + N_STATISTICS + 1
    if not count or m["ones"] in (0, count):
        model.ridge = np.zeros(size)
        model.knots = (np.array([0.0]), np.array([m["ones"] / count if count else 0.5]))
        return model
    rate = m["ones"] / count

    def equations(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        stats, label, fold = _matrix(batch)
        z, y = model.features(stats[fold != 0]), label[fold != 0]
        w = np.where(y > 0, 0.5 / rate, 0.5 / (1 - rate))  # both labels weigh the same
        return {"a": (z * w[:, None]).T @ z, "b": (z * w[:, None]).T @ y, "w": w.sum()}

    e = _total(rows, equations)
    model.ridge = np.linalg.solve(e["a"] + ridge * e["w"] * np.eye(size), e["b"])
    low, high = -0.5, 1.5

    def binned(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        stats, label, fold = _matrix(batch)
        at = np.clip((model.raw(stats[fold == 0]) - low) / (high - low) * BINS, 0, BINS - 1).astype(np.int64)
        return {"n": np.bincount(at, minlength=BINS), "ones": np.bincount(at, label[fold == 0], minlength=BINS)}

    c = _total(rows, binned)
    some = np.flatnonzero(c["n"])
    if not len(some):
        model.knots = (np.array([low, high]), np.array([0.0, 1.0]))
        return model
    model.knots = isotonic(low + (some + 0.5) * (high - low) / BINS, c["ones"][some] / c["n"][some], c["n"][some])
    return model


def score(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).

    Every text has a score, null and empty ones that of an empty text. Other columns pass
    through; a ``score`` or ``predicted`` in ``df`` is replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in df.columns if c not in ("score", "predicted")]
    base = df.select(*kept)
    schema = T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = np.array([statistics(t) for t in batch[text_col].to_pylist()]).reshape(-1, N_STATISTICS)
            s = sent.value.scores(stats)
            columns = [*(batch[c] for c in kept), pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "score", "predicted"])

    return base.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """Rows that no fit may see: crc32 of the id's digits leaves 1 over 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_rows: int = 100_000, **how) -> Model:
    """Fit on the documents that ``labels`` marks, held-out ones left out.

    Of more than about ``max_rows`` marks those of a hash of the id are taken, so the marks
    are few enough to go to the documents, and no text is shuffled.
    """
    marks = labels.where(~held_out(id_col)).select(id_col, F.col(label_col).alias("label")).where("label is not null")
    n = marks.count()
    if n > max_rows:
        marks = marks.where(F.pmod(F.xxhash64(id_col), F.lit(1_000_000)) < int(1e6 * max_rows / n))
    return fit(docs.select(id_col, "text").join(F.broadcast(marks), id_col), max_rows=max_rows, **how)
