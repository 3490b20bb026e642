"""Pages of a response: cut by size or time, resumed by ``nextBlock``."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.relations import running_total
from .compile import Tables, response_rows
from .query import Query, QueryError


def page_by_size(rows: DataFrame, order: str, size: str, limit: int, bucket: int = 100_000) -> DataFrame:
    """Rows of the first page: all until the sizes before them reach the limit. The limit
    is soft, so a page has at least a row."""
    return running_total(rows, order, size, bucket).where(F.col("before") < limit).drop("before")


@dataclass(frozen=True)
class Limits:
    max_bytes: int = 30_000_000
    max_ms: int = 5_000
    max_queries: int = 32
    #: Blocks asked for at a time: what may be held on the driver follows from it.
    batch_blocks: int = 100_000


class TooManyQueries(QueryError):
    pass


class Admission:
    """Refuses more queries at once than it was made for."""

    def __init__(self, limit: int):
        self._slots = threading.BoundedSemaphore(limit)

    @contextmanager
    def __call__(self) -> Iterator[None]:
        if not self._slots.acquire(blocking=False):
            raise TooManyQueries("too many queries at once")
        try:
            yield
        finally:
            self._slots.release()


@contextmanager
def _cancelled_at(spark: SparkSession, seconds: float) -> Iterator[threading.Event]:
    """The jobs started within are cancelled after so many seconds; the event tells."""
    tag, fired, sc = f"page-{uuid.uuid4().hex}", threading.Event(), spark.sparkContext

    def stop() -> None:
        fired.set()
        sc.cancelJobsWithTag(tag)

    timer = threading.Timer(max(0.001, seconds), stop)
    timer.daemon = True
    sc.addJobTag(tag)
    timer.start()
    try:
        yield fired
    finally:
        timer.cancel()
        sc.removeJobTag(tag)


def answer(tables: Tables, query: Query, height: int, limits: Limits = Limits(), semantics: str = "documented", clock=time.monotonic) -> dict:
    """One page, as the envelope that goes to the client.

    Blocks are asked for in batches of consecutive ranges. After each the limits are
    looked at, and a batch that runs beyond the time limit is cancelled. ``nextBlock`` moves
    only past blocks that are in the page, so pages in a row make up the whole answer. Where
    the time is up before the first entry, a batch of a tenth is waited for, so that every
    page gets on. ``archiveHeight`` is that of the last block, or None.
    """
    began = now = clock()
    end = height if query.end is None else min(height, query.end)
    data, size, at, step = [], 0, query.first, limits.batch_blocks
    while at < end:
        upto = min(end, at + step)
        part = Query(at, upto, query.logs, query.transactions, query.include_all_blocks, query.fields)
        entries, patient = [], step < limits.batch_blocks
        left = threading.TIMEOUT_MAX if patient else limits.max_ms / 1000 - (now - began)
        with _cancelled_at(tables.blocks.sparkSession, left) as fired:
            try:
                # Entries come a partition at a time, and no more of them than the page can take.
                for row in response_rows(tables, part, semantics).orderBy("number").toLocalIterator():
                    entries.append(row["entry"])
                    size += len(row["entry"])
                    at = row["number"] + 1
                    if size >= limits.max_bytes:
                        break
                else:
                    at = upto
            except Exception:
                if not fired.is_set():
                    raise
                if at == query.first and step > 1:
                    step = max(1, step // 10)
                    continue
        if entries:
            data.append(entries)
        now = clock()
        if size >= limits.max_bytes or fired.is_set() or patient or (now - began) * 1000 >= limits.max_ms:
            break
    return {"data": data, "archiveHeight": height - 1 if height else None, "nextBlock": at, "totalTime": int((now - began) * 1000)}


def to_json(page: dict) -> str:
    """The envelope as JSON; entries are JSON already."""
    data = ",".join(f"[{','.join(batch)}]" for batch in page["data"])
    rest = json.dumps({k: v for k, v in page.items() if k != "data"})
    return f'{{"data":[{data}],{rest[1:]}'
