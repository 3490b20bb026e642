"""Blocks from JSON-RPC nodes, as a streaming and batch source.

The transport is a function ``(url, body) -> reply`` (parsed JSON), so tests and proxies
put in their own. It must be importable or picklable: executors call it.
"""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

Transport = Callable[[str, object], object]
SCHEMA = "number long, block string, receipts string"


class RpcError(RuntimeError):
    pass


def http(url: str, body: object) -> object:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as reply:
        return json.loads(reply.read())


# -- requests ---------------------------------------------------------------------------


def _body(method: str, params: list, i: int) -> dict:
    return {"jsonrpc": "2.0", "method": method, "params": params, "id": i}


def block_by_number(n: int, i: int = 0) -> dict:
    return _body("eth_getBlockByNumber", [hex(n), True], i)


def best_block(i: int = 0) -> dict:
    return _body("eth_blockNumber", [], i)


def block_receipts(n: int, i: int = 0) -> dict:
    return _body("eth_getBlockReceipts", [hex(n)], i)


def logs_in(first: int, last: int, i: int = 0) -> dict:
    """Logs of the blocks first to last, both inclusive."""
    return _body("eth_getLogs", [{"fromBlock": hex(first), "toBlock": hex(last)}], i)


def result_of(reply: object) -> object:
    if not isinstance(reply, dict):
        raise RpcError(f"a reply must be an object, not {type(reply).__name__}")
    if reply.get("error") is not None or reply.get("result") is None:
        raise RpcError(f"no result: {str(reply.get('error'))[:200]}")
    return reply["result"]


def results_of(replies: object, bodies: list[dict]) -> list:
    """Results in the order of the requests; replies may come in any."""
    if not isinstance(replies, list):
        raise RpcError("a batch must be answered by a list")
    by_id = {r.get("id"): r for r in replies if isinstance(r, dict)}
    return [result_of(by_id.get(b["id"])) for b in bodies]


@dataclass(frozen=True)
class Retry:
    """Tries with a pause between; ``tries`` None: until it works."""

    tries: int | None = 3
    seconds: float = 3.0

    def __call__(self, action: Callable[[], object], sleep=time.sleep) -> object:
        errors: list[Exception] = []
        while self.tries is None or len(errors) < self.tries:
            if errors:
                sleep(self.seconds)
            try:
                return action()
            except Exception as e:  # noqa: BLE001 - any failure of a node is tried again
                errors = [*errors[-9:], e] if self.tries is None else [*errors, e]
        raise RpcError(f"gave up after {len(errors)} tries: {errors[-1]}") from errors[-1]


class RateLimit:
    """At most ``per_second`` requests in each second of the clock, over all endpoints."""

    def __init__(self, per_second: int | None, clock=time.monotonic):
        self.limit, self.clock, self.second, self.counts = per_second, clock, None, {}

    def count(self, endpoint: str, n: int = 1) -> None:
        now = int(self.clock())
        if now != self.second:
            self.second, self.counts = now, {}
        if self.limit is not None and sum(self.counts.values()) + n > self.limit:
            raise RpcError("too many requests in this second")
        self.counts[endpoint] = self.counts.get(endpoint, 0) + n


def in_chunks(bodies: list, size: int | None) -> Iterator[list]:
    size = size or max(1, len(bodies))
    return (bodies[i : i + size] for i in range(0, len(bodies), size))


@dataclass(frozen=True)
class Node:
    """Some endpoints, and how they are asked."""

    urls: tuple[str, ...]
    transport: Transport = http
    retry: Retry = Retry()
    max_behind: int = 5
    best_block_offset: int = 10
    max_batch: int | None = None

    def heights(self) -> dict[str, int]:
        """Of those endpoints that answer."""
        out = {}
        for url in self.urls:
            try:
                out[url] = int(str(result_of(self.transport(url, best_block()))), 16)
            except Exception:  # noqa: BLE001 - an endpoint that fails is just not healthy
                continue
        if not out:
            raise RpcError("no endpoint answers")
        return out

    def healthy(self) -> tuple[list[str], int]:
        """Endpoints near the highest, and the newest block to take: the least height
        among them, held back by the offset against reorganisations."""
        heights = self.retry(self.heights)
        best = max(heights.values())
        near = {u: h for u, h in heights.items() if h >= best - self.max_behind}
        return sorted(near), max(-1, min(near.values()) - self.best_block_offset)

    def ask(self, bodies: list[dict], seed: int = 0) -> list:
        urls, _ = self.healthy()
        out: list = []
        for k, chunk in enumerate(in_chunks(bodies, self.max_batch)):
            url = random.Random(seed + k).choice(urls)
            out += self.retry(lambda c=chunk, u=url: results_of(self.transport(u, c), c))
        return out

    def blocks(self, first: int, end: int) -> Iterator[tuple[int, str, str]]:
        """Number, block and receipts (both JSON) of [first, end)."""
        numbers = range(first, end)
        bodies = [f(n, 2 * (n - first) + k) for n in numbers for k, f in enumerate((block_by_number, block_receipts))]
        found = self.ask(bodies, first)
        for i, n in enumerate(numbers):
            yield n, json.dumps(found[2 * i]), json.dumps(found[2 * i + 1])


# -- Spark source -------------------------------------------------------------------------


@dataclass
class BlockRange(InputPartition):
    first: int
    end: int


class _Batch(DataSourceReader):
    def __init__(self, node: Node, first: int, end: int, step: int):
        self.node, self.first, self.end, self.step = node, first, end, step

    def partitions(self) -> list[BlockRange]:
        return [BlockRange(a, min(self.end, a + self.step)) for a in range(self.first, self.end, self.step)]

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        yield from self.node.blocks(partition.first, partition.end)


class _Follow(DataSourceStreamReader):
    """Follows the tip. The driver only asks for the tip and deals ranges of blocks;
    executors fetch them.

    A trigger takes up to ``step`` blocks, in ``TASKS`` ranges. The first one after a
    restart goes up to the tip, as Spark doesn't tell a source where it is going on; its
    ranges have no more blocks than others.
    """

    TASKS = 8

    def __init__(self, node: Node, first: int, end: int | None, step: int):
        self.node, self.first, self.end, self.step = node, first, end, step
        self.at: int | None = None

    def initialOffset(self) -> dict:
        self.at = self.first
        return {"block": self.first}

    def latestOffset(self) -> dict:
        limits = [self.node.healthy()[1] + 1]
        limits += [self.end] * (self.end is not None) + [(self.at or 0) + self.step] * (self.at is not None)
        self.at = max(min(limits), self.first, self.at or 0)
        return {"block": self.at}

    def partitions(self, start: dict, end: dict) -> list[BlockRange]:
        first, end, size = int(start["block"]), int(end["block"]), max(1, -(-self.step // self.TASKS))
        self.at = max(self.at or 0, end)
        return [BlockRange(a, min(end, a + size)) for a in range(first, end, size)]

    def read(self, partition: BlockRange) -> Iterator[tuple]:
        yield from self.node.blocks(partition.first, partition.end)


class RpcSource(DataSource):
    """``format("blockrpc")`` with options ``node`` (a registered name), ``startingBlock``,
    ``endingBlock`` (exclusive; needed for batch reads) and ``blocksPerBatch``."""

    nodes: dict[str, Node] = {}

    @classmethod
    def name(cls) -> str:
        return "blockrpc"

    def schema(self) -> str:
        return SCHEMA

    def _bounds(self) -> tuple[Node, int, int | None, int]:
        o = self.options
        node = self.nodes[o["node"]] if "node" in o else Node(tuple(o["urls"].split(",")))
        end = o.get("endingBlock")
        return node, int(o.get("startingBlock", 0)), None if end is None else int(end), int(o.get("blocksPerBatch", 100))

    def reader(self, schema) -> DataSourceReader:
        node, first, end, step = self._bounds()
        return _Batch(node, first, node.healthy()[1] + 1 if end is None else end, step)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follow(*self._bounds())


def source_for(node: Node) -> type[RpcSource]:
    """A source class that carries its node with it, to register with a session."""
    return type("RpcSourceForNode", (_Carrying,), {"node": node})


class _Carrying(RpcSource):
    node: Node

    def _bounds(self):
        o = self.options
        end = o.get("endingBlock")
        return self.node, int(o.get("startingBlock", 0)), None if end is None else int(end), int(o.get("blocksPerBatch", 100))
