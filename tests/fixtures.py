"""A small chain in plain Python, and matching by brute force."""

from __future__ import annotations

import random
from decimal import Decimal

from blockspan.plans.compile import Tables
from blockspan.schema import BLOCKS, LOGS, TRANSACTIONS


def filler(schema, row):
    """A value for every column that may not be null."""
    kinds = {"binary": b"\1", "bigint": 1, "decimal(20,0)": None}
    return tuple(row.get(f.name, None if f.nullable else kinds.get(f.dataType.simpleString())) for f in schema)


def h(i, n=32):
    return int(i).to_bytes(n, "big")


def chain(seed=1, n_blocks=12):
    r = random.Random(seed)
    blocks, txs, logs = [], [], []
    for b in range(n_blocks):
        blocks.append({"number": b, "hash": h(b), "miner": h(b, 20), "nonce": 2**64 - 1 if b == 3 else None})
        for i in range(0 if b == 5 else r.randint(1, 20)):
            data = r.choice([b"", b"abc", b"abcd", b"wxyz" + b"1" * 3])
            txs.append(
                {"block_number": b, "transaction_index": i, "nonce": i, "source": r.choice([None, *(h(x, 20) for x in range(4))]), "dest": r.choice([None, *(h(x, 20) for x in range(4))])}
                | {"status": r.choice([None, 0, 1]), "input": data, "sighash": data[:4] if len(data) >= 4 else None, "hash": h(1000 * b + i), "value": b"\xff" * 32}
            )
            if r.random() < 0.5:
                topics = [h(r.randint(0, 3)) for _ in range(r.randint(0, 4))]
                logs.append({"block_number": b, "log_index": len(logs), "transaction_index": i, "address": h(r.randint(0, 4), 20), **{f"topic{k}": t for k, t in enumerate(topics)}})
    logs.append({"block_number": 5, "log_index": 999, "transaction_index": 77, "address": h(0, 20)})  # no parent
    return blocks, txs, logs


def tables(spark, data):
    frames = []
    for rows, schema in zip(data, (BLOCKS, TRANSACTIONS, LOGS), strict=True):
        out = []
        for row in rows:
            row = {"nonce": 0, **row} if schema is TRANSACTIONS else row
            out.append(tuple(Decimal(v) if f.dataType.simpleString() == "decimal(20,0)" and v is not None else v for f, v in zip(schema, filler(schema, row), strict=True)))
        frames.append(spark.createDataFrame(out, schema))
    return Tables(*frames)


def log_hit(s, x, literal=False):
    if s.address and x["address"] not in s.address:
        return False
    for i, values in enumerate(s.topics):
        t = x.get(f"topic{i}")
        if values and t not in values and not (literal and t is None):
            return False
    return True


def tx_hit(s, x, literal=False):
    a, b = x["source"] in s.source, x["dest"] in s.dest
    if (s.source or s.dest) and not ((a and b) if literal else (a or b)):
        return False
    if s.sighash and x["sighash"] not in s.sighash or literal and x["sighash"] is None:
        return False
    return s.status is None or x["status"] is None or x["status"] == s.status


def brute(data, q, literal=False):
    """Keys of matched blocks, transactions and logs."""
    blocks, txs, logs = data
    inside = lambda n: n >= q.first and (q.end is None or n < q.end)
    ml = [x for x in logs if inside(x["block_number"]) and any(log_hit(s, x, literal) for s in q.logs)]
    parents = {(x["block_number"], x["transaction_index"]) for x in ml}
    key = lambda x: (x["block_number"], x["transaction_index"])
    mt = [x for x in txs if inside(x["block_number"]) and (key(x) in parents or any(tx_hit(s, x, literal) for s in q.transactions))]
    numbers = {x["block_number"] for x in ml + mt}
    mb = [x["number"] for x in blocks if inside(x["number"]) and (q.include_all_blocks or x["number"] in numbers)]
    return sorted(mb), sorted(map(key, mt)), sorted((x["block_number"], x["log_index"]) for x in ml)
