"""URL filters by a bit-parallel wildcard automaton (operator 2).

All rules run at once: their glob patterns are packed side by side into 64-bit words, a
bit for each place of each pattern (Shift-And with self-loops). A byte of a URL moves the
words of a whole batch of URLs one step by shifts and masks, whatever the number of
rules. ``*`` stands for any run of bytes without ``/``, ``**`` for any run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U = np.uint64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and a path that the URL's path must start with."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def globs(self) -> tuple[str, str]:
        return f"{self.host}{self.path}**", f"*.{self.host}{self.path}**"


RULES = (Rule("block", "net"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"))


class Automaton:
    """Which of many glob patterns match a byte string as a whole."""

    def __init__(self, patterns: list[str]):
        self.n = len(patterns)
        places: list[list[tuple[int | None, str]]] = []  # for each state: the byte that leads to it, its loop
        for p in patterns:
            states: list[tuple[int | None, str]] = [(None, "")]
            data, i = p.encode(), 0
            while i < len(data):
                if data[i : i + 1] == b"*":
                    loop = "any" if data[i : i + 2] == b"**" else "segment"
                    states[-1] = (states[-1][0], "any" if "any" in (loop, states[-1][1]) else "segment")
                    i += 2 if loop == "any" else 1
                else:
                    states.append((data[i], ""))
                    i += 1
            places.append(states)
        size = sum(map(len, places))
        self.words = max(1, -(-size // 64))
        self.step, self.loop = np.zeros((256, self.words), U), np.zeros((256, self.words), U)
        self.start = np.zeros(self.words, U)
        self.ends: list[tuple[int, U]] = []
        at = 0
        for states in places:
            self._set(self.start, at)
            for byte, loop in states:
                if byte is not None:
                    self._set(self.step[byte], at)
                for b in range(256) if loop else ():
                    if loop == "any" or b != ord("/"):
                        self._set(self.loop[b], at)
                at += 1
            self.ends.append(((at - 1) // 64, U(1 << (at - 1) % 64)))

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= U(1 << bit % 64)

    def matches(self, strings: list[bytes]) -> np.ndarray:
        """A row for each string, a column for each pattern."""
        lengths = np.array([len(s) for s in strings], np.int64)
        order = np.argsort(-lengths, kind="stable")
        states = np.tile(self.start, (len(strings), 1))
        joined = np.frombuffer(b"".join(strings), np.uint8)
        begin = np.cumsum(lengths) - lengths
        begin, sorted_lengths = begin[order], lengths[order]
        for i in range(int(lengths.max(initial=0))):
            live = int(np.searchsorted(-sorted_lengths, -i, side="left"))  # those longer than i
            byte, now = joined[begin[:live] + i], states[:live]
            moved = now << U(1)
            if self.words > 1:
                moved[:, 1:] |= now[:, :-1] >> U(63)
            # A first state has no step mask, so no pattern runs on into the next.
            states[:live] = moved & self.step[byte] | now & self.loop[byte]
        out = np.zeros((len(strings), self.n), bool)
        for j, (word, bit) in enumerate(self.ends):
            out[order, j] = states[:, word] & bit != 0
        return out


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, parts, 1), UPPER, LOWER), F.regexp_extract(text, parts, 2)


def filter_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """A row for each URL: id, ``host``, ``path``, ``rule``, ``verdict``.

    Of the rules that match, the longest wins (the first given among equally long ones).
    Where none does, ``rule`` is null and the verdict ``default``. A null URL and one
    without ``://`` have an empty host and path, which no rule matches. Null ids, repeated
    rows and other columns make no difference; an empty table gives an empty table.
    """
    ranked = sorted(rules, key=lambda r: -len(r.name))
    automaton = Automaton([g for r in ranked for g in r.globs])

    def which(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in urls:
            data = [x.encode("utf-8", "surrogatepass") for x in s]
            hit = automaton.matches(data).reshape(len(data), len(ranked), 2).any(2) if ranked else np.zeros((len(data), 1), bool)
            yield pd.Series(np.where(hit.any(1), hit.argmax(1), -1))

    find = F.pandas_udf(which, T.IntegerType())
    host, path = host_and_path(F.col(url_col))
    out = df.select(F.col(id_col), host.alias("host"), path.alias("path")).withColumn("k", find(F.concat("host", "path")))
    name = F.array(*(F.lit(r.name) for r in ranked)).cast("array<string>")
    verdict = F.array(*(F.lit(r.verdict) for r in ranked)).cast("array<string>")
    return out.select(
        id_col, "host", "path", F.when(F.col("k") >= 0, F.get(name, F.col("k"))).alias("rule"), F.coalesce(F.get(verdict, F.col("k")), F.lit(default)).alias("verdict")
    )
