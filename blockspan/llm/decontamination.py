"""Benchmark decontamination by pigeonhole edit matching (operator 4).

A passage of m characters may occur with up to e = floor(``error_rate`` * m) edits. Cut it
into e + 1 pieces: e edits leave one of them as it was. All pieces of all passages go into
one keyword automaton; where a document has one, the passage may begin as far before it as
the piece stands in it, give or take e. Such windows are verified with Myers' bit-parallel
edit distance, which also tells where the occurrence ends, and run backwards, where it
begins. Before the whole passage its part around the piece is verified: of neighbouring
pieces in groups, some group of p pieces has fewer than p edits, by the same argument.

Test items go to the tasks in blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SOLID = re.compile(r"\S+")
#: Pieces a group: four of them are some 40 characters, which fit a small integer.
GROUP = 4
#: The last matcher a worker made, by the name of its block.
_MATCHER: dict[str, "Matcher"] = {}


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def normal(text: str | None) -> str:
    """Lower case, white space as one space, none at the ends."""
    return " ".join(_lower(text or "").split())


def origins(text: str) -> np.ndarray:
    """The place in the text of each character of its normal form."""
    parts = []
    for m in _SOLID.finditer(text):
        if parts:
            parts.append([parts[-1][-1] + 1])
        parts.append(range(*m.span()))
    return np.concatenate([np.asarray(p) for p in parts]) if parts else np.zeros(0, np.int64)


def _masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edit_search(masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """Least edit distance between the pattern and any substring of the text, and the first
    place where such a substring ends; ``anchored`` ones begin where the text does."""
    full, top = (1 << m) - 1, 1 << m - 1
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        h = ((eq & up) + up ^ up) | eq
        plus, minus = down | ~(h | up) & full, up & h
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus = plus << 1 | anchored
        up, down = (minus << 1 | ~(x | plus)) & full, plus & x & full
        if score < best:
            best, end = score, j
    return best, end


def _apart(text: str, begin: int, end: int) -> bool:
    """Whether no word goes on across either end of this part of the text."""
    inside = lambda i: 0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum()
    return not inside(begin) and not inside(end)


class Matcher:
    """All passages of a block of items."""

    def __init__(self, items: list[tuple[object, str]], error_rate: float, max_chars: int):
        import ahocorasick

        self.passages: list[tuple[object, int, str, int]] = []  # item, part, text, errors
        self.groups: list[tuple[int, int, int, int, dict[str, int]]] = []  # passage, begin, end, errors, masks
        pieces: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            text = normal(text)
            n_parts = -(-len(text) // max_chars)
            cut = [len(text) * k // n_parts for k in range(n_parts + 1)] if n_parts > 1 else []
            for part, t in enumerate([text, *(text[a:b] for a, b in zip(cut, cut[1:], strict=False))] if text else ()):
                errors, i = int(error_rate * len(t)), len(self.passages)
                self.passages.append((key, part, t, errors))
                cuts = [len(t) * k // (errors + 1) for k in range(errors + 2)]
                for first in range(0, errors + 1, GROUP):
                    own = cuts[first : first + GROUP + 1]
                    for a, b in zip(own, own[1:], strict=False):
                        pieces.setdefault(t[a:b], []).append((len(self.groups), a))
                    self.groups.append((i, own[0], own[-1], len(own) - 2, _masks(t[own[0] : own[-1]])))
        self.masks = [_masks(p[2]) for p in self.passages]
        self.back = [_masks(p[2][::-1]) for p in self.passages]
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """Passage, distance, begin and end in a normal text; the best of each passage."""
        found, hits = [], set()
        for end, (size, places) in self.automaton.iter(text) if len(self.automaton) else ():
            for g, offset in places:
                hits.add((g, end + 1 - size - offset))
        starts: dict[int, set[int]] = {}
        for g, s in hits:
            i, a, b, errors, masks = self.groups[g]
            if not self.passages[i][3] and not _apart(text, s, s + b):
                continue  # short ones allow no edit, but must stand as words of their own
            if s not in starts.get(i, ()):
                if edit_search(masks, b - a, text[max(0, s + a - errors) : s + b + errors])[0] <= errors:
                    starts.setdefault(i, set()).add(s)
        for i, own in starts.items():
            _, _, t, errors = self.passages[i]
            windows: list[list[int]] = []
            for s in sorted(own):
                a, b = max(0, s - errors), s + len(t) + errors
                if windows and a <= windows[-1][1]:
                    windows[-1][1] = b
                else:
                    windows.append([a, b])
            best = None
            for a, b in windows:
                d, end = edit_search(self.masks[i], len(t), text[a:b])
                if d <= errors and (best is None or d < best[0]):
                    best = (d, a + end)
            if best:
                d, end = best
                _, size = edit_search(self.back[i], len(t), text[max(0, end - len(t) - errors) : end][::-1], anchored=True)
                found.append((i, d, end - size, end))
        return found


def _matcher(sent: Broadcast, *how) -> Matcher:
    name, items = sent.value
    if name not in _MATCHER:
        _MATCHER.clear()
        _MATCHER[name] = Matcher(items, *how)
    return _MATCHER[name]


def _hits(batches: Iterator[pa.RecordBatch], sent: Broadcast, how: tuple, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(sent, *how)
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for k, text in enumerate(batch["text"].to_pylist()):
            found = matcher.find(normal(text)) if text else ()
            place = origins(text) if found else ()
            for i, d, a, b in found:
                key, part, _, _ = matcher.passages[i]
                span = (int(place[a]), int(place[b - 1]) + 1) if b > a else (0, 0)
                for column, value in zip(rows, (k, key, part, d, *span), strict=True):
                    column.append(value)
        kinds = (pa.int64(), kind, pa.int32(), pa.int32(), pa.int64(), pa.int64())
        columns = [pa.array(c, t) for c, t in zip(rows, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch["id"].take(columns[0]), *columns[1:]], ["id", "item", "part", "distance", "span_start", "span_end"])


def _clean(batches: Iterator[pa.RecordBatch], sent: Broadcast, how: tuple, text_col: str) -> Iterator[pa.RecordBatch]:
    matcher = _matcher(sent, *how)
    for batch in batches:
        yield batch.filter(pa.array([not (t and matcher.find(normal(t))) for t in batch[text_col].to_pylist()], pa.bool_()))


def _blocks(items: DataFrame, item_col: str, item_text: str, block_chars: int) -> Iterator[Broadcast]:
    """The items in broadcasts of about ``block_chars`` characters."""
    spark = items.sparkSession
    items = items.select(F.col(item_col).alias("item"), F.col(item_text).cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-total // block_chars))
    for k in range(n):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
        rows = [tuple(r) for r in block.collect()]
        yield spark.sparkContext.broadcast((uuid.uuid4().hex, sorted(rows, key=lambda r: (str(r[0]), r[1]))))


def benchmark_hits(
    df: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    error_rate: float = 0.1,
    max_chars: int = 2_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """A row for each document and passage of a test item that it contains: id, the item,
    ``part``, ``distance``, ``span_start``, ``span_end``.

    Case and the amount of white space make no difference; beyond that up to ``error_rate``
    edits a character. Of several occurrences of a passage the nearest is reported, the
    first of equally near ones. Every item is matched as a whole (part 0); one of more than
    ``max_chars`` characters also in equal parts of at most that size (parts from 1), so
    that a piece of it in a document shows. An item so short that no edit is allowed must
    stand as words of its own; an empty or null one matches nothing. Null and
    empty documents have no hits, null ids stay null, repeated documents each have theirs,
    repeated items count once, other columns are not read, empty tables give no rows.
    """
    how = (error_rate, max_chars)
    field, kind = items.schema[item_col].dataType, df.schema[id_col].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {kind}, item {field.simpleString()}, part int, distance int, span_start long, span_end long"
    out = None
    for sent in _blocks(items, item_col, item_text, block_chars):
        hits = source.mapInArrow(lambda it, s=sent: _hits(it, s, how, to_arrow_type(field)), schema)
        out = hits if out is None else out.unionByName(hits)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(
    df: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    error_rate: float = 0.1,
    max_chars: int = 2_000,
    block_chars: int = 8_000_000,
) -> DataFrame:
    """The rows of ``df`` that contain no passage of a test item, as ``benchmark_hits`` has
    them; all columns pass through."""
    how = (error_rate, max_chars)
    for sent in _blocks(items, item_col, item_text, block_chars):
        df = df.mapInArrow(lambda it, s=sent: _clean(it, s, how, text_col), df.schema)
    return df
