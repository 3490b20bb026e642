import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from blockspan.llm.packing import cut, pack, patterns, slots
from blockspan.llm.token_counts import token_counts
from blockspan.llm.words import PRETOKEN, Encoder, _begins

NAME = "byte_bpe_50k.json"
ODD = ["", None, " ", "\n\n  x", "a<|endoftext|>b <|endoftext|>", "日本語 text ½²", "naïve — “quoted” 𝒳", "x" * 900, " \x85\xa0\x1c 's'll", "it's we'll 12345   \t end  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def texts(seed, n):
    r = random.Random(seed)
    chars = " \n\t'sStrevmldD019²_-!\x85\xa0\x1cabcxyzéßñ" + "日’“<|>"
    words = ["the", " of", " naïve", "'ll", "<|endoftext|>", " 12", "\n", "  ", "…", " inter", "nation"]
    return ["".join(r.choice(words) if r.random() < 0.5 else r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_encoder_is_the_library(library):
    every = texts(1, 1500) + [x or "" for x in ODD]
    e = Encoder(public_tokenizers.path(NAME), max_memory=50)
    got = e.encode(every, at_once=300)
    for t, x in zip(every, got, strict=True):
        assert np.frombuffer(x, e.dtype).tolist() == ids(library, t), repr(t)


def test_words_need_no_second_split(library, monkeypatch):
    """A space and letters go to the model as they are, not through the library's split."""
    words = ["a", "naïve", "Ærø", "ªº", "ǅ", "ɏ", "straße", "İ"]
    e, seen = Encoder(public_tokenizers.path(NAME)), []
    monkeypatch.setattr(e, "_encoded", lambda texts, f=e._encoded: (seen.extend(texts), f(texts))[1])
    every = ["".join(f" {x}" for x in words[i:] + words[:i]) for i in range(len(words))]
    for t, x in zip(every, e.encode(every), strict=True):
        assert np.frombuffer(x, e.dtype).tolist() == ids(library, t), repr(t)
    assert not seen


def test_no_pretoken_needs_a_second_split(library, monkeypatch):
    """Pretokens of all kinds, not words alone, go to the model as they are."""
    e, seen = Encoder(public_tokenizers.path(NAME)), []
    monkeypatch.setattr(e, "_encoded", lambda texts, f=e._encoded: (seen.extend(texts), f(texts))[1])
    every = ["Word\n\n  it's 12345 — ½ \x00\x1f!!? \xa0“x”", "'s'll\r\n\t'", "z" * 900, "Größe  ÿ\x85"]
    for t, x in zip(every, e.encode(every), strict=True):
        assert np.frombuffer(x, e.dtype).tolist() == ids(library, t), repr(t)
    assert not seen


@pytest.mark.parametrize("seed", range(4))
def test_begins_are_those_of_the_expression(seed):
    """The ends of texts too: nothing of the next text moves a boundary."""
    r = random.Random(seed)
    parts = ["'s", "'ll", "'re", "'", " '", "''", "  ", "\n ", "\xa0", "\x85 ", "l", "e", "s", "é", "ɏ", "9", "½", " ", "\t", "-", "’", "₿", "\x00"]
    for _ in range(600):
        every = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(r.randint(1, 12))]
        ends = np.cumsum([0, *(len(x.encode()) for x in every)])
        raw = "".join(every).encode()
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        at = _begins(raw, first).tolist() if raw else []
        assert [raw[a:b].decode() for a, b in zip(at, at[1:])] == [w for x in every for w in PRETOKEN.findall(x)]


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_encoder_takes_columns(library, at_once):
    every = [*ODD, *texts(3, 200), "", None, *ODD]
    e = Encoder(public_tokenizers.path(NAME), max_memory=30, max_word=5)
    for column in (pa.array(every), pa.array(every).slice(3, 190), pa.array(every, pa.large_string()), pa.array([], pa.string()), pa.array(["", None])):
        got = e.encode(column, at_once=at_once)
        assert [np.frombuffer(x, e.dtype).tolist() for x in got] == [ids(library, t) for t in column.to_pylist()]


def test_safe_alike_by_text_and_by_column():
    e = Encoder(public_tokenizers.path(NAME))
    every = ["", *map(chr, [*range(0xD800), *range(0xE000, 0x11000), 0x1F600]), "a<|endoftext|>", "<|endoftext|"]
    assert e._safe(pa.array(every)).tolist() == [e.safe(x) for x in every]


def test_boundaries_count_tokens(library):
    e = Encoder(public_tokenizers.path(NAME))
    for t in texts(2, 300):
        at, n = e.boundaries(t)
        assert (n[-1] if len(n) else 0) == len(ids(library, t)) and (at[-1] if len(at) else 0) == len(t)


@pytest.mark.parametrize("overlap", [20, 40])
def test_counts_with_chunks(spark, docs, library, overlap):
    long = ["".join(texts(s, 40)) for s in range(6)] + ["z" * 700 + " end", " " * 300 + "a" * 50, "<|endoftext|>" * 60]
    rows = list(enumerate([*ODD, *long])) + [(None, "null id"), (3, "\n\n  x")]
    got = sorted(token_counts(docs(rows), chunk_chars=4 * overlap, overlap=overlap).collect(), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(ids(library, t)), n > 512) for i, t in rows], key=lambda r: f"Row(doc_id={r[0]}, n_bytes={r[1]}, n_tokens={r[2]}, over_limit={r[3]})")
    assert [tuple(r) for r in got] == want


def test_counts_of_nothing(docs):
    assert token_counts(docs([])).count() == 0


def test_cut():
    assert cut(5, 10) == [(0, 5)] and cut(20, 10) == [(0, 10), (10, 10)] and cut(23, 10) == [(0, 3), (3, 10), (13, 10)] and cut(0, 10) == [(0, 0)]


def test_patterns_are_close_to_the_bound():
    r = np.random.default_rng(5)
    counts = np.bincount(r.integers(1, 1025, 50_000), minlength=1025)
    made = patterns(counts, 1024)
    used = np.zeros_like(counts)
    for items, times in made:
        assert sum(items) <= 1024
        np.add.at(used, items, times)
    assert (used == counts).all()
    bound = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(t for _, t in made) <= 1.01 * bound


def test_two_for_the_smallest():
    counts = np.zeros(101, np.int64)
    counts[[60, 30, 21, 19]] = 1  # greedy: 60 + 30; 21 + 19 fill the gap of 40 wholly
    assert patterns(counts, 100)[0] == ([60, 21, 19], 1)
    assert len(slots(patterns(counts, 100))["rank"]) == 4


def test_pack(docs, library):
    rows = list(enumerate([*ODD, *texts(7, 200), "word " * 5000])) + [(None, "null id"), (3, "\n\n  x")]
    got = pack(docs(rows), capacity=256, with_ids=True).toPandas()
    want = sorted(len(ids(library, t)) + 1 for _, t in rows)
    assert sorted(got.groupby(["doc_id", "start", "ids_crc32"], dropna=False).length.count())[-1] >= 1
    assert got.length.sum() == sum(want) and got.length.max() <= 256
    for _, bin_ in got.groupby("sequence_id"):
        bin_ = bin_.sort_values("offset")
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 256
    assert all(zlib.crc32(x) == c and len(x) == 4 * n for x, c, n in zip(got.ids, got.ids_crc32, got.length, strict=True))
    whole = got[got.doc_id == 210].sort_values("start").ids.sum()
    assert np.frombuffer(whole, "<u4").tolist() == ids(library, "word " * 5000) + [2]
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 256) + 1


def test_pack_nothing(docs):
    assert pack(docs([])).count() == 0


def test_large_ids_beside_nulls(spark, docs, library):
    big = (1 << 53) + 1
    rows = [(None, "null"), (big, "one " * 90), (big + 2, "two"), (big + 4, None), (big + 4, None)]
    clash = "doc_id long, text string, id string, key int, n_bytes string, chunk int, length string, block int, nth int, piece string, ids int"
    df = spark.createDataFrame([(*r, "x", 1, "y", 2, "z", 3, 4, "p", 5) for r in rows], clash).coalesce(1)
    want = sorted([(i, len(ids(library, t))) for i, t in rows], key=str)
    for chunk_chars, overlap in ((1000, 50), (60, 30)):
        got = token_counts(df, chunk_chars=chunk_chars, overlap=overlap).collect()
        assert sorted([(r.doc_id, r.n_tokens) for r in got], key=str) == want
    assert sorted([(r.doc_id, r.length - 1) for r in pack(df).collect()], key=str) == want


def one_by_one(lengths, capacity):
    """Best-two-fit, a bin at a time, over a plain list of documents."""
    left, bins = sorted(lengths, reverse=True), []
    while left:
        items, gap = [], capacity
        while fit := next((x for x in left if x <= gap), None):
            left.remove(fit)
            items.append(fit)
            gap -= fit
        if gap and len(items) > 1:
            room, best = gap + items[-1], items[-1]
            pairs = [(left[i] + left[j], left[j], left[i]) for i in range(len(left)) for j in range(i + 1, len(left)) if best < left[i] + left[j] <= room]
            if pairs:
                most = max(p[0] for p in pairs)
                pair = min(p for p in pairs if p[0] == most)
                left = sorted([*left, items.pop()], reverse=True)
                for x in pair[1:]:
                    left.remove(x)
                    items.append(x)
        bins.append(sorted(items, reverse=True))
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_patterns_are_best_two_fit_one_by_one(seed):
    r = random.Random(seed)
    lengths = [r.choice((r.randint(1, 40), r.randint(1, 12))) for _ in range(r.randint(1, 90))]
    made = [items for items, times in patterns(np.bincount(lengths, minlength=41), 40) for _ in range(times)]
    want = one_by_one(lengths, 40)
    assert sorted(x for b in made for x in b) == sorted(lengths)
    assert len(made) == len(want) and sorted(map(sum, made)) == sorted(map(sum, want))
