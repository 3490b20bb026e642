"""Token ids by way of pretokens.

A byte-level BPE vocabulary splits a text into pretokens by one regular expression and
encodes each pretoken by itself, so the ids of a text are the ids of its pretokens in a
row. Corpora repeat their words; the library therefore encodes each distinct pretoken
once per worker, and texts are put together from that memory. Texts are split about
a megabyte at a time: where pretokens begin follows from the kinds of neighbouring
characters, so ``_begins`` finds it for a whole buffer at once, and Arrow tells the
pretokens apart and lays their ids in a row. What the expression below can't be proven to
split as the library does (letters past U+024F, added tokens in the text, other kinds of
vocabulary) goes to the library as it is.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .runtime import single_threaded_tokenizers, tokenizer_path

LATIN = range(0x250)
SPACE = "\t\n\x0b\x0c\r \x85\xa0"
#: Beyond LATIN, these blocks hold neither letters, numbers nor white space.
SYMBOLS = "‐-‧‰-⁞₠-₿"


def _of(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, LATIN) if unicodedata.category(c)[0] == kind)


_L, _N, _S = _of("L"), _of("N"), re.escape(SPACE)
PRETOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
)
KNOWN = re.compile(f"[\x00-ɏ{SYMBOLS}]*")
#: Kinds of characters: letters, numbers, white space; 0 is all else.
LETTER, NUMBER, WHITE = 1, 2, 3


def _kind(c: str) -> int:
    return WHITE if c in SPACE else {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], 0)


_KINDS = np.array([_kind(chr(c)) for c in LATIN], np.uint8)
_ASCII = bytes(_KINDS[:128]) + bytes(128)


def _begins(raw: bytes, first: np.ndarray) -> np.ndarray:
    """Where each pretoken begins in the UTF-8 of safe texts that stand in a row, as PRETOKEN
    splits them, and the end of it all; ``first`` marks where a text begins and the end.

    Runs of one kind are pretokens, but: the last character of white space before another
    kind stands alone, or opens the next pretoken if it is a space; and a contraction, where
    a pretoken would begin, ends after its letters.
    """
    at, n = np.frombuffer(raw + b"\0\0", np.uint8), len(raw)
    kind = np.frombuffer(bytearray(raw.translate(_ASCII)), np.uint8)
    two = np.flatnonzero((at >= 0xC2) & (at < 0xE0))
    kind[two] = kind[two + 1] = _KINDS[(at[two] & 0x1F).astype(np.int64) << 6 | at[two + 1] & 0x3F]
    begins = first.copy()
    begins[1:n] |= kind[1:] != kind[:-1]
    after = np.flatnonzero((kind[:-1] == WHITE) & begins[1:n] & ~first[1:n]) + 1
    last = at[after - 1]
    begins[after - 1 - (last >= 0x80)] = True
    begins[after[last == 0x20]] = False
    quote = np.flatnonzero(begins[:n] & (at[:n] == 0x27))
    quote = quote[~first[quote + 1]]
    a, b = at[quote + 1], at[quote + 2]
    pair = np.isin(a.astype(np.uint16) << 8 | b, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")]) & ~first[quote + 2]
    length = np.where(np.isin(a, list(b"stmd")), 2, np.where(pair, 3, 0))
    quote, length = quote[length > 0], length[length > 0]
    begins[quote + 1] = False
    begins[quote + length] = True
    return np.flatnonzero(begins).astype(np.int32)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: as themselves if they show, else past U+00FF."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()
_WRITTEN = np.array([ord(_LETTERS[b]) for b in range(256)], "<u4")
#: Bytes that UTF-8 never has.
_NEVER = (0xC0, 0xC1, *range(0xF5, 0x100))


def _mark(model: dict) -> int | None:
    """A byte that no text has and no merge touches. Words with it between them are encoded in
    one go as each by itself, as a merge only joins neighbours."""
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if model["type"] != "BPE" or any(model.get(x) for x in odd):
        return None
    merged = set("".join(x if isinstance(x, str) else "".join(x) for x in model["merges"]))
    return next((b for b in _NEVER if _LETTERS[b] in model["vocab"] and _LETTERS[b] not in merged), None)


class Encoder:
    """Ids of whole texts, without added special tokens.

    ``max_memory`` bounds the number of remembered pretokens; beyond it the memory starts
    anew, with the one before beside it, from which words that come again are taken over.
    What both have forgotten is encoded again, which costs time and changes nothing else.
    """

    _open: dict[str, "Encoder"] = {}

    def __init__(self, path: str, max_memory: int = 300_000, max_word: int = 64):
        from tokenizers import Tokenizer

        single_threaded_tokenizers()
        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, self.added)) or r"(?!)")
        split = spec["pre_tokenizer"] or {}
        self.plain = (
            spec["normalizer"] is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        # The same model, for pretokens that are written as bytes already.
        self.model = Tokenizer(self.library.model)
        self.mark = _mark(spec["model"]) if self.plain else None
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.memory: dict[bytes, bytes] = {}
        self.former: dict[bytes, bytes] = {}
        self.max_memory, self.max_word = max_memory, max_word

    @classmethod
    def of(cls, name: str) -> "Encoder":
        """One for each worker process and vocabulary."""
        if name not in cls._open:
            cls._open[name] = cls(name if "/" in name else tokenizer_path(name))
        return cls._open[name]

    def safe(self, text: str) -> bool:
        """Whether PRETOKEN splits this text as the library does."""
        if not self.plain or any(x in text for x in self.added):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return KNOWN.fullmatch(text) is not None
        return True

    def _bytes(self, ids) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct pretokens, remembered or new."""
        if len(self.memory) > self.max_memory:
            self.former, self.memory = self.memory, {}
        found = list(map(self.memory.get, words))
        todo = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in todo:
            if (x := self.former.get(words[i])) is None:
                new.append(i)
            else:
                found[i] = self.memory[words[i]] = x
        for i, x in zip(new, self.learn([words[i] for i in new]), strict=True):
            found[i] = x
            if len(words[i]) <= self.max_word:
                self.memory[words[i]] = x
        return found

    def learn(self, words: list[bytes], at_once: int = 100) -> list[bytes]:
        """The ids of pretokens by the library, many a call."""
        if self.mark is None:
            return [self._bytes(e.ids) for e in self._encoded([w.decode() for w in words])]
        if not words:
            return []
        mark = bytes([self.mark])
        lines = (mark.join([*words[i : i + at_once], b""]) for i in range(0, len(words), at_once))
        written = [_WRITTEN[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in lines]
        ids = np.concatenate([np.array(e.ids, self.dtype) for e in self.model.encode_batch_fast(written, add_special_tokens=False)])
        ends = np.flatnonzero(ids == self.model.token_to_id(_LETTERS[self.mark]))
        raw, size = ids.tobytes(), self.dtype.itemsize
        return [raw[a:b] for a, b in zip([0, *((ends[:-1] + 1) * size).tolist()], (ends * size).tolist(), strict=True)]

    def _encoded(self, texts: list[str]) -> list:
        return self.library.encode_batch_fast(texts, add_special_tokens=False)

    def _safe(self, texts: pa.Array) -> np.ndarray:
        """``safe`` of each text."""
        if not self.plain:
            return np.zeros(len(texts), bool)
        added = (re.sub(r"([!-/:-@\[-^`{-~])", r"\\\1", x) for x in self.added)
        odd = "|".join([rf"[^\x{{0}}-\x{{24F}}{SYMBOLS}]", *added])
        return ~pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)

    def _texts(self, raw: bytes, ends: np.ndarray) -> list[bytes]:
        """Ids of safe texts that stand in a row; ``ends`` has 0 and where each ends."""
        first = np.zeros(len(raw) + 1, bool)
        first[ends] = True
        begins = _begins(raw, first)
        words = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(begins), pa.py_buffer(raw)]).dictionary_encode()
        ids = pa.array(self.ids(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        places = np.frombuffer(ids.buffers()[1], np.int64)[np.searchsorted(begins, ends)].tolist()
        data = ids.buffers()[2].to_pybytes()
        return [data[a:b] for a, b in zip(places, places[1:])]

    def encode(self, texts: pa.Array | Iterable[str | None], at_once: int = 1 << 20) -> list[bytes]:
        """Little-endian ids of each text, in ``dtype``; some ``at_once`` bytes of text at a time."""
        column = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())
        column = column.cast(pa.large_string()).fill_null("")
        safe = self._safe(column)
        out: list[bytes] = [b""] * len(column)
        odd = np.flatnonzero(~safe)
        for i, text in zip(odd.tolist(), column.take(pa.array(odd)).to_pylist(), strict=True):
            out[i] = self._bytes(self.library.encode(text, add_special_tokens=False).ids)
        rows, column = np.flatnonzero(safe), column.filter(pa.array(safe))
        if not len(rows):
            return out
        _, places, data = column.buffers()
        places = np.frombuffer(places, np.int64)[column.offset : column.offset + len(column) + 1]
        start = 0
        while start < len(rows):
            stop = max(start + 1, int(np.searchsorted(places, places[start] + at_once, side="right")) - 1)
            ends = places[start : stop + 1] - places[start]
            if ends[-1]:
                raw = data.slice(int(places[start]), int(ends[-1])).to_pybytes()
                for i, x in zip(rows[start:stop].tolist(), self._texts(raw, ends), strict=True):
                    out[i] = x
            start = stop
        return out

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pretokens in characters, and the number of tokens up to each."""
        words: list[str] = []
        at = 0
        for m in [*self.special.finditer(text), None]:
            piece = text[at : m.start() if m else len(text)]
            if self.safe(piece):
                words += PRETOKEN.findall(piece)
            elif piece:
                words += [piece[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(piece)]
            if m:
                words.append(m[0])
                at = m.end()
        distinct = [w for w in dict.fromkeys(words) if w not in self.added]
        sizes = {x: len(self.library.encode(x, add_special_tokens=False).ids) for x in self.added}
        sizes |= {w: len(x) // self.dtype.itemsize for w, x in zip(distinct, self.ids([w.encode() for w in distinct]), strict=True)}
        return np.cumsum([len(w) for w in words], dtype=np.int64), np.cumsum([sizes[w] for w in words], dtype=np.int64)
