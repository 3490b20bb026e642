"""Word sequences as numbers, and the banded alignment of two of them."""

from __future__ import annotations

import numpy as np

U = np.uint64
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = U(pow(int(_P), -1, 1 << 64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    h = h + U(seed * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(32))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(29))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(32))


class _Powers:
    """Powers of the multiplier and of its inverse, as far as they were needed."""

    up = down = np.ones(1, U)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up), 1 << 16)
            cls.up = np.cumprod(np.r_[U(1), np.full(size - 1, _P)], dtype=U)
            cls.down = np.cumprod(np.r_[U(1), np.full(size - 1, _P_INV)], dtype=U)
        return cls.up[:n], cls.down[:n]


def _hashed(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = _WORD[data]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    begin, end = edge[::2], edge[1::2]
    up, down = _Powers.upto(len(data) + 1)
    sums = np.r_[U(0), np.cumsum((data.astype(U) + U(1)) * down[:-1], dtype=U)]
    return (mix((sums[end] - sums[begin]) * up[begin], 1) >> U(32)).astype(np.uint32), begin, end


def words(text: str | None) -> np.ndarray:
    """A 32-bit number for each word: letters and digits, in lower case, of any script.

    Bytes of 128 and above count as letters. Equal words get equal numbers.
    """
    return _hashed(np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8))[0]


class Words:
    """The words of a text with their places in it."""

    def __init__(self, text: str | None):
        text = text or ""
        lower = text.lower()
        if len(lower) != len(text):  # a few letters grow when lowered
            lower = "".join(x if len(x := c.lower()) == 1 else c for c in text)
        self._data = np.frombuffer(lower.encode("utf-8", "surrogatepass"), np.uint8)
        self.ids, self._begin, self._end = _hashed(self._data)

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def lengths(self) -> np.ndarray:
        return self._end - self._begin

    def span(self, first: int, last: int) -> tuple[int, int]:
        """Characters from the first word to the last, the end exclusive."""
        chars = lambda b: int(np.count_nonzero((self._data[:b] & 0xC0) != 0x80))
        return chars(self._begin[first]), chars(self._end[last])


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit number for each k words in a row; a shorter sequence is one shingle."""
    if not len(w):
        return np.zeros(0, U)
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, U)
    for i in range(k):
        h = mix(h ^ w[i : i + n].astype(U), i + 1)
    return h


def common_subsequence(a: np.ndarray, b: np.ndarray, band: int, need: float = 0) -> int:
    """Length of the longest common subsequence whose matches lie within ``band`` of the
    diagonal; bit-parallel, some two band widths of bits a row. Where it can't be ``need``,
    any smaller number."""
    n = min(len(a), len(b))
    if not n:
        return 0
    differ = a[:n] != b[:n]
    head = int(differ.argmax()) if differ.any() else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if not n:
        return head
    differ = a[::-1][:n] != b[::-1][:n]
    tail = int(differ.argmax()) if differ.any() else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    # Elements that the other side lacks match nothing; their places still count for the band.
    a_shared = np.isin(a, b)
    if not a_shared.any() or head + tail + np.count_nonzero(a_shared) < need:
        return head + tail
    at = np.flatnonzero(np.isin(b, a))
    at = at[np.argsort(b[at], kind="stable")]
    cuts = np.r_[0, np.flatnonzero(np.diff(b[at])) + 1, len(at)]
    where = {int(b[at[x]]): at[x:y].tolist() for x, y in zip(cuts[:-1], cuts[1:], strict=True)}
    common: dict[int, int] = {}  # all places of elements that occur often, as bits
    # ``open_`` has the bits of the places from ``base`` to ``top``. Those before the band
    # never change again and are counted; those beyond it are still all set.
    open_, base, top, done = 0, 0, 0, 0
    for i in np.flatnonzero(a_shared).tolist():
        low, high = max(0, i - band), min(len(b), i + band + 1)
        if low - base > 4096:
            gone = min(low, top) - base
            done += gone - (open_ & (1 << gone) - 1).bit_count()
            open_, base = open_ >> gone, base + gone
            if base < low:
                base = top = low
        if high > top:
            more = min(len(b), high + 4096)
            open_, top = open_ | (1 << more - top) - 1 << top - base, more
        x = int(a[i])
        places = where[x]
        if len(places) <= 8:
            match = 0
            for j in places:
                if low <= j < high:
                    match |= 1 << j - base
        else:
            if x not in common:
                bits = np.zeros(len(b), np.uint8)
                bits[places] = 1
                common[x] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            match = common[x] >> low << low - base & (1 << high - base) - 1
        u = open_ & match
        if u:
            open_ = (open_ + u | open_ - u) & (1 << top - base) - 1
    return head + tail + done + top - base - open_.bit_count()


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shingles that align in order, over all places: m / (n_a + n_b - m).

    The band is what ``least`` leaves room for: at that similarity at most
    (n_a + n_b) (1 - least) / (1 + least) places stay unaligned. Below ``least`` the value
    may be too small, never too large.
    """
    total = len(a) + len(b)
    if not total or min(len(a), len(b)) < least * max(len(a), len(b)):
        return 0.0
    band = int(total * (1 - least) / (1 + least)) + 1
    m = common_subsequence(a, b, band, need=total * least / (1 + least) - 1e-6)
    return m / (total - m)
