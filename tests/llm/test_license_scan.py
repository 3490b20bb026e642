import pytest
import re
import random

import numpy as np

from blockspan.llm.license_scan import TEMPLATES, Index, align, grams, license_scan, scan, winnow
from blockspan.llm.sequences import Words

R = random.Random(8)


def noise(n):
    return " ".join("".join(R.choice("abcdefg") for _ in range(4)) for _ in range(n))


def test_winnow_keeps_one_of_each_window():
    h = np.random.default_rng(0).integers(0, 1 << 60, 200).astype(np.uint64)
    at = winnow(h, 4)
    assert all(any(i <= x < i + 4 for x in at) for i in range(197)) and len(winnow(h[:0], 4)) == 0 and len(winnow(h[:2], 4)) == 1


def test_align():
    n = lambda *x: np.array(x, np.uint32)
    assert align(n(9, 1, 2, 3, 9), n(1, 2, 3), 2) == (3, 1, 3)
    assert align(n(1, 9, 1, 2, 8, 3), n(1, 2, 3), 3) == (3, 2, 5)
    assert align(n(7, 8), n(1, 2, 3), 2)[0] == 0


def test_scan(docs):
    mit, notice = TEMPLATES["MIT-grant"], TEMPLATES["MIT-notice"]
    words = mit.split()
    worn = " ".join(w for i, w in enumerate(words) if i % 15)
    half = " ".join(words[:25])
    rows = [
        (1, noise(30) + "\n" + mit.upper() + "\n" + noise(10)), (2, worn), (3, half), (4, noise(500)), (5, None), (6, ""), (7, notice + noise(5) + " " + notice),
        (None, notice), (8, "İé " + noise(20_000) + " " + TEMPLATES["CC-BY-NC-4.0-notice"]), (7, notice),
    ]
    got = license_scan(docs(rows)).collect()
    found = sorted(((r.doc_id, r.license) for r in got), key=str)
    assert found == sorted([(1, "MIT-grant"), (2, "MIT-grant"), (7, "MIT-notice"), (7, "MIT-notice"), (7, "MIT-notice"), (8, "CC-BY-NC-4.0-notice"), (None, "MIT-notice")], key=str)
    by = {(r.doc_id, r.license): r for r in got}
    one = by[1, "MIT-grant"]
    assert one.coverage == 1.0 and rows[0][1][one.span_start : one.span_end].lower().startswith("permission is") and rows[0][1][: one.span_end].endswith("CONDITIONS")
    last = by[8, "CC-BY-NC-4.0-notice"]
    assert rows[8][1][last.span_start : last.span_end] == "Licensed under CC BY-NC 4.0"
    assert 0.8 < by[2, "MIT-grant"].coverage < 1
    assert license_scan(docs([])).count() == 0


def test_no_template_hides_in_the_index():
    index = Index(TEMPLATES, 3, 4)
    for name, t in TEMPLATES.items():
        h = grams(Words(t).ids, 3)
        assert any(int(x) in index.places for x in h), name


def test_changed_words_leave_a_candidate():
    index = Index(TEMPLATES, 3, 4)
    for text in ("Released under MIT License.", "Released under an MIT License."):
        assert ("MIT-notice", 0.8) in [f[:2] for f in scan(noise(20) + " " + text + " " + noise(20), index, 0.8)]
    for t, template in enumerate(index.words):
        own, size = TEMPLATES[index.names[t]], len(template)
        words, allowed = "".join(c if c.isalnum() else " " for c in own).split(), size - -(-size * 4 // 5)
        assert len(words) == size
        evenly = {(i + 1) * size // (allowed + 1) for i in range(allowed)}
        for changed in (evenly, *(set(R.sample(range(size), allowed)) for _ in range(5))):
            body = " ".join("qqq" if i in changed else x for i, x in enumerate(words))
            text = noise(20) + " " + body + " " + noise(20)
            matched = align(Words(body).ids, template, size)[0]
            assert matched >= 0.8 * size
            assert any(n == index.names[t] and c == matched / size for n, c, *_ in scan(text, index, 0.8)), (index.names[t], changed)


def test_headers_are_found():
    index = Index(TEMPLATES, 3, 4)
    gnu = "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    text = f"This program is free software: you can redistribute it and/or modify it {gnu} " + TEMPLATES["GPL-3.0-header"].split("later version. ")[1]
    assert ("GPL-3.0-header", 1.0) in [f[:2] for f in scan(text, index, 0.8)]


def whole_scan(text, template):
    """Words of a template that a text has in order: a table over the whole text."""
    a, b = (re.findall(r"[0-9a-z\x80-\U0010ffff]+", x.lower()) for x in (text, template))
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(row[j], new[-1], row[j - 1] + 1 if x == y else 0))
        row = new
    return row[-1] / len(b)


def test_finds_are_brute_force(spark):
    r = random.Random(12)
    names, vocabulary = list(TEMPLATES), [f"v{i}" for i in range(200)]
    rows = []
    for i in range(60):
        words = TEMPLATES[r.choice(names)].split()
        for _ in range(r.randint(0, len(words) // 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        around = [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40))) for _ in "ab"]
        rows.append((i, f"{around[0]} {' '.join(words)} {around[1]}", i, "x", 1.0, i))
    clash = spark.createDataFrame(rows, "doc_id long, text string, nth int, license string, coverage double, span_start int")
    got = {}
    for x in license_scan(clash).collect():
        got[x.doc_id, x.license] = max(x.coverage, got.get((x.doc_id, x.license), 0))
    whole, near = {}, {}
    for i, text, *_ in rows:
        words = text.split()
        for name, t in TEMPLATES.items():
            if (c := whole_scan(text, t)) >= 0.8:
                # Anywhere in the text is too much (a notice's words, strewn over a header);
                # as many words in a row as the template has are what must be found.
                n = len(t.split())
                whole[i, name] = c
                near[i, name] = max(whole_scan(" ".join(words[k : k + n]), t) for k in range(max(1, len(words) - n + 1)))
    must = {k: c for k, c in near.items() if c >= 0.8}
    assert must.keys() <= got.keys() <= whole.keys() and len(must) > 30
    assert all(must.get(k, 0) - 1e-9 <= c <= whole[k] + 1e-9 for k, c in got.items())
    assert license_scan(clash, templates={}).count() == 0 and license_scan(clash.limit(0)).count() == 0
    with pytest.raises(ValueError, match="fewer than 3 words"):
        license_scan(clash, templates={"a": "two words"})
