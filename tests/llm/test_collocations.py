"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import collocations as co

ODD = "".join(chr(c) for c in (1, 0x1C, 0x1F, 0x7F)) + "é"


def brute(rows, least, best, cover):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = lang or "und"
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            for m in (1, 2, 3):
                f.update(tuple(words[i:i + m]) for i in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in found.items():
            for part in (p[:2], p[1:]) if len(p) == 3 else ():
                longer[part] = max(longer.get(part, 0), a)
        scored = []
        for p, a in found.items():
            if len(p) == 2 and 100 * longer.get(p, 0) >= cover * a:
                continue
            s, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -s))
    return sorted(out)


def sample(n=160, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "of", "and", "New", "york", "city", "a\x01b", "a", "größe", "x-y", "日本", ODD, "<|x|>"]
    rows = [(None, None), ("en", ""), (None, "."), ("en", "   \t "), ("und", "new york city. " * 30), ("de", "w" * 5000 + " " + "lang" * 400), ("xx", "hot hot hot hot " * 50)]
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", " \r ", "!"]) for _ in range(rng.randint(1, 120)))
        rows.append((rng.choice(["en", "en", "de", None, "fr"]), text))
    return rows + rows[-20:]


@pytest.mark.parametrize(("least", "best", "block", "part", "fan"), [(10, 2000, co.BLOCK, co.PART, co.FAN), (3, 7, 64, 4, 1), (2, 50, 300, 64, 2)])
def test_equals_plain_counting(spark, least, best, block, part, fan):
    rows = sample()
    frame = spark.createDataFrame([(i, lang, text, "x", 1, b"") for i, (lang, text) in enumerate(rows)], "block long, lang string, text string, word string, n long, salt binary").repartition(3)
    got = co.collocations(frame, least, best, block=block, part=part, fan=fan).collect()
    assert sorted(map(tuple, got)) == brute(rows, least, best, 50)


def test_large_products_are_exact(spark):
    a, left, right = 3_000_000_017, 3_000_000_019, 3_000_000_021
    got = spark.sql(f"SELECT {co._score('a', 'l', 'r')} AS s FROM VALUES ({a}L, {left}L, {right}L) AS t(a, l, r)").first().s
    assert got == 1_000_000 * a * a // (left * right)


@pytest.mark.parametrize("bits", [1, 7, 21, 22, 32])
def test_filters_keep_every_phrase(bits):
    rng = np.random.default_rng(bits)
    top = 1 << bits
    ids = rng.integers(0, min(top, 40), (3, 5000)).astype(np.uint64) + np.uint64(max(0, top - 40))
    rest = ids[1] | (ids[2] << np.uint64(bits))
    quotient = co.permuted(ids[0], rest, bits)
    assert np.array_equal(co.first_of(quotient, rest, bits), ids[0])
    q, r, n = co.counted(quotient, rest, None, bits)
    n = n * np.where(np.arange(len(n)) % 3 == 0, 10**12, 1)
    back = co.unpack(co.pack(q, r, n, bits), bits)
    assert all(np.array_equal(x, y) for x, y in zip((q, r, n), back, strict=True))
    twice = co.counted(*(np.concatenate((x, x[::-1])) for x in (q, r, n)), bits)
    assert np.array_equal(twice[0], q) and np.array_equal(twice[1], r) and np.array_equal(twice[2], 2 * n)
    want = Counter(zip(*(x.tolist() for x in ids), strict=True))
    assert len(q) == len(want)


def test_long_texts_are_cut_at_separators_only():
    text = b"a b.c d.e" * 50 + b"x" * 300 + b".tail"
    parts = list(co.parts_of(text, 40))
    assert b".".join(parts) == text and len(parts) > 10


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
