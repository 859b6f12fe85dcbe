"""Exact dedup by recipes against a plain grouping of whole texts."""

import hashlib
from collections import defaultdict

import pytest

from ledgerloom.llm import recipes


def thue_morse(n):
    word = b"a"
    while len(word) < n:
        word += bytes(97 + 98 - c for c in word)
    return word.decode()


def brute(rows):
    groups = defaultdict(list)
    for k, (doc, text) in enumerate(rows):
        groups[text or ""].append((doc is not None, doc if doc is not None else 0, k))
    out = []
    for k, (doc, text) in enumerate(rows):
        known, best, at = max(groups[text or ""])
        out.append((doc, best if known else None, len(groups[text or ""]), text or ""))
    return sorted(str((d, k, n, hashlib.sha256(t.encode()).hexdigest())) for d, k, n, t in out)


@pytest.mark.parametrize("name_bytes", [16, 1])
def test_equal_texts_make_one_group(spark, name_bytes):
    long = " ".join(f"word{i * i % 977}" for i in range(40_000))
    tm = thue_morse(4096)
    texts = [None, "", "a", "a", " a", long, long, long + "x", "x" + long, tm, tm.translate(str.maketrans("ab", "ba")), "é" * 9000, "é" * 9000, None, "a"]
    rows = [*enumerate(texts), (3, "a"), (3, "a"), (None, "a"), (None, "only here"), (99, "hot"), *((200 + i, "hot") for i in range(400))]
    frame = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, recipe long, keep_id string").repartition(5)
    got = recipes.deduplicate(frame, name_bytes).collect()
    assert sorted(str((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == brute(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in kept}) == len({t or "" for _, t in rows})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_colliding_names_are_found(spark):
    texts = spark.createDataFrame([(i, f"text number {i}") for i in range(2000)], "doc_id long, text string")
    assert recipes.shared_names(texts, 1).count() > 100 and recipes.shared_names(texts, 16).isEmpty()


def test_empty_table(spark):
    assert recipes.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
