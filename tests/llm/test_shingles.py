"""Parts of the n-gram Jaccard join by themselves: sets, their order and their bitmaps."""

import numpy as np

from ledgerloom.llm import shingles
from ledgerloom.llm.common import mix


def test_half_of_a_bitmap_is_the_shorter_bitmap():
    """One pass over a set makes both of its bitmaps (before: a pass for each)."""
    rng = np.random.default_rng(8)
    for n in (33, 64, 65, 1000, 1 << 15):
        mixed = mix(rng.integers(0, 2**63, n, dtype=np.uint64))
        assert shingles.half(shingles.bitmap(mixed, 2)) == shingles.bitmap(mixed)


def test_sets_are_sorted_and_distinct():
    texts = ["a b c d e f a b c d e f a b c d e", "one two", "", "x " * 50]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    found = list(shingles.Shingler().sets(data, offsets))
    assert [len(s) for s in found] == [6, 1, 0, 1] and all((s[1:] > s[:-1]).all() for s in found)
    kinds = np.array([1, 0, 2, 0, 1, 0], np.uint8)
    assert (shingles.in_order(found[0], kinds) == found[0][[1, 3, 5, 0, 4, 2]]).all()
