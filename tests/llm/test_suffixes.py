"""Parts of suffix-array dedup by themselves: the order of windows, names of spans, merged runs and the memory of a task."""

import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa

from ledgerloom.llm import suffixes
from ledgerloom.llm.common import SpanHasher, value_order


class Frame:
    """Takes the place of a DataFrame and keeps the function of a task."""

    def where(self, *_):
        return self

    def mapInArrow(self, run, _):
        self.run = run
        return self

    def groupBy(self, *_):
        return self

    applyInArrow = mapInArrow


def test_value_order_with_equal_high_bits():
    rng = np.random.default_rng(5)
    names = rng.integers(0, 2**63, 5000, dtype=np.uint64)
    names[1000:2000] = names[:1000]
    assert (value_order(names) == np.argsort(names, kind="stable")).all()
    near = names & ~np.uint64(1 << 12) | (np.arange(5000, dtype=np.uint64) % np.uint64(3))  # differ in low bits alone
    near[::2] = near[0]
    near[1::4] += np.uint64(7)
    assert (value_order(near) == np.argsort(near, kind="stable")).all()
    assert (value_order(np.arange(9, 0, -1, dtype=np.uint64)) == np.arange(8, -1, -1)).all()


def test_spans_of_up_to_128_bytes_need_no_digest(monkeypatch):
    rng = np.random.default_rng(6)
    text = rng.integers(97, 99, 4000).astype(np.uint8)
    text[2000:] = text[:2000]
    word = np.array([bin(i).count("1") & 1 for i in range(128)], np.uint8)
    pair = np.concatenate((97 + word, 98 - word)).astype(np.uint8)
    monkeypatch.setattr(hashlib, "blake2b", None)
    starts = rng.integers(0, 1872, 500)
    for size in (64, 65, 92, 127, 128):
        hasher = SpanHasher(3)
        sums = hasher.sums(text)
        assert (hasher.spans(sums, starts, starts + size) == hasher.spans(sums, starts + 2000, starts + 2000 + size)).all()
        assert len(np.unique(hasher.spans(sums, np.arange(1800), np.arange(1800) + size))) == len({text[i:i + size].tobytes() for i in range(1800)})
        a, b = hasher.spans(hasher.sums(pair), np.array([0, 128]), np.array([size, 128 + size]))
        assert a != b


def test_covered_runs():
    assert suffixes.covered(np.array([90, 0, 50, 10, 300]), np.array([60, 50, 60, 20, 50])) == [(0, 150), (300, 350)]


def test_memory_of_tasks():
    """The arrays of a task that makes spans and of a part, beside what they are given (before: 302 MB for the first)."""
    rng = np.random.default_rng(7)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)).decode() for _ in range(20_000)]
    texts = [" ".join(words[i] for i in rng.integers(0, len(words), 1500)) for _ in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    spans, matches = Frame(), Frame()
    suffixes.span_rows(spans, 6, suffixes.LENGTH, suffixes.GRAM)
    suffixes.match_rows(matches, 24, suffixes.LENGTH)
    peaks = []
    tracemalloc.start()
    try:
        made = pa.Table.from_batches(list(spans.run(iter([batch]))))
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
        part = made.filter(pa.compute.equal(made["part"], 0))
        tracemalloc.reset_peak()
        matches.run(part)
        peaks.append(tracemalloc.get_traced_memory()[1] >> 20)
    finally:
        tracemalloc.stop()
    assert peaks[0] < 160 and peaks[1] < 160
