"""Helpers that several corpus operators share: byte views of Arrow columns, word spans and hashes, sizing."""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on. A longer document gets a pass of its own.
SLICE = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string or binary column and the n + 1 offsets into them; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64) \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of whole documents of at most ``limit`` bytes each, or of one longer document."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


#: Words of the token contracts: anything but the space and the control characters 9 to 13.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: Words of the benchmark contract: digits, letters (of either case, to be lower-cased) and everything beyond ASCII.
ALNUM = np.ones(256, bool)
ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
#: Lower-cases A-Z and nothing else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of ``member`` bytes, none across documents, and for each document
    the number of its first word (n + 1 numbers)."""
    inside = np.concatenate((member[data], [False]))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~before | first))
    after = np.concatenate((inside[1:], [False])) & ~np.concatenate((first[1:], [True]))
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def value_order(names: np.ndarray) -> np.ndarray:
    """Places of 64-bit names in ascending order, equal names in the order of their places."""
    bits = np.uint64(max(1, (len(names) - 1).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    # the high bits of a name with its place below them are sorted by value, which is several times as fast
    place = (np.sort((names & ~low) | np.arange(len(names), dtype=np.uint64)) & low).view(np.int64)
    held = names[place]
    wrong = np.flatnonzero(held[1:] < held[:-1])
    if len(wrong) > 64:
        return np.argsort(names, kind="stable")
    high = held >> bits if len(wrong) else held
    for i in wrong.tolist():  # names that differ in low bits alone
        a, b = np.searchsorted(high, high[i]), np.searchsorted(high, high[i], "right")
        group = np.sort(place[a:b])
        place[a:b] = group[np.argsort(names[group], kind="stable")]
    return place


def distinct(names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ascending distinct names, the first place of each, and for each name its number among them), as ``np.unique`` gives them."""
    place = value_order(names)
    held = names[place]
    head = np.ones(len(held), bool)
    head[1:] = held[1:] != held[:-1]
    number = np.empty(len(held), np.int64)
    number[place] = np.cumsum(head) - 1
    return held[head], place[head], number


#: Bytes of the longest span that a polynomial may name. Modulo a power of two some long words over two letters agree with
#: their complements under every base; up to this length such words still differ in more than half of the bits.
SHORT = 64


class SpanHasher:
    """64-bit hashes of byte spans; equal spans hash alike at any place, and the result depends only on the bytes and ``seed``.

    Short spans get polynomials from prefix sums, spans up to twice as long those of both their ends, and longer ones (rare among
    words and pieces) a digest of their bytes. Two given
    spans collide with a chance of about 2**-64; among some 2**32 different ones a collision is to be expected.
    """

    def __init__(self, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        base = int(rng.integers(1, 2**61)) * 8 + 5
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 2**64))
        self.powers = self.inverses = np.ones(0, np.uint64)
        self.key, self.data = seed.to_bytes(8, "little"), None

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverses = (self._powers(b, n) for b in (self.base, self.inverse))

    @staticmethod
    def _powers(base: np.uint64, n: int) -> np.ndarray:
        out, done = np.ones(1 << (n - 1).bit_length(), np.uint64), 1
        while done < len(out):  # by doubling
            out[done:2 * done] = out[:done] * (out[done - 1:done] * base)
            done *= 2
        return out

    def sums(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        self.data = data  # of the sums that ``spans`` is asked for next
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[:len(data)], dtype=np.uint64)))

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        length = (ends - starts).astype(np.uint64)
        out = mix((sums[ends] - sums[starts]) * self.inverses[starts] + length)
        wide = np.flatnonzero(length > SHORT)
        if not len(wide):
            return out
        both = wide[length[wide] <= 2 * SHORT]
        a, b, c, d = starts[both], starts[both] + SHORT, ends[both] - SHORT, ends[both]
        head, tail = (mix((sums[y] - sums[x]) * self.inverses[x]) for x, y in ((a, b), (c, d)))
        out[both] = mix(head * np.uint64(0x9E3779B97F4A7C15) + tail + length[both])
        for i in wide[length[wide] > 2 * SHORT].tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[starts[i]:ends[i]].tobytes(), digest_size=8, key=self.key).digest(), "little")
        return out


def lean() -> None:
    """For the start of a task's work and for after a large piece of it: freed arrays go back to the system at once, so that a
    Python worker, which lives on from task to task, holds what it uses and not what it once used. Only glibc has this."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD: blocks from 1 MB on are mapped, and unmapped when freed
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Arrow batches of fewer rows for the jobs that run inside the block, where a task makes several times the
    size of a batch from it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def free_names(columns: Iterable[str], *stems: str) -> list[str]:
    """Helper column names that ``columns`` lack, whatever the case of their letters."""
    taken, tail = {c.lower() for c in columns}, ""
    while any((stem + tail).lower() in taken for stem in stems):
        tail += "_"
    return [stem + tail for stem in stems]


def without(columns: Iterable[str], *names: str) -> list[str]:
    """The columns but those of the given names, whatever the case of their letters."""
    gone = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in gone]


def pieces(total: int, each: int, least: int = 1) -> int:
    """How many parts of about ``each`` a total makes; grows with the data, so that no part does."""
    return int(max(least, -(-total // each)))


def text_bytes(documents: DataFrame, column: str = "text") -> int:
    return documents.agg(F.sum(F.octet_length(column))).first()[0] or 0
