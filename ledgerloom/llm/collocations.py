"""Phrase collocations from counting quotient filters over packed word numbers.

1. Texts become blocks of one language: their distinct words with counts, and the text as numbers into them.
2. Words that are frequent enough in their language are numbered from 1 without gaps. Phrases with another word can neither
   be candidates nor parts of one, so every other word ends a run like a piece's end does.
3. A phrase of up to three words packs into (first, second, third or 0), each of ``bits`` bits. The permutation
   (first, rest) -> (first + mix(rest) mod 2**bits, rest) is invertible: its quotient spreads evenly, and the whole rest is the
   remainder, so a counter is never shared and its phrase can be read back from it.
4. A filter holds remainders in quotient order with a step from one quotient to the next (0 inside a run) and a counter of one
   byte, longer ones apart. Tasks make filters of a bounded number of phrases and deal them out by the leading bits of the
   quotient, ``FAN`` bits at a time, with a salt while more bits are to come; each level merges sorted filters and adds counters.
5. What has the least count is joined with its parts (all of which have it too), scored, and ranked in two steps.

Words are the runs of bytes other than space and tab in the pieces between ``.,;:!?`` and the line ends 10-13, after
lower-casing A-Z. A null text is empty, a null language is ``und``. Rows count as often as they occur. Other columns are not
read. An empty table gives an empty result. More than 2**32 frequent words, or a count of 10**15, is an error.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.order_stats import with_position
from ledgerloom.session import stage

from .common import column_bytes, lean, mix, pieces

LEAST, BEST, COVER = 10, 2000, 50
#: Bytes of text in a block; phrases in a filter of a task; phrases that meet in a part; bits of quotient dealt at a time.
BLOCK, FILTER, PART, FAN = 4 << 20, 1 << 20, 1 << 20, 8

_TABLE = bytearray(range(256))
_TABLE[0x41:0x5B] = range(0x61, 0x7B)
for _c in b".,;:!?\n\x0b\x0c\r":
    _TABLE[_c] = 0x2E
_TABLE[0x09] = 0x20
#: Lower-cases A-Z, makes every separator of pieces a full stop and every one of words a space.
TABLE = bytes(_TABLE)


def parts_of(text: bytes, size: int = BLOCK) -> Iterator[bytes]:
    """Parts of about ``size`` bytes of a translated text, cut at separators only."""
    at = 0
    while len(text) - at > size:
        stop = text.rfind(b".", at, at + size)
        stop = stop if stop >= 0 else text.find(b".", at + size)
        if stop < 0:
            break
        yield text[at:stop]
        at = stop + 1
    yield text[at:]


BLOCKS = "lang string, words array<binary>, counts array<long>, stream binary"


def blocks(documents: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, lang, words, counts, stream), written; stream is the text as 1-based numbers of words, 0 for a separator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}

        def give(lang: str) -> Iterator[pa.RecordBatch]:
            sizes.pop(lang)
            for part in parts_of(b".".join(held.pop(lang)), size):
                tokens = part.replace(b".", b" . ").split()
                number = {b".": 0}
                for word in tokens:
                    number.setdefault(word, len(number))
                stream = np.fromiter(map(number.__getitem__, tokens), np.int32, len(tokens))
                counts = np.bincount(stream, minlength=len(number))[1:].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang]), pa.array([list(number)[1:]], pa.list_(pa.binary())), pa.array([counts], pa.list_(pa.int64())),
                     pa.array([zstandard.compress(stream.tobytes(), 1)], pa.binary())], ["lang", "words", "counts", "stream"])
                del tokens, number, stream
                lean()

        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            raw = data.tobytes().translate(TABLE)
            for lang, a, b in zip(batch.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                held.setdefault(lang, []).append(raw[a:b])
                sizes[lang] = sizes.get(lang, 0) + b - a + 1
                if sizes[lang] >= size:
                    yield from give(lang)
            if sum(sizes.values()) >= 2 * size or len(sizes) > 1000:
                for lang in list(sizes):
                    yield from give(lang)
        for lang in list(sizes):
            yield from give(lang)

    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    out, _ = stage(texts.mapInArrow(run, BLOCKS).select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")
    return out


def numbered(words: DataFrame, least: int) -> DataFrame:
    """(lang, word, f, id) of the frequent words, written; ids run from 1, the most frequent first, so that most have few bits."""
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    counted_once, _ = stage(frequent, "frequent-words")
    return with_position(counted_once, [F.desc("f"), F.asc("lang"), F.asc("word")], "id")


def permuted(first: np.ndarray, rest: np.ndarray, bits: int) -> np.ndarray:
    """The quotient of a phrase; the rest is its remainder."""
    return (first + mix(rest)) & np.uint64((1 << bits) - 1)


def first_of(quotient: np.ndarray, rest: np.ndarray, bits: int) -> np.ndarray:
    return (quotient - mix(rest)) & np.uint64((1 << bits) - 1)


def counted(quotient: np.ndarray, rest: np.ndarray, count: np.ndarray | None, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (quotient, remainder) in order, with the sums of their counters (1 each if None)."""
    if 3 * bits <= 64 and count is None:
        key = np.sort((quotient << np.uint64(2 * bits)) | rest)
        quotient, rest = key >> np.uint64(2 * bits), key & np.uint64((1 << (2 * bits)) - 1)
    else:
        order = np.argsort((quotient << np.uint64(2 * bits)) | rest, kind="stable") if 3 * bits <= 64 else np.lexsort((rest, quotient))
        quotient, rest, count = quotient[order], rest[order], None if count is None else count[order]
    heads = np.flatnonzero(np.concatenate(([True], (quotient[1:] != quotient[:-1]) | (rest[1:] != rest[:-1])))) if len(rest) else np.zeros(0, np.int64)
    sums = np.diff(np.append(heads, len(rest))) if count is None else np.add.reduceat(count, heads) if len(heads) else count
    return quotient[heads], rest[heads], sums.astype(np.int64)


def pack(quotient: np.ndarray, rest: np.ndarray, count: np.ndarray, bits: int) -> bytes:
    """A filter of at least one phrase as bytes, deflated: steps, the bytes of both words of the remainder place by place, counters, and
    then the long counters."""
    steps = np.diff(quotient, prepend=quotient[:1])
    wide = 1 << max(0, (int(steps.max()).bit_length() + 7) // 8 - 1).bit_length()
    long, narrow = count >= 255, -(-bits // 8)
    halves = [x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :narrow].T.tobytes() for x in (rest & np.uint64((1 << bits) - 1), rest >> np.uint64(bits))]
    columns = (steps.astype(f"<u{wide}").tobytes(), *halves, np.where(long, 255, count).astype(np.uint8).tobytes(), count[long].astype("<i8").tobytes())
    return struct.pack("<QQB", len(rest), int(quotient[0]), wide) + zstandard.compress(b"".join(columns), 1)


def unpack(blob: bytes, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    head, narrow = struct.calcsize("<QQB"), -(-bits // 8)
    n, base, wide = struct.unpack_from("<QQB", blob)
    raw = zstandard.decompress(blob[head:])
    quotient = np.cumsum(np.frombuffer(raw, f"<u{wide}", n), dtype=np.uint64) + np.uint64(base)
    halves = np.zeros((2, n, 8), np.uint8)
    halves[:, :, :narrow] = np.frombuffer(raw, np.uint8, 2 * narrow * n, n * wide).reshape(2, narrow, n).transpose(0, 2, 1)
    second, third = halves.reshape(2, -1).view("<u8").astype(np.uint64)
    at = n * (wide + 2 * narrow)
    count = np.frombuffer(raw, np.uint8, n, at).astype(np.int64)
    count[count == 255] = np.frombuffer(raw, "<i8", -1, at + n)
    return quotient, second | (third << np.uint64(bits)), count


def dealt(quotient: np.ndarray, rest: np.ndarray, count: np.ndarray, bits: int, top: int, salt: int) -> pa.RecordBatch:
    """One filter for each value of the ``top`` leading bits of the quotient that occurs."""
    prefix = quotient >> np.uint64(bits - top)
    bounds = [*np.flatnonzero(np.concatenate(([True], prefix[1:] != prefix[:-1]))).tolist(), len(prefix)] if len(prefix) else [0]
    rows = [(int(prefix[a]), pack(quotient[a:b], rest[a:b], count[a:b], bits)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([salt] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                                      ["prefix", "salt", "filter"])


DEALT = "prefix long, salt long, filter binary"


def phrase_counts(texts: DataFrame, dictionary: DataFrame, words: DataFrame, n_words: int, n_tokens: int, least: int,
                  part: int = PART, fan: int = FAN) -> DataFrame:
    """(id1, id2, id3, a) of the phrases of two and three frequent words (id3 0 for two) with a count of ``least`` or more."""
    bits = max(1, n_words.bit_length())
    if bits > 32:
        raise ValueError(f"{n_words} frequent words do not fit 32 bits")
    parts_bits = min(bits, (pieces(2 * n_tokens, part) - 1).bit_length())
    first_top = min(fan, parts_bits)
    numbers = (words.join(dictionary.select("lang", "word", "id"), ["lang", "word"])
               .groupBy("block").agg(F.collect_list(F.shiftleft(F.col("pos").cast("long"), 32).bitwiseOR(F.col("id"))).alias("numbers")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        held, size, salt = [], 0, 0

        def give() -> pa.RecordBatch:
            quotient, rest = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            return dealt(*counted(quotient, rest, None, bits), bits, first_top, int(salt) % (1 << (parts_bits - first_top)))

        for batch in batches:
            for block, n, stream, known in zip(*(batch.column(c) for c in ("block", "n", "stream", "numbers")), strict=True):
                ids = np.zeros(n.as_py() + 1, np.uint64)
                pairs = known.values.to_numpy().astype(np.uint64)
                ids[(pairs >> np.uint64(32)).astype(np.int64) + 1] = pairs & np.uint64(0xFFFFFFFF)
                run = ids[np.frombuffer(zstandard.decompress(stream.as_py()), np.int32)]
                a, b, c = run[:-1], run[1:], np.append(run[2:], np.uint64(0))[:max(len(run) - 1, 0)]
                two = (a > 0) & (b > 0)
                three = two & (c > 0)
                rest = np.concatenate((b[two], b[three] | (c[three] << np.uint64(bits))))
                held.append((permuted(np.concatenate((a[two], a[three])), rest, bits), rest))
                size, salt = size + len(rest), mix(np.array([block.as_py()], np.uint64))[0]
                if size >= FILTER:
                    yield give()
                    held, size = [], 0
                    lean()
        if held:
            yield give()

    def merged(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [unpack(f, bits) for f in group.column("filter").to_pylist()]
        return counted(*(np.concatenate([f[i] for f in found]) for i in (0, 1, 2)), bits)

    def deal_on(top: int):
        def run(group: pa.Table) -> pa.Table:
            lean()
            return pa.Table.from_batches([dealt(*merged(group), bits, top, group.column("salt")[0].as_py() % (1 << (parts_bits - top)))])

        return run

    def finish(group: pa.Table) -> pa.Table:
        lean()
        quotient, rest, total = merged(group)
        often = total >= least
        quotient, rest = quotient[often], rest[often]
        return pa.table([pa.array(x.astype(np.int64)) for x in (first_of(quotient, rest, bits), rest & np.uint64((1 << bits) - 1), rest >> np.uint64(bits), total[often])],
                        ["id1", "id2", "id3", "a"])

    size = F.size("words").alias("n")
    now = texts.select("block", "stream", size).join(numbers, "block").mapInArrow(count, DEALT)
    top = first_top
    while top < parts_bits:
        top = min(top + fan, parts_bits)
        now = now.groupBy("prefix", "salt").applyInArrow(deal_on(top), DEALT)
    out, _ = stage(now.groupBy("prefix").applyInArrow(finish, "id1 long, id2 long, id3 long, a long"), "phrases")
    return out


def _score(a: str, left: str, right: str) -> str:
    whole = "CAST({} AS DECIMAL(15,0))"
    return f"CAST(1000000 AS DECIMAL(7,0)) * {whole.format(a)} * {whole.format(a)} div ({whole.format(left)} * {whole.format(right)})"


def collocations(documents: DataFrame, least: int = LEAST, best: int = BEST, cover: int = COVER, block: int = BLOCK, part: int = PART, fan: int = FAN) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``best`` phrases of each language of ``documents`` (text, lang)."""
    texts = blocks(documents, block)
    words = texts.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts"))).select("block", "lang", "pos", F.col("col.words").alias("word"), F.col("col.counts").alias("n"))
    totals = texts.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).alias("n"))
    dictionary = numbered(words, least)
    n_tokens = totals.agg(F.sum("n")).first()[0] or 0
    found = phrase_counts(texts, dictionary, words, dictionary.count(), n_tokens, least, part, fan)
    two, three = found.where("id3 = 0"), found.where("id3 > 0")
    # every part of a candidate has the least count too, so these joins lose no row; keys are unique on their right sides
    over = (three.select("id1", "id2", "a").union(three.select("id2", "id3", "a")).groupBy("id1", "id2").agg(F.max("a").alias("longer")))
    kept = two.join(over, ["id1", "id2"], "left").where(f"longer IS NULL OR 100 * longer < {cover} * a").select("id1", "id2", "id3", "a", F.lit(0).cast("long").alias("f12"), F.lit(0).cast("long").alias("f23"))
    whole = (three.join(two.select("id1", "id2", F.col("a").alias("f12")), ["id1", "id2"])
             .join(two.select(F.col("id1").alias("id2"), F.col("id2").alias("id3"), F.col("a").alias("f23")), ["id2", "id3"]).select("id1", "id2", "id3", "a", "f12", "f23"))
    named = kept.union(whole)
    for k in (1, 2, 3):
        entry = dictionary.select(F.col("id").alias(f"id{k}"), F.col("word").cast("string").alias(f"w{k}"), F.col("f").alias(f"f{k}"), *(["lang"] if k == 1 else []))
        named = named.join(entry, f"id{k}", "left" if k == 3 else "inner")
    pair = F.col("id3") == 0
    scored = named.select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", "f1", "f2", "f3", "f12", "f23", pair.alias("pair"),
        F.when(pair, F.expr(_score("a", "f1", "f2"))).otherwise(F.expr(_score("a", "f1", "f23"))).alias("s1"),
        F.when(~pair, F.expr(_score("a", "f12", "f3"))).alias("s2"))
    second = F.coalesce(F.col("s2") < F.col("s1"), F.lit(False))
    cut = scored.select("lang", "phrase", "a", F.when(second, F.col("f12")).otherwise(F.col("f1")).alias("l"),
                        F.when(second, F.col("f3")).when(F.col("pair"), F.col("f2")).otherwise(F.col("f23")).alias("r"), F.when(second, F.col("s2")).otherwise(F.col("s1")).alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each of 64 shares of a language first, so that no task ranks a whole language
    shares = cut.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = shares.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best).drop("rank", "share")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
