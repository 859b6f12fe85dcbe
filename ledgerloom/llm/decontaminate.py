"""Benchmark decontamination with one Aho-Corasick automaton over normalised test questions and answers.

Text is normalised to words: A-Z lower-cased, every byte that is no digit, letter or part of a character beyond
ASCII a separator. A window is ``width`` consecutive words of an item, or all words of a shorter one. The automaton
holds each distinct window as text with one space around every word, so it matches whole words only. A document
is normalised and scanned once; a match gives the covered words and, through the words' places, the span in the
original text.

Only one bounded automaton is in memory: benchmarks with more than ``WINDOWS`` windows are split over several by
a hash of the window, and the documents pass one scan for each. The registered benchmark needs one.

A null text has no words. An item without words has no window. Items of a null id are left out. Repeated items
or windows count once. An empty benchmark leaves every document clean; an empty table stays empty. The result
columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, column_bytes, free_names, lean, pieces, without, word_spans

#: Words in a window; windows in one automaton (at about 80 characters each, some 100 MB).
WIDTH, WINDOWS = 13, 20_000
#: Every byte to its lower case, and what is no part of a word to a space.
NORMAL = np.where(ALNUM, LOWER, 0x20).astype(np.uint8).tobytes()


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window, item): each distinct window of each item, as latin-1 text of its UTF-8 bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            data, at = column_bytes(batch.column("text"))
            raw = data.tobytes()
            for i, item in enumerate(batch.column("item").to_pylist()):
                words = raw[at[i]:at[i + 1]].translate(NORMAL).split()
                for k in range(max(1, len(words) - width + 1) if words else 0):
                    found.add((b" ".join(words[k:k + width]), item))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["window", "item"])

    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item IS NOT NULL AND text IS NOT NULL")
    return items.mapInArrow(cut, "window binary, item string").distinct()


RESULT = "n_words long, hits array<int>, items array<string>, matches array<struct<item:string,start:int,stop:int>>"


def scan(documents: DataFrame, patterns: list[tuple[bytes, list[str]]], name: str) -> DataFrame:
    """Adds a column ``name`` (words, hit words, items, matches with character spans) for one set of windows."""
    shared = documents.sparkSession.sparkContext.broadcast(patterns)
    word, match = pa.int32(), pa.struct([("item", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        lean()
        automaton = ahocorasick.Automaton()
        for k, (window, _) in enumerate(shared.value):
            automaton.add_word(f" {window.decode('latin-1')} ", k)
        sizes = [window.count(b" ") + 1 for window, _ in shared.value]
        ready = bool(shared.value)
        if ready:
            automaton.make_automaton()
        for column in texts:
            data, at = column_bytes(column)
            n_words, hits, items, matches = [], [], [], []
            for i in range(len(at) - 1):
                raw = data[at[i]:at[i + 1]]
                words = raw.tobytes().translate(NORMAL).split()
                n_words.append(len(words))
                plain = b" " + b" ".join(words) + b" "
                found = list(automaton.iter(plain.decode("latin-1"))) if ready and words else []
                if not found:
                    hits.append([])
                    items.append([])
                    matches.append([])
                    continue
                gaps = np.flatnonzero(np.frombuffer(plain, np.uint8) == 0x20)
                last = np.searchsorted(gaps, [end for end, _ in found]) - 1
                starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM)
                chars = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
                hit, by = np.zeros(len(words) + 1, np.int64), {}
                for (_, k), end in zip(found, last, strict=True):
                    first = end - sizes[k] + 1
                    hit[first] += 1
                    hit[end + 1] -= 1
                    for item in shared.value[k][1]:
                        by.setdefault(item, []).append((int(chars[starts[first]]), int(chars[ends[end]])))
                hits.append(np.flatnonzero(np.cumsum(hit[:-1])).astype(np.int32))
                items.append(sorted(by))
                matches.append([{"item": x, "start": a, "stop": b} for x in sorted(by) for a, b in joined(by[x])])
            yield pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(word)), pa.array(items, pa.list_(pa.string())), pa.array(matches, pa.list_(match))],
                ["n_words", "hits", "items", "matches"])

    return documents.withColumn(name, F.arrow_udf(run, RESULT)(F.col("text")))


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of one item, overlapping ones made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, window_limit: int = WINDOWS) -> DataFrame:
    """``documents`` with n_words, n_hit, items, matches (item, and character span in the text) and contaminated:
    at least one word in twenty lies in a window."""
    every = windows(benchmark, width).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    parts = pieces(every.count(), window_limit)
    kept = without(documents.columns, "n_words", "n_hit", "items", "matches", "contaminated")
    held, words, hits, items, matches = free_names(kept, "_scan", "_words", "_hits", "_items", "_matches")
    out = documents.select(*[F.col(f"`{c}`") for c in kept])
    for part in range(parts):
        # part of a bounded size: the windows are dealt out by their hash
        rows = every.where(F.pmod(F.xxhash64("window"), F.lit(parts)) == part).collect()
        out = scan(out, sorted((bytes(r.window), list(r["items"])) for r in rows), held)
        found = {hits: F.col(f"{held}.hits"), items: F.col(f"{held}.items"), matches: F.col(f"{held}.matches")}
        if part:
            found = {hits: F.array_union(hits, found[hits]), items: F.array_union(items, found[items]), matches: F.concat(matches, found[matches])}
        out = out.select(*[F.col(f"`{c}`") for c in kept], F.col(f"{held}.n_words").alias(words), *[v.alias(k) for k, v in found.items()])
    n_hit = F.size(hits).cast("long")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.col(words).alias("n_words"), n_hit.alias("n_hit"), F.array_sort(items).alias("items"),
                      F.array_sort(matches).alias("matches"), ((n_hit > 0) & (20 * n_hit >= F.col(words))).alias("contaminated"))
