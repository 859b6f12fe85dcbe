"""Suffix-array dedup with a logarithmic family of indexes.

A suffix matters here by its first ``length`` bytes, its window. Every window holds a sampled position, the
leftmost least hash of its ``GRAM``-byte grams, and the windows around one sampled position make a span of text.
Spans go to parts by that hash, so equal windows of any two documents meet in one part, and a part sees about
three times its share of the text, each distinct span of a task once, deflated.

In a part, documents come in batches of ascending id. The suffix array of a batch is its windows in the order of
their 64-bit names (hashes of the ``length`` bytes; equal windows get equal names, others collide with a chance of
2**-64). It is merge-scanned against every level of the index; windows found there, or in a document of smaller id
in the batch itself, are long matches. What is new becomes a level, and levels of about equal size are merged, so
a part has logarithmically many levels and each window is merged logarithmically often. A level holds a distinct
window once, whatever the number of its copies.

A document loses the bytes that long matches cover, judged on the input. Matches never cross documents; a repeat
within one document is kept. Rows that share a doc_id count as one document for matches, and each is returned (texts of one doc_id are told apart by 16 bits). A
row without doc_id is returned whole and is no source. A null text is empty, and a text under ``length`` bytes has no window.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHasher, column_bytes, free_names, lean, mix, pieces, slices, text_bytes, value_order, without

#: Bytes of a match; bytes of a sampled gram.
LENGTH, GRAM = 50, 8
#: Text in one part of the suffix space, in one group of documents, in what a map task
#: packs together, and in one pass of array work, all in bytes.
PART, GROUP, TASK, PASS = 3 << 20, 6 << 20, 8 << 20, 1 << 20
#: Windows in a batch of a part.
BATCH = 1 << 19


def sampled(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, first window, windows, key) of each run of windows that have the same sampled position.

    Grams across documents are hashed as well, but only windows inside a document are looked at.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64)
    code = data.astype(np.uint64)
    size = 1
    while size < gram:  # gram is a power of two: its bytes as one number
        code = (code[:-size] << np.uint64(8 * size)) | code[size:]
        size *= 2
    h = mix(code)
    reach = length - gram + 1
    least, size = h, 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[:len(least) - (reach - size)], least[reach - size:])
    # least[p] belongs to the window at p; a run ends where it changes, at a document's end, or where the
    # leftmost place of an equal value leaves the window
    sizes = np.diff(offsets)
    documents = np.flatnonzero(sizes >= length)
    first = np.zeros(n + 1, bool)
    first[offsets[documents]] = True
    owner = np.zeros(n + 1, np.int64)
    owner[offsets[documents]] = 1
    owner[offsets[documents + 1] - length + 1] -= 1
    inside = np.cumsum(owner)[:len(least)] > 0
    edge = np.concatenate(([True], least[1:] != least[:-1])) | first[:len(least)]
    # a gram equal to the least that has just left the window: the next equal one takes over
    left = np.flatnonzero(h[:len(least) - 1] == least[:-1]) + 1
    edge[left] = True
    starts = np.flatnonzero(edge & inside)
    stops = np.flatnonzero(np.concatenate(((edge[1:] | ~inside[1:]), [True])) & inside) + 1
    return np.searchsorted(offsets, starts, "right") - 1, starts, stops - starts, least[starts]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start and count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def tags(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """16 bits of each text's checksum: they tell rows apart that share a doc_id and differ in text."""
    raw = data.tobytes()
    return np.array([zlib.crc32(raw[a:b]) & 0xFFFF for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.int64)


SPANS = "part int, ids binary, tags binary, owners binary, places binary, which binary, sizes binary, texts binary"


def span_rows(documents: DataFrame, parts: int, length: int, gram: int) -> DataFrame:
    """One row for each batch of a task and part: the distinct spans, and where each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hasher = SpanHasher(3)
        for piece in (batch.slice(a, b - a) for batch in batches for a, b in slices(column_bytes(batch.column("text"))[1], TASK)):
            data, at = column_bytes(piece.column("text"))
            ids, marks = piece.column("doc_id").to_numpy(zero_copy_only=False), tags(data, at)
            found = []
            for a, b in slices(at, PASS):
                text = data[at[a]:at[b]]
                owner, first, count, key = sampled(text, at[a:b + 1] - at[a], length, gram)
                name = hasher.spans(hasher.sums(text), first, first + count + length - 1)
                bucket = mix(key + np.uint64(1)) % np.uint64(parts)
                found.append(((owner + a).astype(np.int32), first + at[a], count.astype(np.int32), bucket.astype(np.uint16 if parts < 1 << 16 else np.int64), name))
            if not found:
                continue
            owner, first, count, bucket, names = (np.concatenate(x) for x in zip(*found, strict=True))
            del found
            size = count + (length - 1)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(bounds)):
                mine = order[bounds[p]:bounds[p + 1]]
                # distinct spans in the order of their first occurrence, so that places in the list mostly grow by one
                _, example, which = np.unique(names[mine], return_index=True, return_inverse=True)
                rank = np.empty(len(example), np.int64)
                rank[np.argsort(example)] = np.arange(len(example))
                shown = mine[np.sort(example)]
                own = owner[mine]  # ascends
                fresh = np.diff(own, prepend=-1) > 0
                docs, doc_of = own[fresh], np.cumsum(fresh) - 1
                rows.append((int(p), squeeze_ids(ids[docs]), squeeze(marks[docs], "<u2"), squeeze(np.diff(doc_of, prepend=0)), squeeze(first[mine] - at[owner[mine]]),
                             squeeze(np.diff(rank[which], prepend=0)), squeeze(size[shown]), zstandard.compress(data[spread(first[shown], size[shown])].tobytes(), 6)))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 8))],
                    ["part", "ids", "tags", "owners", "places", "which", "sizes", "texts"])

    return documents.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, SPANS)


def squeeze(values: np.ndarray, kind: str = "<i4") -> bytes:
    """Numbers, deflated byte by byte of their width, the low bytes first."""
    planes = np.ascontiguousarray(values.astype(kind)).view(np.uint8).reshape(-1, int(kind[2])).T
    return zstandard.compress(planes.tobytes(), 3)


def unsqueeze(blob: bytes, kind: str = "<i4") -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(int(kind[2]), -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel().astype(np.int64)


def squeeze_ids(ids: np.ndarray) -> bytes:
    return squeeze(np.diff(ids, prepend=np.int64(0)), "<i8")


def unsqueeze_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, "<i8"))


#: The document of a window that no level holds.
NONE = np.iinfo(np.int32).max


class Family:
    """Levels of sorted window names, each with the smallest document that has the window; documents are numbered by ascending id."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, names: np.ndarray) -> np.ndarray:
        """For each of the sorted ``names`` the document of the level that holds it, or ``NONE``."""
        found = np.full(len(names), NONE, np.int32)
        for held, docs in self.levels:
            at = np.searchsorted(held, names)
            hit = np.flatnonzero(held[np.minimum(at, len(held) - 1)] == names)
            found[hit] = docs[at[hit]]
        return found

    def add(self, names: np.ndarray, docs: np.ndarray) -> None:
        """Adds a level of new windows and merges it with levels that are no larger than it."""
        while self.levels and len(self.levels[-1][0]) <= len(names):
            held, first = self.levels.pop()
            at = np.searchsorted(names, held) + np.arange(len(held))
            rest = np.ones(len(names) + len(held), bool)
            rest[at] = False
            both = []
            for small, large in ((held, names), (first, docs)):
                merged = np.empty(len(rest), large.dtype)
                merged[at], merged[rest] = small, large
                both.append(merged)
            names, docs = both
        if len(names):
            self.levels.append((names, docs))


MATCHES = "bundle int, ids binary, tags binary, owners binary, starts binary, sizes binary"


def match_rows(spans: DataFrame, groups: int, length: int) -> DataFrame:
    """Long matches of every part as (document, first byte, bytes), one row for each group of documents."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        hasher, family = SpanHasher(9), Family()
        ids, marks, owners, places, counts, texts, base = [], [], [], [], [], [], 0
        names_of, shown = [], 0
        for r in table.to_pylist():
            size, text = unsqueeze(r["sizes"]), np.frombuffer(zstandard.decompress(r["texts"]), np.uint8)
            windows = size - length + 1
            begin = np.concatenate(([0], np.cumsum(size)))
            for a, b in slices(begin, PASS):
                at = spread(begin[a:b] - begin[a], windows[a:b])
                names_of.append(hasher.spans(hasher.sums(text[begin[a]:begin[b]]), at, at + length))
            which = np.cumsum(unsqueeze(r["which"]))
            docs = unsqueeze_ids(r["ids"])
            ids.append(docs)
            marks.append(unsqueeze(r["tags"], "<u2"))
            owners.append(np.cumsum(unsqueeze(r["owners"])) + base)
            base += len(docs)
            places.append(unsqueeze(r["places"]))
            counts.append(windows[which])
            texts.append((np.cumsum(windows) - windows)[which] + shown)
            shown += int(windows.sum())
        names = np.concatenate(names_of)
        del names_of
        ids, marks, owners, places, counts, texts = (np.concatenate(x) for x in (ids, marks, owners, places, counts, texts))
        rank = np.unique(ids, return_inverse=True)[1].astype(np.int32)  # rows of one doc_id are one document
        order = np.argsort(rank[owners], kind="stable")  # ascending ids
        out_owner, out_start, out_size = [], [], []
        done = 0
        ends = np.cumsum(counts[order])
        while done < len(order):
            stop = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + BATCH, "right")))
            mine = order[done:stop]
            done = stop
            own, windows = owners[mine], counts[mine]
            begin = np.cumsum(windows) - windows
            name, who = names[spread(texts[mine], windows)], np.repeat(rank[own], windows)
            suffix = value_order(name)  # documents of one window stay in ascending order
            name, who = name[suffix], who[suffix]
            head = np.ones(len(name), bool)
            head[1:] = name[1:] != name[:-1]
            distinct = np.flatnonzero(head)
            name, leader = name[distinct], who[distinct]
            before = family.scan(name)
            hit = np.empty(len(head), bool)
            hit[suffix] = who > np.repeat(np.minimum(before, leader), np.diff(distinct, append=len(head)))
            new = before == NONE
            family.add(name[new], leader[new])
            # adjacent windows of one span make one match
            edge = np.zeros(len(hit) + 1, bool)
            edge[begin] = edge[-1] = True
            run_head = np.flatnonzero(hit & (edge[:-1] | ~np.concatenate(([False], hit[:-1]))))
            run_tail = np.flatnonzero(hit & (edge[1:] | ~np.concatenate((hit[1:], [False]))))
            span = np.searchsorted(begin, run_head, "right") - 1
            out_owner.append(own[span])
            out_start.append(places[mine][span] + run_head - begin[span])
            out_size.append(run_tail - run_head + length)
        owner, start, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out_owner, out_start, out_size))
        bundle = group_of(ids[owner], groups)
        rows = []
        deal = np.argsort(bundle, kind="stable")
        bounds = np.searchsorted(bundle[deal], np.arange(groups + 1))
        for g in np.flatnonzero(np.diff(bounds)):
            mine = deal[bounds[g]:bounds[g + 1]]
            docs, local = np.unique(owner[mine], return_inverse=True)
            rows.append((int(g), squeeze_ids(ids[docs]), squeeze(marks[docs], "<u2"), squeeze(np.diff(local, prepend=0)), squeeze(start[mine]), squeeze(size[mine])))
        return pa.table([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6))],
                        ["bundle", "ids", "tags", "owners", "starts", "sizes"])

    return spans.groupBy("part").applyInArrow(run, MATCHES)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64) + np.uint64(1)) % np.uint64(groups)).astype(np.int64)


RESULT = {"doc_id": "long", "n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept_sha256": "string", "kept": "string"}


def deduplicate(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, with_text: bool = False, parts: int | None = None, groups: int | None = None) -> DataFrame:
    """Each row of ``documents`` (doc_id, text and others) with n_bytes, n_removed, n_spans, kept_sha256 and kept in place
    of its text. ``kept``, if asked for, is the remaining text: characters that lost a byte are left out of it, while
    the digest is that of the remaining bytes. Other columns stay, but for those named like a result."""
    others = without(documents.columns, *RESULT, "text")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in others])
    total = text_bytes(rows)
    # the least numbers keep all cores of a small cluster busy; beyond that both grow with the text
    parts, groups = parts or pieces(total, PART, least=24), groups or pieces(total, GROUP, least=24)
    matches = match_rows(span_rows(rows.select("doc_id", "text"), parts, length, gram), groups, length)

    def deal(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in ids:
            yield pa.array(group_of(column.to_numpy(zero_copy_only=False).astype(np.int64), groups), pa.int32())

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        lean()
        spans: dict[tuple[int, int], list] = {}
        for r in found.to_pylist():
            ids, marks = unsqueeze_ids(r["ids"]), unsqueeze(r["tags"], "<u2")
            owner, start, size = np.cumsum(unsqueeze(r["owners"])), unsqueeze(r["starts"]), unsqueeze(r["sizes"])
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(len(ids) + 1))
            for k, key in enumerate(zip(ids.tolist(), marks.tolist(), strict=True)):
                mine = order[bounds[k]:bounds[k + 1]]
                spans.setdefault(key, []).append((start[mine], size[mine]))
        out = []
        for batch in texts.to_batches():
            data, at = column_bytes(batch.column("text"))
            marks, facts = tags(data, at), []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                text = data[at[i]:at[i + 1]]
                found_here = spans.get((doc, int(marks[i])), ()) if doc is not None else ()
                runs = covered(*(np.concatenate(x) for x in zip(*found_here, strict=True))) if found_here else []
                gone = np.zeros(len(text) if runs else 0, bool)
                for first, last in runs:
                    gone[first:last] = True
                kept = text[~gone] if runs else text
                facts.append((len(text), len(text) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(),
                              (whole_characters(text, gone) if runs else text.tobytes().decode("utf-8", "replace")) if with_text else None))
            made = [batch.column("doc_id"), *(pa.array([f[k] for f in facts], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))]
            out.append(pa.Table.from_arrays([*made, *(batch.column(c) for c in others)], [*RESULT, *others]))
        return pa.concat_tables(out) if out else pa.table({name: pa.array([], kind) for name, kind in (*zip(RESULT, kinds, strict=True), *((c, texts.schema.field(c).type) for c in others))})

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    (bundle,) = free_names(rows.columns, "bundle")
    dealt = rows.withColumn(bundle, F.arrow_udf(deal, "int")(F.coalesce(F.col("doc_id"), F.xxhash64("text"))))
    schema = T.StructType([*T.StructType.fromDDL(", ".join(f"{n} {t}" for n, t in RESULT.items())).fields, *(rows.schema[c] for c in others)])
    return dealt.groupBy(bundle).cogroup(matches.groupBy("bundle")).applyInArrow(cut, schema)


def covered(start: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs (first, behind the last) of bytes that the given stretches cover."""
    order = np.argsort(start)
    start, reach = start[order], np.maximum.accumulate((start + size)[order])
    heads = np.flatnonzero(np.concatenate(([True], start[1:] > reach[:-1])))
    return list(zip(start[heads].tolist(), reach[np.append(heads[1:], len(start)) - 1].tolist(), strict=True))


def whole_characters(text: np.ndarray, gone: np.ndarray) -> str:
    """The text without the characters of which a byte is gone."""
    number = np.cumsum((text & 0xC0) != 0x80)
    hurt = np.zeros(int(number[-1]) + 1 if len(text) else 1, bool)
    hurt[number[gone]] = True
    return text[~hurt[number]].tobytes().decode("utf-8", "replace")
