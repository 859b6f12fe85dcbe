"""Token ids in a grammar-compressed binary format with random access.

Documents are range-sorted by id and encoded; a task gathers their ids into shards and compresses each by Re-Pair:
rounds count adjacent pairs, give the frequent ones nonterminals (the most frequent first), and replace their
occurrences, until no pair is frequent or a round saves too little. A shard file holds the documents' ids and
token offsets, the rules, the expansion length of every symbol, and the remaining sequence. To read a range of
tokens, cumulative expansion lengths find the symbols that cover it, and only these are expanded.

Files are written under temporary names and renamed when complete; the manifest lists them with their token
counts, and readers open only what it lists. Rerun tasks write the same bytes to the same names.

Layout (little-endian): magic, version, symbol width in bytes, counts of documents, tokens, rules, symbols and the
first nonterminal; then document ids (int64, with a byte for null), document offsets (int64), rules (pairs of
uint32), expansion lengths of rules (int64), and the sequence, deflated.

A null text has only the end id. A null doc_id sorts first. Rows that repeat are documents of their own, ordered
by id, then text. An empty table gives no shards.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.session import staging_root

from .bytepair import Coder, Vocabulary
from .common import column_bytes, pieces, slices, text_bytes
from .warc import open_store

END_ID = 2
#: Tokens after which a shard is closed; bytes of text for each range.
SHARD, RANGE = 2 << 20, 16 << 20
#: A pair is frequent from this many occurrences; rounds stop below this saving, and after so many; passes of a round.
FREQUENT, SAVING, ROUNDS, PASSES = 24, 0.01, 6, 3
HEAD = "<4sHHqqqqq"
MANIFEST = "part int, seq int, file string, documents long, tokens long, bytes long"
DECODED = "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long"


def compress(ids: np.ndarray, first_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """(rules, sequence): nonterminal ``first_symbol + i`` stands for the pair ``rules[i]``."""
    seq, rules = ids.astype(np.uint64), []
    room = (1 << 16) - first_symbol if first_symbol < 1 << 16 else 1 << 20
    for _ in range(ROUNDS):
        if len(seq) < 2 or room <= 0:
            break
        pairs = (seq[:-1] << np.uint64(32)) | seq[1:]
        bins = (pairs * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        often = np.flatnonzero(np.bincount(bins.astype(np.int64), minlength=1 << 20)[bins.astype(np.int64)] >= FREQUENT)
        distinct, inverse, count = np.unique(pairs[often], return_inverse=True, return_counts=True)
        order = np.lexsort((distinct, -count))
        order = order[count[order] >= FREQUENT][:room]
        if not len(order):
            break
        rank = np.full(len(distinct), len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = np.full(len(seq), len(order), np.int32)  # rank of the pair that begins here
        at[often] = rank[inverse]
        take = apart(at, len(order))
        hit = np.flatnonzero(take)
        if len(hit) < SAVING * len(seq):
            break
        used = np.unique(at[hit])
        name = np.full(len(order), -1, np.int64)
        name[used] = np.arange(len(used))
        rules.append(distinct[order[used]])
        seq[hit] = (first_symbol + name[at[hit]]).astype(np.uint64)
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        seq = seq[keep]
        first_symbol, room = first_symbol + len(used), room - len(used)
    pairs = np.concatenate(rules) if rules else np.zeros(0, np.uint64)
    return np.stack(((pairs >> np.uint64(32)).astype(np.uint32), (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)), axis=1), seq.astype(np.uint32)


def apart(rank: np.ndarray, none: int) -> np.ndarray:
    """Which pairs to replace, so that no two overlap: those of better rank than both neighbours, then again among
    what is left. In a run of one symbol every second pair counts."""
    place = np.arange(len(rank))
    starts = np.maximum.accumulate(np.where(np.concatenate(([True], rank[1:] != rank[:-1])), place, 0))
    open_ = (rank < none) & ((place - starts) % 2 == 0)
    take = np.zeros(len(rank), bool)
    for _ in range(PASSES):
        now = np.where(open_, rank, none)
        best = open_ & (now <= np.concatenate(([none], now[:-1]))) & (now <= np.concatenate((now[1:], [none])))
        take |= best
        open_ &= ~best
        open_[1:] &= ~best[:-1]
        open_[:-1] &= ~best[1:]
    return take


class Shard:
    """One shard file, decoded in part or whole."""

    def __init__(self, blob: bytes):
        magic, version, width, n_docs, self.n_tokens, n_rules, n_symbols, self.first = struct.unpack_from(HEAD, blob)
        if magic != b"RPTK" or version != 1:
            raise ValueError("not a shard")
        at = struct.calcsize(HEAD)

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.nulls, self.offsets = take("<i8", n_docs), take("u1", n_docs), take("<i8", n_docs + 1)
        self.rules, self.rule_lengths = take("<u4", 2 * n_rules).reshape(-1, 2), take("<i8", n_rules)
        self.sequence = np.frombuffer(zlib.decompress(blob[at:]), f"<u{width}", n_symbols).astype(np.int64)
        self.ends = np.cumsum(self.lengths(self.sequence))

    def lengths(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.first
        out[inner] = self.rule_lengths[symbols[inner] - self.first]
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range of tokens; expands only the symbols that cover it."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        symbols, before = self.sequence[a:b], int(self.ends[a - 1]) if a else 0
        while (inner := symbols >= self.first).any():
            wide = np.repeat(symbols, 1 + inner)
            at = np.flatnonzero(inner) + np.arange(int(inner.sum()))
            pairs = self.rules[symbols[inner] - self.first]
            wide[at], wide[at + 1] = pairs[:, 0], pairs[:, 1]
            symbols = wide
        return symbols[start - before:stop - before].astype(np.uint32)


def shard_bytes(doc_ids: list[int | None], ids: list[np.ndarray], first_symbol: int) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    rules, seq = compress(flat, first_symbol)
    lengths = np.ones(len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):  # a rule names earlier rules only
        lengths[i] = (lengths[a - first_symbol] if a >= first_symbol else 1) + (lengths[b - first_symbol] if b >= first_symbol else 1)
    width = 2 if first_symbol + len(rules) <= 1 << 16 else 4
    head = struct.pack(HEAD, b"RPTK", 1, width, len(ids), len(flat), len(rules), len(seq), first_symbol)
    parts = (np.array([i or 0 for i in doc_ids], "<i8"), np.array([i is None for i in doc_ids], "u1"), np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype("<i8"),
             rules.astype("<u4"), lengths.astype("<i8"))
    return b"".join([head, *(p.tobytes() for p in parts), zlib.compress(seq.astype(f"<u{width}").tobytes(), 1)])


def write_ids(documents: DataFrame, path: str, root: str, shard: int = SHARD, ranges: int | None = None) -> DataFrame:
    """Encodes ``documents`` (doc_id, text) and writes shards below ``root``; returns the manifest, also stored there."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    vocabulary = Vocabulary(path)
    shared = documents.sparkSession.sparkContext.broadcast(vars(vocabulary))  # the size of a vocabulary file
    n = ranges or pieces(text_bytes(rows), RANGE, least=12)
    # ranges are sampled by id and a hash, so that no text goes to the driver
    ordered = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h").drop("h").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, (store, folder), coder = TaskContext.get(), open_store(root), Coder(SimpleNamespace(**shared.value))
        doc_ids, ids, held, seq = [], [], 0, 0

        def close() -> pa.RecordBatch:
            nonlocal doc_ids, ids, held, seq
            blob = shard_bytes(doc_ids, ids, max(shared.value["size"], END_ID + 1))
            name, temporary = f"part-{context.partitionId():06d}-{seq:05d}.ids", f"{folder}/.tmp-{context.taskAttemptId()}-{seq}"
            store.create_dir(folder, recursive=True)
            with store.open_output_stream(temporary) as sink:
                sink.write(blob)
            store.move(temporary, f"{folder}/{name}")
            row = pa.RecordBatch.from_pydict({
                "part": pa.array([context.partitionId()], pa.int32()), "seq": pa.array([seq], pa.int32()), "file": [name],
                "documents": pa.array([len(ids)], pa.int64()), "tokens": pa.array([held], pa.int64()), "bytes": pa.array([len(blob)], pa.int64())})
            doc_ids, ids, held, seq = [], [], 0, seq + 1
            return row

        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            names = batch.column("doc_id").to_pylist()
            for a, b in slices(at):
                flat, _, bounds, first = coder.encode(data[at[a]:at[b]], at[a:b + 1] - at[a])
                for d in range(b - a):
                    one = np.append(flat[bounds[first[d]]:bounds[first[d + 1]]], np.uint32(END_ID))
                    doc_ids.append(names[a + d])
                    ids.append(one)
                    held += len(one)
                    if held >= shard:
                        yield close()
        if ids:
            yield close()

    ordered.mapInArrow(write, MANIFEST).write.mode("errorifexists").parquet(f"{root}/manifest")
    return documents.sparkSession.read.schema(MANIFEST).parquet(f"{root}/manifest")


def read_ids(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids, ids_crc32) of every document, from the files that the manifest lists.
    ``start`` counts the ids of all documents before it: sums over ranges, then over the shards of a range."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{root}/manifest")
    running = (Window.unboundedPreceding, Window.currentRow)
    # one row for each range (their number is that of partitions), then one for each shard of a range
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(*running)) - F.col("n")).alias("base"))
    inner = F.sum("tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*running)) - F.col("tokens")
    shards = manifest.select("part", "file", "tokens", inner.alias("inner")).join(parts, "part").select("file", "tokens", (F.col("base") + F.col("inner")).alias("start"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        for batch in batches:
            for name, tokens, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_stream(f"{folder}/{name}", compression=None) as source:
                    one = Shard(source.read())
                if one.n_tokens != tokens:
                    raise ValueError(f"{name} has {one.n_tokens} tokens, the manifest says {tokens}")
                n, blobs, crcs = len(one.doc_ids), [], []
                step = max(1, n // 16)
                for a in range(0, n, step):  # a sixteenth at a time
                    b = min(n, a + step)
                    flat = one.tokens(int(one.offsets[a]), int(one.offsets[b])).astype("<u4")
                    for d in range(a, b):
                        blob = flat[one.offsets[d] - one.offsets[a]:one.offsets[d + 1] - one.offsets[a]].tobytes()
                        blobs.append(blob if with_ids else None)
                        crcs.append(zlib.crc32(blob))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one.doc_ids, pa.int64(), mask=one.nulls.astype(bool)), pa.array(one.offsets[:-1] + start), pa.array(np.diff(one.offsets)),
                     pa.array(blobs, pa.binary()), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return shards.repartition(pieces(manifest.count(), 1), "file").mapInArrow(read, DECODED)


def ids_root(spark: SparkSession) -> str:
    return f"{staging_root(spark)}/ids-{uuid.uuid4().hex}"
