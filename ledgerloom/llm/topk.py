"""Exact top-k inner products over a bit-sliced index.

Rows are packed into blocks; a block keeps its integer vectors and, for each attribute, bitmaps of the leading
bits of the attribute (a quantised slice each, one bit for each row). For a query the slices are added with
bitmap arithmetic, weighted by the bits of the query's components, which gives every row's coarse score as
bit slices. The k-th best coarse score is found from the most significant slice downward. A coarse score is
off by a known bound at most, so the rows within that bound of the k-th are a superset of the answer; these
boundary rows are scored exactly.

Vectors that are null or hold null or non-finite components take no part. Components missing at the end of
a shorter vector count as 0. A repeated vec_id: each row is a candidate of its own, none of them for the
query of that id, and the query is the smallest of the vectors. A null vec_id is never a query and loses ties.
Scores must fit in 64 bits. With no queries or no candidates the result is empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

from .common import pieces

#: Rows in a block, queries in a chunk, chunks that one task takes, leading bits kept as slices.
BLOCK, CHUNK, CHUNKS_AT_ONCE, SLICES = 8192, 128, 16, 5
LAST = np.iinfo(np.int64).max


def integers(column: str, scale: float) -> F.Column:
    """floor(scale * x) of each component, x as double; null for vectors that take no part."""
    usable = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.when(usable, F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("bigint")))


def packed(vectors: DataFrame, rows: int) -> DataFrame:
    """One row for up to ``rows`` vectors of a partition: (part, seq, ids, matrix, width)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, ids, lists = TaskContext.get().partitionId(), 0, [], []

        def block() -> pa.RecordBatch:
            width = max(map(len, lists), default=0)
            m = np.zeros((len(lists), width), np.int64)
            for k, x in enumerate(lists):
                m[k, :len(x)] = x
            for kind in (np.int16, np.int32):
                if not m.size or np.abs(m).max() <= np.iinfo(kind).max:
                    m = m.astype(kind)
                    break
            return pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "ids": [np.array(ids, np.int64).tobytes()],
                "matrix": [m.tobytes()], "width": pa.array([width], pa.int32()), "kind": [m.dtype.str]})

        for batch in batches:
            values = batch.column("v")
            for i, v in zip(batch.column("id").to_pylist(), (values[k].values.to_numpy(zero_copy_only=False) for k in range(len(values))), strict=True):
                ids.append(LAST if i is None else i)
                lists.append(v)
                if len(ids) == rows:
                    yield block()
                    seq, ids, lists = seq + 1, [], []
        if ids:
            yield block()

    return vectors.mapInArrow(pack, "part int, seq int, ids binary, matrix binary, width int, kind string")


def slices_of(m: np.ndarray, n_slices: int) -> tuple[np.ndarray, int]:
    """Bitmaps [attribute, slice, word] of the leading bits of each attribute less the least value of the
    block, and how many low bits they leave out."""
    shifted = (m - m.min()).astype(np.uint64)
    bits = max(1, int(shifted.max()).bit_length())
    low = max(0, bits - n_slices)
    coarse = (shifted >> np.uint64(low)).astype(np.uint8 if n_slices <= 8 else np.uint64)
    words = -(-len(m) // 64)
    out = np.zeros((m.shape[1], min(bits, n_slices), words * 8), np.uint8)
    for s in range(out.shape[1]):
        packed_bits = np.packbits(((coarse >> s) & 1).astype(bool), axis=0, bitorder="little")
        out[:, s, :packed_bits.shape[0]] = packed_bits.T
    return out.view(np.uint64), low


def add_slices(index: np.ndarray, query: np.ndarray) -> list[np.ndarray]:
    """The slices, least significant first, of the sum of |q| * x over attributes, where x is replaced by its
    complement for negative q (which shifts every row's sum alike)."""
    n_slices = index.shape[1]
    by_weight: dict[int, list[np.ndarray]] = {}
    size = np.abs(query)
    for bit in range(int(size.max()).bit_length() if size.size else 0):
        on = np.flatnonzero((size >> bit) & 1)
        flip = np.where(query[on] < 0, ~np.uint64(0), np.uint64(0))[:, None]
        for s in range(n_slices):
            by_weight.setdefault(bit + s, []).append(index[on, s] ^ flip)
    out, weight, carried = [], 0, None
    waiting = {w: np.concatenate(x) for w, x in by_weight.items()}
    while waiting or carried is not None:
        col = waiting.pop(weight, np.zeros((0, index.shape[2]), np.uint64))
        up = []
        while len(col) >= 3:  # three bitmaps of a weight make one of that weight and one of the next
            k = len(col) // 3
            a, b, c = col[0:3 * k:3], col[1:3 * k:3], col[2:3 * k:3]
            either = a ^ b
            up.append((a & b) | (c & either))
            col = np.concatenate((either ^ c, col[3 * k:]))
        rest = [*col, *([carried] if carried is not None else [])]
        carried = None
        total = rest[0] if rest else np.zeros(index.shape[2], np.uint64)
        if len(rest) == 2:
            total, carried = rest[0] ^ rest[1], rest[0] & rest[1]
        elif len(rest) == 3:
            either = rest[0] ^ rest[1]
            total, carried = either ^ rest[2], (rest[0] & rest[1]) | (rest[2] & either)
        out.append(total)
        if up:
            more = np.concatenate(up)
            waiting[weight + 1] = np.concatenate((waiting[weight + 1], more)) if weight + 1 in waiting else more
        if carried is not None and not carried.any():
            carried = None
        weight += 1
    return out


def near_top(slices: list[np.ndarray], exist: np.ndarray, k: int, slack: int) -> np.ndarray:
    """Rows whose sliced value is at least the k-th largest less ``slack``, as row numbers."""
    kth, sure, tied = 0, np.zeros_like(exist), exist
    k = min(k, int(np.bitwise_count(exist).sum()))
    for s in reversed(slices):
        has = sure | (tied & s)
        if int(np.bitwise_count(has).sum()) >= k:
            tied, kth = tied & s, 2 * kth + 1
        else:
            sure, tied, kth = has, tied & ~s, 2 * kth
    least = kth - slack
    if least > 0:
        above, equal = np.zeros_like(exist), exist
        for level in range(len(slices) - 1, -1, -1):
            if (least >> level) & 1:
                equal = equal & slices[level]
            else:
                above, equal = above | (equal & slices[level]), equal & ~slices[level]
        exist = above | equal
    return np.flatnonzero(np.unpackbits(exist.view(np.uint8), bitorder="little"))


def best_of_block(ids: np.ndarray, m: np.ndarray, index: np.ndarray, low: int, query_id: int, query: np.ndarray, k: int):
    exist = np.zeros(index.shape[2] * 64, np.uint8)
    exist[:len(ids)] = ids != query_id
    exist = np.packbits(exist, bitorder="little").view(np.uint64)
    if not exist.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    slack = -(-int(np.abs(query).sum()) * ((1 << low) - 1) // (1 << low))
    rows = near_top(add_slices(index, query), exist, k, slack)
    scores = m[rows].astype(np.int64) @ query
    if len(rows) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        rows, scores = rows[scores >= floor], scores[scores >= floor]
    order = np.lexsort((ids[rows], -scores))[:k]
    return ids[rows[order]], scores[order]


def top_k(vectors: DataFrame, k: int = 5, is_query: F.Column | None = None, scale: float = 256.0,
          id_column: str = "vec_id", column: str = "embedding", block: int = BLOCK, chunk: int = CHUNK, n_slices: int = SLICES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every query row, ties to the smaller id.

    Blocks of rows meet chunks of queries by block number; each task gets one block and a bounded number of
    chunks. What is shuffled is blocks times the number of chunk groups and chunks times the number of blocks.
    """
    kept = vectors.select(F.col(id_column).cast("bigint").alias("id"), integers(column, scale).alias("v")).where("v IS NOT NULL")
    asked = kept.where((F.col("id") % 50 == 0) if is_query is None else is_query).groupBy("id").agg(F.min("v").alias("v"))
    index, _ = stage(packed(kept, block), "bit-slices")
    chunks, _ = stage(packed(asked.where("id IS NOT NULL"), chunk), "queries")
    sizes = index.agg(F.max("part"), F.max("seq")).first()
    n_chunks = chunks.agg(F.max("part"), F.max("seq")).first()
    if sizes[0] is None or n_chunks[0] is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    per_part, per_query_part = sizes[1] + 1, n_chunks[1] + 1
    groups = pieces((n_chunks[0] + 1) * per_query_part, CHUNKS_AT_ONCE)
    blocks = index.select((F.col("part") * per_part + F.col("seq")).cast("long").alias("block"), "ids", "matrix", "width", "kind")
    left = blocks.withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = (chunks.withColumn("bundle", ((F.col("part") * per_query_part + F.col("seq")) % groups).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((sizes[0] + 1) * per_part - 1)))).withColumn("block", F.col("block").cast("long"))
             .select("block", "bundle", "ids", "matrix", "width", "kind"))

    def search(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        for r in rows.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            m = np.frombuffer(r["matrix"], r["kind"]).reshape(len(ids), r["width"])
            width = max(1, r["width"], *queries.column("width").to_pylist())
            m = np.pad(m, ((0, 0), (0, width - r["width"])))
            slices, low = slices_of(m.astype(np.int64), n_slices)
            for q in queries.to_pylist():
                asked_ids = np.frombuffer(q["ids"], np.int64)
                qs = np.frombuffer(q["matrix"], q["kind"]).reshape(len(asked_ids), q["width"]).astype(np.int64)
                for query_id, query in zip(asked_ids, np.pad(qs, ((0, 0), (0, width - q["width"]))), strict=True):
                    found, scores = best_of_block(ids, m, slices, low, query_id, query, k)
                    out += [(int(query_id), None if i == LAST else int(i), int(s)) for i, s in zip(found, scores, strict=True)]
        return pa.table({n: pa.array([x[c] for x in out], pa.int64()) for c, n in enumerate(("query_id", "vec_id", "score"))})

    near = left.groupBy("block", "bundle").cogroup(right.groupBy("block", "bundle")).applyInArrow(search, "query_id long, vec_id long, score long")
    from pyspark.sql import Window

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
