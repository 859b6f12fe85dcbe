"""Exact dedup by content-defined chunk recipes.

1. A text is cut where a rolling hash of its last bytes hits a pattern, so equal texts have equal chunks. A chunk is named by a
   digest, and the ordered list of names is the text's recipe, about 16 bytes for each kilobyte.
2. Names are verified: each task sends a chunk it has not sent before once, and of all chunks of one name the smallest and the
   largest bytes are kept, also map-side. Where these differ, the name stands for two chunks; all names then get twice as many
   bytes, and the check is made again. After it, a name is an identifier: equal recipes are equal texts.
3. Recipes are compared as a whole, counted map-side, and only lists that occur twice go back to their rows; the rows of a
   frequent list are salted. The long texts themselves move once, in chunks, however many rows share them.

Of equal texts the row with the largest doc_id stays; of rows that share this doc_id too, one. A row without doc_id comes after
all others, so it stays only where no row of the group has an id, and keep_id is null then. A null text is an empty one. Only the
id and the text are read, so other columns may have any names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

from .common import SpanHasher, column_bytes, lean, slices
from .roundtrip import cuts

#: Bytes of a chunk's name to begin with; the digest has 64 at most.
NAME_BYTES, MOST_BYTES = 16, 64
#: Bytes of chunks that a task remembers as sent.
REMEMBER = 32 << 20
#: Rows of one recipe that may meet in a task: so many at least, and no smaller a share of all rows than one in FREQUENT.
SOME, FREQUENT = 256, 50_000


def chunks(column: pa.Array, hasher: SpanHasher) -> Iterator[list[bytes]]:
    """The chunks of each text of a batch."""
    data, offsets = column_bytes(column)
    for a, b in slices(offsets):
        part = data[offsets[a]:offsets[b]]
        at, firsts = cuts(part, offsets[a:b + 1] - offsets[a], hasher)
        raw, at = part.tobytes(), at.tolist()
        for x, y in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            yield [raw[at[k]:at[k + 1]] for k in range(x, y)]


def recipes(documents: DataFrame, name_bytes: int) -> DataFrame:
    """(rid, doc_id, recipe, text_sha256) of each row, written."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        hasher = SpanHasher(23)
        for column in texts:
            yield pa.array([b"".join(hashlib.blake2b(c, digest_size=name_bytes).digest() for c in text) for text in chunks(column, hasher)], pa.binary())

    out, _ = stage(documents.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.arrow_udf(run, "binary")(F.col("text")).alias("recipe"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")), "recipes")
    return out


def shared_names(documents: DataFrame, name_bytes: int) -> DataFrame:
    """The names that stand for chunks of different bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        hasher, sent, held = SpanHasher(23), set(), 0
        for batch in batches:
            fresh = []
            for text in chunks(batch.column("text"), hasher):
                for c in text:
                    if c not in sent:
                        sent.add(c)
                        held += len(c)
                        fresh.append(c)
            names = [hashlib.blake2b(c, digest_size=name_bytes).digest() for c in fresh]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(fresh, pa.binary())], ["name", "chunk"])
            if held > REMEMBER:
                sent, held = set(), 0

    sent = documents.select("text").mapInArrow(run, "name binary, chunk binary")
    return sent.groupBy("name").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high")).where("low <> high").select("name")


def deduplicate(documents: DataFrame, name_bytes: int = NAME_BYTES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of ``documents`` (doc_id, text)."""
    texts = documents.select("doc_id", "text")
    while not shared_names(texts, name_bytes).isEmpty():
        if name_bytes >= MOST_BYTES:
            raise ValueError("two chunks of different bytes have the same digest of full length")
        name_bytes *= 2
    rows = recipes(texts, name_bytes)
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id").alias("keep_id"), F.col("rid").alias("keep_rid"))).alias("best")
    groups = rows.groupBy("recipe").agg(F.count("*").alias("group_size"), best).where("group_size > 1").select("recipe", "group_size", "best.keep_id", "best.keep_rid")
    # fewer than FREQUENT marks can have more rows than ``most``; a mark only says into how many salts its rows go
    most = max(SOME, rows.count() // FREQUENT)
    mark = F.xxhash64("recipe").alias("mark")
    frequent = F.broadcast(rows.groupBy(mark).agg(F.ceil(F.count("*") / most).cast("int").alias("salts")).where("salts > 1"))
    salts = F.coalesce("salts", F.lit(1))
    dealt = rows.withColumn("mark", mark).join(frequent, "mark", "left").withColumn("salt", F.pmod(F.xxhash64("rid"), salts).cast("int"))
    copied = groups.withColumn("mark", mark).join(frequent, "mark", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    both = dealt.join(copied.select("recipe", "salt", "group_size", "keep_id", "keep_rid"), ["recipe", "salt"], "left")
    alone = F.col("group_size").isNull()
    return both.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                       (alone | (F.col("rid") == F.col("keep_rid"))).alias("kept"), "text_sha256")
