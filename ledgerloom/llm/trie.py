"""Prefix trie of conversations from the common prefixes of sorted neighbours.

1. A conversation is the sequence of its turns' names (16 bytes of a digest of role and text), joined to one path. Equal paths make
   one class, whose ids are counted and digested in ascending order as a stream.
2. Classes are range-sorted by path. In each range, the edges between neighbours, weighted by the number of turns that they share
   (LCP), go through union-find in descending depth. Whenever components merge at a depth, a branching node is created there, and each
   merged component gives the unbranched nodes from its own depth up to the new one.
3. A component that reaches the end of its range, at a depth that the neighbour beyond shares, stays open. All figures of a
   node are sums over its classes: a class adds (copies - 1) * S(length) + S(LCP with its predecessor), S being bytes of
   text up to a turn, from which the saved tokens of any depth follow. So a range contracts to the open nodes along its two ends,
   and equal ones of all ranges are added up by the digest of their prefix. Their smallest member is then told to their ranges.

Turns are ordered by number, null first; turns of one number by their names. Null roles and texts are empty. Rows without conv_id are no
conversation. Other columns are not read. An empty table gives no node, not even a root, as a node has a smallest member.
A conversation is one row (16 bytes a turn); the ids that end in one node pass through one task, since their digest is one stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

from .common import lean, pieces

#: Bytes of a turn's name; turns in a range of classes.
NAME, RANGE = 16, 1 << 14


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns: array of (name, size)) of each conversation, in order."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * NAME)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").cast("long").alias("turn"), name.alias("name"),
                                                               F.octet_length(text).cast("long").alias("size")).alias("t"))
    ordered = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["name"].alias("name"), t["size"].alias("size")))
    return turns.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Each conversation with its first h turns replaced by those of the first of its family; h is a checksum of its id."""
    own, _ = stage(paths(conversations), "turns")
    heads = own.where(f"conv_id % {family} = 0").select(F.col("conv_id").alias("head_id"), F.slice("turns", 1, most - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    nothing = F.slice("turns", 1, 0)
    both = own.withColumn("head_id", F.expr(f"conv_id - conv_id % {family}")).join(heads, "head_id", "left")
    return both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), nothing), F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))).alias("turns"))


def classes(told: DataFrame) -> DataFrame:
    """(path, sizes, conv_id, n, ends) of each distinct path: smallest id, number of ids and their digest."""
    flat, _ = stage(told.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["name"]), "")).alias("path"), F.col("turns.size").alias("sizes")), "paths")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = least = state = None
        count = 0
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if k == key:
                    state.update(b",%d" % c)
                    count += 1
                    continue
                if key is not None:
                    out.append((least, count, state.hexdigest()))
                key, least, count, state = k, c, 1, hashlib.sha256(b"%d" % c)
            if len(out) > 10_000:
                yield given(out)
                out = []
        if key is not None:
            out.append((least, count, state.hexdigest()))
        yield given(out)

    def given(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())],
                                          ["conv_id", "n", "ends"])

    ids = flat.select(F.unhex(F.sha2("path", 256)).alias("key"), "conv_id")
    ends = ids.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(digest, "conv_id long, n long, ends string")
    return ends.join(flat, "conv_id")


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from the start."""
    low, high = 0, min(len(a), len(b)) // NAME
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle * NAME] == b[:middle * NAME] else (low, middle - 1)
    return low


def shared_turns(a: str, b: str) -> Column:
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([-1 if p is None else shared(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return F.arrow_udf(run, "int")(F.col(a), F.col(b))


FOREST = ("slice int, depth int, conv_id long, parent_conv long, parent_key binary, key binary, n long, children long, leaves long, "
          "total long, before long, ends string")


class Forest:
    """Union-find over the classes of one range; ``rows`` are its nodes, those with a key being open."""

    def __init__(self, paths: list[bytes], sizes: list[np.ndarray], ids: list[int], counts: list[int], ends: list[str], left: int, right: int):
        n = len(paths)
        self.paths, self.ids, self.counts, self.ends, self.left, self.right, self.last = paths, ids, counts, ends, left, right, n - 1
        self.length = [len(p) // NAME for p in paths]
        self.lcp = [left, *(shared(a, b) for a, b in zip(paths[:-1], paths[1:], strict=True))]
        self.bytes = [[0, *np.cumsum(s).tolist()] for s in sizes]
        self.up = list(range(n))
        # of the component with this root: first and last class, depth, edges merged at this depth, members, smallest id, leaves, sum
        self.first, self.stop, self.depth, self.edges = list(range(n)), list(range(n)), list(self.length), [0] * n
        after = [*self.lcp[1:], right]
        self.leaves = [int(after[i] < self.length[i]) for i in range(n)]
        self.total = [(counts[i] - 1) * self.bytes[i][self.length[i]] + self.bytes[i][max(self.lcp[i], 0)] for i in range(n)]
        self.n, self.least = list(counts), list(ids)
        self.rows: list[tuple] = []

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def key(self, root: int, depth: int) -> bytes | None:
        """The name of the component's prefix of this depth, if it goes on beyond the range."""
        if depth == 0 or (self.first[root] == 0 and self.left >= depth):
            return hashlib.blake2b(self.paths[self.first[root]][:depth * NAME], digest_size=16).digest()
        if self.stop[root] == self.last and self.right >= depth:
            return hashlib.blake2b(self.paths[self.stop[root]][:depth * NAME], digest_size=16).digest()
        return None

    def give(self, root: int, down_to: int, above: tuple[int | None, bytes | None]) -> None:
        """Nodes of a component from its depth up to ``down_to``; ``above`` is the parent of the uppermost."""
        first, deepest = self.first[root], self.depth[root]
        sums, length = self.bytes[first], self.length[first]
        key = self.key(root, deepest)
        for j in range(deepest, down_to - 1, -1):
            beyond = first == 0 and self.left >= j  # the node's first class lies in a range before
            children = self.edges[root] if j == deepest else 0
            children += (self.left == j) if beyond else (length > j)
            upper = self.key(root, j - 1) if j > down_to and key is not None else None
            parent = above if j == down_to else (None, upper) if upper is not None else (self.least[root], None)
            before = sums[j - 1] if j else 0
            total = self.total[root] - (0 if beyond else sums[max(self.lcp[first], 0)])
            self.rows.append((j, self.least[root], *parent, key, self.n[root], children, self.leaves[root], total, before,
                              self.ends[first] if not beyond and length == j else None))
            key = upper

    def grow(self) -> list[tuple]:
        at: dict[int, list[int]] = {0: []}
        for i in range(1, self.last + 1):
            at.setdefault(self.lcp[i], []).append(i)
        for d in {self.left, self.right} - {-1}:
            at.setdefault(d, [])
        for d in sorted(at, reverse=True):
            touched = {self.find(i) for e in at[d] for i in (e - 1, e)}
            if d in (0, self.left):
                touched.add(self.find(0))
            if d == self.right:
                touched.add(self.find(self.last))
            parts = {r: (self.first[r], self.stop[r], self.depth[r], self.edges[r], self.n[r], self.least[r], self.leaves[r], self.total[r]) for r in touched}
            state = (self.first, self.stop, self.depth, self.edges, self.n, self.least, self.leaves, self.total)
            for r in touched:
                self.edges[r] = self.edges[r] if self.depth[r] == d else 0
            for e in at[d]:
                a, b = self.find(e - 1), self.find(e)
                self.up[b] = a
                self.stop[a] = self.stop[b]
                self.edges[a] += self.edges[b] + 1
                self.n[a] += self.n[b]
                self.least[a] = min(self.least[a], self.least[b])
                self.leaves[a] += self.leaves[b]
                self.total[a] += self.total[b]
            merged = {r: self.find(r) for r in touched}
            for root in set(merged.values()):
                self.depth[root] = d
            # a part is given as it was before; its parent is the component it has become
            for r, old in parts.items():
                if old[2] > d:
                    root = merged[r]
                    name = self.key(root, d)
                    above = (self.least[root], None) if name is None else (None, name)
                    now = [column[r] for column in state]
                    for column, value in zip(state, old, strict=True):
                        column[r] = value
                    self.give(r, d + 1, above)
                    for column, value in zip(state, now, strict=True):
                        column[r] = value
        self.give(self.find(0), 0, (None, None))
        return self.rows


def trie(told: DataFrame, turns_in_range: int = RANGE) -> DataFrame:
    """The nodes of ``told`` (conv_id, turns): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    found, _ = stage(classes(told), "classes")
    turns = found.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    parts = pieces(turns, turns_in_range)
    placed, _ = stage(found.repartitionByRange(parts, "path").withColumn("slice", F.spark_partition_id()), "ranges")
    ends = placed.groupBy("slice").agg(F.min("path").alias("low"), F.max("path").alias("high"))
    before = ends.select("slice", "low", F.lag("high").over(Window.orderBy("slice")).alias("high"))  # one row per range
    left = {r.slice: r.n for r in before.select("slice", shared_turns("high", "low").alias("n")).collect()}
    order = sorted(left)
    right = {a: left[b] for a, b in zip(order[:-1], order[1:], strict=True)}

    def grow(group: pa.Table) -> pa.Table:
        lean()
        group = group.sort_by("path")
        here = group.column("slice")[0].as_py()
        sizes = [np.asarray(s.values) for s in group.column("sizes")]
        forest = Forest(group.column("path").to_pylist(), sizes, *(group.column(c).to_pylist() for c in ("conv_id", "n", "ends")), left[here], right.get(here, -1))
        rows = forest.grow()
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()]
        columns = [pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.table([pa.array([here] * len(rows), pa.int32()), *columns], [f.split()[0] for f in FOREST.split(", ")])

    forest, _ = stage(placed.groupBy("slice").applyInArrow(grow, FOREST), "forests")
    open_nodes = forest.where("key IS NOT NULL")
    joined, _ = stage(open_nodes.groupBy("depth", "key").agg(
        F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "total")],
        F.max("before").alias("before"), F.max("ends").alias("ends")), "open-nodes")
    names = joined.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_open"))
    upper = joined.join(names, ["depth", "parent_key"], "left").withColumn("parent_conv", F.col("parent_open"))
    # each range asks for its own open nodes, so a node with many children is asked for once a range
    told_ranges = open_nodes.select("slice", "depth", "key").join(joined.select("depth", "key", F.col("conv_id").alias("parent_open")), ["depth", "key"]).select(
        "slice", (F.col("depth") + 1).alias("depth"), F.col("key").alias("parent_key"), "parent_open")
    closed = forest.where("key IS NULL").join(told_ranges, ["slice", "depth", "parent_key"], "left").withColumn("parent_conv", F.coalesce("parent_conv", "parent_open"))
    columns = ["depth", "conv_id", "parent_conv", "n", "children", "leaves", "total", "before", "ends"]
    nodes = closed.select(*columns).union(upper.select(*columns))
    return nodes.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("total") - (F.col("n") - 1) * F.col("before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
