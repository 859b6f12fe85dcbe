"""N-gram Jaccard self-join by token-combination prefixes, down to connected components.

The tokens of a document are its distinct shingles of ``width`` words, as 64-bit hashes. They have one global order:
first by frequency class, then by hash. Classes come from a sketch of fixed size that counts all tokens of all
documents, so rare tokens come first everywhere and a passage that many documents share comes last.

1. Documents with equal token sets make one class; its first row stands for it from here on.
2. Similar sets share a token of their prefixes (the first n - ceil(t * n) + 1 tokens). Prefix tokens are dealt to
   parts by hash, and a part keeps those that two rows have, with a few pivots of each token's rows.
3. Each set is compared with pivots of its tokens: sizes, then a parity bitmap that bounds the overlap from above, then
   the whole sets of the most promising pair. Links give components.
4. What could still link are sets of different components that share a prefix token. For a rare token these are all
   compared; for a frequent one prefixes are extended by one token and the pairs of a frequent token and a later
   token are the index, since similar sets share two tokens of extended prefixes. Bitmaps come first again,
   then the whole sets. Pairs inside one component are left out, as they can change nothing; so one round first tries
   only the nearest set of another component for each set of a key, which joins groups of near copies with few pairs, and
   the last round looks at all pairs of the components that are left.

So every link between different components is looked at, and none is lost, while a group of near copies costs about
one comparison for each copy. Components are found by star steps over the link table. At the end the whole sets of a
component meet in blocks, which counts all links of each class: work that grows with the square of a component by nature,
in memory that does not.

Words are the runs of bytes other than space and 9-13, after lower-casing A-Z. A text with fewer than ``width`` words
has its whole sequence as its one token; a null text, or one without words, has no token and no link. Equal texts
and repeated rows fall into one class. A row without doc_id takes part; it never names a component, and its
component is null if no row with an id is in it. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import stage

from .common import LOWER, NOT_SPACE, SpanHasher, column_bytes, lean, mix, pieces, slices, small_batches, word_spans
from .graph import components

WIDTH, PERCENT = 5, 80
#: Bins of the frequency sketch (log2), rows it travels in, and pivots of a token.
BINS, SLOTS, PIVOTS = 22, 64, 3
#: Prefix tokens in one part; rows of contested index keys in one part (each with a bitmap); rounds of nearest sets.
PART, OPEN, NEAREST = 1 << 18, 20_000, 1
#: Rows of a key up to which all pairs are compared at once; the nearest-set rounds are for larger keys.
FEW = 24
#: Rows of a broadcast when the texts of sets in question are read again.
SMALL = 100_000
#: Tokens and sets of one block when the links of a component are counted; 64-bit words of its sets held at a time.
TOKENS, SETS, WORDS = 1 << 20, 2048, 1 << 19


class Shingler:
    """Token sets of batches of documents; one for each task."""

    def __init__(self, width: int = WIDTH):
        self.width, self.hasher = width, SpanHasher(2)

    def sets(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        """Sorted distinct tokens of each document."""
        for a, b in slices(offsets):
            text, at = LOWER[data[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a]
            starts, ends, first = word_spans(text, at, NOT_SPACE)
            words = self.hasher.spans(self.hasher.sums(text), starts, ends)
            n = len(words) - self.width + 1
            grams = words[:max(n, 0)]
            for k in range(1, self.width if n > 0 else 0):
                grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[k:k + n])
            for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if y - x >= self.width:
                    found = np.sort(grams[x:y - self.width + 1])
                    fresh = np.ones(len(found), bool)
                    np.not_equal(found[1:], found[:-1], out=fresh[1:])
                    yield found[fresh]
                elif y > x:
                    few = words[x:x + 1]
                    for k in range(1, y - x):
                        few = mix(few * np.uint64(0x9E3779B97F4A7C15) + words[x + k:x + k + 1])
                    yield mix(few + np.uint64(y - x))
                else:
                    yield words[:0]


def needed(n: np.ndarray | int, percent: int = PERCENT):
    """The least overlap of a set of n tokens with any similar set."""
    return -(-n * percent // 100)


def similar(overlap: int, a: int, b: int, percent: int = PERCENT) -> bool:
    return 100 * overlap >= percent * (a + b - overlap)


def sketch(documents: DataFrame, width: int, bins: int = BINS) -> np.ndarray:
    """Frequency class of every bin: 0 for up to about the mean load, then one more for each doubling. Each task
    sends one count for each of 2**bins bins, summed by slot; what reaches the driver has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        shingler, total = Shingler(width), np.zeros(1 << bins, np.uint32)
        for batch in batches:
            sets = [s & np.uint64((1 << bins) - 1) for s in shingler.sets(*column_bytes(batch.column("text")))]
            if sets:
                np.add.at(total, np.concatenate(sets).astype(np.int64), np.uint32(1))
        parts = total.reshape(SLOTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS), pa.int32()), pa.array([zstandard.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slot", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(c), np.uint32).astype(np.uint64) for c in group.column("counts").to_pylist())
        return pa.table({"slot": pa.array(group.column("slot").to_pylist()[:1], pa.int32()), "counts": pa.array([zstandard.compress(total.tobytes(), 1)], pa.binary())})

    counts = documents.select("text").mapInArrow(count, "slot int, counts binary").groupBy("slot").applyInArrow(add, "slot int, counts binary")
    total = np.zeros((SLOTS, (1 << bins) // SLOTS), np.float64)
    for r in counts.collect():  # SLOTS rows
        total[r.slot] = np.frombuffer(zstandard.decompress(r.counts), np.uint64)
    load = 4 * total.mean() + 4
    return np.maximum(0, np.floor(np.log2(np.maximum(total.reshape(-1), 1) / load))).astype(np.uint8)


def in_order(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Ascending tokens by their class and then by hash."""
    return tokens[np.argsort(classes, kind="stable")]


def bitmap(mixed: np.ndarray, spread: int = 1) -> bytes:
    """Parity of the (mixed) tokens in each of a power of two of bits, at least ``spread`` times as many as tokens (64 to 65536)."""
    bits = min(1 << 16, max(64, spread << (len(mixed) - 1).bit_length())) if len(mixed) else 64
    odd = np.bincount((mixed & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def half(long: bytes) -> bytes:
    """The bitmap of half the length, for those of more than 64 bits."""
    words = np.frombuffer(long, np.uint64).reshape(2, -1)
    return (words[0] ^ words[1]).tobytes()


def differ(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference, from two bitmaps; the longer is folded."""
    size = min(len(a), len(b)) * 8
    return (_fold(int.from_bytes(a, "little"), size) ^ _fold(int.from_bytes(b, "little"), size)).bit_count()


def _fold(x: int, size: int) -> int:
    out = 0
    while x:
        out, x = out ^ (x & ((1 << size) - 1)), x >> size
    return out


def few_pairs(node: list[int], root: list[int], n: list[int], maps: list[bytes], percent: int) -> Iterator[tuple[int, int]]:
    """Pairs of different components, in a group of a few rows in ascending size, where sizes and bitmaps allow a link."""
    for j in range(1, len(node)):
        for i in range(j):
            if root[i] != root[j] and percent * n[j] <= 100 * n[i] and similar((n[i] + n[j] - differ(maps[i], maps[j])) // 2, n[i], n[j], percent):
                yield (node[i], node[j]) if node[i] < node[j] else (node[j], node[i])


class Bitmaps:
    """Bitmaps of several lengths; a longer one is folded to the length of the one it meets."""

    def __init__(self, maps: list[bytes]):
        self.maps, self.length = maps, np.array([len(m) for m in maps])
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """All maps of at least this length, folded to it, and the row of each."""
        if length not in self.folded:
            row = np.full(len(self.maps), -1)
            parts, start = [], 0
            for own in np.unique(self.length[self.length >= length]).tolist():
                at = np.flatnonzero(self.length == own)
                words = np.frombuffer(b"".join(self.maps[i] for i in at.tolist()), np.uint64).reshape(len(at), own // length, length // 8)
                parts.append(np.bitwise_xor.reduce(words, axis=1))
                row[at] = start + np.arange(len(at))
                start += len(at)
            self.folded[length] = np.concatenate(parts), row
        return self.folded[length]

    def apart(self, i: int, at: np.ndarray) -> np.ndarray:
        """Lower bounds of the symmetric difference of one set and those ``at``."""
        out = np.zeros(len(at), np.int64)
        shorter = np.minimum(self.length[at], self.length[i])
        for length in np.unique(shorter).tolist():
            words, row = self.of(length)
            mine = np.flatnonzero(shorter == length)
            out[mine] = np.bitwise_count(words[row[at[mine]]] ^ words[row[i]]).sum(axis=1)
        return out


def distinct_pairs(low: list[np.ndarray], high: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.concatenate(low), np.concatenate(high)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    fresh = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    return a[fresh], b[fresh]


FEATURES = "n long, set_id binary, tokens array<long>, brief binary, bitmap binary"


def features(documents: DataFrame, classes: np.ndarray, width: int, percent: int) -> DataFrame:
    """(rid, doc_id, mark, n, set_id, tokens, brief, bitmap), written; tokens are the extended prefix in order, brief is a bitmap of
    about a bit for each token, for keys of few rows, and bitmap one of twice the length, which lets fewer pairs of a large key pass."""
    shared = documents.sparkSession.sparkContext.broadcast(classes)  # 2**BINS bytes

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        shingler = Shingler(width)
        for column in texts:
            sets = list(shingler.sets(*column_bytes(column)))
            n = np.array([len(s) for s in sets], np.int64)
            at, full = np.concatenate(([0], np.cumsum(n))), np.flatnonzero(n)
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            mixed, kinds = mix(every), shared.value[(every & np.uint64(len(shared.value) - 1)).astype(np.int64)]
            names = np.zeros((len(sets), 2), np.uint64)  # two independent sums name the set
            if len(full):
                for k, x in enumerate((mixed, mix(every ^ np.uint64(0xA5A5A5A5A5A5A5A5)))):
                    names[full, k] = np.add.reduceat(x, at[full], dtype=np.uint64)
            tokens, briefs, maps = [np.zeros(0, np.uint64)], [], []
            for s, a, b in zip(sets, at[:-1].tolist(), at[1:].tolist(), strict=True):
                tokens.append(in_order(s, kinds[a:b])[:b - a - needed(b - a, percent) + 2])
                maps.append(bitmap(mixed[a:b], 2))
                briefs.append(half(maps[-1]) if 32 < b - a <= 1 << 15 else bitmap(mixed[a:b]))
            held = pa.ListArray.from_arrays(np.cumsum([len(x) for x in tokens]).astype(np.int32), np.concatenate(tokens).view(np.int64))
            yield pa.StructArray.from_arrays(
                [pa.array(n), pa.array([x.tobytes() if k else None for x, k in zip(names, n, strict=True)], pa.binary()), held, pa.array(briefs, pa.binary()), pa.array(maps, pa.binary())],
                ["n", "set_id", "tokens", "brief", "bitmap"])

    found = documents.select("doc_id", F.xxhash64("text").alias("mark"), F.arrow_udf(run, FEATURES)(F.col("text")).alias("f"))
    out, _ = stage(found.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "mark", "f.*"), "shingles")
    return out


LIVE = "token long, rid long, extra boolean, frequent boolean, " + ", ".join(f"p{k} long" for k in range(PIVOTS))


def live_tokens(found: DataFrame, classes: np.ndarray, n_tokens: int, percent: int) -> DataFrame:
    """Prefix tokens that at least two rows have: (token, rid, extra: only in the extended prefix, frequent, pivots)."""
    parts = pieces(n_tokens, PART, least=24)
    shared = found.sparkSession.sparkContext.broadcast(classes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("tokens")
            count = np.diff(np.asarray(column.offsets)).astype(np.int64)
            token = np.asarray(column.flatten()).view(np.uint64)
            n = batch.column("n").to_numpy()
            rid = np.repeat(batch.column("rid").to_numpy(), count)
            place = np.arange(len(token)) - np.repeat(np.cumsum(count) - count, count)
            extra = place > np.repeat(n - needed(n, percent), count)
            part = (mix(token + np.uint64(7)) % np.uint64(parts)).astype(np.int64)
            order = np.lexsort((token, part))
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(bounds)):
                mine = order[bounds[p]:bounds[p + 1]]
                rows.append((int(p), *(zstandard.compress(x.tobytes(), 1) for x in (token[mine], rid[mine], extra[mine]))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))],
                                                 ["part", "token", "rid", "extra"])

    def keep(group: pa.Table) -> pa.Table:
        lean()
        token, rid, extra = (np.concatenate([np.frombuffer(zstandard.decompress(x), kind) for x in group.column(c).to_pylist()])
                             for c, kind in (("token", np.uint64), ("rid", np.int64), ("extra", bool)))
        order = np.lexsort((rid, token))
        token, rid, extra = token[order], rid[order], extra[order]
        heads = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        count = np.diff(np.append(heads, len(token)))
        many = np.repeat(count >= 2, count)
        group_of = np.repeat(np.arange(len(heads)), count)
        pivots = []
        for k in range(PIVOTS):
            by = np.lexsort((mix(rid.astype(np.uint64) + np.uint64(k << 56)), extra, group_of))
            pivots.append(np.repeat(rid[by[heads]], count)[many])
        frequent = shared.value[(token & np.uint64(len(shared.value) - 1)).astype(np.int64)] > 0
        return pa.table([pa.array(token[many].view(np.int64)), pa.array(rid[many]), pa.array(extra[many]), pa.array(frequent[many]), *map(pa.array, pivots)],
                        ["token", "rid", "extra", "frequent", *(f"p{k}" for k in range(PIVOTS))])

    dealt = found.where("n > 0").select("rid", "n", "tokens").mapInArrow(deal, "part int, token binary, rid binary, extra binary")
    out, _ = stage(dealt.groupBy("part").applyInArrow(keep, LIVE), "live-tokens")
    return out


def apart(a: str, b: str) -> Column:
    """Lower bound of the symmetric difference of two bitmap columns."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([differ(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int64())

    return F.arrow_udf(run, "long")(F.col(a), F.col(b))


def linked(percent: int, overlap: Column, a: Column, b: Column) -> Column:
    return 100 * overlap >= percent * (a + b - overlap)


def whole_sets(asked: DataFrame, rows: DataFrame, documents: DataFrame, width: int) -> DataFrame:
    """(rid, tokens) of the row numbers in ``asked`` (rid), each once; sets are made again from the texts of these rows only."""
    wanted = asked.join(rows, "rid").select("rid", "doc_id", "mark", "set_id")
    if asked.count() <= SMALL:  # some 50 bytes a row; beyond it texts and rows meet by key
        wanted = F.broadcast(wanted)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        shingler = Shingler(width)
        for column in texts:
            ids, blobs = [], []
            for s in shingler.sets(*column_bytes(column)):
                ids.append(np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes())
                blobs.append(s.tobytes())
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(blobs, pa.binary())], ["id", "tokens"])

    read = documents.select(F.col("doc_id").alias("_doc"), "text", F.xxhash64("text").alias("_mark"))
    texts = wanted.join(read, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("mark") == F.col("_mark")))
    # written before ids are compared: a filter on a made column would become a join key and make the sets of all texts
    made, _ = stage(texts.select("rid", "set_id", F.arrow_udf(run, "id binary, tokens binary")(F.col("text")).alias("s")), "sets")
    return made.where("s.id = set_id").select("rid", "s.tokens").dropDuplicates(["rid"])  # of rows that repeat as a whole


def verify(pairs: DataFrame, rows: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The (written) pairs (a, b) of row numbers whose whole sets are similar, written."""
    asked = pairs.select(F.col("a").alias("rid")).union(pairs.select(F.col("b").alias("rid"))).distinct()
    sets = whole_sets(asked, rows, documents, width)

    def overlap(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            out = []
            for p, q in zip(x, y, strict=True):
                a, b = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                n = len(np.intersect1d(a, b, assume_unique=True))
                out.append(similar(n, len(a), len(b), percent))
            yield pa.array(out, pa.bool_())

    both = (pairs.join(sets.select(F.col("rid").alias("b"), F.col("tokens").alias("tokens_b")), "b")
            .join(sets.select(F.col("rid").alias("a"), F.col("tokens").alias("tokens_a")), "a"))
    links, _ = stage(both.where(F.arrow_udf(overlap, "boolean")(F.col("tokens_a"), F.col("tokens_b"))).select("a", "b").distinct(), "links")
    return links


def star_pairs(live: DataFrame, nodes: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """For each node the pivot of its tokens whose bitmap is nearest, where sizes and bitmaps allow a link."""
    picked = live.where("NOT extra").select("rid", F.explode(F.array(*[f"p{k}" for k in range(PIVOTS)])).alias("pivot")).where("rid <> pivot").distinct()
    pairs = (picked.join(nodes.select("rid", F.col("node").alias("b")), "rid")
             .join(nodes.select(F.col("rid").alias("pivot"), F.col("node").alias("a")), "pivot").where("a <> b").select("a", "b").distinct())
    sized = (pairs.join(maps.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("brief").alias("map_b")), "b")
             .join(maps.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("brief").alias("map_a")), "a")
             .where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    near = sized.withColumn("apart", apart("map_a", "map_b")).where(
        linked(percent, F.floor((F.col("n_a") + F.col("n_b") - F.col("apart")) / 2), F.col("n_a"), F.col("n_b")))
    return near.groupBy("b").agg(F.min(F.struct("apart", "a")).alias("best")).select("best.a", "b")


def open_rows(live: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root, size) of the index keys that nodes of different components share, written; size is the key's rows."""
    named = live.join(nodes.select("rid", "node"), "rid").select("token", "node", "extra", "frequent").distinct()
    placed = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed, _ = stage(placed, "placed")
    unsettled = placed.where("NOT extra").groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
    members = placed.join(unsettled, "token")
    single = members.where("NOT frequent AND NOT extra").select("node", "root", F.array("token").alias("key"))
    # a frequent token goes with each later live token of the same extended prefix
    later = placed.select("node", F.col("token").alias("token2"), F.col("frequent").alias("frequent2"))
    double = (members.where("frequent AND NOT extra").join(later, "node").where("frequent2 AND token <> token2")
              .select("node", "root", F.array_sort(F.array("token", "token2")).alias("key")).distinct())
    return contested(single.union(double).withColumn("key", F.xxhash64("key")))


def contested(keyed: DataFrame) -> DataFrame:
    """Without the keys that one component fills, or one node has: these are settled. Written."""
    keys = keyed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y").select("key", "size")
    out, _ = stage(keyed.select("key", "node", "root").join(keys, "key"), "open-keys")
    return out


def open_pairs(rows: DataFrame, maps: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Pairs of nodes of different components that share an index key, where sizes and bitmaps allow a link: all of them, or only the
    ``nearest`` one of each node of a key. A part gives a pair once, however many of its keys the pair shares."""
    parts = pieces(rows.count(), OPEN, least=24)

    def compare(group: pa.Table) -> pa.Table:
        lean()
        group = group.sort_by([("key", "ascending"), ("n", "ascending")])
        key, node, root, n = (group.column(c).to_numpy() for c in ("key", "node", "root", "n"))
        bounds = [*np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))).tolist(), len(key)] if len(key) else [0]
        bitmaps, few = group.column("bitmap"), {}
        low, high = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a <= FEW:
                for pair in few_pairs(node[a:b].tolist(), root[a:b].tolist(), n[a:b].tolist(), [m.as_py() for m in bitmaps[a:b]], percent):
                    few[pair] = True
                continue
            names, count = np.unique(root[a:b], return_counts=True)
            if len(names) < 2:
                continue
            main = names[count.argmax()]  # its members need not meet each other
            maps, nodes_here, roots_here, sizes = Bitmaps(bitmaps[a:b].to_pylist()), node[a:b], root[a:b], n[a:b]
            for i in np.flatnonzero(roots_here != main).tolist():
                first, last = np.searchsorted(sizes, needed(int(sizes[i]), percent)), np.searchsorted(sizes, 100 * sizes[i] // percent, "right")
                at = np.arange(first, last)
                at = at[(roots_here[at] != roots_here[i]) & (nearest | (roots_here[at] == main) | (at > i))]
                if not len(at):
                    continue
                distance = maps.apart(i, at)
                overlap = (sizes[i] + sizes[at] - distance) // 2
                near = 100 * overlap >= percent * (sizes[i] + sizes[at] - overlap)
                at, distance = at[near], distance[near]
                if nearest and len(at):
                    at = at[np.lexsort((nodes_here[at], distance))[:1]]
                low.append(np.minimum(nodes_here[i], nodes_here[at]))
                high.append(np.maximum(nodes_here[i], nodes_here[at]))
            if sum(map(len, low)) > 1 << 20:  # a pair comes under each key it shares
                low, high = ([x] for x in distinct_pairs(low, high))
        low, high = distinct_pairs([*low, np.array([p[0] for p in few], np.int64)], [*high, np.array([p[1] for p in few], np.int64)])
        return pa.table({"a": low, "b": high})

    dealt = (rows.select("key", "node", "root", "size").join(maps, "node").withColumn("part", F.pmod("key", F.lit(parts)))
             .select("part", "key", "node", "root", "n", F.when(F.col("size") > FEW, F.col("bitmap")).otherwise(F.col("brief")).alias("bitmap")))
    return dealt.groupBy("part").applyInArrow(compare, "a long, b long").distinct()


def link_counts(sets: list[np.ndarray], cut: int, percent: int) -> np.ndarray:
    """How many of the others each set is similar to; those ahead of ``cut`` meet those from it on, and all meet each other if it is 0."""
    n = np.array([len(x) for x in sets])
    if len(sets) == 2:
        return np.full(2, similar(len(np.intersect1d(*sets, assume_unique=True)), int(n[0]), int(n[1]), percent), np.int64)
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    many = count[place] > 1  # a token of one set is in no overlap
    owner, place = np.repeat(np.arange(len(sets)), n)[many], (np.cumsum(count > 1) - 1)[place[many]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    columns, first = int(np.count_nonzero(count > 1)), cut or len(sets)
    wide = min(max(1, WORDS // len(sets)), -(-columns // 64)) * 64
    overlap = np.zeros((first, len(sets) - cut), np.int64)
    for low in range(0, columns, max(wide, 1)):
        a, b = np.searchsorted(place, (low, low + wide))
        bits = np.zeros((len(sets), wide), bool)
        bits[owner[a:b], place[a:b] - low] = True
        words = np.packbits(bits, axis=1).view(np.uint64)
        for i in range(first):
            overlap[i] += np.bitwise_count(words[i] & words[cut:]).sum(axis=1, dtype=np.int64)
    near = 100 * overlap >= percent * (n[:first, None] + n[None, cut:] - overlap)
    if cut:
        return np.concatenate((near.sum(axis=1), near.sum(axis=0)))
    np.fill_diagonal(near, False)
    return near.sum(axis=1)


def class_links(members: DataFrame, rows: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, class_links) of the nodes of ``members`` (node, root): with how many other classes each is linked. All links lie inside
    components, so the whole sets of a component all meet: in blocks of bounded size, each pair of blocks in one place."""
    sized = members.join(rows.select(F.col("rid").alias("node"), "n"), "node")
    blocks = sized.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / TOKENS), F.ceil(F.count("*") / SETS)).alias("blocks"), F.sum("n").alias("tokens"))
    blocks, _ = stage(blocks, "blocks")
    parts = pieces(blocks.agg(F.sum(F.col("tokens") * F.col("blocks"))).first()[0] or 0, TOKENS, least=24)
    sets = whole_sets(members.select(F.col("node").alias("rid")), rows, documents, width)
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    placed = (sets.withColumnRenamed("rid", "node").join(members.join(blocks.select("root", "blocks"), "root"), "node")
              .select("node", "root", "tokens", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
              .select("node", "root", "tokens", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y")))

    def count(group: pa.Table) -> pa.Table:
        lean()
        group = group.sort_by([("root", "ascending"), ("x", "ascending"), ("y", "ascending"), ("own", "ascending")])
        root, x, y, own, node = (group.column(c).to_numpy() for c in ("root", "x", "y", "own", "node"))
        heads = np.flatnonzero(np.concatenate(([True], (root[1:] != root[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(root) else []
        tokens, found = group.column("tokens"), np.zeros(len(root), np.int64)
        for a, b in zip(heads, [*heads[1:], len(root)], strict=True):
            cut = int(np.searchsorted(own[a:b], y[a])) if x[a] < y[a] else 0
            if b - a > 1 and (x[a] == y[a] or 0 < cut < b - a):
                found[a:b] = link_counts([np.frombuffer(t.as_buffer(), np.uint64) for t in tokens[a:b]], cut, percent)
        return pa.table({"node": node, "links": found})

    dealt = placed.withColumn("part", F.pmod(F.xxhash64("root", "x", "y"), F.lit(parts)))
    return dealt.groupBy("part").applyInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("class_links"))


def near_duplicates(documents: DataFrame, width: int = WIDTH, percent: int = PERCENT, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_links, mark, group) of each row of ``documents`` (doc_id, text): component_id is
    the smallest doc_id that similar sets reach, class_links the number of other classes whose sets are similar, mark a hash of the text that
    tells rows of one doc_id apart, and group a name of the component among those of this call (NULL without tokens).
    Without ``count_links`` class_links is NULL, for callers that need components only."""
    with small_batches(documents.sparkSession):
        return _near_duplicates(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width, percent, count_links)


def _near_duplicates(texts: DataFrame, width: int, percent: int, count_links: bool) -> DataFrame:
    classes = sketch(texts, width)
    found = features(texts, classes, width, percent)
    sets = found.where("set_id IS NOT NULL").groupBy("set_id").agg(F.min("rid").alias("node"), F.min("doc_id").alias("label"))
    rows, _ = stage(found.select("rid", "doc_id", "mark", "n", "set_id").join(sets, "set_id", "left"), "classes")
    nodes = rows.where("node IS NOT NULL").select("rid", "node")
    maps = found.select(F.col("rid").alias("node"), "n", "brief", "bitmap").join(rows.where("rid = node").select("node"), "node", "left_semi")
    live = live_tokens(found, classes, found.agg(F.sum(F.size("tokens"))).first()[0] or 0, percent)
    star, _ = stage(star_pairs(live, nodes, maps, percent), "pairs")
    first = verify(star, rows, texts, width, percent)
    roots, _ = stage(components(first), "roots")
    left = open_rows(live, nodes, roots)
    links = first
    for k in range(NEAREST + 1):
        nearest = k < NEAREST
        # a nearest pair that was no link comes again in the last round; it is one for each set at most
        pairs, _ = stage(open_pairs(left.where(F.col("size") > FEW) if nearest else left, maps, percent, nearest), "pairs")
        if pairs.isEmpty():
            continue
        more = verify(pairs, rows, texts, width, percent)
        links = links.union(more)
        if nearest and not more.isEmpty():
            # only large keys can have changed much; a pair that a small key gives too much is compared in vain, no more
            large, small = left.where(F.col("size") > FEW), left.where(F.col("size") <= FEW)
            now = large.drop("root", "size").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
            left = contested(now).select("key", "node", "root", "size").union(small.select("key", "node", "root", "size"))
    last = components(links)
    labelled = rows.where("rid = node").select("node", "label").join(last, "node")
    lowest = labelled.groupBy("root").agg(F.min("label").alias("component"))
    named = last.join(lowest, "root").select("node", "root", "component")
    out = rows.join(named, "node", "left").withColumn("class_links", F.lit(None).cast("long"))
    if count_links:
        counted = class_links(last, rows, texts, width, percent)
        out = out.drop("class_links").join(counted, "node", "left").withColumn("class_links", F.coalesce("class_links", F.lit(0).cast("long")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "label", "doc_id").alias("component_id"), "class_links", "mark", F.coalesce("root", "node").alias("group"))
