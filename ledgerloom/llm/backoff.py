"""Language-model scoring with interpolated backoff over words, pairs and triples, all counts exact.

A pair or triple is kept when it occurs ``LEAST`` times in training, whatever the size of the corpus. The weight of a
word w after u, after t:

- alone (c(w) + 1) / (N + V + 1);
- after u the share of absolute discounting, (c(u, w) - d) / h for a kept pair with h = c(u) + ``PRIOR``, plus the mass
  that the kept pairs of u leave over times the weight of w alone;
- after t, u the same with kept triples, h = c(t, u) + ``PRIOR``, and the weight of w after u. A history without kept
  n-grams leaves everything to the shorter one.

As these weights fall back by a factor of the history alone, they are a weighted automaton: histories are states, kept n-grams arcs, and
what a history leaves over is the weight of its failure arc. A document is traversed once from left to right, carrying the state.

No model is gathered anywhere: a slice of documents has the states and arcs that its own text can reach. Documents are cut into written slices; a slice sends its distinct words and pairs with
their counts in training to parts by hash, and each part sends back the totals, so that a slice knows the exact counts
at each of its tokens. Triples of which both pairs are kept follow, and the sums over what each history keeps: each kept n-gram
belongs to one of the slices that have it, and this slice alone adds it to the history's sum. An n-gram is one entry of
a slice however often it occurs there, so none is a hot key, and only packed arrays are shuffled.

Words are runs of bytes other than space and 9-13 after lower-casing A-Z, named by 64-bit hashes; a document ends
with an end token, which is also the history of its first word. A null text is empty: it has the end token only. A row
without doc_id is held out. Repeated rows count as often as they occur. Held-out rows never change what is learned. An
empty table gives an empty result.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import stage

from .common import LOWER, NOT_SPACE, SpanHasher, column_bytes, distinct, lean, mix, pieces, slices, text_bytes, word_spans

#: Least count in training of a kept pair or triple, at every size of the corpus.
LEAST = 2
#: What each kept count gives up, and occurrences that a history is taken to have had of the shorter one's kind:
#: they keep rare histories close to the shorter ones.
DISCOUNT, PRIOR = 0.75, 5.0
#: Text for each part of the counts, and in a slice.
PART, SLICE = 8 << 20, 4 << 20
FOLDS, HELD = 7, 2
#: Tokens of a document in one stretch of the traversal, and those ahead of it that lead to its state.
STRETCH, AHEAD = 256, 2
#: Stretches that are worth a common step.
WIDE = 32
#: Name of the end token; keys of slices that teach nothing begin here.
END, FOREIGN = np.uint64(0), 1 << 60


def fold_is_held(id_column: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(FOLDS)) == HELD, F.lit(True))


def token_slices(batch: pa.RecordBatch, hasher: SpanHasher) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, last, names of all tokens with an end after each document, first token of each document)."""
    data, at = column_bytes(batch.column("text"))
    for a, b in slices(at, SLICE):
        text, offsets = LOWER[data[at[a]:at[b]]], at[a:b + 1] - at[a]
        starts, ends, first = word_spans(text, offsets, NOT_SPACE)
        n = b - a
        names = np.zeros(len(starts) + n, np.uint64)
        place = np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(first))
        names[place] = np.maximum(hasher.spans(hasher.sums(text), starts, ends), np.uint64(1))
        yield a, b, names, first + np.arange(n + 1)


def pack(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(blob), kind)


def planes(x: np.ndarray) -> bytes:
    """Numbers from 0 on, all lowest bytes together, then all next ones as far as any number goes, deflated."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    x = x.astype(np.uint64, copy=False)
    return zstandard.compress(bytes([width]) + b"".join((x >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(width)), 1)


def unplanes(blob: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    rows = raw[1:].reshape(int(raw[0]), -1)
    out = rows[0].astype(kind)
    for k in range(1, len(rows)):
        out |= rows[k].astype(kind) << np.dtype(kind).type(8 * k)
    return out


def steps(x: np.ndarray) -> bytes:
    """Ascending codes as differences."""
    return planes(np.diff(x, prepend=np.uint64(0)))


def unsteps(blob: bytes) -> np.ndarray:
    return np.cumsum(unplanes(blob, np.uint64), dtype=np.uint64)


SLICES = "key long, ids binary, marks binary, n binary, words binary, place binary"
SENT = "part int, key long, codes binary, a binary, b binary"
TOTALS = "part int, key long, a binary, b binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: What a part adds up: counts of words, of pairs, what the pairs of a word keep, counts of triples, what the triples of a pair keep.
KIND_WORD, KIND_PAIR, KIND_AFTER_WORD, KIND_TRIPLE, KIND_AFTER_PAIR = range(5)


def follow(history: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Codes of n-grams from those of their histories."""
    return mix(history * np.uint64(0x9E3779B97F4A7C15) + names)


def walk(documents: DataFrame, first_key: int = 0) -> DataFrame:
    """Slices of ``documents`` (doc_id, text, held), written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        lean()
        hasher, part, number = SpanHasher(2), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, held = batch.column("doc_id"), np.asarray(batch.column("held").to_numpy(zero_copy_only=False), bool)
            for a, b, names, first in token_slices(batch, hasher):
                key, number = first_key + (part << 32) + number, number + 1
                words, _, place = distinct(names)
                doc_ids = ids.slice(a, b - a)
                marks = np.asarray(doc_ids.is_null()).astype(np.uint8) | (held[a:b].astype(np.uint8) << 1)
                row = (pack(np.asarray(doc_ids.fill_null(0)).astype(np.int64)), pack(marks), pack(np.diff(first)), steps(words), planes(place.astype(np.uint32)))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), *(pa.array([x], pa.binary()) for x in row)], ["key", "ids", "marks", "n", "words", "place"])

    out, _ = stage(documents.select("doc_id", "text", "held").mapInArrow(run, SLICES), "slices")
    return out


class Slice:
    """A slice's tokens and n-grams, with the totals that parts have sent back so far."""

    def __init__(self, row: dict, totals: list[dict], parts: int, least: int):
        self.parts, self.least, self.key = parts, least, row["key"]
        self.ids, self.marks, self.n = unpack(row["ids"], np.int64), unpack(row["marks"], np.uint8), unpack(row["n"], np.int64)
        self.learn = np.repeat((self.marks & 2) == 0, self.n)
        self.words, self.place = unsteps(row["words"]), unplanes(row["place"], np.uint32).astype(np.int64)
        self.names = self.words[self.place]
        self.last = np.concatenate(([END], self.names[:-1]))
        self.grams = follow(self.last, self.names)
        self.pairs, self.pair_first, self.pair_at = distinct(self.grams)
        self.found: dict[int, list[dict]] = {}
        for r in sorted(totals, key=lambda r: r["part"]):
            self.found.setdefault(r["part"] // parts, []).append(r)
        if KIND_WORD in self.found:
            # an end has the least name, so it is the first word of every slice
            self.c1, self.c2 = self.total(KIND_WORD)[0] >> 1, self.total(KIND_PAIR)[0] >> 1
            kept = self.c2[self.pair_at] >= least
            # a triple needs both of its pairs; none goes beyond the end before its last word
            self.longer = np.flatnonzero(kept & np.concatenate(([False], kept[:-1])) & (self.last != END))
            self.triples, self.triple_first, self.triple_at = distinct(follow(self.grams[self.longer - 1], self.names[self.longer]))
            self.asks1 = np.flatnonzero(self.c1 >= least)
            inner = np.flatnonzero(self.last != END) - 1  # tokens whose pair is a history
            asked = np.zeros(len(self.pairs), bool)
            asked[self.pair_at[inner[kept[inner]]]] = True
            self.asks2 = np.flatnonzero(asked)

    def total(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.found.get(kind, [])
        return tuple(np.concatenate([np.zeros(0, np.int64), *(unplanes(r[c], np.int64) for r in rows)]) for c in ("a", "b"))

    def counts(self, at: np.ndarray, n: int, where: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Occurrences in training of each of n codes, ``at`` being the code of each token in ``where``."""
        return np.bincount(at, weights=self.learn[where], minlength=n).astype(np.int64)

    def kept_after(self, histories: np.ndarray, totals: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of n histories the counts, and the number, of kept n-grams that belong to this slice."""
        mine = np.flatnonzero((totals & 1 == 1) & (totals >> 1 >= self.least))
        return (np.bincount(histories[mine], weights=totals[mine] >> 1, minlength=n).astype(np.int64), np.bincount(histories[mine], minlength=n))

    def send(self, kind: int, codes: np.ndarray, a: np.ndarray, b: np.ndarray | None = None) -> list[tuple]:
        """Rows for the parts; ``codes`` ascend, and so do parts."""
        b = np.zeros(len(a), np.int64) if b is None else b
        part = ((codes >> np.uint64(32)) * np.uint64(self.parts)) >> np.uint64(32)
        bounds = np.searchsorted(part, np.arange(self.parts + 1).astype(np.uint64))
        return [(kind * self.parts + int(p), self.key, *(f(x[bounds[p]:bounds[p + 1]]) for f, x in ((steps, codes), (planes, a), (planes, b)))) for p in np.flatnonzero(np.diff(bounds))]

    def first_round(self) -> list[tuple]:
        return [*self.send(KIND_WORD, self.words, self.counts(self.place, len(self.words))),
                *self.send(KIND_PAIR, self.pairs, self.counts(self.pair_at, len(self.pairs)))]

    def second_round(self) -> list[tuple]:
        before = np.concatenate(([0], self.place[:-1]))  # the word before each token; the end is word 0
        a, b = self.kept_after(before[self.pair_first], self.total(KIND_PAIR)[0], len(self.words))
        return [*self.send(KIND_AFTER_WORD, self.words[self.asks1], a[self.asks1], b[self.asks1]),
                *self.send(KIND_TRIPLE, self.triples, self.counts(self.triple_at, len(self.triples), self.longer))]

    def third_round(self) -> list[tuple]:
        a, b = self.kept_after(self.pair_at[self.longer - 1][self.triple_first], self.total(KIND_TRIPLE)[0], len(self.pairs))
        return self.send(KIND_AFTER_PAIR, self.pairs[self.asks2], a[self.asks2], b[self.asks2])

    def automaton(self, size: int) -> Automaton:
        """The part of the model's automaton that the slice's tokens can reach."""
        alone = (self.c1 + 1) / size
        before = np.concatenate(([0], self.place[:-1]))
        word, last = before[self.pair_first], self.place[self.pair_first]
        left1, seen1 = self.left(KIND_AFTER_WORD, self.asks1, self.c1)
        kept = self.c2 >= self.least
        after_word = np.where(kept, self.c2 - DISCOUNT, 0.0) / seen1[word] + left1[word] * alone[last]
        left2, seen2 = self.left(KIND_AFTER_PAIR, self.asks2, self.c2)
        count = self.total(KIND_TRIPLE)[0] >> 1
        history, pair = self.pair_at[self.longer - 1][self.triple_first], self.pair_at[self.longer][self.triple_first]
        after_pair = (count - DISCOUNT) / seen2[history] + left2[history] * after_word[pair]
        return Automaton(alone, left1, left2, word, last, kept, after_word, history, pair, count >= self.least, after_pair)

    def left(self, kind: int, asked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The mass that each history leaves to the shorter one, and what its n-grams are shares of."""
        seen, kept = counts + PRIOR, np.zeros(len(counts))
        a, b = self.total(kind)
        kept[asked] = (a >> 1) - DISCOUNT * b
        return (seen - kept) / seen, seen


class Automaton:
    """Weighted backoff automaton. State 0 has no history, 1 + w the word w as history, and beyond them 1 + words + p the pair p.

    A kept n-gram is an arc from the state of its history to the longest state that its end is in, with the smoothed weight of its
    last word. A state without an arc for a word fails to the state of its history's tail, at the weight that its kept
    n-grams leave over; state 0 has an arc for every word. Word 0 is the end: it is the history of a document's first
    word, and no longer history goes beyond it.
    """

    def __init__(self, alone: np.ndarray, left1: np.ndarray, left2: np.ndarray, word: np.ndarray, last: np.ndarray, kept: np.ndarray,
                 after_word: np.ndarray, history: np.ndarray, pair: np.ndarray, often: np.ndarray, after_pair: np.ndarray):
        self.words = words = len(alone)
        state = np.where(kept & (last != 0), 1 + words + np.arange(len(last)), 1 + last)  # after a pair
        sources = np.concatenate((1 + word[kept], 1 + words + history[often]))
        labels = np.concatenate((last[kept], last[pair[often]]))
        codes = sources * words + labels
        order = np.argsort(codes)
        # the last code is no arc: every search ends at a place
        self.codes = np.append(codes[order], np.iinfo(np.int64).max)
        self.weight = np.append(np.log10(np.concatenate((after_word[kept], after_pair[often])))[order], 0.0)
        self.target = np.append(np.concatenate((state[kept], state[pair[often]]))[order], 0)
        self.first = np.log10(alone)
        self.loss = np.log10(np.concatenate(([1.0], left1, left2)))
        self.fail = np.concatenate(([0], np.zeros(words, np.int64), 1 + last))

    def score(self, tokens: np.ndarray, begins: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The sum of log10 weights of each document, traversed from left to right with its state carried on. Long documents are
        traversed in stretches, and all stretches take their next token together; a few that are left of a small automaton go on one by one. As no history is longer than ``AHEAD`` words,
        every path over the tokens ahead of a stretch ends in the state that the document has there."""
        cuts = np.maximum(1, -(-n // STRETCH))
        owner = np.repeat(np.arange(len(n)), cuts)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * STRETCH
        ahead = np.where(first > 0, AHEAD, 0)
        length = np.minimum(n[owner] - first, STRETCH) + ahead
        order = np.argsort(-length, kind="stable")
        at, length, late = (begins[owner] + first - ahead)[order], length[order], ahead[order] > 0
        state, total = np.ones(len(order), np.int64), np.zeros(len(order))
        longest, step, live = int(length.max(initial=0)), 0, len(order)
        while step < longest:
            live = int(np.searchsorted(-length[:live], -step))  # stretches of more tokens than that
            if step >= AHEAD and live < WIDE and 100 * (longest - step) > len(self.codes):
                break
            state[:live], weight = self.step(state[:live], tokens[at[:live] + step])
            total[:live] += np.where(late[:live], 0.0, weight) if step < AHEAD else weight
            step += 1
        if step < longest:
            walk = self.walker()
            for i in range(live):
                total[i] = walk(tokens[at[i] + step:at[i] + length[i]].tolist(), int(state[i]), float(total[i]))
        return np.bincount(owner[order], weights=total, minlength=len(n))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next state, log10 weight) of one token from each state."""
        state, target, weight, left = state.copy(), 1 + token, np.zeros(len(state)), np.arange(len(state))
        while len(left):
            wanted = state[left] * self.words + token[left]
            arc = np.searchsorted(self.codes, wanted)
            found = self.codes[arc] == wanted
            weight[left[found]] += self.weight[arc[found]]
            target[left[found]] = self.target[arc[found]]
            left = left[~found]
            weight[left] += self.loss[state[left]]
            state[left] = self.fail[state[left]]
            ground = left[state[left] == 0]
            weight[ground] += self.first[token[ground]]
            left = left[state[left] != 0]
        return target, weight

    def walker(self) -> Callable[[list[int], int, float], float]:
        """The same for the rest of one stretch, from a state and a total."""
        arcs, words = dict(zip(self.codes.tolist(), range(len(self.codes)), strict=True)), self.words
        weight, target, first, loss, fail = (x.tolist() for x in (self.weight, self.target, self.first, self.loss, self.fail))

        def walk(tokens: list[int], state: int, total: float) -> float:
            for token in tokens:
                arc = arcs.get(state * words + token)
                while arc is None:
                    total += loss[state]
                    state = fail[state]
                    if not state:
                        break
                    arc = arcs.get(state * words + token)
                if arc is None:
                    total += first[token]
                    state = 1 + token
                else:
                    total += weight[arc]
                    state = target[arc]
            return total

        return walk


def add_up(group: pa.Table) -> pa.Table:
    """Totals of each code over all slices, for each slice; the lowest bit of the first marks the slice a code belongs to. The
    row of key -1 has the sum and the number of all codes that occur in training."""
    lean()
    group = group.sort_by("key")
    codes = [unsteps(x) for x in group.column("codes").to_pylist()]
    sums, first, inverse = distinct(np.concatenate(codes))
    a, b = (np.bincount(inverse, weights=np.concatenate([unplanes(x, np.int64) for x in group.column(c).to_pylist()]), minlength=len(sums)).astype(np.int64) for c in ("a", "b"))
    first_total, second_total = a[inverse] << 1, b[inverse]
    first_total[first] |= 1
    bounds = np.cumsum([0, *map(len, codes)])
    cut = [slice(x, y) for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
    keys = group.column("key").to_pylist() + [-1]
    return pa.table([pa.array(group.column("part").to_pylist()[:1] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                     pa.array([*(planes(first_total[c]) for c in cut), planes(a.sum(keepdims=True))], pa.binary()),
                     pa.array([*(planes(second_total[c]) for c in cut), planes(np.array([(a > 0).sum()], np.int64))], pa.binary())], ["part", "key", "a", "b"])


@dataclass
class Model:
    documents: DataFrame
    slices: DataFrame  # written; what is not held out is counted when documents are scored
    least: int


def learn(documents: DataFrame, least: int = LEAST) -> Model:
    """``documents`` has doc_id, text and held."""
    return Model(documents, walk(documents), least)


def score(documents: DataFrame, model: Model, parts: int) -> DataFrame:
    """Scores every row of ``documents`` (doc_id, text, held) by what ``model`` has learned from its own."""
    spark, least, slices = documents.sparkSession, model.least, model.slices
    other = documents is not model.documents
    if other:  # these are scored, but teach nothing
        slices = slices.union(walk(documents.withColumn("held", F.lit(True)), FOREIGN))

    def rows_of(rows: list[tuple]) -> pa.Table:
        kinds = (("part", pa.int32()), ("key", pa.int64()), ("codes", pa.binary()), ("a", pa.binary()), ("b", pa.binary()))
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds)})

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows_of(Slice(batch.slice(i, 1).to_pylist()[0], [], parts, least).first_round()).to_batches()

    def second(own: pa.Table, found: pa.Table) -> pa.Table:
        lean()
        return rows_of([x for r in own.to_pylist() for x in Slice(r, found.to_pylist(), parts, least).second_round()])

    def third(own: pa.Table, found: pa.Table) -> pa.Table:
        lean()
        return rows_of([x for r in own.to_pylist() for x in Slice(r, found.to_pylist(), parts, least).third_round()])

    def with_totals(totals: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, slices: DataFrame = slices) -> DataFrame:
        return slices.groupBy("key").cogroup(totals.where("key >= 0").groupBy("key")).applyInArrow(work, schema)

    def added(sent: DataFrame) -> DataFrame:
        out, _ = stage(sent.groupBy("part").applyInArrow(add_up, TOTALS), "totals")
        return out

    totals = added(slices.mapInArrow(begin, SENT))
    sums = totals.where((F.col("key") == -1) & (F.floor(F.col("part") / parts) == KIND_WORD)).select("a", "b").collect()  # a row for each part
    n, v = (sum(int(unplanes(bytes(r[c]), np.int64)[0]) for r in sums) for c in ("a", "b"))
    for work in (second, third):
        free_shuffles(spark)
        totals = totals.union(added(with_totals(totals, work, SENT)))
    free_shuffles(spark)

    def finish(own: pa.Table, found: pa.Table) -> pa.Table:
        lean()
        out = []
        for r in own.to_pylist():
            x = Slice(r, found.to_pylist(), parts, least)
            count = x.c1[x.place]
            alone = (count + 1) / (n + v + 1)
            begins = np.cumsum(x.n) - x.n
            model = x.automaton(n + v + 1)
            scores = model.score(x.place, begins, x.n)
            del model
            held = np.ones(len(x.ids), bool) if other else (x.marks & 2) > 0
            out.append(pa.table([pa.array(x.ids, mask=(x.marks & 1).astype(bool)), pa.array(held), pa.array(x.n), pa.array(np.add.reduceat((count > 0).astype(np.int64), begins)),
                                 pa.array(np.full(len(x.ids), n)), pa.array(np.add.reduceat(np.log10(alone), begins)), pa.array(scores, pa.float64())],
                                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]))
        return pa.concat_tables(out) if out else pa.table({n: pa.array([], t) for n, t in (
            ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))})

    scored = slices.where(F.col("key") >= FOREIGN) if other else slices
    return with_totals(totals.where(F.col("key") >= FOREIGN) if other else totals, finish, SCORED, scored)


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files of finished jobs stay until the driver collects its garbage; written totals have replaced them."""
    for _ in range(2):
        gc.collect()
        time.sleep(1.5)  # py4j tells the JVM of dropped objects once a second, and Spark's cleaner works apart
        spark.sparkContext._jvm.System.gc()
    time.sleep(1.5)


def learn_and_score(documents: DataFrame) -> DataFrame:
    """Learns from the rows whose fold is not held out and scores every row of ``documents`` (doc_id, text)."""
    told = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", fold_is_held().alias("held"))
    return score(told, learn(told), pieces(text_bytes(told), PART, least=24))
