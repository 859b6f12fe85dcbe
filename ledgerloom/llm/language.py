"""Language identification: averaged hashed subword embeddings under a linear softmax.

Features of a text are the byte 1- to 4-grams inside its words (with a mark for each end) of the lower-cased
text, hashed into buckets. Each bucket has an embedding; a text is the average of its embeddings, weighted by how
often each occurs, and a softmax over a linear map of that average gives the languages. Embeddings and map are
trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows (``SAMPLE``), in an
order fixed by a seed. One part of the sample is held back to fit a temperature, so that scores are
probabilities that can be compared, and to place the rejection threshold below nearly all of its right answers.

Prediction reads the whole text and nothing else. A text that is null or has no letter is ``und`` with score 0 and
is rejected. Rows without a language or a text teach nothing; with no labelled row at all every text is ``und``.
Equal texts get equal answers. Ties between languages go to the first in sorted order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, column_bytes, free_names, lean, mix, slices, without

#: Buckets, embedding width, longest gram; rows that training may collect, at most, and the part held back.
BUCKETS, WIDTH, LONGEST = 1 << 14, 16, 4
SAMPLE, HELD_BACK = 3000, 0.25
EPOCHS, RATE, SEED = 6, 8.0, 7
#: Share of right held-back answers that rejection may cost.
FALSE_REJECTIONS = 0.001
UNKNOWN = "und"

#: Bytes of words: letters of ASCII and everything beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Text in one pass of array work, in bytes; its grams take some fifty times as much.
PASS = 1 << 18


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # of each bucket and language: embeddings times the linear map
    bias: np.ndarray
    temperature: float
    threshold: float


def grams(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every gram of every document, and the n + 1 offsets of the documents in them."""
    # other bytes become one mark, and each document is led and ended by one
    n = len(offsets) - 1
    padded = np.zeros(len(data) + n + 1, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    padded[at] = np.where(LETTERS[data], LOWER[data], 0)
    bounds = offsets + np.arange(n + 1)
    codes, owners = [], []
    h = padded.astype(np.uint64) + np.uint64(1)
    inside = padded != 0
    code, crosses = h, np.zeros(len(padded), bool)
    for size in range(1, longest + 1):
        if size > 1:
            code = code[:-1] * np.uint64(257) + h[size - 1:]
            # a mark may only lead or end a gram
            crosses = crosses[:-1] | (~inside[size - 2:-1] if size > 2 else np.zeros(len(code), bool))
        keep = np.flatnonzero(~crosses & (inside[:len(code)] if size == 1 else (inside[:len(code)] | inside[size - 1:])))
        codes.append(mix(code[keep] + np.uint64(size << 40)) & np.uint64(buckets - 1))
        owners.append(keep)
    split = [np.searchsorted(o, bounds) for o in owners]
    total = np.sum(split, axis=0)
    out = np.empty(total[-1], np.int64)
    # grams of a document lie together, one size after the other
    for k, (c, s) in enumerate(zip(codes, split, strict=True)):
        before = np.sum([x[1:] for x in split[:k]], axis=0) + np.sum([x[:-1] for x in split[k:]], axis=0) if k else np.sum([x[:-1] for x in split], axis=0)
        out[np.arange(len(c)) + np.repeat(before - s[:-1], np.diff(s))] = c
    return out, total


def has_letter(text: str) -> Column:
    return F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))


def sample(labelled: DataFrame, id_column: str, rows: int) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """About ``rows`` rows, and no more, as (language, buckets, shares). Rows are picked by a hash of id and text
    against a share of all labelled rows, repeated rows once, and featurized whole on the executors."""
    usable = labelled.where(F.col("lang").isNotNull() & has_letter("text"))
    total = usable.count()
    if not total:
        return []
    scale = 1 << 40
    picked = usable.select("lang", "text", F.pmod(F.xxhash64(F.col(id_column).cast("string"), F.col("text"), F.lit("language")), F.lit(scale)).alias("h"))
    some = picked.where(F.col("h") < int(scale * min(1.0, rows / total))).groupBy("h").agg(F.min(F.struct("lang", "text")).alias("r")).select("h", "r.lang", "r.text")

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            out = []
            for i in range(batch.num_rows):
                one = data[offsets[i]:offsets[i + 1]]
                ids, counts = np.unique(grams(one, np.array([0, len(one)]))[0], return_counts=True)
                out.append(ids.astype(np.uint16).tobytes() + (counts / counts.sum()).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang").cast(pa.string()), pa.array(out, pa.binary())], ["h", "lang", "features"])

    found = sorted(some.mapInArrow(featurize, "h long, lang string, features binary").collect(), key=lambda r: r.h)[:rows]
    return sorted(((r.lang, np.frombuffer(r.features[:len(r.features) // 3], np.uint16).astype(np.int64), np.frombuffer(r.features[len(r.features) // 3:], np.float32))
                   for r in found), key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """Stochastic gradient descent, one row at a time; then temperature and threshold on the rows held back."""
    languages = sorted({r[0] for r in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(rows))
    back = order[:int(len(rows) * HELD_BACK)] if len(rows) >= 20 else order[:0]
    learn = order[len(back):]
    place = {x: i for i, x in enumerate(languages)}
    e = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    w, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(learn):
            lang, ids, share = rows[i]
            mean = share @ e[ids]
            error = softmax(mean @ w + bias)
            error[place[lang]] -= 1
            step = w @ error
            w -= 0.1 * rate * np.outer(mean, error)
            bias -= 0.01 * rate * error
            e[ids] -= rate * share[:, None] * step
    logits = (e @ w).astype(np.float32)
    model = Model(languages, logits, bias, 1.0, 0.0)
    if len(back):
        z = np.array([rows[i][2] @ logits[rows[i][1]] + bias for i in back])
        truth = np.array([place[rows[i][0]] for i in back])
        loss = [(-np.log(np.maximum(softmax(z / t)[np.arange(len(z)), truth], 1e-12)).mean(), t) for t in np.geomspace(0.25, 8, 41)]
        model.temperature = float(min(loss)[1])
        p = softmax(z / model.temperature)
        right = np.sort(p.max(axis=1)[p.argmax(axis=1) == truth])
        model.threshold = rejection(right)
    return model


def rejection(right: np.ndarray) -> float:
    """The score that a share ``FALSE_REJECTIONS`` of right answers lies below; ``right`` are their held-back scores, ascending.
    With too few for that share, the log-odds go on below the least of them as the lowest ones fall (exponentially)."""
    n = len(right)
    if n < 2:
        return 0.0
    at = int(n * FALSE_REJECTIONS)
    odds = np.log(np.clip(right, 1e-9, 1 - 1e-9)) - np.log1p(-np.clip(right, 1e-9, 1 - 1e-9))
    k = min(n - 1, int(np.sqrt(n)))
    # the least of n has a share of ln 2 / (n + 1) below it, in the median
    beyond = max(0.0, np.log(np.log(2) / ((n + 1) * FALSE_REJECTIONS))) * (odds[k] - odds[:k]).mean()
    return float(1 / (1 + np.exp(beyond - odds[at])))


def predict(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with lang_pred, score and rejected, which replace columns of these names. Only the text is read."""
    fields = without(documents.columns, "lang_pred", "score", "rejected")
    letters, lettered, guessed = free_names(fields, "_letters", "_text", "_guess")
    plain = documents.select(*[F.col(f"`{c}`") for c in fields]).withColumn(letters, has_letter(text)).withColumn(lettered, F.when(F.col(letters), F.col(text)))

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        logits = np.ascontiguousarray(model.logits)
        for column in texts:
            data, offsets = column_bytes(column)
            scores = np.zeros((len(offsets) - 1, logits.shape[1]))
            for a, b in slices(offsets, PASS):
                ids, at = grams(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                full = np.flatnonzero(np.diff(at))
                if len(full):
                    for k in range(logits.shape[1]):
                        scores[a + full, k] = np.add.reduceat(logits[ids, k], at[full], dtype=np.float64) / np.diff(at)[full]
            p = softmax((scores + model.bias) / model.temperature)
            yield pa.StructArray.from_arrays(
                [pa.array(np.array(model.languages or [UNKNOWN], object)[p.argmax(axis=1)], pa.string()), pa.array(p.max(axis=1))], ["lang", "score"])
        lean()

    guess = F.arrow_udf(run, "lang string, score double")
    known = F.col(letters) & F.lit(bool(model.languages))
    out = plain.withColumn(guessed, guess(F.col(lettered)))
    score = F.when(known, F.least(F.greatest(F.col(f"{guessed}.score"), F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return out.select(
        *[F.col(f"`{c}`") for c in fields], F.when(known, F.col(f"{guessed}.lang")).otherwise(F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"),
        (~known | (score < model.threshold)).alias("rejected"))


def fold(id_column: str = "doc_id", parts: int = 4) -> Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(parts))


def identify(documents: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Trains on the rows whose fold is not 2 and predicts every row; adds held_out, lang_pred, score, rejected.
    A null id is held out."""
    held = F.coalesce(fold(id_column) == 2, F.lit(True))
    model = train(sample(documents.where(~held), id_column, SAMPLE))
    return predict(documents.withColumn("held_out", held), model)
