"""BPE encoding and decoding with content-defined chunks that documents share.

Texts are cut where a rolling hash of the last ``REACH`` bytes hits a pattern, so equal passages give equal chunks
wherever they stand. A task encodes each distinct chunk once (it remembers a bounded number of bytes of them) and
puts documents together from the chunks' ids. The pieces next to a cut can differ from those of the whole text, so
every join is repaired: a window that begins at a piece before the cut whose extent the cut cannot change is
encoded again, until a piece of the window and one of the right chunk begin at the same byte. From there on the
chunk's ids are those of the whole text, since the pattern looks at nothing before a piece. A window that does not
agree is doubled; where it comes to the end of the chunk, and in texts with special tokens, the whole text is
encoded instead. Ids are decoded again, and a document whose bytes do not come back is an error.

A null text is an empty one; it has no ids. Rows are independent, so repeated rows and ties need no rule.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytepair import Coder, Vocabulary
from .common import SpanHasher, column_bytes, free_names, lean, slices, without

#: Bytes that decide on a cut; one cut in so many bytes; shortest and longest chunk.
REACH, EVERY, LEAST, MOST = 32, 1024, 256, 8192
#: Bytes of a window on either side of a cut; a piece's extent depends on no more than ``LOOK`` bytes behind it.
WINDOW, LOOK = 48, 16
#: Bytes of distinct chunks that a task remembers.
REMEMBER = 12 << 20


def cuts(data: np.ndarray, offsets: np.ndarray, hasher: SpanHasher) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of all chunks of all documents (one more than there are), and the first chunk of each document
    (likewise). Cuts depend on the bytes around them and on the cut before, and never split a character."""
    sums = hasher.sums(data)
    at = np.arange(REACH, len(data))
    wanted = at[(hasher.spans(sums, at - REACH, at) % np.uint64(EVERY)) == 0] if len(at) else at
    wanted = wanted[(data[wanted] & 0xC0) != 0x80] if len(wanted) else wanted
    out, firsts = [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        firsts.append(len(out))
        if a == b:
            continue
        out.append(a)
        for c in [*wanted[np.searchsorted(wanted, a + LEAST):np.searchsorted(wanted, b)].tolist(), b]:
            while c - out[-1] > MOST:  # a stretch without a cut
                stop = out[-1] + MOST
                while (data[stop] & 0xC0) == 0x80:
                    stop -= 1
                out.append(stop)
            if LEAST <= c - out[-1] and c < b:
                out.append(c)
    return np.array([*out, offsets[-1]], np.int64), np.array([*firsts, len(out)], np.int64)


class Chunk:
    __slots__ = ("bounds", "ids", "size", "starts")

    def __init__(self, ids: np.ndarray, starts: np.ndarray, bounds: np.ndarray, size: int):
        self.ids, self.starts, self.bounds, self.size = ids, starts, bounds, size


class ChunkCoder:
    """Encodes batches of documents, chunk by chunk; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        self.coder, self.hasher, self.keys = Coder(vocabulary), SpanHasher(5), SpanHasher(17)
        self.chunks: dict[bytes, Chunk] = {}
        self.held = self.reused = self.encoded = self.whole = 0

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        at, firsts = cuts(data, offsets, self.hasher)
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        if self.held > REMEMBER:
            self.chunks, self.held = {}, 0
        fresh = [t for t in dict.fromkeys(texts) if t not in self.chunks]
        self.reused, self.encoded = self.reused + len(texts) - len(fresh), self.encoded + len(fresh)
        self.held += sum(map(len, fresh))
        for t, c in zip(fresh, self._encode(fresh), strict=True):
            self.chunks[t] = c
        parts = [self.chunks[t] for t in texts]
        special = self.coder.special
        out: list[np.ndarray | None] = [None] * (len(offsets) - 1)
        redo, open_joins = set(), []
        for d in range(len(out)):
            if any(s in raw[offsets[d]:offsets[d + 1]] for s in special):
                redo.add(d)
            else:
                open_joins += [(d, k) for k in range(firsts[d] + 1, firsts[d + 1])]
        # joins of all documents at once; those whose windows do not agree come again, with wider windows
        repaired: dict[int, tuple[int, np.ndarray, int]] = {}
        width = WINDOW
        while open_joins:
            asked, again = [], []
            for d, k in open_joins:
                if d in redo:
                    continue
                left, right = parts[k - 1], parts[k]
                # the last piece of the left chunk that begins where nothing behind the cut matters
                j = int(np.searchsorted(left.starts, left.size - LOOK, "right")) - 1
                if j < 1:
                    redo.add(d)
                    continue
                begin, stop = int(left.starts[j]), min(right.size, width)
                cut = int(at[k])
                while stop < right.size and (data[cut + stop] & 0xC0) == 0x80:
                    stop += 1
                asked.append((d, k, begin, stop, raw[cut - (left.size - begin):cut + stop]))
            for (d, k, begin, stop, text), w in zip(asked, self._encode([x[4] for x in asked]), strict=True):
                left, right = parts[k - 1], parts[k]
                lead = left.size - begin
                ends_here = stop == right.size and k + 1 == firsts[d + 1]
                inner = w.starts[(w.starts >= lead) & (w.starts <= lead + stop - (0 if ends_here else LOOK))] - lead
                both = inner[np.isin(inner, right.starts)]
                if len(both):
                    sync = int(both[0])
                    repaired[k] = (begin, w.ids[:w.bounds[np.searchsorted(w.starts, sync + lead)]], sync)
                elif stop >= right.size:
                    redo.add(d)
                else:
                    again.append((d, k))
            open_joins, width = again, width * 2
        for d in range(len(out)):
            if d in redo:
                continue
            pieces, resume = [], 0
            for k in range(firsts[d], firsts[d + 1]):
                chunk = parts[k]
                until = repaired[k + 1][0] if k + 1 < firsts[d + 1] else None
                if until is not None and until < resume:  # two windows overlap
                    redo.add(d)
                    break
                a = chunk.bounds[np.searchsorted(chunk.starts, resume)]
                b = chunk.bounds[np.searchsorted(chunk.starts, until)] if until is not None else len(chunk.ids)
                pieces.append(chunk.ids[a:b])
                if until is not None:
                    pieces.append(repaired[k + 1][1])
                    resume = repaired[k + 1][2]
            out[d] = np.concatenate(pieces) if pieces else np.zeros(0, np.uint32)
        again = sorted(redo)
        self.whole += len(again)
        for d, c in zip(again, self._encode([raw[offsets[d]:offsets[d + 1]] for d in again]), strict=True):
            out[d] = c.ids
        return out

    def _encode(self, texts: list[bytes]) -> list[Chunk]:
        if not texts:
            return []
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        ids, starts, bounds, first = self.coder.encode(np.frombuffer(b"".join(texts), np.uint8), at)
        return [Chunk(ids[bounds[a]:bounds[b]], starts[a:b] - o, bounds[a:b + 1] - bounds[a], int(e - o))
                for a, b, o, e in zip(first[:-1].tolist(), first[1:].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True)]


def encoded(vocabulary: Vocabulary, text: Column, documents: DataFrame, with_ids: bool = True) -> Column:
    """Struct of ids (little-endian unsigned 32-bit), n_tokens, ids_sha256 and decoded_sha256 of a text column."""
    shared = documents.sparkSession.sparkContext.broadcast(vars(vocabulary))  # the size of a vocabulary file

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        coder = ChunkCoder(SimpleNamespace(**shared.value))
        for column in texts:
            data, at = column_bytes(column)
            ids_out, n, ids_sha, text_sha = [], [], [], []
            for a, b in slices(at):
                part = data[at[a]:at[b]]
                ids = coder.encode(part, at[a:b + 1] - at[a])
                back = coder.coder.decode(np.concatenate(ids) if ids else np.zeros(0, np.uint32))
                if not np.array_equal(back, part):
                    raise ValueError("decoded bytes differ from the text")
                for k, x in enumerate(ids):
                    blob = x.astype("<u4").tobytes()
                    ids_out.append(blob if with_ids else None)
                    n.append(len(x))
                    ids_sha.append(hashlib.sha256(blob).hexdigest())
                    text_sha.append(hashlib.sha256(back[at[a + k] - at[a]:at[a + k + 1] - at[a]].tobytes()).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(ids_out, pa.binary()), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             ["ids", "n_tokens", "ids_sha256", "decoded_sha256"])
        del coder
        lean()  # the worker may stay idle from here on

    return F.arrow_udf(run, "ids binary, n_tokens long, ids_sha256 string, decoded_sha256 string")(text)


def encode_documents(documents: DataFrame, path: str, text: str = "text", with_ids: bool = True) -> DataFrame:
    """``documents`` with ids, n_tokens, ids_sha256 and decoded_sha256, which replace columns of these names."""
    names = ("ids", "n_tokens", "ids_sha256", "decoded_sha256")
    kept = without(documents.columns, *names)
    (coded,) = free_names(documents.columns, "_coded")
    out = documents.withColumn(coded, encoded(Vocabulary(path), F.col(text), documents, with_ids))
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{coded}.{n}").alias(n) for n in names])


def decode_ids(ids: np.ndarray, coder: Coder) -> str:
    """Text of ids; bytes that are no UTF-8 become replacement characters."""
    return coder.decode(np.asarray(ids, np.int64)).tobytes().decode("utf-8", "replace")
