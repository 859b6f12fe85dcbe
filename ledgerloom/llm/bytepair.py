"""A fast encoder and decoder for byte-level BPE vocabularies of the tokenizers library.

Texts are cut into pieces by the vocabulary's pattern, each distinct piece is merged once and remembered, and a
batch is assembled by array look-ups. Where all characters beyond ASCII are letters, pieces are found by byte
classes for the whole batch at once; other texts are cut by the pattern itself. The ids are those of the
library's encode(text, add_special_tokens=False) with truncation and padding unused; special tokens in a text get
their ids, as there.
"""

from __future__ import annotations

import json
from itertools import chain

import numpy as np

from .common import SpanHasher

#: The pattern of the byte-level pre-tokenizer. Fixed values.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Remembered pieces, at most; beyond that the memory starts afresh, which costs time only.
REMEMBER = 1_000_000

LETTER, DIGIT, SPACE, OTHER = 0, 1, 2, 3
CLASS = np.full(256, OTHER, np.uint8)
CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = LETTER
CLASS[[*range(0x30, 0x3A)]] = DIGIT
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens of a vocabulary file; picklable, so that it can be broadcast (its size is the file's)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"] != spec["pre_tokenizer"] | {
                "type": "ByteLevel", "add_prefix_space": False, "use_regex": True}:
            raise ValueError("only byte-level BPE files without normalizer or prefix space are read")
        alphabet = byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ranks = {bytes(alphabet[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.size = max([*self.ranks.values(), *self.special.values()], default=-1) + 1


class Coder:
    """Encodes and decodes batches; one for each task."""

    def __init__(self, vocabulary: Vocabulary):
        import regex
        import tiktoken

        self.merge = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})._core_bpe.encode_single_piece
        self.pattern, self.letter = regex.compile(PATTERN), regex.compile(r"\p{L}")
        self.special = {k.encode(): v for k, v in vocabulary.special.items()}
        self.stop = regex.compile("|".join(regex.escape(s) for s in vocabulary.special)) if vocabulary.special else None
        self.hasher, self.is_letter = SpanHasher(11), {}
        self._forget()
        tokens = [b""] * vocabulary.size
        for t, i in vocabulary.ranks.items():
            tokens[i] = t
        for t, i in vocabulary.special.items():
            tokens[i] = t.encode()
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)))[:-1]
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)  # hashes of pieces, sorted
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)  # where their ids lie
        self.ids = np.zeros(0, np.uint32)

    def plain(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which documents the byte classes describe: no character beyond ASCII that is no letter, no special token."""
        ok = np.ones(len(offsets) - 1, bool)
        raw = data.tobytes()
        if (data >= 0x80).any():
            text = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
            at = np.flatnonzero(text >= 0x80)
            odd = [c for c in np.unique(text[at]) if not self._letter(int(c))]
            if odd:
                lead = np.flatnonzero((data & 0xC0) != 0x80)
                bad = lead[at[np.isin(text[at], odd)]]
                ok[np.searchsorted(offsets, bad, "right") - 1] = False
        for s in self.special:
            k = raw.find(s)
            while k >= 0:
                ok[np.searchsorted(offsets, k, "right") - 1] = False
                k = raw.find(s, k + 1)
        return ok

    def _letter(self, code: int) -> bool:
        if code not in self.is_letter:
            self.is_letter[code] = bool(self.letter.match(chr(code)))
        return self.is_letter[code]

    def piece_starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First bytes of all pieces of all documents, in order."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = CLASS[data]
        edge = np.zeros(n + 1, bool)  # a document begins here
        edge[offsets] = True
        head = edge[:-1].copy()  # a run of one class begins here
        head[1:] |= kind[1:] != kind[:-1]
        space = kind == SPACE
        start = head.copy()
        # the last of a run of spaces, before other text: leads that text if it is 0x20, else stands alone
        joint = np.flatnonzero(space[:-1] & ~space[1:] & ~edge[1:-1])
        start[joint] = True
        start[joint[data[joint] == 0x20] + 1] = False
        # a contraction: an apostrophe that makes a run of its own and is not led by a space, then fixed letters
        mark = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & head[1:] & ~edge[1:-1])
        if len(mark):
            a = data[mark + 1]
            two = np.where(mark + 2 < n, data[np.minimum(mark + 2, n - 1)], 0)
            two = np.where(edge[np.minimum(mark + 2, n)], 0, two)
            one = np.isin(a, [0x73, 0x74, 0x6D, 0x64])
            pair = ((a == 0x72) & (two == 0x65)) | ((a == 0x76) & (two == 0x65)) | ((a == 0x6C) & (two == 0x6C))
            start[mark[one | pair] + 1] = False
            rest = np.concatenate((mark[one] + 2, mark[pair & ~one] + 3))
            start[rest[rest < n]] |= kind[rest[rest < n]] == LETTER
        ok = self.plain(data, offsets)
        if not ok.all():
            raw = data.tobytes()
            for d in np.flatnonzero(~ok):
                a, b = offsets[d], offsets[d + 1]
                start[a:b] = False
                start[a + self._cut(raw[a:b])] = True
        return np.flatnonzero(start)

    def _cut(self, raw: bytes) -> np.ndarray:
        text, lengths, at = raw.decode("utf-8", "replace"), [], 0
        for m in [*(self.stop.finditer(text) if self.stop else ()), None]:
            lengths += [len(p.encode()) for p in self.pattern.findall(text[at:m.start() if m else len(text)])]
            if m:
                lengths.append(len(m[0].encode()))
                at = m.end()
        return np.concatenate(([0], np.cumsum(lengths)))[:-1].astype(np.int64)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all documents; first bytes of the pieces, the number of the first id of each piece (one more
        than there are pieces), and the number of the first piece of each document (likewise)."""
        starts = self.piece_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), starts, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
        ends = np.concatenate((starts[1:], [len(data)]))
        sums = self.hasher.sums(data)
        hashes = self.hasher.spans(sums, starts, ends)
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.flatnonzero((at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != distinct) if len(self.known) else np.ones(len(distinct), bool))
        if len(new):
            if len(self.known) + len(new) > REMEMBER and len(self.known):
                self._forget()
                new = np.arange(len(distinct))
            raw = data.tobytes()
            spans = [raw[a:b] for a, b in zip(starts[example[new]], ends[example[new]], strict=True)]
            merged = [[self.special[s]] if s in self.special else self.merge(s) for s in spans]
            count = np.fromiter(map(len, merged), np.int64, len(merged))
            first = len(self.ids) + np.cumsum(count) - count
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(merged), np.uint32, int(count.sum()))))
            put = np.searchsorted(self.known, distinct[new])
            self.known, self.first, self.count = np.insert(self.known, put, distinct[new]), np.insert(self.first, put, first), np.insert(self.count, put, count)
            at = np.searchsorted(self.known, distinct)
        place = at[inverse]
        count = self.count[place]
        bounds = np.concatenate(([0], np.cumsum(count)))
        ids = self.ids[np.arange(bounds[-1]) + np.repeat(self.first[place] - bounds[:-1], count)]
        return ids, starts, bounds, np.searchsorted(starts, offsets)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of the tokens."""
        count = self.lengths[ids]
        bounds = np.concatenate(([0], np.cumsum(count)))
        return self.bytes[np.arange(bounds[-1]) + np.repeat(self.starts[ids] - bounds[:-1], count)]
