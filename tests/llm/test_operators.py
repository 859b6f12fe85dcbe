"""Each corpus operator against a plain re-computation on small inputs with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from ledgerloom.llm import backoff, chat, decontaminate, language, repair, roundtrip, shingles, suffixes, topk, warc  # noqa: E402
from ledgerloom.llm.graph import components  # noqa: E402
from ledgerloom.llm.registry import vocabulary_path  # noqa: E402

WORDS = "the of and to in is sé für größe 12 x-y don't we've  \n".split(" ")


def texts(n=60, seed=3):
    """Random texts with copies, near copies, shared passages, empty, null, very long and odd ones."""
    rng = random.Random(seed)

    def prose(k):
        return " ".join(rng.choice(WORDS) + rng.choice(["", "s", "", "ly"]) for _ in range(k))

    passage, base = prose(60), prose(300)
    out = [None, "", " ", "a", "Word", passage, passage, "x" * 5000, "é" * 400, "\n\n\n", "<|endoftext|> tail", prose(20_000)]
    for i in range(n):
        kind = i % 6
        out.append(prose(rng.randint(1, 200)) if kind < 2 else prose(30) + " " + passage + " " + prose(30) if kind == 2
                   else base.replace("the", "thE", 1) + " " + prose(3) if kind == 3 else out[rng.randrange(len(out))] if kind == 4 else base[: 900 + i])
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, "zz", 1.5, True) for i, t in rows], "doc_id long, text string, score string, n_tokens double, held boolean").repartition(5).cache()
    return dict(rows), frame


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# ------------------------------------------------------------------ suffix-array dedup
def brute_suffixes(docs, length=50):
    first = {}
    raws = {d: (t or "").encode() for d, t in docs.items()}
    for d in sorted(raws):
        for i in range(len(raws[d]) - length + 1):
            first.setdefault(raws[d][i:i + length], d)
    out = []
    for d, raw in raws.items():
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if first[raw[i:i + length]] < d:
                gone[i:i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((d, len(raw), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_dedup(corpus):
    docs, frame = corpus
    found = suffixes.deduplicate(frame, parts=5, groups=3, with_text=True)
    assert {"score", "n_tokens", "held"} <= set(found.columns)
    rows = found.collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute_suffixes(docs)
    assert all(len(r.kept.encode()) <= r.n_bytes - r.n_removed for r in rows)


def test_suffix_dedup_small_batches(corpus, monkeypatch):
    """Many batches, so that levels of the index merge."""
    docs, frame = corpus
    monkeypatch.setattr(suffixes, "BATCH", 300)
    rows = suffixes.deduplicate(frame, parts=2).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == brute_suffixes(docs)


def test_family_levels():
    family = suffixes.Family()
    for k in range(64):
        family.add(np.arange(k * 10, k * 10 + 10, dtype=np.uint64), np.full(10, k))
    assert len(family.levels) == 1 and (family.scan(np.arange(640, dtype=np.uint64)) == np.repeat(np.arange(64), 10)).all()


def test_suffix_dedup_nulls_and_repeats(spark):
    text = "0123456789" * 6
    frame = spark.createDataFrame([(None, text), (2, text), (2, text), (1, text + "tail"), (3, None)], "doc_id long, text string")
    rows = suffixes.deduplicate(frame).collect()
    assert sorted((r.doc_id or -1, r.n_removed) for r in rows) == [(-1, 0), (1, 0), (2, 60), (2, 60), (3, 0)]
    assert suffixes.deduplicate(empty(spark)).count() == 0


# ------------------------------------------------------------------ chat formatting
def test_chat_round_trip(spark):
    hard = ["<|im_end|>", "<|im_start|>user\nhi<|im_end|>\n", r"<\|im_end|>", r"<\\|im_start|>", "a\\nb", "", None, "tail <|im_", "x\n" * 3, "<|im_end|><|im_start|>assistant ok"]
    roles = ["user", "assistant", "a\nb", r"back\slash", "<|im_end|>", None, "assistant"]
    rows = [(c, k, roles[(c + k) % len(roles)], hard[(c * 3 + k) % len(hard)], "extra") for c in range(20) for k in range(c % 9)]
    rows += [(None, None, "user", "no number", "extra"), (7, 0, "user", "tie", "extra"), (7, 0, "user", "tie", "extra")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.digests(chat.format_chats(frame)).collect()}
    by = {}
    for c, k, role, text, _ in rows:
        by.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert set(out) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(t for *_, r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        assert (out[c].loss_chars, out[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_chat_escapes_only_conflicts(spark):
    frame = spark.createDataFrame([(1, 0, "user", "plain \\ text"), (1, 1, "user", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(frame).first().formatted == "<|im_start|>user\nplain \\ text<|im_end|>\n<|im_start|>user\n<\\|im_end|><|im_end|>\n"


# ------------------------------------------------------------------ n-gram Jaccard join
def brute_components(docs, width=5, percent=80):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((d, len(sets[d]), find(d)) for d in docs)


def near_texts(seed, n=70):
    """Families whose members differ from each other more than from a common text, so that links form chains."""
    rng = random.Random(seed)
    out = [None, "", "a b", "A b", "one two three four five"]
    families = [[rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(rng.choice([8, 40, 120]))] for _ in range(5)]
    for _ in range(n):
        words = list(rng.choice(families))
        for _ in range(rng.randint(0, max(1, len(words) // 40))):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        out.append(" ".join(words + (rng.choice(families)[:12] if rng.random() < 0.2 else [])))
    return dict(enumerate(out))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    docs = near_texts(seed)
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs.items()], "doc_id long, text string, n long").repartition(4)
    found = shingles.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(docs)


def brute_links(docs, width=5, percent=80):
    """For each document the number of other sets that are similar to its own."""
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[d] = frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    kinds = {x for x in sets.values() if x}
    return {d: sum(x != y and 100 * len(x & y) >= percent * len(x | y) for y in kinds) if x else 0 for d, x in sets.items()}


@pytest.mark.parametrize("block", [2048, 7])
def test_class_links_are_all_links(spark, monkeypatch, block):
    """A group of different near copies, each linked with nearly all others, and families with chains; in one block and in many."""
    monkeypatch.setattr(shingles, "SETS", block)
    monkeypatch.setattr(shingles, "WORDS", 64 * block)
    rng = random.Random(8)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    docs = near_texts(3)
    for d in range(1000, 1060):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(150)] = f"own{d}"
        docs[d] = " ".join(words)
    docs[2000] = docs[1000].upper()
    found = {r.doc_id: r.class_links for r in shingles.near_duplicates(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    expected = brute_links(docs)
    assert found == expected and max(expected.values()) > 40


def test_near_duplicates_by_open_pairs_alone(spark, monkeypatch):
    """Without pivots the exact second step has to find every link, through combinations for frequent tokens."""
    docs = near_texts(5)
    monkeypatch.setattr(shingles, "star_pairs", lambda live, nodes, maps, percent: nodes.sparkSession.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(shingles, "sketch", lambda documents, width: np.ones(1 << 10, np.uint8))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = shingles.near_duplicates(frame).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == brute_components(docs)


def test_near_duplicates_nulls(spark):
    text = " ".join(map(str, range(30)))
    frame = spark.createDataFrame([(None, text), (4, text), (4, text), (9, text + " end"), (5, None)], "doc_id long, text string")
    found = sorted(((r.doc_id or -1), r.component_id) for r in shingles.near_duplicates(frame).collect())
    assert found == [(-1, 4), (4, 4), (4, 4), (5, 5), (9, 4)]
    assert shingles.near_duplicates(empty(spark)).count() == 0


def test_bitmap_bounds_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 60, 500, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate((a[: int(n * 0.9)], rng.integers(0, 2**63, n // 5 + 1, dtype=np.uint64))))
        assert shingles.differ(shingles.bitmap(a), shingles.bitmap(b)) <= len(np.setxor1d(a, b))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 60)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(100, 141), 100), **dict.fromkeys(range(1, 60), 1)}


# ------------------------------------------------------------------ language-model scoring
def test_backoff_base_and_model(corpus):
    docs, frame = corpus
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", lower(t)), None] for d, t in docs.items()}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in docs}
    count = Counter(x for d, w in tokens.items() if not held[d] for x in w)
    n, v = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in backoff.learn_and_score(frame).collect()}
    assert set(rows) == set(docs)
    for d, w in tokens.items():
        r = rows[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(math.fsum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
        assert r.score <= 0


def test_backoff_learns_order(spark):
    """Held-out texts of a source with strong word order score better than by words alone."""
    rng = random.Random(4)
    after = {w: [rng.choice("abcdefghij") for _ in range(2)] for w in "abcdefghij"}
    docs = []
    for i in range(300):
        words = [rng.choice("abcdefghij")]
        for _ in range(rng.randint(0, 60)):
            words.append(rng.choice(after[words[-1]]))
        docs.append((i, " ".join(words)))
    rows = backoff.learn_and_score(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").collect()
    assert sum(r.score for r in rows) > 0.6 * sum(r.base_score for r in rows)


def test_backoff_equals_recursion_and_sums_to_one(spark):
    rng = random.Random(9)
    docs = [(i, " ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 30)))) for i in range(80)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("held", F.lit(False))
    model = backoff.learn(frame)
    lists = [["<s>", *t.split(), "<s>"] for _, t in docs]
    uni = Counter(x for w in lists for x in w[1:])
    pairs = Counter(p for w in lists for p in zip(w, w[1:]))
    triples = Counter(p for w in lists for p in zip(w, w[1:], w[2:]))
    pairs, triples = ({k: c for k, c in x.items() if c >= backoff.LEAST} for x in (pairs, triples))
    n, v, disc, prior = sum(uni.values()), len(uni), backoff.DISCOUNT, backoff.PRIOR

    def one(w):
        return (uni[w] + 1) / (n + v + 1)

    def two(u, w):
        kept = {b: c for (a, b), c in pairs.items() if a == u}
        if not kept:
            return one(w)
        h = uni[u] + prior
        return max(kept.get(w, disc) - disc, 0) / h + (h - sum(kept.values()) + disc * len(kept)) / h * one(w)

    def three(t, u, w):
        kept = {c: k for (a, b, c), k in triples.items() if (a, b) == (t, u)}
        if not kept or u == "<s>":
            return two(u, w)
        h = pairs[t, u] + prior
        return max(kept.get(w, disc) - disc, 0) / h + (h - sum(kept.values()) + disc * len(kept)) / h * two(u, w)

    rows = {r.doc_id: r.score for r in backoff.score(frame, model, 3).collect()}
    for i, w in enumerate(lists):
        mine = sum(math.log10(three(w[k - 2] if k > 1 else None, w[k - 1], w[k])) for k in range(1, len(w)))
        assert rows[i] == pytest.approx(mine)
    unknown = 1 / (n + v + 1)
    for t, u in list(pairs)[:20]:
        left = three(t, u, "never seen") / one("never seen") * unknown
        assert sum(three(t, u, w) for w in uni) + left == pytest.approx(1)


def test_backoff_steps_together_equal_steps_of_one(monkeypatch):
    rng = np.random.default_rng(3)
    n = np.concatenate((rng.integers(1, 40, 60), [3000, 1]))
    begins, words = np.cumsum(n) - n, 50
    place = rng.integers(1, words, n.sum())
    place[begins + n - 1] = 0
    word, last = (x.reshape(-1) for x in np.meshgrid(np.arange(words), np.arange(words), indexing="ij"))
    kept = (rng.random(len(word)) < 0.5) & (word + last > 0)
    history = np.repeat(np.flatnonzero(kept & (last != 0)), 3)
    pair = last[history] * words + np.tile([0, 7, 19], len(history) // 3)
    history, pair = history[kept[pair]], pair[kept[pair]]
    share = [rng.uniform(0.01, 1, k) for k in (words, words, len(word), len(word), len(history))]
    model = backoff.Automaton(*share[:3], word, last, kept, share[3], history, pair, np.ones(len(history), bool), share[4])
    scores = []
    for wide in (0, 32, 1000):  # all together, long rests one by one, each one by one
        monkeypatch.setattr(backoff, "WIDE", wide)
        scores.append(model.score(place, begins, n))
    assert np.allclose(scores[0], scores[1], rtol=1e-12) and np.allclose(scores[0], scores[2], rtol=1e-12)
    walk = model.walker()
    assert np.allclose(scores[0], [walk(place[a:a + k].tolist(), 1, 0.0) for a, k in zip(begins, n, strict=True)], rtol=1e-12)


def test_backoff_edge_cases(spark):
    assert backoff.learn_and_score(empty(spark)).count() == 0
    rows = backoff.learn_and_score(spark.createDataFrame([(None, "a b"), (1, None), (1, None)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens) for r in rows)[0] == (-1, True, 3)
    assert len(rows) == 3


def test_backoff_keeps_ngrams_whatever_the_corpus(spark):
    """A phrase with a few occurrences has its arcs, also among so much other text that it is less than one in 5 MB."""
    taught = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2]
    phrases = [(i, "zig zag zog zug") for i in taught[:4]]
    other = [(100 + i, f"w{i} " * 300) for i in range(20)]
    padding = [(1000 + i, "x" * 1_000_000) for i in range(30)]
    rows = {r.doc_id: r for r in backoff.learn_and_score(spark.createDataFrame(phrases + other + padding, "doc_id long, text string")).collect()}
    assert rows[taught[0]].score > rows[taught[0]].base_score + 3


def test_backoff_held_out_texts_teach_nothing(spark):
    """Other documents score the same when held-out texts grow, also by so much that a share of all bytes would move."""
    ids = {h: [i for i in range(200) if (zlib.crc32(str(i).encode()) % 7 == 2) == h] for h in (True, False)}
    docs = [(i, "rare pair of words") for i in ids[False][:5]] + [(i, "y" * 1_000_000) for i in ids[False][5:24]]
    scores = []
    for held in ("rare pair of words", "z" * 1_000_000):
        frame = spark.createDataFrame(docs + [(i, held) for i in ids[True][:9]], "doc_id long, text string")
        scores.append({r.doc_id: r.score for r in backoff.learn_and_score(frame).collect() if not r.held_out})
    assert scores[0] == pytest.approx(scores[1])


# ------------------------------------------------------------------ benchmark decontamination
def brute_contamination(docs, items, width=13):
    def words(t):
        return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    wins = {}
    for item, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            wins.setdefault(tuple(w[k:k + width]), set()).add(str(item))
    out = {}
    for d, t in docs.items():
        w, hit, got = words(t), set(), set()
        for size in {len(x) for x in wins}:
            for k in range(len(w) - size + 1):
                if (x := wins.get(tuple(w[k:k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    got |= x
        out[d] = (len(w), len(hit), sorted(got), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("limit", [20_000, 7])
def test_decontamination(spark, corpus, limit):
    """Also with so small a limit that several automata are needed."""
    docs, frame = corpus
    some = [t for t in docs.values() if t and 20 < len(t.split()) < 300][:3]
    items = [(1, "Größe, x-y: THE of"), (2, some[0]), (3, " ".join(some[1].split()[5:40])), (4, None), (5, ""), (10, some[0]), (None, some[2]), (2, some[0])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.decontaminate(frame.withColumn("items", F.lit(1)), bench, window_limit=limit).collect()
    expected = brute_contamination(docs, [x for x in items if x[0] is not None])
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in rows} == expected
    for r in rows:
        for m in r.matches:
            assert re.match(r"\w", docs[r.doc_id][m.start:m.stop])


def test_decontamination_empty(spark, corpus):
    _, frame = corpus
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame, bench).where("contaminated OR n_hit > 0").count() == 0
    assert decontaminate.decontaminate(empty(spark), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


# ------------------------------------------------------------------ tokens
@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(vocabulary_path())


def odd_texts(seed=5, n=150):
    rng = random.Random(seed)
    bits = ["a", "b", "s", "t", "re", "ll", "'", " ", "  ", "\n", "\t", "1", "!", "é", "’", " ", "日", "'s", "'ve", "\x85", "²", "😀", "\r\n", "<|endoftext|>", " " * 30, "z" * 40]
    return ["".join(rng.choice(bits[:rng.choice([8, 23, 26])]) for _ in range(rng.randint(0, 900))) for _ in range(n)]


def test_round_trip_equals_library(spark, corpus, library):
    docs = {**corpus[0], **{1000 + i: t for i, t in enumerate(odd_texts())}, 5000: "'re" * 3000, 5001: " " * 9000}
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs.items()], "doc_id long, text string, ids string").repartition(3)
    for r in roundtrip.encode_documents(frame, vocabulary_path()).collect():
        ids = library.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert roundtrip.encode_documents(empty(spark), vocabulary_path()).count() == 0


def test_chunks_are_shared():
    passage = " ".join(str(i * 7919) for i in range(3000))
    raws = [(f"start {i} " * i + passage).encode() for i in range(6)]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raws])))
    coder = roundtrip.ChunkCoder(roundtrip.Vocabulary(vocabulary_path()))
    coder.encode(np.frombuffer(b"".join(raws), np.uint8), offsets)
    assert coder.reused > 3 * coder.encoded and coder.whole == 0


def test_token_files(spark, corpus, library):
    docs, frame = corpus
    root = repair.ids_root(spark)
    manifest = repair.write_ids(frame, vocabulary_path(), root, shard=3000, ranges=3)
    assert manifest.count() > 3
    rows, start = {r.doc_id: r for r in repair.read_ids(spark, root, with_ids=True).collect()}, 0
    for d in sorted(docs):
        ids = np.array([*library.encode(docs[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32, bytes(rows[d]["ids"])) == (start, len(ids), zlib.crc32(ids.tobytes()), ids.tobytes())
        start += len(ids)
    root = repair.ids_root(spark)
    repair.write_ids(empty(spark), vocabulary_path(), root)
    assert repair.read_ids(spark, root).count() == 0


def test_grammar_random_access():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 500, 40).astype(np.uint32)
    docs = [np.concatenate([phrase[: rng.integers(1, 40)] if rng.random() < 0.7 else rng.integers(0, 500, 9).astype(np.uint32) for _ in range(30)]) for _ in range(60)]
    docs += [np.full(1000, 7, np.uint32), np.zeros(0, np.uint32)]
    shard = repair.Shard(repair.shard_bytes([*range(61), None], docs, 600))
    flat = np.concatenate(docs)
    assert len(shard.sequence) < len(flat) / 2 and len(shard.rules) and shard.ends[-1] == len(flat)
    for _ in range(200):
        a, b = sorted(rng.integers(0, len(flat) + 1, 2))
        assert (shard.tokens(a, b) == flat[a:b]).all()


# ------------------------------------------------------------------ exact top-k
@pytest.mark.parametrize("block,chunk,n_slices", [(8192, 128, 5), (64, 3, 2), (200, 50, 12)])
def test_top_k(spark, block, chunk, n_slices):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.normal(0, 0.3, 6)]) for i in range(400)]
    rows += [(400 + i, rows[50][1]) for i in range(30)] + [(1000, [1e3, -1e3]), (1001, None), (1002, [float("nan")] * 6), (1050, [float("inf"), 0.0]), (1100, [0.1, None]), (1150, []), (None, [0.5] * 6)]
    frame = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(frame, block=block, chunk=chunk, n_slices=n_slices).collect()}
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    expected = {}
    for q, v in ok:
        if q is not None and q % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), math.inf if i is None else i) for i, w in ok if i != q)
            for k, (s, i) in enumerate(scored[:5]):
                expected[q, k + 1] = (None if i == math.inf else i, -s)
    assert got == expected


def test_top_k_few_rows(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema)).count() == 0
    assert topk.top_k(spark.createDataFrame([(1, [1.0])], schema)).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (3, [2.0]), (2, [2.0])], schema)).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(2, 256 * 512), (3, 256 * 512)]


# ------------------------------------------------------------------ WARC
def test_warc(spark):
    rng = random.Random(6)
    pages = [(i, f"http://h/{i}", rng.choice([None, "", "same", f"own {i} é" * 50, "same\r\n\r\nparts"])) for i in range(200)]
    pages += [(None, "http://none", "same"), (None, None, "alone"), (300, "http://twice", "twice"), (300, "http://twice", "twice")]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, record_type string").repartition(4)
    root = warc.archive_root(spark)
    manifest = warc.write_archives(frame, root, roll=2000, ranges=3)
    assert manifest.agg(F.sum("records")).first()[0] == len(pages) and manifest.count() > 5
    largest = {}
    for i, _, html in pages:
        if i is not None:
            largest[html or ""] = max(i, largest.get(html or "", -1))
    expected = sorted((i if i is not None else -1, len((h or "").encode()), "response" if largest.get(h or "") in (i, None) else "revisit",
                       None if largest.get(h or "") == i else largest.get(h or "")) for i, _, h in pages)
    rows = warc.read_archives(spark, root, with_payload=True).collect()
    assert sorted(((r.page_id if r.page_id is not None else -1), r.payload_bytes, r.record_type, r.refers_to) for r in rows) == expected
    texts_of = {i: (h or "").encode() for i, _, h in pages}
    assert all(bytes(r.payload) == texts_of[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)
    again = warc.archive_root(spark)
    twin = warc.write_archives(frame, again, roll=2000, ranges=3)
    assert sorted(map(tuple, twin.collect())) == sorted(map(tuple, manifest.collect()))


def test_warc_empty_and_threshold(spark):
    schema = "page_id long, url string, html string"
    root = warc.archive_root(spark)
    warc.write_archives(spark.createDataFrame([], schema), root)
    assert warc.read_archives(spark, root).count() == 0
    root = warc.archive_root(spark)
    warc.write_archives(spark.createDataFrame([(1, "u", "abc"), (2, "u", "abc")], schema), root, least_bytes=10)
    assert {r.record_type for r in warc.read_archives(spark, root).collect()} == {"response"}


# ------------------------------------------------------------------ language ID
def test_language(spark):
    rng = random.Random(8)
    stems = {"aa": ["ka", "lo", "mi"], "bb": ["sch", "ung", "ber"], "cc": ["eau", "ille", "ment"]}
    rows = []
    for i in range(400):
        lang = rng.choice(list(stems))
        rows.append((i, " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40))), lang, 5.0))
    rows += [(1000, None, "aa", 1.0), (1001, "12 34 !", "aa", 1.0), (1002, "", None, 1.0), (None, "kalomi mikalo", None, 1.0), (1003, "schung", None, 1.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").repartition(3)
    out = language.identify(frame).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if r.text is None or not any(c.isalpha() for c in r.text):
            assert (r.lang_pred, r.rejected) == ("und", True)
    judged = [r for r in out if r.held_out and r.lang]
    assert sum(r.lang_pred == r.lang for r in judged if r.doc_id is not None and r.doc_id < 1000) >= 0.98 * len([r for r in judged if r.doc_id < 1000])
    none = language.identify(spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id long, text string, lang string")).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language.identify(empty(spark)).count() == 0


def test_language_rejects_what_it_never_learned(spark):
    """Texts of a language that no label names are rejected by their score; clean texts stay."""
    rng = random.Random(8)
    stems = {"aa": ["ka", "lo", "mi", "ne"], "bb": ["sch", "ung", "ber", "ein"], "cc": ["eau", "ille", "ment", "oi"], "dd": ["the", "ing", "wh", "ly"], None: ["кош", "дом", "лес"]}

    def prose(lang):
        return " ".join("".join(rng.choice(stems[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40)))

    rows = [(i, prose(lang), lang) for i in range(4000) for lang in [rng.choice(["aa", "bb", "cc", "dd"])]] + [(5000 + i, prose(None), None) for i in range(40)]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert all(r.rejected for r in out if r.doc_id >= 5000)
    assert sum(r.rejected for r in out if r.doc_id < 4000) <= 12


def test_language_threshold_with_few_rows():
    """Few held-back answers say less about the lowest share, so the threshold lies below all of them."""
    rng = np.random.default_rng(3)
    right = np.sort(1 / (1 + np.exp(-rng.exponential(1.5, 50))))
    assert language.rejection(right) < right[0]
    many = np.sort(1 / (1 + np.exp(-rng.exponential(1.5, 5000))))
    assert language.rejection(many) == pytest.approx(many[5])


# ------------------------------------------------------------------ words that a polynomial can't tell apart
def test_thue_morse_words_are_told_apart(spark):
    """A word over two letters and its complement agree modulo 2**64 under every base from about a thousand bytes on."""
    word = b"a"
    while len(word) < 2048:
        word += bytes(195 - c for c in word)
    a, b = word.decode(), bytes(195 - c for c in word).decode()
    frame = spark.createDataFrame([(1, a), (2, b), (3, a), (4, f"x {a} y {b}"), (7, "some words to learn")], "doc_id long, text string").repartition(2)
    found = {r.doc_id: r.component_id for r in shingles.near_duplicates(frame).collect()}
    assert found == {1: 1, 2: 2, 3: 1, 4: 4, 7: 7}
    tokenizer = tokenizers.Tokenizer.from_file(vocabulary_path())
    for r in roundtrip.encode_documents(frame, vocabulary_path()).collect():
        assert np.frombuffer(r.ids, "<u4").tolist() == tokenizer.encode(r.text, add_special_tokens=False).ids
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in range(100)}
    learnt, out = next(d for d in held if not held[d]), next(d for d in held if held[d])
    scored = backoff.learn_and_score(spark.createDataFrame([(learnt, a), (out, b)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_known for r in scored} == {learnt: 2, out: 1}


# ------------------------------------------------------------------ columns that clash with helper names
def test_helper_names_never_clash(spark):
    names = ("bundle", "_scan", "_words", "_hits", "_items", "_matches", "_coded", "_guess", "_text", "_letters", "_Scan_", "IDS_", "BUNDLE_")
    frame = spark.createDataFrame([(1, "some text of words", "en", *range(len(names))), (2, None, "en", *range(len(names)))],
                                  "doc_id long, text string, lang string, " + ", ".join(f"`{n}` long" for n in names))
    items = spark.createDataFrame([("i1", "text of words")], "item_id string, text string")
    for out in (suffixes.deduplicate(frame), decontaminate.decontaminate(frame, items), roundtrip.encode_documents(frame, vocabulary_path()), language.identify(frame)):
        rows = out.collect()
        assert len(rows) == 2 and all(r[n] == k for r in rows for k, n in enumerate(names))
    upper = roundtrip.encode_documents(frame.withColumn("IDS", F.lit(1)), vocabulary_path())
    assert [c.lower() for c in upper.columns].count("ids") == 1
