"""The conversation trie against a plain trie of Python dictionaries."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ledgerloom.llm import trie


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            name = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[conv].append((turn is not None, turn or 0, name, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        told[c] = own.get(c - int(c - 5 * int(c / 5)), [])[:h] + turns[h:]
    members, children = defaultdict(list), defaultdict(set)
    for c, turns in told.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    out = []

    def below(node):
        stack, leaves, saved = [node], 0, 0
        while stack:
            x = stack.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * len(x[-1][1].encode()) if x else 0
            stack += children[x]
        return leaves, saved

    for node, convs in members.items():
        ends = sorted(c for c in convs if len(told[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), *below(node),
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=80):
    rng = random.Random(seed)
    first = [("user", f"opening {k}") for k in range(4)]
    rows = [(1001, None, None, None), (1001, 1, "", ""), (7, 1, "user", "only"), (None, 0, "user", "lost"), (1005, 2, "user", "x" * 3000), (1005, 2, "assistant", "tie"), (1005, 2, "assistant", "tie")]
    for c in range(n):
        turns = [rng.choice(first)] + [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é", None, ""])) for _ in range(rng.choice([0, 1, 2, 3, 12, 30]))]
        if c % 4 == 0:
            turns = [("user", "opening 0")] * rng.randint(1, 6)
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    return rows


def build(spark, rows):
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "conv_id long, turn long, role string, text string, depth long, path string").repartition(4)


@pytest.mark.parametrize(("seed", "turns_in_range"), [(1, trie.RANGE), (1, 12), (2, 40), (3, 4), (4, 150)])
def test_equals_plain_trie(spark, seed, turns_in_range):
    rows = conversations(seed)
    got = trie.trie(trie.rebuilt(build(spark, rows)), turns_in_range).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_forests_of_any_cut_agree():
    """Every way of cutting one sorted list of paths into two ranges gives the same closed nodes and sums of open ones."""
    rng = random.Random(9)
    names = [bytes([k]) * trie.NAME for k in range(3)]
    paths = sorted({b"".join(rng.choice(names) for _ in range(rng.randint(0, 6))) for _ in range(60)})
    sizes = [[p[k * trie.NAME] + 1 for k in range(len(p) // trie.NAME)] for p in paths]
    ids, counts, ends = list(range(len(paths))), [1 + i % 3 for i in range(len(paths))], [str(i) for i in range(len(paths))]

    def nodes(cuts):
        merged = {}
        bounds = [0, *cuts, len(paths)]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            left = trie.shared(paths[a - 1], paths[a]) if a else -1
            right = trie.shared(paths[b - 1], paths[b]) if b < len(paths) else -1
            for depth, conv, _, _, key, n, children, leaves, total, before, end in trie.Forest(
                    paths[a:b], sizes[a:b], ids[a:b], counts[a:b], ends[a:b], left, right).grow():
                name = (depth, key or conv)
                old = merged.get(name, (10**9, 0, 0, 0, 0, 0, ""))
                merged[name] = (min(old[0], conv), old[1] + n, old[2] + children, old[3] + leaves, old[4] + total, before, old[6] or end or "")
        return sorted((d, c, n, ch, lv, t - (n - 1) * b, e) for (d, _), (c, n, ch, lv, t, b, e) in merged.items())

    whole = nodes([])
    assert all(nodes([k]) == whole for k in range(1, len(paths))) and nodes(list(range(1, len(paths)))) == whole


def test_empty_table_and_one_turnless_conversation(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert trie.trie(trie.rebuilt(none)).collect() == []
    one = spark.createDataFrame([(4, [])], "conv_id long, turns array<struct<name: string, size: long>>")
    assert [tuple(r) for r in trie.trie(one).collect()] == [(4, 0, None, 1, 0, 1, 0, hashlib.sha256(b"4").hexdigest())]
