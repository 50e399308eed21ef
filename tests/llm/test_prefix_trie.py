"""The prefix trie against a plain walk."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from partloom.llm import prefix_trie

SHAPE = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - c % 20, [])[:h] + ts[h:])
    return out


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        ends[ts].append(c)
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        own = (len(members[path]) - 1) * len((path[-1][1] if path else "").split())
        leaves[path] = sum(leaves[x] for x in children[path]) or 1
        saved[path] = own + sum(saved[x] for x in children[path])
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def found(df):
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"])
                  for r in df.collect())


def some(seed, convs=120, longest=9):
    draw, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(draw.randint(1, longest)):
            rows.append((c, t, draw.choice(["user", "assistant"]), draw.choice(["yes", "no", "two words", "yes"])))
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize("band", [16, 2, 3])
def test_trie_equals_a_plain_walk(spark, band):
    rows = some(5)
    got = found(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SHAPE), band))
    assert got == plain_trie(plain_rebuilt(rows))


@pytest.mark.parametrize("band, piece", [(16, 1024), (4, 7)])
def test_long_conversations_sum_over_several_levels_of_bands(spark, monkeypatch, band, piece):
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    draw = random.Random(1)
    line = [(t, "user", f"turn {draw.randrange(9)}") for t in range(300)]
    rows = [(20, *t) for t in line] + [(21, *t) for t in line[:270]] + [(c, *t) for c in (22, 23, 24) for t in line[:100] + [(x, "user", str(x)) for x in range(100, 130)]]
    got = found(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SHAPE), band))
    want = plain_trie(plain_rebuilt(rows))
    assert max(w[1] for w in want) == 300 and got == want


def test_many_equal_conversations_hash_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 7)
    rows = [(c * 20, 0, "user", "hi") for c in range(9, 400)] + [(c, 0, "user", "hi") for c in (3, 101, 1001)]
    assert found(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SHAPE).repartition(5))) == plain_trie(plain_rebuilt(rows))


def test_odd_rows(spark):
    rows = [(None, 1, "user", "lost"), (1, None, None, None), (1, 0, "user", "a  b"), (1, 0, "user", "a  b"), (2, 5, None, "x" * 100_000), (2, 3, "user", "first"),
            (40, 1, "user", "base"), (41, 1, "user", "own"), (42, 1, "user", "own"), (43, 1, "user", "own"), (44, 1, "user", "own"), (65, 1, "user", "no base")]
    table = spark.createDataFrame(rows, SHAPE).selectExpr("*", "role AS depth", "text AS k0", "1 AS pos")
    got = found(prefix_trie.rebuilt_trie(table))
    assert got == plain_trie(plain_rebuilt(rows))
    assert any(not v for v in plain_rebuilt(rows).values())  # a conversation without turns is a member of the root
    assert prefix_trie.rebuilt_trie(table.limit(0)).count() == 0


def test_ties_of_turn_have_one_order(spark):
    rows = [(20, 1, "user", t) for t in "abcdefgh"] + [(20, None, "user", "z"), (20, None, "user", "y")]
    one = found(prefix_trie.rebuilt_trie(spark.createDataFrame(rows, SHAPE).repartition(3)))
    other = found(prefix_trie.rebuilt_trie(spark.createDataFrame(rows[::-1], SHAPE).repartition(2)))
    assert one == other and len(one) == len(rows) + 1
