import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from surveyspark.llm import trie
from surveyspark.llm.queries import op13_trie


def rebuilt(rows):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, tie), role, text))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in turns.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - int(math.fmod(c, 100)), [])[:h[c]] + v[h[c]:] for c, v in own.items()}


def plain_trie(convs):
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in kids[node]) or 1
        saved[node] = sum(saved[k] for k in kids[node]) + ((len(members[node]) - 1) * len(node[-1][1]) if node else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k],
                   hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k, m in members.items())


def nodes(frame):
    return sorted(tuple(-1 if x is None else x for x in r) for r in frame.collect())


def items(spark, rows):
    return trie.turn_items(spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, items string"))


def random_rows(seed, convs=300):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", None, "", "ccc"])))
    rows += [(5000, t, "user", f"t{t}") for t in range(150)] + [(5001, t, "user", f"t{t}") for t in range(120)]
    rows += [(6000 + i, 0, "system", "the same start") for i in range(200)]
    rows += [(6000 + i, 1, "user", f"q{i % 40}") for i in range(150)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("range_turns,fan_in", [(10**6, 512), (200, 512), (30, 8)])
def test_trie_against_plain(spark, range_turns, fan_in):
    rows = random_rows(range_turns)
    got = trie.prefix_trie(trie.with_shared_heads(items(spark, rows)), range_turns, fan_in)
    assert nodes(got) == plain_trie(rebuilt(rows))


def test_salted_parents_equal_broadcast_ones(spark, monkeypatch):
    rows = random_rows(7, 120)
    monkeypatch.setattr(trie, "BROADCAST_ROWS", 0)
    assert nodes(trie.prefix_trie(trie.with_shared_heads(items(spark, rows)), 40, 8)) == plain_trie(rebuilt(rows))


def test_ids_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK_IDS", 3)
    rows = [(c, 0, "user", "same") for c in range(-20, 60)]
    got = nodes(trie.prefix_trie(items(spark, rows)))
    assert got == plain_trie({c: [("user", "same")] for c in range(-20, 60)})


def test_edge_cases(spark):
    rows = [(1, None, "user", "first"), (1, 0, "user", "second"), (1, 0, "user", "tie"), (1, 0, "user", "tie"),
            (2, 5, None, None), (2, 7, None, "x" * 300_000), (-3, 0, "a", "b"), (None, 0, "user", "no conversation"),
            (100, 0, "u", "é"), (107, 0, "u", "é"), (107, 0, "u", "é"), (250, 3, "u", "base is absent")]
    got = trie.prefix_trie(trie.with_shared_heads(items(spark, rows)))
    assert nodes(got) == plain_trie(rebuilt(rows))
    assert any(not v for v in rebuilt(rows).values())  # a conversation without turns
    assert trie.prefix_trie(items(spark, rows).limit(0)).collect() == []
    assert trie.prefix_trie(items(spark, [(None, 0, "u", "t")])).collect() == []
    with pytest.raises(ValueError):
        trie.prefix_trie(items(spark, rows), fan_in=2)


def test_query_against_brute_force(spark):
    from tests.conftest import SF_CHECK

    rows = spark.read.parquet(f"{SF_CHECK}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert nodes(op13_trie(spark, SF_CHECK)) == plain_trie(rebuilt([tuple(r) for r in rows]))
