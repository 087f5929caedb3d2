import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyspark.llm import simhash


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split() if w]
    grams = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_classes(fps, max_bits=2):
    fps, parent = list(fps), {}
    for f in fps:
        parent.setdefault(f, f)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = sorted(parent)
    for i, a in enumerate(some):
        for b in some[i + 1:]:
            if bin(a ^ b).count("1") <= max_bits:
                parent[root(a)] = root(b)
    return {f: root(f) for f in some}


def test_fingerprint_matches_plain(monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 7)
    for text in (None, "", "One", "one TWO", "a b c", "É a\x0bb\tc " * 40, " ".join(map(str, range(900)))):
        assert simhash.fingerprint(text, 3) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c')").first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=40), st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_tree_finds_every_link(seeds, seed):
    rng = random.Random(seed)
    fps = set(seeds)
    for f in seeds:
        for _ in range(rng.randrange(6)):
            fps.add(f ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    fp = np.array(sorted(fps), np.uint64)
    fp = fp[np.argsort(simhash.gray_rank(fp))]
    found = {(int(a), int(b)) for x, y in simhash.Tree(fp).links(2) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(fp)) for j in range(i + 1, len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= 2}
    assert found == want


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(5000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "w1 w2"), (4, "W1 w2"), (5, "w1")]
    for base in range(60):
        text = rng.choices(words, k=rng.randrange(3, 400))
        for copy in range(rng.randrange(1, 5)):
            edited = list(text)
            if copy > 1:
                edited[rng.randrange(len(edited))] = rng.choice(words)
            rows.append((len(rows), " ".join(edited)))
    rows += [(7, rows[7][1]), (None, rows[8][1])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, component_id int")
    got = simhash.near_duplicates(docs.repartition(5)).collect()
    assert len(got) == len(rows)
    classes = plain_classes({plain_fingerprint(t) for _, t in rows})
    least = {}
    for i, t in rows:
        c = classes[plain_fingerprint(t)]
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted((i or -1, f"{plain_fingerprint(t):016x}", least.get(classes[plain_fingerprint(t)])) for i, t in rows)
    assert sorted((r["doc_id"] or -1, r["fingerprint"], r["component_id"]) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_one_row_stays_per_class_whatever_its_ids(spark):
    """Null ids and one id over texts of different classes."""
    rng = random.Random(6)
    a, b, c, d, e, f = (" ".join(rng.choices([f"w{i}" for i in range(400)], k=80)) for _ in range(6))
    rows = [(None, a), (None, a), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, e), (4, f), (None, f), (5, a.upper()),
            (None, None), (None, "")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, text_hash int")
    kept = simhash.keep_one(docs.repartition(5))
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"] or "") for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, a.upper()), (None, b), (1, c), (2, d), (2, e), (4, f), (None, "")], key=str)


def test_chain_of_fingerprints_closes(spark):
    """A path of links much longer than a star."""
    fp, chain = 0, [0]
    for bit in range(60):
        fp ^= 1 << bit
        chain.append(fp)
    rows = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in chain], "fp long")
    roots = simhash.close_links(simhash.fingerprint_edges(rows, 2)).collect()
    assert {r["root"] for r in roots} == {0} and {r["node"] for r in roots} | {0} == set(chain)


def test_one_hot_node(spark):
    """Thousands of fingerprints under the same masked patterns."""
    rng = np.random.default_rng(1)
    base = 0x0123456789ABCDEF
    fps = {base ^ int(1 << a) ^ int(1 << b) for a, b in rng.integers(0, 63, (3000, 2))}
    rows = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.fingerprint_edges(rows, 2)
    assert edges.count() < 15 * len(fps)
    assert len({r["root"] for r in simhash.close_links(edges).collect()}) == len(set(
        plain_classes(list(fps)[:0] or [base]).values()))


def test_more_bits_are_refused_and_empty_tables_work(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        simhash.fingerprint_edges(empty.selectExpr("doc_id fp"), 3)
