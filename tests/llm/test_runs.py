import hashlib
import random
import time
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from surveyspark.llm import runs
from surveyspark.llm.queries import op12_runs


def plain_runs(words, min_words=24, min_periods=3):
    """All runs by trying every period."""
    n, out = len(words), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start:i + q]
            smaller = any(part[r:] == part[:-r] for r in range(1, q))
            if len(part) >= max(min_words, min_periods * q) and not smaller:
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_report(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def report(docs):
    return runs.run_report(runs.word_runs(runs.with_periodic_tails(docs)))


def lyndon_lengths(codes):
    out = []
    for i in range(len(codes)):
        j = i + 1
        while j < len(codes) and codes[j:] > codes[i:]:
            j += 1
        out.append(j - i)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=40))
def test_lyndon_array(codes):
    lengths, groups = runs.lyndon_groups(codes)
    assert lengths.tolist() == lyndon_lengths(codes)
    roots = [tuple(codes[i:i + k]) for i, k in enumerate(lengths.tolist())]
    named = dict(zip(groups.tolist(), roots))
    assert len(set(roots)) == len(named) and [named[g] for g in groups.tolist()] == roots


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=8), st.integers(0, 9), st.text("abc", max_size=12)), max_size=4),
       st.sampled_from([6, 9, 24]))
def test_runs_of_texts(parts, min_words):
    docs = [[c.encode() for c in unit * times + tail] for unit, times, tail in parts]
    docs.append([w for d in docs for w in d])
    assert runs.runs_of_texts(docs, min_words) == [plain_runs(d, min_words) for d in docs]


def test_overlapping_runs_of_random_words():
    rng = random.Random(3)
    docs = []
    for _ in range(300):
        words = [b"w%d" % rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.randrange(90))]
        at = rng.randrange(len(words) + 1)
        unit = words[at:at + rng.randrange(1, 12)]
        docs.append(words[:at] + unit * rng.randrange(1, 6) + words[at:])
    found = runs.runs_of_texts(docs)
    assert found == [plain_runs(d) for d in docs] and sum(map(bool, found)) > 30


def test_query_against_brute_force(spark):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    found = op12_runs(spark, SF_SMALL)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(plain_report(*r) for r in docs)


def test_edge_cases(spark):
    # 35 is an id whose CRC-32 ends in 0
    tail_id = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    rows = [(1, None, 5), (2, "", 5), (3, " \n\t ", 5), (None, "a b " * 30, 5), (4, "a b " * 30, 5), (4, "a b " * 30, 5),
            (tail_id, None, 1), (tail_id, "", 1), (tail_id, "one", 1), (tail_id, " x  y\nz \x0b" * 40, 1),
            (5, "a " * 23, 1), (6, "a " * 24, 1), (7, "é\x1cb " * 30, 1), (8, "a" * 500_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int").withColumnRenamed("runs", "n_words")
    key = lambda r: str(r)
    assert sorted(map(tuple, report(docs).collect()), key=key) == sorted((plain_report(i, t) for i, t, _ in rows), key=key)
    assert report(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        runs.word_runs(docs, min_periods=2)


def test_operator_outputs(spark):
    row = runs.word_runs(spark.createDataFrame([(1, "x " + "a b c " * 9 + "y")], "doc_id long, text string")).first()
    assert row["n_words"] == 29 and [tuple(r) for r in row["runs"]] == [(1, 27, 3)] and row["collapsed"] == "x a b c y"


@pytest.mark.parametrize("words", [
    [b"a"] * 400_000, [b"w%d" % (i % 70_001) for i in range(300_000)], [b"w%d" % i for i in range(400_000)]])
def test_long_texts_take_linear_time(words):
    began = time.time()
    found = runs.runs_of_texts([words])[0]
    assert time.time() - began < 20
    assert found == ([(0, len(words), 1)] if words[1] == b"a" else [(0, 300_000, 70_001)] if len(words) == 300_000 else [])
