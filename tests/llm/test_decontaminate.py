import random
from collections import Counter

import numpy as np
import pytest

from surveyspark.llm import decontaminate as dc


def plain(docs, items, shingle=5, threshold=0.8):
    found, sets = [], []
    for i, item in {x for x in items if x[1]}:
        own = dc.WORD.findall(item.lower())
        width = min(shingle, len(own))
        sets.append((i, width, dc.shingles(own, width) if width else set()))
    for d, text in docs:
        words = dc.WORD.findall((text or "").lower())
        mine_by_width = {w: dc.shingles(words, w) for w in range(1, shingle + 1)}
        for i, width, mine in sets:
            shared = len(mine & mine_by_width[width]) if mine else 0
            if mine and shared >= threshold * len(mine) - 1e-9:
                found.append((d, i, shared, len(mine)))
    return Counter(found)


def fixture():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 2, 4, 5, 6, 9, 15, 40, 120])))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "!!"), (None, items[9][1]), (5, items[5][1]), (5, "another text for one id of five")]
    docs = [(0, None), (1, ""), (2, "..."), (None, "x " + items[9][1])]
    for d in range(3, 200):
        text = rng.choices(words, k=rng.randrange(1, 600))
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items[:60])[1]).split()
            for _ in range(rng.randrange(4)):  # damaged copies, some under the threshold
                item[rng.randrange(len(item))] = rng.choice(words)
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() + rng.choice(["", ",", "\n"]) for w in item]
        docs.append((d, " ".join(text)))
    docs += [docs[20], docs[20]]
    docs.append((1000, "pad " * 300_000 + items[8][1]))
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("block", [4 << 20, 2000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(dc, "BLOCK_BYTES", block)
    docs, items = fixture()
    d, i = frames(spark, docs, items)
    got = dc.contaminated(d.repartition(3), i).collect()
    want = plain(docs, items)
    assert sum(want.values()) > 80
    assert Counter((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in got) == want
    assert all(r["containment"] == r["n_shared"] / r["n_item"] >= 0.8 for r in got)
    kept = dc.clean(d, i)
    assert kept.columns == d.columns
    hit = {k[0] for k in want}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(x for x, _ in docs if x not in hit)


def test_word_hashes_follow_the_words(monkeypatch):
    text = "Añb c1, c1\n日本 - a" * 30
    one = dc.hashes_of(text, [1])[1]
    words = dc.WORD.findall(text.lower())
    assert len(one) == len(words) and len(set(one.tolist())) == len(set(words))
    assert len({(w, int(h)) for w, h in zip(words, one)}) == len(set(words))
    monkeypatch.setattr(dc, "PIECE", 64)
    assert np.array_equal(dc.hashes_of(text, [1])[1], one)


def test_empty_tables(spark):
    d, i = frames(spark, *fixture())
    assert dc.contaminated(d.limit(0), i).count() == 0
    none = dc.contaminated(d, i.limit(0))
    assert none.count() == 0 and none.columns == dc.contaminated(d, i).columns
    assert dc.clean(d, i.limit(0)).count() == d.count()
