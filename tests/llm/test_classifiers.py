import math
import random
from zlib import crc32

import numpy as np
import pytest

from surveyspark.llm import langid, quality

SMALL = "/root/testdata/sf0.01"


def docs_and_labels(spark, n=300):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [rng.choice(["river", "stone", "cloud", "meadow", "winter"]) for _ in range(30)]
        docs.append((i, " ".join(words if good else [w.upper() + "!!!" for w in words]), "s", 0.0))
        labels.append((i, int(good), 0))
    labels += [(0, None, 0), (None, 1, 0), (3, labels[3][1], 0)]
    return (spark.createDataFrame(docs, "doc_id long, text string, source string, score double"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


def test_quality_on_held_out_rows(spark):
    docs, labels = docs_and_labels(spark)
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").collect()}
    got = quality.classify(docs, labels).collect()
    assert len(got) == 300
    for r in got:
        assert r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in got if r["predicted"]}


def test_quality_does_not_learn_held_out_labels(spark):
    docs, labels = docs_and_labels(spark)
    flipped = labels.withColumn("quality", quality.F.when(quality.crc_of_id("doc_id") % 5 == 0, 1 - labels.quality)
                                .otherwise(labels.quality))
    assert sorted(quality.classify(docs, labels).collect()) == sorted(quality.classify(docs, flipped).collect())


def test_quality_odd_rows(spark):
    docs, labels = docs_and_labels(spark, 60)
    odd = spark.createDataFrame([(1000, None, "s", 0.0), (1001, "", "s", 0.0), (None, "stone", "s", 0.0),
                                 (1002, "stone river " * 200_000, "s", 0.0), (1003, "é!" * 3, "s", 0.0)], docs.schema)
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs.unionByName(odd), labels).collect()}
    assert got[1000] == got[1001] and all(0 <= s <= 1 for s in got.values())
    assert {r["score"] for r in quality.classify(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0
    one = quality.classify(docs, labels.where("quality = 1")).collect()
    assert all(r["predicted"] == 1 for r in one)


def test_long_text_pools_like_its_pieces(monkeypatch):
    text = "One two, two THREE... " * 50
    vectors = quality.word_vectors(quality.context_sums([text]))
    whole = quality.features([text], vectors)
    monkeypatch.setattr(quality, "PIECE", 40)
    assert np.allclose(whole, quality.features([text], vectors), atol=0.02)


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = (rng.random(3000) < 1 / (1 + np.exp(-x[:, 0]))).astype(int)
    p = quality.train(x, y).probability(x)
    for low in (0.2, 0.4, 0.6):
        some = (p >= low) & (p < low + 0.2)
        assert abs(y[some].mean() - p[some].mean()) < 0.1


@pytest.mark.parametrize("folder", [SMALL])
def test_quality_of_the_given_table(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in quality.classify(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.93


def plain_kernel(a, b):
    a, b = set(langid.bins(a).tolist()), set(langid.bins(b).tolist())
    return len(a & b) / math.sqrt(len(a) * len(b))


def test_kernel_and_folding():
    texts = ["the cat sat on the mat", "der hund und die katze", "the dog ran", "die maus und der baum"]
    rows = [langid.bins(t) for t in texts]
    p = langid.presence(rows)
    assert np.allclose(p @ p.T, [[plain_kernel(a, b) for b in texts] for a in texts], atol=1e-5)
    names, matrix = langid.fit_kernel(rows, ["en", "de", "en", "de"])
    assert [names[i] for i in (p @ matrix).argmax(1)] == ["en", "de", "en", "de"]


def test_bins_of_pieces_equal_the_whole(monkeypatch):
    text = "Ein langer Text, mit 123 Zahlen -- und Wörtern. " * 9
    whole = langid.bins(text)
    for piece in (7, 48, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert np.array_equal(langid.bins(text), whole)


def test_languages_of_the_given_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, "en", "s", 0), (10**9 + 1, "", "en", "s", 0), (10**9 + 2, "12 !?", "fr", "s", 5),
                                 (None, "x", None, "s", 1), (10**9 + 3, "the of and " * 100_000, None, "s", 0)], docs.schema)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = {r["doc_id"]: r for r in langid.identify(docs.unionByName(odd)).collect()}
    assert [got[10**9 + i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[10**9]["score"] == 0
    assert got[10**9 + 3]["lang_pred"] == "en" and got[None]["lang_pred"] in set(truth.values())
    held = [r for i, r in got.items() if r["held_out"] and i in truth]
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got.values() if r["doc_id"])
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.98


def test_many_frequent_languages_leave_the_rare_one(spark, monkeypatch):
    monkeypatch.setattr(langid, "PER_LANGUAGE", 20)
    monkeypatch.setattr(langid, "SAMPLE", 40)
    docs = spark.range(1205).selectExpr("id doc_id", "concat('text ', id) text",
                                        "if(id < 1200, concat('l', id % 4), 'rare') lang")
    names, _ = langid.fit(docs, langid.F.lit(True))
    assert names == ["l0", "l1", "l2", "l3", "rare"]


def test_language_without_labels_and_empty(spark):
    rows = spark.createDataFrame([(1, "abc", None), (2, None, None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.identify(rows).collect()} == {"und"}
    assert langid.identify(rows.limit(0)).count() == 0
    one = spark.createDataFrame([(i, "abc def", "xx") for i in range(9)] + [(9, "..", "xx")], rows.schema)
    assert {(r["doc_id"] == 9, r["lang_pred"]) for r in langid.identify(one).collect()} == {(False, "xx"), (True, "und")}


def test_contexts_cover_all_documents(spark, monkeypatch):
    texts = ["one two three two one", None, "", "alone", "four five, four five! six", "seven eight " * 60]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = quality.context_sums(texts)
    assert np.array_equal(quality.corpus_contexts(docs.repartition(3), "text"), whole)
    assert not quality.corpus_contexts(docs.limit(0), "text").any()
    monkeypatch.setattr(quality.Contexts, "HELD", 5)
    assert np.array_equal(quality.context_sums(texts), whole)
    plain, index = np.zeros_like(whole), quality.index_vectors()
    for text in texts:
        b = [quality.bucket(w) for w in quality.WORDS.findall(text or "")]
        for i, word in enumerate(b):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(b):
                    plain[word] += index[b[j]]
    assert np.array_equal(plain, whole)
    # one labelled document; the words of the others have vectors all the same
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    vectors, _ = quality.fit(docs, labels, quality.F.lit(True))
    assert np.array_equal(vectors, quality.word_vectors(whole))
