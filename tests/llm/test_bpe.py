import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken

from surveyspark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH),
                             special_tokens={})


TEXTS = [None, "", " ", "Hello world, it's   fine.\n\n\t x", "a" * 1000 + " " + "ab" * 700, "naïve café — 日本語 👍🏽 ١٢٣",
         "<|endoftext|> is ordinary", "The cat. " * 30_000 + "end", "\x00\x85\xa0 odd", "The cat. " * 2, "The cat. " * 2]


def test_same_ids_as_the_library_and_round_trip(spark, reference):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN, keep_ids=True).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = reference.encode_ordinary(text or "")
        assert got[i]["ids"] == want
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bpe.decode(
        spark.createDataFrame([(i, r["ids"]) for i, r in got.items()], "doc_id long, ids array<int>"),
        PATH, public_tokenizers.PATTERN).collect()}
    assert [back[i] for i in range(len(TEXTS))] == [t or "" for t in TEXTS]


def test_whole_table_equals_the_library(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in bpe.encode(docs, PATH, public_tokenizers.PATTERN).collect():
        ids = " ".join(map(str, reference.encode_ordinary(texts[r["doc_id"]])))
        assert r["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_cache_overflow_keeps_results(reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 5)
    coder = bpe.WordCoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    for text in ("zebra quilt vexing", "quilt jumbled foxes zebra", "zebra"):
        words = coder.split.findall(text)
        coder.learn(iter(words))
        assert " ".join(coder.solved[w][0] for w in words) == " ".join(map(str, reference.encode_ordinary(text)))


@pytest.mark.parametrize("size", [400, 64, 20])
def test_long_words_stay_in_memory_and_time(reference, size, tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    rng = random.Random(size)
    words = ["".join(rng.choices("etaoinshrdlu", k=size)) for _ in range(1_000_000 // size)]
    coder = bpe.WordCoder(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    began = time.time()
    coder.learn(words)
    assert time.time() - began < 30 and not list(tmp_path.iterdir())  # nothing spilled to the working folder
    for word in words[::37]:
        assert coder.solved[word][0] == " ".join(map(str, reference.encode_ordinary(word)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, PATH, public_tokenizers.PATTERN).count() == 0
