"""A corpus-cleaning pipeline out of the text operators.

``STAGES`` lists (name, function) in order; each function takes (spark, docs,
sf_dir) and returns a DataFrame. All but the last return the columns of
``docs``; the last returns token counts and digests per surviving document.
``run`` applies them to ``documents``, each stage's rows written once to the
shared checkpoint folder before the next.

1. quality: documents that the classifier scores below its threshold go.
2. near_duplicates: of each class of near-duplicates the document of least id
   stays (null ids only stand for classes without any other).
3. decontaminate: documents that contain a benchmark item go.
4. pseudonymise: personal data in the texts is replaced, ``n_chars`` renewed.
5. tokenize: byte-level BPE; ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

No stage is expressible in SQL over the input tables as a whole (the first is a
trained network), so there is no oracle; tests compare with brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import bpe, decontaminate, pii, quality, simhash
from surveyspark.llm.common import cut, table

PSEUDONYM_KEY = "corpus-pipeline"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject; learnt from ``docs`` and
    ``labels``. Null and empty texts are scored like others; repeated rows go or stay
    together; an empty table stays empty; other columns stay."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_per_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per SimHash class (three-word shingles, two bits): the least id, null
    ids last, then the least text hash. Texts without words are one class; repeated
    rows leave one; other columns stay."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that contain no benchmark item. Null and empty texts contain none;
    repeated rows go or stay together; other columns stay."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with personal data replaced, and ``n_chars``, if there, renewed (null
    for a null text); other columns stay."""
    out = pii.pseudonymise(docs, PSEUDONYM_KEY, count_col=None)
    kind = dict(docs.dtypes).get("n_chars")
    return out.withColumn("n_chars", F.char_length("text").cast(kind)) if kind else out


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests per row; a null or empty text has no tokens. Other
    columns are not read."""
    return bpe.encode(docs, RANKS, public_tokenizers.PATTERN).drop("ids")


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_per_class),
    ("decontaminate", without_benchmark),
    ("pseudonymise", pseudonymised),
    ("tokenize", tokenized),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
