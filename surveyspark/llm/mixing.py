"""Mixing sources to target weights, in DataFrame functions only.

Each source gets a target share of all words by its weight; a target stops at
``max_epochs`` times its source's words, and what it leaves is shared again by
weight among the others until no target is above that (the level of a water fill:
one small aggregate over the sources a round).

The words of a source are a stream: its documents in the order of a keyed hash.
A target of F words (rounded) is F div W whole passes of the stream's W words and
one more over its first F mod W words; the one document that this point falls into
gives only its first words there, so each source's words meet its target to one
word. Windows of ``block_words`` words cut a pass into blocks of whole documents.

Blocks are dealt to the output shards by a multivariate hypergeometric splitting
tree: a node holds every source's exact number of blocks and a range of shards; it
sends its left half as many blocks in all as its share of shards, and of these each
source's number is drawn from the hypergeometric distribution, given what the
sources before it took (inverse of the distribution function at a hashed uniform
number, summed outward from the mode until the terms vanish in double precision).
So the shards' compositions are those of one great shuffle, while every quota is
exact. At the leaves each shard draws its quota of a source's blocks, disjoint from
the other shards', from a Feistel permutation of the source's blocks; its rows are
shuffled locally by a keyed hash (``order_key``).

A hot source is spread over buckets of the hash, sized by the number of rows;
running sums are taken within buckets and over bucket totals. Sources are numbered
through a range partition; the quotas of a tree node are one row with a number per
source. No step holds documents of a source in one task.

Edge cases: a null text has size 0; a null source is a source of its own, the
last; a source without words has target 0; null ids and repeated rows are rows like
others (rows equal in id, size and source are interchangeable); an empty table
gives an empty result. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import cut
from surveyspark.llm.pii import feistel

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"
BUCKET_ROWS = 8192
BLOCK_WORDS = 1 << 12


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _uniform(*parts: Column) -> Column:
    """A number of [0, 1) from the digest of the parts."""
    digest = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def hypergeometric(good: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``good`` among ``total`` are in a random draw of ``drawn``: the
    inverse of the distribution function at ``u``.

    Terms go outward from the mode by their ratios, at most 9 standard deviations
    and 24 either way; what lies beyond is below the precision of a double.
    """
    def draw(s: Column) -> Column:
        k, n, d = s["k"].cast("double"), s["n"].cast("double"), s["d"].cast("double")
        least = F.greatest(F.lit(0).cast("long"), s["d"] + s["k"] - s["n"])
        most = F.least(s["d"], s["k"])
        mode = F.greatest(least, F.least(most, F.floor((d + 1) * (k + 1) / (n + 2))))
        spread = F.ceil(9 * F.sqrt(F.greatest(F.lit(0.0), d * (k / n) * (1 - k / n) * ((n - d) / F.greatest(n - 1, F.lit(1.0)))))) + 24
        bounds = F.struct(mode.alias("mode"), F.greatest(least, mode - spread).alias("lo"),
                          F.least(most, mode + spread).alias("hi"))

        def up(x: Column) -> Column:  # term x + 1 over term x
            return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

        def steps(count: Column) -> Column:
            return F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))

        def summed(count: Column, ratio) -> Column:
            """The last term and the sum of ``count`` terms, the mode's being 1."""
            zero = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
            return F.aggregate(steps(count), zero, lambda a, i: _let(
                a["p"] * ratio(i), lambda p: F.struct(p.alias("p"), (a["sum"] + p).alias("sum"))))

        def pick(b: Column, below: Column, above: Column) -> Column:
            """From lo up: as many terms as it takes to pass the mark."""
            goal = u * (1.0 + below["sum"] + above["sum"])
            start = F.struct(below["p"].alias("p"), F.lit(0.0).alias("sum"), b["lo"].alias("x"))

            def step(a: Column, mark: Column) -> Column:
                return F.when(a["sum"] + a["p"] > mark, a).otherwise(F.struct(
                    (a["p"] * up(a["x"].cast("double"))).alias("p"), (a["sum"] + a["p"]).alias("sum"), (a["x"] + 1).alias("x")))

            return _let(goal, lambda mark: F.aggregate(steps(b["hi"] - b["lo"]), start, lambda a, _: step(a, mark), lambda a: a["x"]))

        def sums(b: Column) -> Column:
            return F.struct(b.alias("b"), summed(b["mode"] - b["lo"], lambda i: F.lit(1.0) / up((b["mode"] - i).cast("double"))).alias("below"),
                            summed(b["hi"] - b["mode"], lambda i: up((b["mode"] + i - 1).cast("double"))).alias("above"))

        return F.when(most <= least, least).otherwise(
            _let(_let(bounds, sums), lambda s: pick(s["b"], s["below"], s["above"])))

    args = F.struct(good.cast("long").alias("k"), total.cast("long").alias("n"), drawn.cast("long").alias("d"))
    return _let(args, draw)


def split_quotas(quotas: DataFrame, shards: int, key: str) -> DataFrame:
    """Rows ``shard, quotas`` out of one row ``quotas`` (array of longs): the leaves
    of the splitting tree over ``shards`` shards."""
    if shards < 1:
        raise ValueError("at least one shard")
    middle = F.expr("(a + b) div 2").cast("int")
    total = F.aggregate("quotas", F.lit(0).cast("long"), lambda acc, q: acc + q)
    # a child's share of the blocks follows its share of the shards
    left = F.floor((F.col("total") * (F.col("middle") - F.col("a")) + F.expr("(b - a) div 2")) / (F.col("b") - F.col("a")))

    def take(acc: Column, s: Column) -> Column:
        u = _uniform(F.lit(key), F.col("a"), F.col("b"), s["i"])
        got = hypergeometric(s["q"], acc["n"], acc["d"], u)
        return _let(got, lambda x: F.struct((acc["n"] - s["q"]).alias("n"), (acc["d"] - x).alias("d"),
                                            F.array_append(acc["all"], x).alias("all")))

    numbered = F.transform("quotas", lambda q, i: F.struct(q.alias("q"), i.alias("i")))
    lefts = F.aggregate(numbered, F.struct(F.col("total").alias("n"), F.col("left").cast("long").alias("d"),
                                           F.array().cast("array<bigint>").alias("all")), take, lambda acc: acc["all"])
    halves = F.array(F.struct("a", F.col("middle").alias("b"), F.col("lefts").alias("quotas")),
                     F.struct(F.col("middle").alias("a"), F.col("b"), F.zip_with("quotas", "lefts", lambda q, x: q - x).alias("quotas")))
    node = F.explode(F.when(F.col("b") - F.col("a") > 1, halves).otherwise(F.array(F.struct("a", "b", "quotas")))).alias("node")

    nodes = quotas.select(F.lit(0).alias("a"), F.lit(shards).alias("b"), "quotas")
    for _ in range((shards - 1).bit_length()):
        nodes = (nodes.withColumn("middle", middle).withColumn("total", total).withColumn("left", left)
                 .withColumn("lefts", lefts).select(node).select("node.*"))
    return nodes.select(F.col("a").alias("shard"), "quotas")


def _number(rows: DataFrame, by: str) -> DataFrame:
    """``rows`` with ``number`` from 0 in the order of ``by``, nulls last: places in
    range partitions plus the sizes of the partitions before."""
    order = F.col(by).asc_nulls_last()
    placed = cut(rows.repartitionByRange(order).sortWithinPartitions(order)
                 .withColumn("part_no", F.spark_partition_id())
                 .withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("part_no").count()
    ahead = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = sizes.select("part_no", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("start"))
    return (placed.join(starts, "part_no").withColumn("number", F.col("place") + F.col("start"))
            .drop("part_no", "place", "start"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_no, source_size, weight, target`` out of ``source,
    source_size`` (one row a source)."""
    if not weights or min(weights) <= 0 or max_epochs < 1:
        raise ValueError("positive weights and at least one epoch")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights)).cast("int") + 1)
    weighed = cut(_number(sizes, "source").withColumn("weight", weight))
    cap = F.col("source_size") * max_epochs
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # the level only rises, so a round without a newly capped source ends it
        full = cap <= F.lit(level) * F.col("weight")
        row = weighed.agg(F.count_if(full).alias("n"), F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("words"),
                          F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("weight")).first()
        if row["n"] == capped or not row["weight"]:
            break
        level, capped = float(total - row["words"]) / float(row["weight"]), row["n"]
    target = F.when(cap <= F.lit(level) * F.col("weight"), cap.cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return weighed.select("source", F.col("number").alias("source_no"), "source_size", "weight", target.alias("target"))


def _position(copy: Column, count: Column, key: str, source: Column) -> Column:
    """A keyed permutation of [0, count): a Feistel network over a little more
    values, walked on until inside."""
    def walked(s: Column) -> Column:
        a, b = s["a"], s["b"]

        def once(x: Column) -> Column:
            mixed = feistel((x - x % b) / b, x % b, a, b, key, "block", source)
            return _let(mixed, lambda m: m["l"] * b + m["r"])

        # values outside number a * b - count < b; 64 in a row do not occur in large cycles
        more = F.sequence(F.lit(1).cast("long"), F.least(a * b - count + 1, F.lit(64).cast("long")))
        out = F.aggregate(more, once(copy), lambda x, _: F.when(x < count, x).otherwise(once(x)))
        return _let(out, lambda x: F.when(x < count, x).otherwise(F.raise_error(F.lit("block permutation left its range")).cast("long")))

    side = F.ceil(F.sqrt(count.cast("double"))).cast("long")
    return _let(side, lambda b: _let(F.struct(F.ceil(count / b).cast("long").alias("a"), b.alias("b")), walked))


def mix(docs: DataFrame, shards: int = 16, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
        key: str = "mix", block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """Per document ``id_col, source, size, source_size, target`` and ``copies``: an
    array of (epoch, words, shard, order_key), one for each time that the mix takes
    the document. ``words`` is the document's size but for at most one copy of one
    document per source, which is cut to its first words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rank = F.md5(F.concat_ws("|", F.lit(key), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary"))
    # the written table has no texts
    sized = cut(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                            F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), rank.alias("rank")))
    rows = sized.count()
    buckets = max(1, -(-rows // BUCKET_ROWS))
    # the hash's top 32 bits, cut into equal ranges: bucket order is hash order
    bucket = F.floor(F.conv(F.substring("rank", 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("long")
    sized = sized.withColumn("bucket", bucket)
    parts = cut(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    sources = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)

    goal = F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs)
    per_pass = F.expr(f"(source_size + {block_words - 1}) div {block_words}")
    quota = F.col("passes") * F.col("pass_blocks") + F.expr(f"(rest + {block_words - 1}) div {block_words}")
    planned = cut(sources.withColumn("goal", goal)
                  .withColumn("passes", F.when(F.col("source_size") > 0, F.expr("goal div source_size")).otherwise(F.lit(0)))
                  .withColumn("rest", F.col("goal") - F.col("passes") * F.col("source_size"))
                  .withColumn("pass_blocks", per_pass).withColumn("quota", quota))
    one = planned.agg(F.sort_array(F.collect_list(F.struct("source_no", "quota"))).alias("s"))
    leaves = split_quotas(one.select(F.transform("s", lambda x: x["quota"]).alias("quotas")), shards, key)
    dealt = (leaves.select("shard", F.posexplode("quotas").alias("source_no", "blocks"))
             .groupBy(F.col("source_no").alias("dealt_no")).agg(F.sort_array(F.collect_list(F.struct("shard", "blocks"))).alias("d"))
             .select("dealt_no", F.transform("d", lambda x: x["blocks"]).alias("dealt")))
    # ends[j]: blocks of the source in shards 0 to j
    ends = F.aggregate("dealt", F.array().cast("array<bigint>"), lambda acc, x: F.array_append(
        acc, x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))))
    about = ["source_no", "source_size", "target", "passes", "rest", "pass_blocks", "quota"]
    planned = planned.join(dealt, F.col("source_no") == F.col("dealt_no"), "left").select(
        F.col("source").alias("s"), *about, ends.alias("ends"))

    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (parts.withColumn("bucket_start", F.coalesce(F.sum("words").over(ahead), F.lit(0)))
              .join(planned, F.col("source").eqNullSafe(F.col("s")))
              .select("s", F.col("bucket").alias("b"), "bucket_start", *about, "ends"))

    inner = Window.partitionBy("source", "bucket").orderBy("rank", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("bucket_start") + F.col("inner")

    def copy(epoch: Column) -> Column:
        words = F.when(epoch < F.col("passes"), F.col("size")).otherwise(
            F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("start"))))
        number = epoch * F.col("pass_blocks") + F.expr(f"start div {block_words}")
        at = _position(number.cast("long"), F.col("quota"), key, F.col("source_no"))
        shard = _let(at, lambda p: F.size(F.filter("ends", lambda e: e <= p)))
        order = F.md5(F.concat_ws("|", F.lit(key), "rank", "size", epoch.cast("string")).cast("binary"))
        return F.struct(epoch.cast("int").alias("epoch"), words.alias("words"), shard.alias("shard"), order.alias("order_key"))

    last = F.col("passes") - 1 + (F.col("start") < F.col("rest")).cast("long")
    epochs = F.when((last >= 0) & (F.col("size") > 0), F.sequence(F.lit(0).cast("long"), last)).otherwise(F.array().cast("array<bigint>"))
    return (joined.withColumn("start", start)
            .select(F.col("id").alias(id_col), "source", "size", "source_size", "target",
                    F.transform(epochs, copy).alias("copies")))


def mixed_rows(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The mix itself: ``shard, order_key, id_col, epoch, text``, each shard's rows
    together and in shuffled order; a cut copy has its words joined by one space.
    ``id_col`` must be unique and not null here, to find the texts again."""
    words = F.regexp_extract_all(F.col("t"), F.lit(WORD), F.lit(0))
    drawn = mixed.select(F.col(id_col).alias("i"), "size", F.inline("copies"))
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    text = F.when(F.col("words") == F.col("size"), F.col("t")).otherwise(
        F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " "))
    return (drawn.join(texts, "i").select("shard", "order_key", F.col("i").alias(id_col), "epoch", text.alias("text"))
            .repartition("shard").sortWithinPartitions("shard", "order_key"))


def taken_words(mixed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col, size, source_size, target, taken``: words the mix takes, repeats counted."""
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return mixed.select(id_col, "size", "source_size", "target", taken.alias("taken"))
