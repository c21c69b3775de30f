"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree, in DataFrame operations only.

1. Sizes are counted in words. Sources in code point order, null last, take the weights in turn; targets share the whole
   size by weight, stop at ``most`` times the source's size, and the excess is shared again until none is above. In closed
   form: with sources ordered by cap over weight, a prefix of them is at its cap and the rest share one price per weight.
2. Each document is cut into blocks of at most ``block_words`` words. Blocks of a source are put in a seeded random order,
   kept as a bin (top part of the hash) and a rank within the bin, so that no source needs a sort in one task. Running
   totals per bin give every block its rank in its source, and the words before it.
3. A source passes through its order whole as often as its target holds it, and then as far as the target reaches; the
   block at the end is cut there. The number of draws is the source's exact block quota.
4. Quotas are split among ``2**depth`` output shards by a binary tree: a node sends to its left child a sample of half its
   blocks without replacement, source by source: a hypergeometric draw for the first source, then for the next among what
   is left, and so on. The draw inverts its distribution at a seeded uniform number, over a range that leaves out less than
   a double can show. Quotas of children add up exactly.
5. A shard takes its own, disjoint run of each source's order, and its blocks are ordered by another hash.

Tables of sources, bins and shards grow with the number of sources only. All numbers come from hashes of the seed, so
reruns and recomputed tasks agree.

Defined results: null text has size 0 and takes nothing; a null source is a source; null doc_ids are documents too; equal
rows are separate documents; without any words all targets are 0; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slidewatch.llm.common import WORD, as_key, packed, pick
from slidewatch.session import work_path

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
SEED = 7
BLOCK_WORDS = 512
BINS = 1024
DEPTH = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size and a key: a hash of the row's content and, among equal rows, a number."""
    rows = pick(docs, doc_id=id_col, _text=text_col, source=source_col).select(
        "doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("_text")).alias("size"),
        F.xxhash64("_text", F.lit(SEED)).alias("text_hash"),
    )
    # Equal rows are combined before the shuffle and made apart after it.
    same = rows.groupBy("doc_id", "source", "size", "text_hash").count()
    return same.select(
        "doc_id", "source", "size", "text_hash", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy")
    )


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """source, source_size and target from (source, size) rows; one row per source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order) - 1
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int")))
    each = each.withColumn("cap", F.col("source_size") * F.lit(most))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    above = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    each = each.withColumn("total", F.sum("source_size").over(everything)).withColumn(
        "price", (F.col("total") - F.coalesce(F.sum("cap").over(above), F.lit(0.0))) / F.sum("weight").over(rest)
    )
    # The first source, by cap over weight, that the price leaves below its cap sets the price for itself and the rest.
    free = F.when(F.col("price") * F.col("weight") <= F.col("cap"), F.col("price"))
    price = F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return each.select(
        "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("weight") * price), F.col("cap")).alias("target")
    )


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: Stirling's series at n + 9, brought back by a product."""
    x = n.cast("double") + 9.0
    down = F.lit(1.0)
    for k in range(1, 9):
        down = down * (n.cast("double") + float(k))
    series = 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series - F.log(down)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(good: Column, bad: Column, drawn: Column, chance: Column) -> Column:
    """How many of ``drawn`` blocks, taken without replacement from good and bad ones, are good, at the quantile ``chance``.

    The probabilities within 12 standard deviations of the mean are weighed; the rest is below 1e-30.
    """
    one, none = F.lit(1.0), F.lit(0).cast("long")
    given = F.struct(good.alias("good"), bad.alias("bad"), drawn.alias("drawn"), chance.alias("chance"))

    def moments(g: Column) -> Column:
        everything = F.greatest((g["good"] + g["bad"]).cast("double"), one)
        mean = g["drawn"] * g["good"] / everything
        variance = mean * (g["bad"] / everything) * ((everything - g["drawn"]) / F.greatest(everything - 1, one))
        return F.struct(mean.alias("mean"), F.sqrt(F.greatest(variance, F.lit(0.0))).alias("spread"))

    def span(g: Column, m: Column) -> Column:
        low = F.greatest(none, g["drawn"] - g["bad"])
        high = F.least(g["drawn"], g["good"])
        start = F.greatest(low, F.floor(m["mean"] - 12 * m["spread"] - 2))
        stop = F.least(high, F.ceil(m["mean"] + 12 * m["spread"] + 2))
        return F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"))

    def log_weight(g: Column, x: Column) -> Column:
        return -(
            _log_factorial(x) + _log_factorial(g["good"] - x) + _log_factorial(g["drawn"] - x)
            + _log_factorial(g["bad"] - g["drawn"] + x)
        )

    def quantile(g: Column, s: Column) -> Column:
        logs = F.transform(F.sequence(s["start"], s["stop"]), lambda x: let(x, lambda y: log_weight(g, y)))
        weights = let(logs, lambda found: let(F.array_max(found), lambda peak: F.transform(found, lambda v: F.exp(v - peak))))

        def count_below(found: Column) -> Column:
            wanted = F.aggregate(found, F.lit(0.0), lambda a, v: a + v) * g["chance"]
            return let(
                wanted,
                lambda limit: F.aggregate(
                    found,
                    F.struct(F.lit(0.0).alias("sum"), none.alias("n")),
                    lambda a, v: F.struct(
                        (a["sum"] + v).alias("sum"), (a["n"] + F.when(a["sum"] + v < limit, 1).otherwise(0)).cast("long").alias("n")
                    ),
                    lambda a: a["n"],
                ),
            )

        return F.least(s["start"] + let(weights, count_below), s["stop"])

    return let(given, lambda g: let(let(moments(g), lambda m: span(g, m)), lambda s: quantile(g, s)))


def _draw(seed: int, level: int):
    """One step of a node's fold over its sources."""

    def draw(acc: Column, q: Column) -> Column:
        rest = acc["rest"] - q["quota"]
        chance = uniform(F.lit(seed), F.lit(level), F.col("node"), q["owner"])
        mine = hypergeometric(q["quota"], rest, acc["wanted"], chance).cast("long")
        return let(
            mine,
            lambda n: F.struct(
                rest.alias("rest"), (acc["wanted"] - n).alias("wanted"), F.concat(acc["left"], F.array(n)).alias("left")
            ),
        )

    return draw


def split_quotas(quotas: DataFrame, depth: int = DEPTH, seed: int = SEED) -> DataFrame:
    """(owner, quota) to (owner, shard, quota): the splitting tree, level by level.

    A node is one row that holds the quotas of all sources in order. Each source's draw is conditional on those before it:
    the fold carries what is left in the node and what is still to be sent left.
    """
    held = F.sort_array(F.collect_list(F.struct("owner", F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.groupBy().agg(held.alias("held")).select(F.lit(0).cast("long").alias("node"), "held")
    for level in range(depth):
        total = F.aggregate("held", F.lit(0).cast("long"), lambda a, q: a + q["quota"])
        odd = (F.col("total") % 2 == 1) & (uniform(F.lit(seed), F.lit(level), F.col("node"), F.lit("half")) < 0.5)
        nodes = nodes.withColumn("total", total).withColumn(
            "left_size", (F.floor(F.col("total") / 2) + F.when(odd, 1).otherwise(0)).cast("long")
        )

        begin = F.struct(
            F.col("total").alias("rest"), F.col("left_size").alias("wanted"), F.array().cast("array<bigint>").alias("left")
        )
        nodes = nodes.withColumn("left", F.aggregate("held", begin, _draw(seed, level), lambda a: a["left"]))
        sent = F.zip_with("held", "left", lambda q, n: F.struct(q["owner"].alias("owner"), n.alias("quota")))
        stay = F.zip_with("held", "left", lambda q, n: F.struct(q["owner"].alias("owner"), (q["quota"] - n).alias("quota")))
        children = F.array(
            F.struct((F.col("node") * 2).alias("node"), sent.alias("held")),
            F.struct((F.col("node") * 2 + 1).alias("node"), stay.alias("held")),
        )
        nodes = nodes.select(F.explode(children).alias("child")).select("child.*")
    return nodes.select(F.col("node").alias("shard"), F.explode("held").alias("q")).select("q.owner", "shard", "q.quota")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, depth: int = DEPTH, seed: int = SEED,
    block_words: int | None = BLOCK_WORDS, bins: int = BINS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row per drawn block, and one row with null ``pass_no`` and ``shard`` per block that is not drawn at all.

    doc_id, source, size, text_hash, copy (the document), source_size, target, block and n_words (the part of it that is
    taken, from word ``block * block_words``), pass_no, shard and place (order within the shard). With ``block_words``
    None a block is a whole document, and the one at the end is taken whole if at least half of it is within the target.
    """
    whole = block_words is None
    # Texts are read once: all that follows starts from this small table.
    path = work_path(docs.sparkSession, "mixing_documents")
    numbered_documents(docs, id_col, text_col, source_col).write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    goals = targets(rows.select("source", "size"), weights, most)
    last = F.lit(0).cast("long") if whole else F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block_words))
    blocks = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    words = F.col("size") if whole else F.least(F.lit(block_words).cast("long"), F.col("size") - F.col("block") * block_words)
    # A key for sources without nulls, so that windows and joins by source share one shuffle.
    owner = as_key(F.col("source"))
    blocks = blocks.withColumn("words", words.cast("long")).withColumn("owner", owner).withColumn(
        "mark", F.xxhash64(F.lit(seed), "owner", "doc_id", "text_hash", "copy", "block")
    ).withColumn("bin", F.pmod(F.shiftrightunsigned("mark", 40), F.lit(bins)).cast("int"))

    filled = F.expr("cast(words > 0 as int)")
    by_bin = blocks.groupBy("owner", "bin").agg(F.sum("words").alias("bin_words"), F.sum(filled).alias("bin_blocks"))
    before = Window.partitionBy("owner").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy("owner")
    zero = F.lit(0).cast("long")
    starts = by_bin.select(
        "owner", "bin",
        F.coalesce(F.sum("bin_words").over(before), zero).alias("words_before"),
        F.coalesce(F.sum("bin_blocks").over(before), zero).alias("blocks_before"),
        F.sum("bin_blocks").over(all_of).alias("source_blocks"),
    )
    goals = goals.select(owner.alias("owner"), "source_size", "target")
    starts = starts.join(goals, "owner")

    # Blocks without words come last in their bin: they are never drawn and shift no rank.
    inner = Window.partitionBy("owner", "bin").orderBy(filled.desc(), "mark", "doc_id", "text_hash", "copy", "block")
    upto = inner.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumn("_rank", F.row_number().over(inner) - 1).withColumn(
        "_words", F.coalesce(F.sum("words").over(upto), zero)
    )
    placed = placed.join(starts, ["owner", "bin"])
    # Words of the target, the whole passes in it and what the last pass takes.
    goal = F.round("target").cast("long")
    passes = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(zero)
    placed = placed.select(
        "doc_id", "source", "owner", "size", "text_hash", "copy", "source_size", "target", "block", "words", "mark",
        "source_blocks", (F.col("blocks_before") + F.col("_rank")).cast("long").alias("rank"),
        passes.cast("long").alias("passes"),
        F.greatest(zero, goal - passes * F.col("source_size") - F.col("words_before") - F.col("_words")).alias("left"),
    )
    part = (
        F.when(2 * F.col("left") >= F.col("words"), F.col("words")).otherwise(zero) if whole else F.least("left", "words")
    )
    placed = placed.withColumn("part", F.when(F.col("words") > 0, part).otherwise(zero))
    draws = F.when(F.col("words") > 0, F.col("passes") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(zero)
    placed = placed.withColumn("draws", draws.cast("long"))

    # The exact quota: places 0 .. quota - 1 of the endless repetition of a source's order.
    quotas = placed.groupBy("owner").agg(F.sum("draws").alias("quota"))
    ends = Window.partitionBy("owner").orderBy("shard")
    runs = split_quotas(quotas, depth, seed).select("owner", "shard", F.sum("quota").over(ends).alias("stop"))
    runs = runs.groupBy("owner").agg(F.sort_array(F.collect_list("stop")).alias("stops"))

    no_pass = F.array(F.lit(None).cast("long"))
    drawn = placed.withColumn("pass_no", F.explode(F.when(F.col("draws") > 0, F.sequence(zero, F.col("draws") - 1)).otherwise(no_pass)))
    drawn = drawn.join(runs, "owner")
    place = F.col("pass_no") * F.col("source_blocks") + F.col("rank")
    return drawn.select(
        "doc_id", "source", "size", "text_hash", "copy", "source_size", "target", "block",
        F.when(F.col("pass_no").isNull(), zero)
        .when(F.col("pass_no") < F.col("passes"), F.col("words"))
        .otherwise(F.col("part"))
        .alias("n_words"),
        "pass_no",
        F.when(F.col("pass_no").isNotNull(), F.size(F.filter("stops", lambda stop: stop <= place))).alias("shard"),
        F.xxhash64(F.lit(seed + 1), "mark", "pass_no").alias("place"),
    )


def taken(mixed: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, and the words that each output shard takes of it.

    ``taken`` is the sum over the shards, so both come from the blocks that the tree gave to each shard.
    """
    key = ["doc_id", "source", "size", "text_hash", "copy", "source_size", "target"]
    zero = F.lit(0).cast("long")
    by_shard = [F.sum(F.when(F.col("shard") == shard, F.col("n_words")).otherwise(zero)) for shard in range(2**depth)]
    words = mixed.groupBy(*key).agg(F.array(*by_shard).alias("shard_words"))
    total = F.aggregate("shard_words", zero, lambda s, x: s + x)
    return words.select("doc_id", "size", "source_size", "target", total.alias("taken"), "shard_words")


def mixed_documents(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, depth: int = DEPTH, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """``docs`` as drawn: a row for each draw of a whole document, with its columns, grouped in shards and shuffled there.

    Draws are counted per document content, so equal rows are drawn together and a text is moved once.
    """
    drawn = mix(docs, weights, most, depth, seed, None, BINS, id_col, text_col, source_col).where("shard is not null")
    key = ["_id", "_source", "_hash"]
    drawn = drawn.select(as_key(F.col("doc_id")).alias("_id"), as_key(F.col("source")).alias("_source"), F.col("text_hash").alias("_hash"), "shard", "place")
    times = drawn.groupBy(*key).agg(F.collect_list(F.struct("shard", "place")).alias("_draws"))
    own = packed(docs).select(
        "_row", as_key(F.col("_row")[id_col]).alias("_id"), as_key(F.col("_row")[source_col]).alias("_source"),
        F.xxhash64(F.col("_row")[text_col], F.lit(SEED)).alias("_hash"),
    )
    # Equal rows: one takes all draws of their content. Their number is bounded by passes times copies. The removal of the
    # others shares the join's shuffle of the texts.
    joined = own.join(times, key).dropDuplicates(key)
    rows = joined.select("_row", F.explode("_draws").alias("_draw"))
    rows = rows.repartition("_draw.shard", F.pmod("_draw.place", F.lit(64)))
    return rows.sortWithinPartitions("_draw.shard", "_draw.place").select("_row.*")
