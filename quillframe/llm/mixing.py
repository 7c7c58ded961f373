"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Targets: sources share 150 % of all words by weight; a target stops at twice
   its source's size, and what is over goes to the others (water filling).
2. Blocks of equal tokens go to the sources by highest quotients
   target / (2 k + 1), then each source's blocks to its shards in the same way:
   integer quotas. Only some 5 quotients of a party are compared, however many blocks there are.
3. Each shard lays its documents end to end in seeded order, over and over, and numbers the blocks of that line. A
   seed names the first block that is taken; the quota's blocks are taken from there on.

A block has BLOCK words at most, and no more than a SHARE_OF part of the smallest shard's target, so that rounding starves no source.

All of it is native columns and windows over (doc_id, source, size); texts are read once. Sources are ranked over range partitions, so there may be very many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillframe.llm.common import materialize
from quillframe.llm.quality_rules import count_words

WEIGHTS = (5, 2, 1)
#: Percent of all words that the mix has; times its size that a source may come to.
SHARE, MOST = 150, 2
#: Words of a block at most; which part of the smallest shard's target it is at most.
BLOCK, SHARE_OF = 1024, 100
#: Hexadecimal digits of the seeded hash that name a shard: 256 shards of each source. A shard's documents are sorted by one task, so tables beyond some 10**9 documents a source want more.
SHARD_DIGITS = 2
SEED = "mix"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, _s (source as a key that sorts by code point, null last), _h (seeded hash)."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), "source"), F.lit("t")).alias("_s"),
        count_words(F.coalesce("text", F.lit(""))).alias("size"),
        F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("_h"),
    )


def ranked(rows: DataFrame, order: list[Column], name: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """rows with _n, the place of each in that order (from 1; ties are for the caller to break), and for each of sums the total of the rows before it, _before_<column>.

    Range partitions are ordered each for itself; what lies before a partition comes from one row for each of them."""
    d = materialize(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    totals = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_c"), *[F.sum(c).alias(f"_s_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    totals = totals.select("_part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_c", *[f"_s_{c}" for c in sums])])
    own = Window.partitionBy("_part").orderBy(*order)
    d = d.withColumns({"_n": F.row_number().over(own), **{f"_before_{c}": F.coalesce(F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in sums}})
    d = d.join(F.broadcast(totals), "_part").withColumn("_n", F.col("_n") + F.col("_c"))
    return d.withColumns({f"_before_{c}": F.col(f"_before_{c}") + F.col(f"_s_{c}") for c in sums}).drop("_part", "_c", *[f"_s_{c}" for c in sums])


def targets(sources: DataFrame) -> DataFrame:
    """_s, source_size, target, total of (_s, source_size)."""
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), ((F.col("_n") - 1) % len(WEIGHTS) + 1).cast("int"))
    d = ranked(sources, [F.col("_s")], "mix-order").withColumn("w", weight).withColumn("cap", F.col("source_size") * MOST).drop("_n")
    d = ranked(d, [F.col("cap") / F.col("w"), F.col("_s")], "mix-ratios", ("cap", "w"))
    every = d.agg(F.sum("source_size").alias("total"), F.sum("w").alias("w_all"))
    d = d.join(F.broadcast(every))  # one row
    d = d.withColumn("level", (F.col("total") * SHARE / 100 - F.col("_before_cap")) / (F.col("w_all") - F.col("_before_w")))
    level = d.agg(F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "_s", "level")))["level"].alias("at"))
    d = d.join(F.broadcast(level))  # one row
    return d.select("_s", "source_size", "total", F.least(F.col("cap").cast("double"), F.col("w") * F.coalesce("at", F.lit(0.0))).alias("target"))


def _range(parties: DataFrame, votes: str, block: Column, all_votes: Column, n: Column) -> DataFrame:
    """parties with _lo and _hi: with n parties a party's seats lie within n / 2 of its share of the rounding, in proportion to its votes, and 2 of votes / block."""
    slack = F.col(votes) / F.greatest(all_votes, F.lit(1e-9)) * n / 2
    return parties.withColumn("_lo", F.greatest(F.lit(0), F.floor(F.col(votes) / block - slack) - 2)).withColumn("_hi", F.greatest(F.lit(0), F.ceil(F.col(votes) / block + slack) + 2))


def quotas(sources: DataFrame) -> DataFrame:
    """sources (_s, target, n_blocks, block) with quota: their share of n_blocks by the highest quotients target / (2 k + 1), first key first among equals."""
    every = sources.agg(F.sum("target").alias("_votes"), F.count(F.lit(1)).alias("_parties"))
    d = _range(sources.join(F.broadcast(every)), "target", F.col("block"), F.col("_votes"), F.col("_parties"))  # one row
    d = d.select("_s", "target", "n_blocks", "_lo", "_hi")
    rest = d.agg((F.first("n_blocks") - F.sum("_lo")).alias("_rest"))
    each = d.filter("target > 0").withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("_q", F.col("target") / (2 * F.col("_k") + 1))
    placed = ranked(each.select("_s", "_lo", "_k", "_q"), [F.desc("_q"), F.asc("_s"), F.asc("_k")], "mix-quotients").join(F.broadcast(rest))  # one row
    won = placed.groupBy("_s").agg((F.first("_lo") + F.sum((F.col("_n") <= F.col("_rest")).cast("long"))).cast("long").alias("quota"))
    return sources.join(won, "_s", "left").withColumn("quota", F.coalesce("quota", F.lit(0).cast("long")))


def shard_quotas(shards: DataFrame) -> DataFrame:
    """shards (_s, _shard, votes, quota, block) with shard_quota: their share of their source's quota in the same way. A source has a bounded number of shards."""
    group = Window.partitionBy("_s")
    ranged = _range(shards, "votes", F.col("block"), F.sum("votes").over(group), F.count(F.lit(1)).over(group))
    ranged = ranged.withColumn("_rest", F.col("quota") - F.sum("_lo").over(group)).filter("votes > 0")
    won = (
        ranged.withColumn("_k", F.explode(F.sequence("_lo", "_hi")))
        .withColumn("_r", F.row_number().over(group.orderBy((F.col("votes") / (2 * F.col("_k") + 1)).desc(), "_shard", "_k")))
        .groupBy("_s", "_shard")
        .agg((F.first("_lo") + F.sum((F.col("_r") <= F.col("_rest")).cast("long"))).cast("long").alias("shard_quota"))
    )
    return shards.join(won, ["_s", "_shard"], "left").withColumn("shard_quota", F.coalesce("shard_quota", F.lit(0).cast("long")))


def mix(docs: DataFrame, digits: int = SHARD_DIGITS) -> DataFrame:
    """doc_id, size, source_size, target, taken, block of each row of docs (doc_id, text, source; others are not read). digits: 16**digits shards of a source.

    Null or empty texts have size 0 and nothing taken; a null source is a source of its own, last in order; a
    null doc_id stays null. A source's words come within half a block for each shard of its target, which is within some 0.5 % where blocks have more than one word.
    Rows that repeat are documents of their own; equal ones may swap what is taken of
    them, so the result as a set is the same in each run. An empty table gives no rows."""
    d = materialize(sizes(docs), "mix-sizes").withColumn("_shard", F.substring("_h", 1, digits))
    sources = materialize(targets(d.groupBy("_s").agg(F.sum("size").alias("source_size"))), "mix-targets")
    sent = F.broadcast if _small(sources) else lambda x: x
    shards = d.groupBy("_s", "_shard").agg(F.sum("size").alias("shard_size")).join(sent(sources.select("_s", "source_size", "target")), "_s")
    shards = materialize(shards.withColumn("votes", F.col("target") * F.col("shard_size") / F.greatest(F.col("source_size"), F.lit(1))), "mix-shards")
    least = shards.agg(F.min(F.when(F.col("votes") > 0, F.col("votes"))).alias("least"))
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.coalesce("least", F.lit(0.0)) / SHARE_OF))).cast("long")
    sources = sources.join(F.broadcast(least)).withColumn("block", block).drop("least")  # one row
    sources = sources.withColumn("n_blocks", F.round(F.col("total") * SHARE / 100 / F.col("block")).cast("long"))
    sources = materialize(quotas(sources), "mix-sources")
    shards = shard_quotas(shards.join(sent(sources.select("_s", "block", "quota")), "_s"))
    number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}:"), "_s", F.lit(":"), "_shard")), 1, 8), 16, 10).cast("long")
    first = number % F.greatest(F.lit(1), F.ceil(F.col("shard_size") / F.col("block"))) * F.col("block")
    words = F.least(F.col("shard_quota") * F.col("block"), F.col("shard_size") * MOST)
    shards = shards.select("_s", "_shard", "source_size", "target", "shard_size", "block", first.alias("first"), words.alias("words"))
    line = Window.partitionBy("_s", "_shard").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = d.withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0))).join(shards, ["_s", "_shard"])
    whole = F.greatest(F.col("shard_size"), F.lit(1))
    laid = laid.withColumn("rest", F.col("words") % whole)
    # a document's part of the stretch from the first block on, which may come round to the start of the line
    part = lambda start, end: F.greatest(F.lit(0), F.least(F.col("before") + F.col("size"), end) - F.greatest(F.col("before"), start))
    end = F.col("first") + F.col("rest")
    taken = F.floor(F.col("words") / whole) * F.col("size") + part(F.col("first"), F.least(end, whole)) + part(F.lit(0), end - whole)
    return laid.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "block")


def _small(sources: DataFrame, rows: int = 10_000) -> bool:
    """Whether there are few enough sources to send to every executor."""
    return sources.limit(rows + 1).count() <= rows
