"""Mixing sources to target weights, with hash-threshold histograms and built-in functions only.

A document's place in its source's mix is a 48-bit hash of its id and text. The words of each source are summed by the hash's
leading bits; the bucket in which the budget ends is refined by the next bits, until one hash value is left. What lies
below the threshold is taken: a filter, no sort of documents. Budgets of one source at different targets are nested.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its own, last in order;
rows of null or equal ids are told apart by their texts; rows of a source equal in both share their hash and are taken or
left together, whichever comes nearer to the budget; a very long text is one document like any other, so a source's taken
words may miss its target by half of the document at the threshold; no rows give no rows; columns besides the named ones,
of any name, are ignored by mix_plan and kept by mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, join_checked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
LEVELS, LEVEL_BITS = 6, 8


def size_of(text: str = "text"):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def hash_of(doc_id: str = "doc_id", text: str = "text"):
    """48 bits of the MD5 of the id and the text's MD5."""
    own = lambda c: F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary"))
    both = F.md5(F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(":"), own(text)).cast("binary"))
    return F.conv(F.substring(both, 1, LEVELS * LEVEL_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, h."""
    return docs.select("doc_id", "source", size_of().alias("size"), hash_of().alias("h"))


def targets(per_source: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From source, source_size: target words by weight, none above cap times its source's size.

    Sources in code point order (nulls last) weigh weights, repeating. A source at its cap frees words for the others;
    where that ends, all others stand at level x weight. Sources are visited by the level that fills them, so running
    sums give the level at which each would be the first that isn't full. One row per source passes a single window.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_fill = Window.orderBy("ratio", "rank")
    w = F.array(*[F.lit(float(x)) for x in weights])
    ranked = per_source.withColumn("rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(w, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    every = Window.partitionBy()
    filled = (
        ranked.withColumn("pos", F.row_number().over(by_fill))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("rest", F.sum("weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    )
    first = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("pos", "level"))).over(every)
    return filled.withColumn("first", first).select(
        "source",
        "source_size",
        F.when(F.col("first").isNull() | (F.col("pos") < F.col("first.pos")), F.col("cap")).otherwise(F.col("first.level") * F.col("weight")).alias("target"),
    )


def thresholds(docs_sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per source of wanted: rounds (times that all is taken) and h_end, at_end: in one more round, hashes below h_end, and h_end itself if at_end."""
    state = cut(
        wanted.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumn("prefix", F.lit(0).cast("long"))
        .withColumn("mass", F.lit(0).cast("long"))
    )
    plan = state.select("source", "source_size", "target", "rounds")
    in_order = Window.partitionBy("source").orderBy("bucket")
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * LEVEL_BITS
        live = join_checked(
            docs_sized.select("size", "h", F.col("source").alias("of")),
            state.select("source", "left", "prefix"),
            F.col("of").eqNullSafe(F.col("source")) & (F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix")),
        )
        sums = live.groupBy("source", "left", "prefix", F.shiftright("h", shift).bitwiseAND(F.lit((1 << LEVEL_BITS) - 1)).alias("bucket")).agg(F.sum("size").alias("mass"))
        run = sums.withColumn("upto", F.sum("mass").over(in_order))
        state = cut(
            run.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("mass") <= F.col("left"))).select(
                "source", (F.col("left") - (F.col("upto") - F.col("mass"))).alias("left"), (F.col("prefix") * (1 << LEVEL_BITS) + F.col("bucket")).alias("prefix"), "mass"
            )
        )
    ends = state.select(F.col("source").alias("s"), F.col("prefix").alias("h_end"), (F.col("mass") - F.col("left") < F.col("left")).alias("at_end"))
    return plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def copies(h):
    """How often a document of hash h is taken, beside the columns of thresholds()."""
    rounds, h_end, at_end = map(F.col, ("rounds", "h_end", "at_end"))
    return rounds + F.coalesce((h < h_end) | ((h == h_end) & at_end), F.lit(False)).cast("long")


def mix_plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target (its source's), copies and taken (copies x size)."""
    rows = cut(sized(docs))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ends = cut(thresholds(rows, wanted).withColumnRenamed("source", "s"))
    return (
        join_checked(rows, ends, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("copies", F.when(F.col("size") > 0, copies(F.col("h"))).otherwise(F.lit(0).cast("long")))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """docs, each row as often as the mix takes it; rows without words never."""
    rows = cut(sized(docs))
    wanted = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    ends = cut(thresholds(rows, wanted).select(F.col("source").alias("_from"), "rounds", "h_end", "at_end"))
    whole = docs.where(F.coalesce(F.col("text").rlike(WORD), F.lit(False))).select(F.struct("*").alias("row"), F.col("source").alias("_source"), hash_of().alias("h"))
    joined = join_checked(whole, ends, F.col("_source").eqNullSafe(F.col("_from")))
    times = joined.select("row", copies(F.col("h")).cast("int").alias("n")).where("n > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")
