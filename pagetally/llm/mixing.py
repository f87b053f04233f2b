"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words. Sources, by code point with null last, have weights in turn; they
share `total` times all words by weight, none beyond `most` times its own size (what is over is shared again
by weight among the rest: water-filling, solved in closed form from prefix sums over the sources, in ranges).

A source's target is met by complete epochs (every document once each) and then a fractional one: documents
get the key -ln(u) / w, u from a hash of the id and w their quality weight, and are taken in the order of
their keys while the prefix sum of sizes stays within what is left. The document at the budget's edge is
taken in part, so a source's words differ from its target by less than one.

Prefix sums are two-level, so a source that holds a third of all rows is not one task: keys fall into
BINS ranges; sums of ranges are prefix-summed by source (BINS rows at most), rows only within a range.

Null or empty texts have size 0 and are taken 0 times. A null id is replaced by the text's hash in the draw.
Rows that repeat an id share a key; ties go by id, then size. Documents without a label have weight 1. An
empty table gives an empty result. Only id, source and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import n_parts, staged

BINS = 4096
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def draw(id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) of 52 bits, from the id."""
    name = F.coalesce(id.cast("string"), F.md5(text))
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), name)), 1, 13), 16, 10).cast("bigint").cast("double") + 0.5) / float(1 << 52)


def with_sums_before(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with `place` (from 1) in an order that has no ties, and of each given column the sum over all rows before.
    Ranges of the order are tasks; only a row a range, with its sums, meets in one."""
    n = n_parts(rows.sparkSession)
    ranges = staged(rows.withColumns(sums).repartitionByRange(n, *order).withColumn("range", F.spark_partition_id()), "ranges")
    whole = ranges.groupBy("range").agg(F.count("*").alias("place"), *[F.sum(c).alias(c) for c in sums])
    lower = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # n rows at most
    whole = staged(whole.select("range", *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"lower_{c}") for c in ("place", *sums)]), "range-sums")
    own = Window.partitionBy("range").orderBy(*order)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    place = (F.col("lower_place") + F.row_number().over(own)).alias("place")
    return ranges.join(whole, "range").select(*rows.columns, place, *[(F.col(f"lower_{c}") + F.coalesce(F.sum(c).over(before), F.lit(0))).alias(c) for c in sums])


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size). However many sources there are, they
    are ranked and summed by ranges; the driver sees their sums only."""
    rows = with_sums_before(sizes, [F.col("source").isNull(), F.col("source")], {})
    rows = rows.select("source", F.col("source_size").cast("double").alias("size"), (F.col("place") - 1).alias("turn"))
    rows = rows.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int")))
    rows = staged(rows.withColumn("cap", F.col("size") * most).withColumn("level", F.col("cap") / F.col("w")), "sources")
    size, w = rows.agg(F.coalesce(F.sum("size"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
    rising = with_sums_before(rows, [F.col("level"), F.col("turn")], {"caps": F.col("cap"), "ws": F.col("w")})
    share = (F.lit(size) * total - F.col("caps")) / (F.lit(w) - F.col("ws"))
    first = rising.select("place", "level", share.alias("share")).filter("share <= level").agg(F.min(F.struct("place", "share"))["share"]).first()[0]
    return rows.select("source", F.col("size").cast("bigint").alias("source_size"), (F.col("cap") if first is None else F.least(F.col("cap"), F.lit(first) * F.col("w"))).alias("target"))


def quality_weights(labels: DataFrame, good: float = 2.0, bad: float = 0.5) -> DataFrame:
    """doc_id, weight of labelled documents (a document labelled both ways counts as good)."""
    return labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.when(F.max("quality") > 0, F.lit(good)).otherwise(F.lit(bad)).alias("weight"))


def mix_documents(df: DataFrame, quality: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, total: float = 1.5, most: float = 2.0, seed: str = "mix:") -> DataFrame:
    """id, size, source_size, target, taken and text_hash of each row of df. quality: doc_id, weight."""
    rows = df.select(df[id].alias("id"), df[source].alias("source"), F.coalesce(F.regexp_count(df[text], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"), draw(df[id], F.coalesce(df[text], F.lit("")), seed).alias("u"), F.xxhash64(df[text]).alias("text_hash"))
    rows = rows.join(quality.select(F.col("doc_id").alias("id"), "weight"), "id", "left")
    rows = rows.withColumn("key", -F.log("u") / F.coalesce("weight", F.lit(1.0))).drop("u", "weight")
    rows = staged(rows.withColumn("bin", F.least(F.lit(BINS - 1), F.floor(BINS * (1 - F.exp(-F.col("key")))).cast("int"))), "mix-rows")
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    targets = source_targets(staged(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes"), weights, total, most)
    upto = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(upto), F.lit(0)))
    at = bins.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source"))).select("b.source", "b.bin", "bin_start", "source_size", "target")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    at = staged(at.withColumn("epochs", epochs).withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("bigint")), "mix-bins")
    rows = rows.alias("r").join(at.alias("a"), F.col("r.source").eqNullSafe(F.col("a.source")) & (F.col("r.bin") == F.col("a.bin"))).select("r.*", "bin_start", "source_size", "target", "epochs", "rest")
    within = Window.partitionBy("source", "bin").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("bin_start") + F.sum("size").over(within) - F.col("size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - start))
    return rows.select(F.col("id").alias(id), "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"), "text_hash")


def mixed(df: DataFrame, plan: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: rows of df as often as the plan takes them, a last copy cut to the words taken of it.
    Rows that repeat both id and text share what is taken of them evenly."""
    plan = plan.groupBy(id, "text_hash").agg(F.sum("taken").alias("t"), F.count("*").alias("n"), F.max("size").alias("size"))
    plan = plan.select(F.col(id).alias("key"), F.col("text_hash").alias("hash"), F.floor(F.col("t") / F.col("n")).alias("taken"), "size").filter("taken > 0")
    rows = df.select(F.struct(*[df[c] for c in df.columns]).alias("row"), df[id].alias("id"), F.xxhash64(df[text]).alias("text_hash"))
    rows = rows.join(plan, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_hash") == F.col("hash")))
    rows = rows.select("row", "taken", "size", F.explode(F.expr("sequence(1L, cast(ceil(taken / size) as bigint))")).alias("copy"))
    words = F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    own = F.col("row")[text]
    cut = F.array_join(F.slice(F.regexp_extract_all(own, F.lit(f"({WORD})"), F.lit(1)), F.lit(1), words.cast("int")), " ")
    return rows.select(*[(F.when(words < F.col("size"), cut).otherwise(own) if c == text else F.col("row")[c]).alias(c) for c in df.columns])
