"""Corpus profiles: lengths, frequencies, duplicates, issues, and rows for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio

QUANTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def length_summary(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group: count, the nearest-rank-by-rounding quantiles, max and mean (3 places).

    Values are counted first, so what a group's task holds is its distinct lengths, not its
    rows; a quantile is the first length whose cumulative count passes the wanted index."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    index = lambda q: F.bround((F.col("all") - 1) * F.lit(q), 0)
    at = [F.min(F.when(F.col("upto") > index(q), F.col(value))).alias(f"p{round(q * 100)}") for q in QUANTILES]
    return rows.groupBy(by).agg(F.sum("n").alias("count"), *at, F.max(value).alias("max"), F.round(F.sum(F.col(value) * F.col("n")) / F.sum("n"), 3).alias("mean"))


def nearest_rank(df: DataFrame, value: str, by: str) -> DataFrame:
    """Per group the element at ceil(q * n) - 1, by the same counting."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(by).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(by)))
    return rows.groupBy(by).agg(*[F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * F.lit(q)), F.col(value))).alias(f"p{round(q * 100)}") for q in QUANTILES])


def threshold_counts(df: DataFrame, value: str, by: str, limits: tuple[int, ...] = (768, 1024, 1280)) -> DataFrame:
    return df.groupBy(by).agg(*[F.count_if(F.col(value) >= t).alias(f"at_least_{t}") for t in limits])


def with_overall(df: DataFrame, by: str, *aggregates: Column, name: str = "overall") -> DataFrame:
    """Aggregates per group and over all rows, in one pass."""
    rows = df.withColumn("_group", F.coalesce(by, F.lit(""))).rollup("_group").agg(F.grouping("_group").alias("_all"), *aggregates)
    return rows.withColumn(by, F.when(F.col("_all") == 1, name).otherwise(F.col("_group"))).drop("_group", "_all")


#: Hash buckets into which the refs of one key are dealt.
BUCKETS = 32


def duplicate_groups(df: DataFrame, key: str, ref: str, split: str, first: int = 10) -> DataFrame:
    """Keys that two or more different refs hold: refs, splits, if they cross splits, and the
    ``first`` smallest refs. Ranks stop at ``first`` before anything is collected.

    One pass over the rows, since their keys may be costly: a key's refs are ranked in buckets,
    whose counts, splits and first refs are put together. Null keys are no groups, null refs and
    splits don't count. The null keys are told by a count: a filter on the key, or a join, would
    be moved below it and evaluate it again."""
    dealt = df.select(key, ref, split, F.pmod(F.xxhash64(ref), F.lit(BUCKETS)).alias("_bucket")).repartition(key, "_bucket")
    order = Window.partitionBy(key, "_bucket").orderBy(F.col(ref).asc_nulls_last())
    new = F.col(ref).isNotNull() & ~F.lag(ref).over(order).eqNullSafe(F.col(ref))
    ranked = dealt.withColumn("_new", new).withColumn("_place", F.dense_rank().over(order))
    parts = ranked.groupBy(key, "_bucket").agg(
        F.count_if("_new").alias("_refs"), F.collect_set(split).alias("_splits"), F.collect_list(F.when(F.col("_new") & (F.col("_place") <= first), F.col(ref))).alias("_first")
    )
    groups = parts.groupBy(key).agg(
        F.sum("_refs").alias("refs"), F.size(F.array_distinct(F.flatten(F.collect_list("_splits")))).cast("long").alias("splits"),
        F.slice(F.sort_array(F.flatten(F.collect_list("_first"))), 1, first).alias("examples"), F.count(key).alias("_held"),
    )
    return groups.where("refs > 1 and _held > 0").drop("_held").withColumn("crosses", F.col("splits") > 1)


def label_counts(df: DataFrame, labels: str) -> DataFrame:
    """How often each label of the array column occurs."""
    return df.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def negative_share(df: DataFrame, by: str, negative: Column) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("records"), F.count_if(negative).alias("negatives"), ratio(F.count_if(negative), F.count("*"), 6).alias("negative_ratio"))


def longest(df: DataFrame, value: str, *ties: str, n: int = 30) -> DataFrame:
    """The n rows with the largest value, ties by the given columns: top n per task, then one merge."""
    return df.orderBy(F.desc(value), *ties).limit(n)


def issue_order(issues: DataFrame) -> DataFrame:
    """Issues by severity, type, split (none first), index (none first)."""
    return issues.orderBy("severity", "issue_type", F.coalesce("split", F.lit("")), F.coalesce("row_index", F.lit(-1)))


def issue_counts(issues: DataFrame, blockers: tuple[str, ...]) -> DataFrame:
    return issues.groupBy("issue_type").agg(F.count("*").alias("n")).withColumn("blocker", F.col("issue_type").isin(*blockers))


def seeded_key(seed, *parts: str) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]), 256)


def review_selection(df: DataFrame, reasons: dict[str, tuple[Column, int]], ref: str, seed: int = 42) -> DataFrame:
    """For each reason (a condition and a cap), the capped first refs by seeded digest; a row
    for each chosen ref with its sorted reasons."""
    chosen = None
    for name, (condition, cap) in sorted(reasons.items()):
        own = df.where(condition).select(ref, F.lit(name).alias("reason")).distinct().orderBy(seeded_key(f"{seed}:{name}", ref), ref).limit(cap)
        chosen = own if chosen is None else chosen.unionByName(own)
    return chosen.groupBy(ref).agg(F.sort_array(F.collect_set("reason")).alias("reasons"))


def capped(groups: DataFrame, key: str, most: int = 100) -> DataFrame:
    """The first groups by key, for a report."""
    return groups.orderBy(key).limit(most)


def unique_documents(df: DataFrame, *keys: str) -> DataFrame:
    """One row: documents, and the number of different values of each key."""
    return df.agg(F.count("*").alias("documents"), *[F.countDistinct(k).alias(k) for k in keys])


#: Nodes under one node of a digest tree; its levels hold CHILDREN ** LEVELS ids.
CHILDREN, LEVELS = 4096, 3


def digest_tree(df: DataFrame, order: str, value: str) -> DataFrame:
    """One digest that depends on all values and their order by an integer id: runs of CHILDREN
    ids are folded in parallel, then runs of those, so no task folds more than a run. Rows that
    agree in id and value are counted; a null value is empty; a null id comes first."""
    rows = df.select(F.coalesce(F.col(order).cast("long"), F.lit(-1)).alias("node"), F.sha2(F.coalesce(value, F.lit("")), 256).alias("digest"))
    counted = rows.groupBy("node", "digest").agg(F.count("*").alias("n"))
    rows = counted.select("node", F.concat_ws(":", "digest", F.col("n").cast("string")).alias("digest"))
    folded = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "digest"))), lambda x: x["digest"]), ","), 256).alias("digest")
    for _ in range(LEVELS - 1):
        rows = rows.groupBy(F.floor(F.col("node") / CHILDREN).alias("above")).agg(folded).withColumnRenamed("above", "node")
    return rows.agg(folded)
