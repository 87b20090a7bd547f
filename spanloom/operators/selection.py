"""Reproducible selection of dataset stages, set operations on ids, and dataset checks.

The order of every selection is a seeded digest of the id, so results depend neither on
partitions nor on a random generator's state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..labels import ENTITY_TYPES
from .profile import seeded_key

NEGATIVE_SHARE = 0.25


def stable_order(df: DataFrame, key: str, id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    """Adds order_key; sorting by (order_key, id) is the seeded shuffle of that name."""
    return df.withColumn("order_key", seeded_key(f"{seed}:{key}", id_col))


def first_by_key(df: DataFrame, n: int, key: str, id_col: str = "sample_id", seed: int = 42) -> DataFrame:
    """The first n rows of a seeded shuffle: top n per task, then one merge of those."""
    return stable_order(df, key, id_col, seed).orderBy("order_key", id_col).limit(n).drop("order_key")


def cover_labels(df: DataFrame, minimum: int, key: str, id_col: str = "sample_id", labels_col: str = "labels") -> DataFrame:
    """Ids such that each label occurs in ``minimum`` of them, or in all that have it: the first
    ``minimum`` of each label by seeded digest. (A sequential scan would choose other ids with
    the same guarantee; this one ranks labels in parallel.)"""
    rows = stable_order(df, f"coverage:{key}", id_col).select(id_col, "order_key", F.explode(F.array_distinct(labels_col)).alias("label"))
    place = F.row_number().over(Window.partitionBy("label").orderBy("order_key", id_col))
    return rows.withColumn("place", place).where(F.col("place") <= minimum).select(id_col).distinct()


def select_stage(df: DataFrame, total: int, minimum: int, key: str, id_col: str = "sample_id", labels_col: str = "labels") -> DataFrame:
    """id, kind, place: round(total / 4) negatives, the covering positives, and positives to
    fill up; place is the order of the seeded final shuffle. Short pools give short stages,
    which ``stage_faults`` reports."""
    negatives = int(round(total * NEGATIVE_SHARE))
    negative = F.size(F.coalesce(labels_col, F.array().cast("array<string>"))) == 0
    none = first_by_key(df.where(negative).select(id_col), negatives, f"{key}:negative", id_col).withColumn("kind", F.lit("negative"))
    covered = cover_labels(df.where(~negative), minimum, key, id_col, labels_col).withColumn("covers", F.lit(0))
    ranked = stable_order(df.where(~negative).select(id_col), f"{key}:positive-fill", id_col).join(covered, id_col, "left")
    some = ranked.orderBy(F.coalesce("covers", F.lit(1)), "order_key", id_col).limit(total - negatives).select(id_col, F.lit("positive").alias("kind"))
    chosen = stable_order(none.unionByName(some), f"{key}:final-order", id_col)
    # a stage is a fixed number of rows, so one task numbers them
    return chosen.withColumn("place", F.row_number().over(Window.orderBy("order_key", id_col))).drop("order_key")


def stage_faults(stage: DataFrame, samples: DataFrame, total: int, id_col: str = "sample_id", labels_col: str = "labels") -> DataFrame:
    """(fault, found, wanted): too few records, negatives outside [0.20, 0.30], missing labels."""
    rows = stage.select(id_col).join(samples, id_col)
    counts = rows.agg(F.count("*").alias("n"), F.count_if(F.size(labels_col) == 0).alias("neg"))
    labels = rows.select(F.explode(labels_col).alias("label")).where(F.col("label").isin(*ENTITY_TYPES)).agg(F.countDistinct("label").alias("n_labels"))
    share = F.try_divide(F.col("neg").cast("double"), F.col("n"))
    checks = [
        (F.col("n") != total, "records", F.col("n").cast("double"), float(total)),
        (~F.coalesce(share.between(0.20, 0.30), F.lit(False)), "negative_share", share, NEGATIVE_SHARE),
    ]
    first = counts.select(F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(n).alias("fault"), v.alias("found"), F.lit(w).alias("wanted"))) for c, n, v, w in checks]))).alias("f")).select("f.*")
    second = labels.where(F.col("n_labels") != len(ENTITY_TYPES)).select(F.lit("labels").alias("fault"), F.col("n_labels").cast("double").alias("found"), F.lit(float(len(ENTITY_TYPES))).alias("wanted"))
    return first.unionByName(second)


def partition(df: DataFrame, prior: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in prior, the others): disjoint and exhaustive."""
    return df.join(prior.select(key).distinct(), key, "left_semi"), df.join(prior.select(key).distinct(), key, "left_anti")


def prior_faults(df: DataFrame, prior: DataFrame, key: str, content: Column) -> DataFrame:
    """(key, fault) of prior rows that df doesn't have, or has with another content."""
    now = df.select(key, F.sha2(content, 256).alias("now"))
    was = prior.select(key, F.sha2(content, 256).alias("was"))
    joined = was.join(now, key, "left")
    fault = F.when(F.col("now").isNull(), "unknown").when(F.col("now") != F.col("was"), "changed")
    return joined.select(key, fault.alias("fault")).where("fault is not null")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys in one table only."""
    only = lambda x, y, side: x.select(key).distinct().join(y.select(key).distinct(), key, "left_anti").withColumn("side", F.lit(side))
    return only(a, b, "missing").unionByName(only(b, a, "extra"))


def label_union(known: DataFrame, seen: DataFrame, label: str = "label") -> DataFrame:
    """All labels of either table: in which they are, and how often they are seen."""
    n = seen.groupBy(label).agg(F.count("*").alias("seen"))
    k = known.select(label).distinct().withColumn("known", F.lit(True))
    return k.join(n, label, "full_outer").select(label, F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))


def ownership(df: DataFrame, key: str, split: str, within: bool = True) -> DataFrame:
    """(key, errors): uses of a key beyond the first; with ``within`` off only keys that several
    splits hold, counted by split."""
    rows = df if within else df.select(key, split).distinct()
    return rows.groupBy(key).agg((F.count("*") - 1).alias("errors")).where("errors > 0")


def dataset_statistics(df: DataFrame, *by: str, labels_col: str = "labels") -> DataFrame:
    """Per group: records, negatives, their ratio (6 places), synthetic records, label occurrences."""
    negative = F.size(labels_col) == 0
    return df.groupBy(*by).agg(
        F.count("*").alias("records"), F.count_if(negative).alias("negatives"), ratio(F.count_if(negative), F.count("*"), 6).alias("negative_ratio"),
        F.count_if("synthetic").alias("synthetic"), F.sum(F.size(labels_col)).cast("long").alias("label_occurrences"),
    )


def resume(todo: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """What is left to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def in_order_of(selected: DataFrame, rows: DataFrame, key: str = "sample_id") -> DataFrame:
    """The rows of a subset (key, row_index) with its order. A selected key without a row fails
    the query, when it runs; the message counts nothing and names no key."""
    there = rows.withColumn("is_there", F.lit(True))
    joined = selected.join(there, key, "left")
    missing = F.raise_error(F.lit("selected keys have no row")).cast("boolean")
    return joined.where(F.coalesce("is_there", missing)).drop("is_there").orderBy("row_index")


def uncovered(selected: DataFrame, rows: DataFrame, key: str = "sample_id") -> int:
    """How many selected keys have no row."""
    return selected.select(key).distinct().join(rows.select(key), key, "left_anti").count()


def main_split(source: DataFrame, made: DataFrame, total: int, minimum: int, key: str, id_col: str = "sample_id", labels_col: str = "labels") -> DataFrame:
    """A stage of source and generated samples: source negatives up to their share, generated
    ones for what is missing; generated positives are 3 for each label or a tenth of the total,
    whichever is more, and source positives the rest. Then ``select_stage`` over these pools."""
    negatives = int(round(total * NEGATIVE_SHARE))
    own = min(max(3 * len(ENTITY_TYPES), total // 10), total - negatives)
    none = F.size(F.coalesce(labels_col, F.array().cast("array<string>"))) == 0
    columns = [id_col, labels_col]
    kept = first_by_key(source.where(none).select(*columns), negatives, f"{key}:source-negative", id_col)
    # generated negatives rank behind all source ones, so they only fill up
    fill = kept.withColumn("tier", F.lit(0)).unionByName(made.where(none).select(*columns).withColumn("tier", F.lit(1)))
    fill = stable_order(fill, f"{key}:negative", id_col).orderBy("tier", "order_key", id_col).limit(negatives).select(*columns)
    some = first_by_key(source.where(~none).select(*columns), total - negatives - own, f"{key}:source-positive", id_col)
    new = first_by_key(made.where(~none).select(*columns), own, f"{key}:made-positive", id_col)
    return select_stage(fill.unionByName(some).unionByName(new), total, minimum, key, id_col, labels_col)


def sampled_refs(df: DataFrame, n: int, seed: int, ref: str) -> DataFrame:
    """n different refs by seeded digest, in place of a random generator's sample."""
    return first_by_key(df.select(ref).distinct(), n, "refs", ref, seed)
