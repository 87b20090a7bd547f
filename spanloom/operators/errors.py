"""Why predictions fail: causes, groups, and a reproducible sample for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap
from . import spans

_ERROR = "array<struct<kind:string,label:string,cause:string,start:int,stop:int>>"


def _touches(a: Column, b: Column) -> Column:
    return overlap(a["start"], a["stop"], b["start"], b["stop"])


def _same(a: Column, b: Column) -> Column:
    return (a["start"] == b["start"]) & (a["stop"] == b["stop"])


def error_rows(texts: DataFrame, valid: DataFrame | None, aligned: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample_id, kind, label, cause, start, stop) of every error.

    texts (sample_id, text), valid (sample_id, schema_valid; None if texts has that column),
    aligned as ``spans.align`` gives it, gold (sample_id, type, start, stop, text). Missed spans look at predictions that hit nothing
    for a wrong label or boundary, and at all placed ones for a repeated value; false ones look at
    all gold spans. The spans of one sample meet in one row, in which all causes are found, so
    each input is read once."""
    rows = spans.by_sample(aligned, gold, texts=texts, valid=valid)
    missed, wrong = spans.missed_of(F.col("real"), F.col("said")), F.filter("said", lambda p: ~spans.is_hit(p, F.col("real")))
    rows = rows.select("sample_id", "text", "schema_valid", "real", "said", F.explode(F.array(F.struct(missed.alias("missed"), wrong.alias("wrong")))).alias("o")).select("*", "o.*")
    placed_wrong = F.filter("wrong", lambda p: p["start"].isNotNull())

    def of_missed(g: Column) -> Column:
        cause = (
            F.when(~F.col("schema_valid"), "invalid_schema")
            .when(F.exists(placed_wrong, lambda p: _same(p, g) & (p["type"] != g["type"])), "wrong_label")
            .when(F.exists(placed_wrong, lambda p: _touches(p, g) & (p["type"] == g["type"])), "boundary_mismatch")
            .when(F.exists("said", lambda p: p["start"].isNotNull() & (p["type"] == g["type"]) & (p["value"] == g["value"])), "repeated_occurrence_omission")
            .otherwise("missed_entity")
        )
        return _error("FN", g["type"], cause, g["start"], g["stop"])

    def of_wrong(p: Column) -> Column:
        cause = (
            F.when(p["start"].isNull(), F.when(F.contains("text", p["value"]), "overpredicted_occurrence").otherwise("hallucinated_text"))
            .when(F.exists("real", lambda g: _same(p, g) & (p["type"] != g["type"])), "wrong_label")
            .when(F.exists("real", lambda g: _touches(p, g) & (p["type"] == g["type"])), "boundary_mismatch")
            .otherwise("spurious_entity")
        )
        return _error("FP", p["type"], cause, p["start"], p["stop"])

    none = F.lit(None)
    schema = F.when(F.col("schema_valid"), F.array().cast(_ERROR)).otherwise(F.array(_error("SCHEMA", none, F.lit("invalid_schema"), none, none)))
    # a span of a sample without a validity row is no error of this run
    missed_errors = F.when(F.col("schema_valid").isNull(), F.array().cast(_ERROR)).otherwise(F.transform("missed", of_missed))
    false_errors = F.when(F.col("text").isNull(), F.array().cast(_ERROR)).otherwise(F.transform("wrong", of_wrong))
    found = F.concat(missed_errors, false_errors, F.when(F.col("schema_valid").isNull(), F.array().cast(_ERROR)).otherwise(schema))
    return rows.select("sample_id", F.explode(found).alias("e")).select("sample_id", "e.*")


def _error(kind: str, label: Column, cause: Column, start: Column, stop: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), label.cast("string").alias("label"), cause.alias("cause"), start.cast("int").alias("start"), stop.cast("int").alias("stop"))


def with_group(errors: DataFrame) -> DataFrame:
    return errors.withColumn("error_group", F.concat_ws("/", "kind", F.coalesce("label", F.lit("UNASSIGNED")), "cause"))


def error_groups(errors: DataFrame) -> DataFrame:
    """error_group, errors, documents."""
    return with_group(errors).groupBy("error_group").agg(F.count("*").alias("errors"), F.countDistinct("sample_id").alias("documents"))


def review_sample(members: DataFrame, seed: int = 42, per_group: int = 20, most: int = 500) -> DataFrame:
    """(error_group, sample_id) -> sample_id, reasons: in each group the first ``per_group`` ids
    by a seeded digest; then round robin over the sorted groups until ``most`` ids are chosen.
    A chosen id still gains reasons afterwards. Only the ranked heads, at most ``per_group`` rows
    of each group, meet in one task, and groups are kinds, labels and causes: a fixed set."""
    escaped = lambda c: F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    key = F.sha2(F.concat(F.lit(f'[{seed}, "'), escaped("error_group"), F.lit('", "'), escaped("sample_id"), F.lit('"]')), 256)
    heads = members.select("error_group", "sample_id").distinct().withColumn("rank", F.row_number().over(Window.partitionBy("error_group").orderBy(key, "sample_id"))).where(F.col("rank") <= per_group)
    turn = F.row_number().over(Window.orderBy("rank", "error_group"))
    first = heads.withColumn("turn", turn).withColumn("first", F.min("turn").over(Window.partitionBy("sample_id")))
    place = F.dense_rank().over(Window.orderBy("first"))
    return first.withColumn("place", place).where(F.col("place") <= most).groupBy("sample_id").agg(F.sort_array(F.collect_set("error_group")).alias("reasons"))
