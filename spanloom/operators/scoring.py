"""Scores of predictions: by occurrence, class and document; comparison and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..labels import type_dimension
from . import spans

TOLERANCE = 1e-8


def prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """precision, recall and F1 to 8 places; F1 from the unrounded two; 0 over nothing."""
    p = F.coalesce(F.try_divide(tp.cast("double"), (tp + fp).cast("double")), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp.cast("double"), (tp + fn).cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return {"precision": F.round(p, 8), "recall": F.round(r, 8), "f1": F.round(f1, 8)}


def class_counts(aligned: DataFrame, gold: DataFrame) -> DataFrame:
    """label, tp, fp, fn for all types, also those without support, by exact match."""
    found = spans.scored_spans(aligned, gold).groupBy(F.col("type").alias("label")).agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"), F.count_if(F.col("hit").isNull()).alias("fn"))
    rows = type_dimension(gold.sparkSession).join(found, "label", "left")
    return rows.select("ordinal", "label", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")])


def per_class(counts: DataFrame) -> DataFrame:
    return counts.select("label", "tp", "fp", "fn", *[c.alias(n) for n, c in prf(*map(F.col, ("tp", "fp", "fn"))).items()])


def averages(counts: DataFrame) -> DataFrame:
    """Two rows: micro over the summed counts, macro as the mean of the rounded class values."""
    total = counts.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    micro = total.select(F.lit("micro").alias("average"), *[c.alias(n) for n, c in prf(*map(F.col, ("tp", "fp", "fn"))).items()])
    macro = per_class(counts).agg(*[F.round(F.avg(n), 8).alias(n) for n in ("precision", "recall", "f1")])
    return micro.unionByName(macro.select(F.lit("macro").alias("average"), "precision", "recall", "f1"))


def document_flags(samples: DataFrame, aligned: DataFrame, gold: DataFrame) -> DataFrame:
    """For each sample (sample_id): n_gold, n_predicted, tp, complete and exact."""
    hits = F.size(F.filter("said", lambda p: spans.is_hit(p, F.col("real"))))
    found = spans.by_sample(aligned, gold).select("sample_id", F.size("real").cast("long").alias("n_gold"), F.size("said").cast("long").alias("n_predicted"), hits.cast("long").alias("tp"))
    rows = samples.select("sample_id").join(found, "sample_id", "left").na.fill(0, ["n_gold", "n_predicted", "tp"])
    complete = F.col("tp") == F.col("n_gold")
    return rows.withColumn("complete", complete).withColumn("exact", complete & (F.col("n_predicted") == F.col("tp")))


def document_metrics(flags: DataFrame) -> DataFrame:
    """One row: recall of complete positives, exact documents, false alarms among negatives."""
    positive, negative = F.col("n_gold") > 0, F.col("n_gold") == 0
    return flags.agg(
        ratio(F.count_if(positive & F.col("complete")), F.count_if(positive), 8).alias("complete_document_recall"),
        ratio(F.count_if("exact"), F.count("*"), 8).alias("exact_document_match"),
        ratio(F.count_if(negative & (F.col("n_predicted") > 0)), F.count_if(negative), 8).alias("negative_false_positive_rate"),
    )


def validity_metrics(parsed: DataFrame) -> DataFrame:
    """(json_valid, schema_valid, ordered, hallucinated) -> rates and the hallucinated total."""
    rate = lambda c: ratio(F.count_if(c), F.count("*"), 8).alias(f"{c}_rate")
    return parsed.agg(rate("json_valid"), rate("schema_valid"), rate("ordered"), F.coalesce(F.sum("hallucinated"), F.lit(0)).cast("long").alias("hallucinated"))


def coverage(dataset: DataFrame, predictions: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row of counts: shared, missing (no prediction) and extra keys, repeated predictions."""
    a = dataset.select(key).distinct().withColumn("in_data", F.lit(1))
    b = predictions.groupBy(key).agg(F.count("*").alias("n"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("in_data").isNotNull() & F.col("n").isNotNull()).alias("shared"),
        F.count_if(F.col("n").isNull()).alias("missing"),
        F.count_if(F.col("in_data").isNull()).alias("extra"),
        F.count_if(F.col("n") > 1).alias("repeated"),
    )


def run_deltas(old: DataFrame, new: DataFrame, key: str = "sample_id", columns: tuple[str, ...] = ("tp", "fp", "fn")) -> DataFrame:
    """Per sample: new minus old of each column."""
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return old.join(n, key).select(key, *[(F.col(f"new_{c}") - F.col(c)).alias(f"delta_{c}") for c in columns])


def gates(old: DataFrame, new: DataFrame, allowed: dict[str, float]) -> DataFrame:
    """(metric, value) twice -> metric, old, new, passed: new + allowed + 1e-8 >= old."""
    if any(not 0 <= a <= 1 for a in allowed.values()):
        raise ValueError("an allowance must be finite and in [0, 1]")
    rows = old.select("metric", F.col("value").alias("old")).join(new.select("metric", F.col("value").alias("new")), "metric").where(F.col("metric").isin(sorted(allowed)))
    gift = F.create_map(*[F.lit(x) for pair in sorted(allowed.items()) for x in pair])
    return rows.withColumn("passed", F.col("new") + gift[F.col("metric")] + TOLERANCE >= F.col("old"))


def output_changes(old: DataFrame, new: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, raw, entities) twice -> counts of changed raw outputs and changed entity lists."""
    n = new.select(key, F.col("raw").alias("new_raw"), F.col("entities").alias("new_entities"))
    return old.join(n, key).agg(
        F.count_if(~F.col("raw").eqNullSafe(F.col("new_raw"))).alias("raw_changed"),
        F.count_if(~F.col("entities").eqNullSafe(F.col("new_entities"))).alias("entities_changed"),
    )


def ranked_candidates(runs: DataFrame) -> DataFrame:
    """Runs by recall, complete documents, precision, schema validity, F1 (all falling) and
    false alarms (rising); ties by input number."""
    order = [F.desc(c) for c in ("recall", "complete_document_recall", "precision", "schema_valid", "f1")]
    # one row for each run: a table of a few rows, ranked in one task
    return runs.withColumn("place", F.row_number().over(Window.orderBy(*order, "negative_false_positive_rate", "input_index")))


def timing(rows: DataFrame) -> DataFrame:
    """(elapsed_s, prompt_ms, prompt_n, predicted_ms, predicted_n) -> anomalies and rates; a
    clock anomaly (stages longer than the request by over 1 s) voids both rates."""
    odd = (F.col("prompt_ms") + F.col("predicted_ms")) / 1000 > F.col("elapsed_s") + 1
    sums = rows.agg(
        F.count_if(odd).alias("anomalies"), F.sum("prompt_n").alias("prompt_tokens"), F.sum("prompt_ms").alias("prompt_ms"),
        F.sum(F.greatest(F.col("predicted_n") - 1, F.lit(0))).alias("decode_tokens"), F.sum("predicted_ms").alias("predicted_ms"),
    )
    rate = lambda n, ms: F.when(F.col("anomalies") == 0, F.round(F.try_divide(F.col(n) * 1000.0, F.col(ms)), 6))
    return sums.select("anomalies", rate("prompt_tokens", "prompt_ms").alias("prompt_rate"), rate("decode_tokens", "predicted_ms").alias("decode_rate"))
