"""Plans that join operators end to end: score a run, compare two, profile, build stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import response_column
from ..functions.text import digest, normalized, word_count
from ..operators import errors, profile, scoring, selection, spans


@dataclass(frozen=True)
class Evaluation:
    """Frames of one run; nothing is computed until one of them is used."""

    parsed: DataFrame
    aligned: DataFrame
    per_class: DataFrame
    averages: DataFrame
    documents: DataFrame
    validity: DataFrame
    errors: DataFrame


def evaluate(samples: DataFrame, gold: DataFrame, predictions: DataFrame, folder: str | None = None) -> Evaluation:
    """samples (sample_id, text), gold (sample_id, type, start, stop, text), predictions
    (sample_id, raw_output). A sample without a prediction counts as invalid; ``coverage``
    reports such ids. With a folder, responses and their alignment are written there once, and
    every frame reads them from it; without one, each frame parses and aligns when it is used."""
    spark = samples.sparkSession

    def once(df: DataFrame, name: str) -> DataFrame:
        if folder is None:
            return df
        df.write.mode("errorifexists").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    said = samples.select("sample_id").join(predictions.select("sample_id", "raw_output"), "sample_id", "left")
    parsed = once(said.select("sample_id", "raw_output", response_column(F.col("raw_output")).alias("p")).select("sample_id", "raw_output", "p.*"), "parsed")
    items = parsed.select("sample_id", F.posexplode("entities").alias("k", "e")).select("sample_id", "k", "e.type", F.col("e.text").alias("value"))
    texts = samples.select("sample_id", "text")
    aligned = once(spans.align(texts, items), "aligned")
    counts = scoring.class_counts(aligned, gold)
    lost = aligned.where("start is null").join(texts, "sample_id").groupBy("sample_id").agg(F.count_if(~F.contains("text", "value")).alias("hallucinated"))
    flags = parsed.drop("raw_output").join(spans.source_ordered(aligned), "sample_id", "left").join(lost, "sample_id", "left").withColumn("ordered", F.col("schema_valid") & F.coalesce("ordered", F.lit(True)))
    return Evaluation(
        parsed=parsed,
        aligned=aligned,
        per_class=scoring.per_class(counts),
        averages=scoring.averages(counts),
        documents=scoring.document_metrics(scoring.document_flags(samples, aligned, gold)),
        validity=scoring.validity_metrics(flags),
        errors=errors.error_rows(texts, parsed.select("sample_id", "schema_valid"), aligned, gold),
    )


def inspect(records: DataFrame) -> dict[str, DataFrame]:
    """Profile of source rows (uid, split, text): lengths, duplicates within and across splits."""
    rows = records.select("uid", "split", word_count(F.col("text")).alias("words"), digest(F.col("text")).alias("exact"), digest(normalized(F.col("text"))).alias("normal"))
    return {
        "lengths": profile.length_summary(rows, "words", "split"),
        "thresholds": profile.threshold_counts(rows, "words", "split"),
        "exact_duplicates": profile.duplicate_groups(rows, "exact", "uid", "split"),
        "normal_duplicates": profile.duplicate_groups(rows, "normal", "uid", "split"),
        "shared_ids": selection.ownership(rows, "uid", "split"),
    }


def build_stages(pool: DataFrame, sizes: dict[str, tuple[int, int]]) -> dict[str, DataFrame]:
    """Nested stages, largest first: each is selected from the one before. sizes maps a name to
    (records, minimum of records with each label)."""
    out, source = {}, pool
    for name, (total, minimum) in sorted(sizes.items(), key=lambda x: -x[1][0]):
        out[name] = selection.select_stage(source, total, minimum, name)
        source = pool.join(out[name].select("sample_id"), "sample_id", "left_semi")
    return out
