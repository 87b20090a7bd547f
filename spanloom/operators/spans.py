"""Exact spans: from annotations, from declared values, their order and overlaps, and the
alignment of predictions to occurrences. Offsets are code points, half open, from 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import classification
from ..functions.text import occurrence_starts, occurrences, overlap

#: In this field order a sorted array of spans is in source order.
SPAN = "struct<start:int,stop:int,type:string,text:string>"
_SPANS = f"array<{SPAN}>"
_ENTITIES = "array<struct<entity:string,types:array<string>>>"


def _span(start: Column, type_: Column, text: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("stop"), type_.alias("type"), text.alias("text"))


def overlapping(spans: Column) -> Column:
    """Two neighbours of a sorted span array share a position."""
    n = F.size(spans)
    return F.exists(
        F.zip_with(F.slice(spans, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(spans, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: a["stop"] > b["start"]),
        lambda x: x,
    )


def convert_annotations(records: DataFrame) -> DataFrame:
    """(uid, text, entities array<struct<entity, types>>) -> uid, spans, error.

    Annotations with one canonical type are grouped by their exact text; a record is rejected
    (error, null spans) for an unknown label, an ambiguous annotation, one text under two types,
    a count of annotations other than that of occurrences, or overlapping spans. A record without
    annotations has no spans. A record is converted in its own row, without a shuffle: its
    annotations, sorted by text and type, are cut where the text changes. Each step is a column of
    an exploded row, so that it is computed once."""

    def step(rows: DataFrame, name: str, value: Column) -> DataFrame:
        return rows.select(*rows.columns, F.explode(F.array(value)).alias(name))

    def classes(e: Column) -> Column:
        found = classification(e["types"])  # of its fields only those that are read are computed
        return F.struct(e["entity"].alias("value"), found["canonical"].alias("canonical"), found["unknown"].alias("unknown"))

    items = F.transform(
        F.transform(F.coalesce("entities", F.array().cast(_ENTITIES)), classes),
        lambda x: F.struct(
            x["value"].alias("value"),
            F.when(F.size(x["canonical"]) == 1, F.get(x["canonical"], F.lit(0))).alias("type"),
            F.when(F.size(x["unknown"]) > 0, "unknown label").when(F.size(x["canonical"]) > 1, "ambiguous types").alias("fault"),
        ),
    )
    rows = step(records.select("uid", "text", "entities"), "items", F.sort_array(items)).drop("entities")
    at = lambda i: F.get("items", i)
    size = F.size("items")
    places = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
    rows = step(rows, "firsts", F.filter(places, lambda i: (i == 0) | ~at(i)["value"].eqNullSafe(at(i - 1)["value"])))
    nexts = F.concat(F.slice("firsts", F.lit(2), F.size("firsts")), F.filter(F.array(size), lambda n: n > 0))
    own = lambda i, n: F.slice("items", i + 1, n - i)
    rows = step(rows, "cut", F.zip_with("firsts", nexts, lambda i, n: F.struct(i.alias("first"), n.alias("next"), F.size(F.filter(own(i, n), lambda x: x["type"].isNotNull())).alias("annotated"))))
    groups = F.transform(
        "cut",
        lambda g: F.struct(
            at(g["first"])["value"].alias("value"), g["annotated"].alias("annotated"), F.array_min(F.transform(own(g["first"], g["next"]), lambda x: x["fault"])).alias("fault"),
            # items without a type come first
            F.when(g["annotated"] > 0, at(g["next"] - g["annotated"])["type"]).alias("type"), F.when(g["annotated"] > 0, at(g["next"] - 1)["type"]).alias("other"),
            F.when(g["annotated"] > 0, occurrence_starts(F.col("text"), at(g["first"])["value"])).alias("starts"),
        ),
    )
    rows = step(rows, "groups", groups)
    faults = F.transform(
        "groups",
        lambda g: F.when(g["fault"].isNotNull(), g["fault"])
        .when(g["type"] != g["other"], "one text, two types")
        .when((g["annotated"] > 0) & (F.size(g["starts"]) != g["annotated"]), "annotations and occurrences differ"),
    )
    found = F.flatten(F.transform("groups", lambda g: F.coalesce(F.transform(g["starts"], lambda s: _span(s, g["type"], g["value"])), F.array().cast(_SPANS))))
    rows = step(step(rows, "fault", F.array_min(faults)), "found", F.sort_array(found))
    rows = step(rows, "error", F.coalesce("fault", F.when(overlapping(F.col("found")), "overlapping spans")))
    return rows.select("uid", F.when(F.col("error").isNull(), F.col("found")).alias("spans"), "error")


def anchor_values(samples: DataFrame) -> DataFrame:
    """(sample_id, text, items array<struct<type, text>>) -> sample_id, spans, error: every
    occurrence of every declared value, without repeats; each value must occur."""
    found = F.flatten(F.transform("items", lambda v: F.transform(occurrence_starts(F.col("text"), v["text"]), lambda s: _span(s, v["type"], v["text"]))))
    missing = F.exists("items", lambda v: occurrences(F.col("text"), v["text"]) == 0)
    placed = samples.select("sample_id", F.explode(F.array(F.sort_array(F.array_distinct(found)))).alias("spans"), missing.alias("missing"))
    error = F.when(F.col("missing"), "value does not occur").when(overlapping(F.col("spans")), "overlapping spans")
    return placed.select("sample_id", F.when(error.isNull(), F.col("spans")).alias("spans"), error.alias("error"))


def overlap_violations(spans: DataFrame) -> DataFrame:
    """(sample_id, start, stop, type, text) rows that begin before the span before them ends."""
    order = Window.partitionBy("sample_id").orderBy("start", "stop", "type", "text")
    return spans.withColumn("before", F.lag("stop").over(order)).where("before > start").drop("before")


def occurrence_classes(entities: DataFrame) -> DataFrame:
    """(rec, k, text, value) -> + n, class (zero, unique, multiple) and the first start."""
    n = occurrences(F.col("text"), F.col("value"))
    rows = entities.withColumn("n", n)
    kind = F.when(F.col("n") == 0, "zero").when(F.col("n") == 1, "unique").otherwise("multiple")
    return rows.withColumn("class", kind).withColumn("first", F.expr("CASE WHEN n > 0 THEN locate(value, text) - 1 END"))


def order_violations(entities: DataFrame) -> DataFrame:
    """Records whose values with one occurrence are annotated out of text order."""
    unique = occurrence_classes(entities).where("class = 'unique'")
    before = F.lag("first").over(Window.partitionBy("rec").orderBy("k"))
    return unique.withColumn("before", before).where("before > first").select("rec").distinct()


_SAID = "array<struct<k:int,type:string,value:string,start:int,stop:int>>"
_REAL = "array<struct<start:int,stop:int,type:string,value:string>>"


def align(texts: DataFrame, predictions: DataFrame) -> DataFrame:
    """texts (sample_id, text), predictions (sample_id, k, type, value) -> + start, stop.

    The j-th prediction of a value takes its j-th occurrence, else null: two predictions
    compete for a place only if their values are equal, so this is the greedy assignment.
    A sample's predictions meet its text in one row, once."""
    said = predictions.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("k", "type", "value"))).alias("items"))
    rows = said.join(texts.select("sample_id", "text"), "sample_id", "left")

    def placed(x: Column, i: Column) -> Column:
        turn = F.size(F.filter(F.slice("items", F.lit(1), i), lambda y: y["value"] == x["value"]))
        start = F.get(occurrence_starts(F.col("text"), x["value"]), turn)
        return F.struct(x["k"].alias("k"), x["type"].alias("type"), x["value"].alias("value"), start.alias("start"), (start + F.length(x["value"])).alias("stop"))

    return rows.select("sample_id", F.explode(F.transform("items", placed)).alias("a")).select("sample_id", "a.*")


def is_hit(p: Column, real: Column) -> Column:
    """A placed prediction is one of the gold spans."""
    return F.coalesce(F.exists(real, lambda g: (g["type"] == p["type"]) & (g["start"] == p["start"]) & (g["stop"] == p["stop"])), F.lit(False))


def missed_of(real: Column, said: Column) -> Column:
    """The gold spans that no prediction hits."""
    return F.filter(real, lambda g: ~F.exists(said, lambda p: p["start"].isNotNull() & (g["type"] == p["type"]) & (g["start"] == p["start"]) & (g["stop"] == p["stop"])))


def by_sample(aligned: DataFrame, gold: DataFrame, texts: DataFrame | None = None, valid: DataFrame | None = None) -> DataFrame:
    """(sample_id, said, real): the aligned predictions in order and the distinct gold spans of
    each sample that has any (with its text and schema_valid, if those frames are given, of all
    their samples). One union and one exchange by sample; a sample's spans are one row."""
    parts = []
    kinds = {"text": "string", "schema_valid": "boolean", "p": _SAID[6:-1], "g": _REAL[6:-1]}
    # the value of a gold span, where the frame holds it; of equal spans one is kept
    value = F.col("text") if "text" in gold.columns else F.lit(None).cast("string")
    for frame, name, column in (
        (aligned, "p", F.struct(*[F.col(c) for c in ("k", "type", "value", "start", "stop")])),
        (gold, "g", F.struct("start", "stop", "type", value.alias("value"))),
        (texts, "text", F.coalesce("text", F.lit(""))),
        (valid, "schema_valid", F.col("schema_valid")),
    ):
        if frame is not None:
            own = {c: F.lit(None) for c in kinds} | {name: column}
            if frame is texts and "schema_valid" in texts.columns:
                own["schema_valid"] = F.col("schema_valid")
            parts.append(frame.select("sample_id", *[c.cast(kinds[n]).alias(n) for n, c in own.items()]))
    every = reduce(DataFrame.unionByName, parts)
    rows = every.groupBy("sample_id").agg(F.sort_array(F.collect_list("p")).alias("said"), F.sort_array(F.collect_set("g")).alias("real"), F.first("text", ignorenulls=True).alias("text"), F.first("schema_valid", ignorenulls=True).alias("schema_valid"))
    first = lambda g, i: (i == 0) | ~F.exists(F.slice("real", F.lit(1), i), lambda h: (h["start"] == g["start"]) & (h["stop"] == g["stop"]) & (h["type"] == g["type"]))
    return rows.withColumn("real", F.filter("real", first))


def scored_spans(aligned: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample_id, type, hit): true for each prediction that is gold, false for each other one,
    null for each gold span that is missed."""
    rows = by_sample(aligned, gold)
    outcome = lambda x, hit: F.struct(x["type"].alias("type"), hit.cast("boolean").alias("hit"))
    said = F.transform("said", lambda p: outcome(p, is_hit(p, F.col("real"))))
    lost = F.transform(missed_of(F.col("real"), F.col("said")), lambda g: outcome(g, F.lit(None)))
    return rows.select("sample_id", F.explode(F.concat(said, lost)).alias("o")).select("sample_id", "o.*")


def exact_matches(aligned: DataFrame, gold: DataFrame) -> DataFrame:
    """aligned + hit: (type, start, stop) is gold. gold (sample_id, type, start, stop)."""
    keys = gold.select("sample_id", "type", "start", "stop").distinct().withColumn("is_gold", F.lit(True))
    return aligned.join(keys, ["sample_id", "type", "start", "stop"], "left").withColumn("hit", F.coalesce("is_gold", F.lit(False))).drop("is_gold")


def missed_gold(aligned: DataFrame, gold: DataFrame) -> DataFrame:
    keys = ["sample_id", "type", "start", "stop"]
    return gold.select(*keys).distinct().join(aligned.where("start is not null").select(*keys), keys, "left_anti")


def relaxed_counts(aligned: DataFrame, gold: DataFrame) -> DataFrame:
    """(sample_id, type, tp, fp, fn): each prediction in order takes the first free gold span of
    its type that it overlaps. The fold runs over the arrays of one sample and type."""
    p = aligned.groupBy("sample_id", "type").agg(F.sort_array(F.collect_list(F.struct("k", "start", "stop"))).alias("p"))
    g = gold.select("sample_id", "type", "start", "stop").distinct().groupBy("sample_id", "type").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("g"))
    both = p.join(g, ["sample_id", "type"], "full_outer")
    none = F.array().cast("array<int>")

    def take(used: Column, x: Column) -> Column:
        free = F.filter(
            F.sequence(F.lit(0), F.size("g") - 1),
            lambda i: (~F.array_contains(used, i)) & overlap(x["start"], x["stop"], F.get("g", i)["start"], F.get("g", i)["stop"]),
        )
        return F.when(x["start"].isNotNull() & (F.size(free) > 0), F.concat(used, F.slice(free, 1, 1))).otherwise(used)

    used = F.when(F.col("p").isNull() | F.col("g").isNull(), none).otherwise(F.aggregate("p", none, take))
    tp = F.size(used)
    size = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.size(c))
    return both.select("sample_id", "type", tp.cast("long").alias("tp"), (size("p") - tp).cast("long").alias("fp"), (size("g") - tp).cast("long").alias("fn"))


def source_ordered(aligned: DataFrame) -> DataFrame:
    """(sample_id, ordered): all predictions of a sample have a place, and starts don't fall."""
    before = F.lag("start").over(Window.partitionBy("sample_id").orderBy("k"))
    rows = aligned.withColumn("bad", F.col("start").isNull() | (F.coalesce(before, F.lit(0)) > F.col("start")))
    return rows.groupBy("sample_id").agg((~F.bool_or("bad")).alias("ordered"))


def overlap_pairs(gold: DataFrame, aligned: DataFrame) -> DataFrame:
    """Gold and predictions of one sample and type that share a position: an equi-join with the
    interval condition as residual, never a nested loop."""
    g, p = gold.alias("g"), aligned.where("start is not null").alias("p")
    near = (F.col("g.sample_id") == F.col("p.sample_id")) & (F.col("g.type") == F.col("p.type")) & overlap(F.col("g.start"), F.col("g.stop"), F.col("p.start"), F.col("p.stop"))
    return g.join(p, near).select("g.sample_id", "g.type", F.col("g.start").alias("gold_start"), F.col("g.stop").alias("gold_stop"), "p.k")


def relabelled(gold: DataFrame, aligned: DataFrame) -> DataFrame:
    """Gold spans that some prediction covers exactly under another type."""
    p = aligned.where("start is not null").select("sample_id", "start", "stop", F.col("type").alias("said"))
    same = gold.join(p, ["sample_id", "start", "stop"]).where("said != type")
    return same.select("sample_id", "type", "start", "stop").distinct()
