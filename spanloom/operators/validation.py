"""Checks of prepared records, of saved generations, and of dataset views.

Prepared records come as strict lines; their shape is checked by one Arrow function, which
returns the faults and, for records that can be used further, typed columns."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ratio
from ..labels import ENTITY_TYPES
from .selection import set_difference

POLICY_VERSION, PROMPT_VERSION = "pii-taxonomy-v1", "pii-extraction-v1"
REQUIRED_METADATA = frozenset(["source", "source_split", "is_negative", "policy_version", "prompt_version", "entity_spans"])
CHECKED = "struct<faults:array<string>,usable:boolean,sample_id:string,text:string,is_negative:boolean,labels:array<string>,family:string,kind:string>"
_TYPES = frozenset(ENTITY_TYPES)
_SPAN_KEYS = frozenset(["start", "end", "type", "text"])


def _messages(found) -> list[str] | None:
    """The three texts of a system, user, assistant exchange."""
    if not isinstance(found, list) or len(found) != 3:
        return None
    texts = []
    for item, role in zip(found, ("system", "user", "assistant"), strict=True):
        if not isinstance(item, dict) or item.keys() != {"role", "content"} or item["role"] != role or not isinstance(item["content"], str):
            return None
        texts.append(item["content"])
    return texts


def _span_faults(text: str, spans: list) -> tuple[list[str], list[dict]]:
    faults, said, last = [], [], -1
    for k, s in enumerate(spans):
        if not isinstance(s, dict) or s.keys() != _SPAN_KEYS:
            faults.append(f"span {k}: shape")
            continue
        label, value, start, end = s["type"], s["text"], s["start"], s["end"]
        if not isinstance(label, str) or label not in _TYPES:
            faults.append(f"span {k}: label")
        whole = isinstance(value, str) and value and type(start) is int and type(end) is int and 0 <= start < end <= len(text)
        if not whole or text[start:end] != value:
            faults.append(f"span {k}: not the text there")
        if type(start) is int and type(end) is int:
            if start < last:
                faults.append(f"span {k}: overlap or order")
            last = end
        said.append(dict(text=value, type=label))
    return faults, said


def check_record(value: str | None, split: str, system_prompt: str | None = None) -> dict:
    """Faults of one record; some end the check of the record (it is not usable), others don't."""
    out = {"faults": [], "usable": False, "sample_id": None, "text": None, "is_negative": None, "labels": None, "family": None, "kind": None}

    def stop(fault: str) -> dict:
        out["faults"].append(fault)
        return out

    try:
        record = json.loads(value or "")
    except (ValueError, RecursionError):
        return stop("not JSON")
    if not isinstance(record, dict) or record.keys() != {"sample_id", "messages", "metadata"}:
        return stop("top-level keys")
    if not isinstance(record["sample_id"], str) or not record["sample_id"]:
        return stop("sample_id")
    out["sample_id"] = record["sample_id"]
    texts = _messages(record["messages"])
    if texts is None:
        return stop("messages")
    if system_prompt is not None and texts[0] != system_prompt:
        out["faults"].append("system prompt")
    out["text"] = texts[1]
    try:
        said = json.loads(texts[2])
    except (ValueError, RecursionError):
        return stop("response: not JSON")
    if not isinstance(said, dict) or said.keys() != {"entities"}:
        return stop("response: keys")
    if not isinstance(said["entities"], list):
        return stop("response: entities")
    meta = record["metadata"]
    if not isinstance(meta, dict) or not meta.keys() >= REQUIRED_METADATA:
        return stop("metadata")
    for key, wanted in (("source_split", split), ("policy_version", POLICY_VERSION), ("prompt_version", PROMPT_VERSION)):
        if meta[key] != wanted:
            out["faults"].append(key)
    spans, wanted = meta["entity_spans"], len(said["entities"])
    if not (isinstance(spans, list) and len(spans) == wanted):
        return stop("response and spans differ")
    faults, again = _span_faults(texts[1], spans)
    out["faults"] += faults
    if again != said["entities"]:
        out["faults"].append("response and span order differ")
    if meta["is_negative"] is not (not spans):
        out["faults"].append("is_negative")
    text = lambda k: meta.get(k) if isinstance(meta.get(k), str) else None
    return out | {"usable": True, "is_negative": not spans, "labels": [s["type"] for s in spans if isinstance(s, dict) and isinstance(s.get("type"), str)], "family": text("template_family"), "kind": text("synthetic_kind")}


def check_column(value: Column, split: str, system_prompt: str | None = None) -> Column:
    kind = pa.struct([
        ("faults", pa.list_(pa.string())), ("usable", pa.bool_()), ("sample_id", pa.string()), ("text", pa.string()),
        ("is_negative", pa.bool_()), ("labels", pa.list_(pa.string())), ("family", pa.string()), ("kind", pa.string()),
    ])

    @F.arrow_udf(CHECKED)
    def checked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([check_record(x, split, system_prompt) for x in batch.to_pylist()], kind)

    return checked(value)


def check_records(lines: DataFrame, split: str, system_prompt: str | None = None) -> DataFrame:
    """lines (value, and any key columns) -> the keys and CHECKED's columns; a key column that
    has the name of one of those is left out. Ids that several records use are a fault of each."""
    own = {f.split(":")[0] for f in CHECKED[len("struct<") : -1].split(",")}
    keys = [c for c in lines.columns if c != "value" and c.lower() not in own]
    rows = lines.select(*keys, check_column(F.col("value"), split, system_prompt).alias("c")).select(*keys, "c.*")
    uses = rows.where("sample_id is not null").groupBy(F.col("sample_id").alias("used")).agg((F.count("*") > 1).alias("again")).where("again")
    marked = rows.join(uses, rows["sample_id"] == uses["used"], "left").drop("used")
    return marked.withColumn("faults", F.when(F.col("again"), F.concat("faults", F.array(F.lit("repeated sample_id")))).otherwise(F.col("faults"))).drop("again")


def prepared_lines(samples: DataFrame, system_prompt: str) -> DataFrame:
    """(sample_id, text, source, split, spans array<struct<start,stop,type,text>>, and the optional
    family and kind) -> sample_id, value: a prepared record as one canonical line. Structs are
    laid out by name, so keys come sorted; absent optional fields are left out."""
    spans = F.transform("spans", lambda s: F.struct(s["stop"].alias("end"), s["start"].alias("start"), s["text"].alias("text"), s["type"].alias("type")))
    said = F.to_json(F.struct(F.transform("spans", lambda s: F.struct(s["type"].alias("type"), s["text"].alias("text"))).alias("entities")))
    message = lambda role, content: F.struct(content.alias("content"), F.lit(role).alias("role"))
    optional = lambda c: F.col(c) if c in samples.columns else F.lit(None).cast("string")
    metadata = F.struct(
        spans.alias("entity_spans"), (F.size("spans") == 0).alias("is_negative"), F.lit(POLICY_VERSION).alias("policy_version"), F.lit(PROMPT_VERSION).alias("prompt_version"),
        F.col("source").alias("source"), F.col("split").alias("source_split"), optional("kind").alias("synthetic_kind"), optional("family").alias("template_family"),
    )
    messages = F.array(message("system", F.lit(system_prompt)), message("user", F.col("text")), message("assistant", said))
    return samples.select("sample_id", F.to_json(F.struct(messages.alias("messages"), metadata.alias("metadata"), F.col("sample_id").alias("sample_id"))).alias("value"))


def generation_faults(rows: DataFrame, context: int, max_tokens: int, eos: int) -> DataFrame:
    """Saved generations (stop_type, generated_token_ids, sampled_tokens, prompt_tokens) + fault:
    the first rule that a row breaks, null if it keeps them all."""
    ids, n = F.col("generated_token_ids"), F.size("generated_token_ids")
    fault = (
        F.when(~F.coalesce(F.col("stop_type").isin("eos", "limit"), F.lit(False)), "stop type")
        .when(ids.isNull() | (n <= 0) | F.exists(ids, lambda t: t.isNull()), "tokens")
        .when(~n.eqNullSafe(F.col("sampled_tokens")), "token count")
        .when(n > max_tokens, "cap")
        .when(F.coalesce(F.col("prompt_tokens") + max_tokens > context, F.lit(True)), "context")
        .when((F.col("stop_type") == "eos") & (F.element_at(ids, -1) != eos), "last token")
        .when((F.col("stop_type") == "limit") & (n != max_tokens), "limit length")
    )
    return rows.withColumn("fault", fault)


def generation_diagnostics(rows: DataFrame) -> DataFrame:
    """By stop type: records, schema-invalid records, largest prompt and output."""
    return rows.groupBy("stop_type").agg(F.count("*").alias("records"), F.count_if(~F.col("schema_valid")).alias("schema_invalid"), F.max("prompt_tokens").alias("max_prompt"), F.max("sampled_tokens").alias("max_sampled"))


def length_preflight(rows: DataFrame, limit: int, by: str = "split") -> DataFrame:
    """By split: records, the largest full and prompt lengths, and how many would be cut
    (full > limit) or lose their target (prompt >= limit)."""
    return rows.groupBy(by).agg(
        F.count("*").alias("records"), F.max("full_tokens").alias("full_max"), F.max("prompt_tokens").alias("prompt_max"),
        F.count_if(F.col("full_tokens") > limit).alias("full_over"), F.count_if(F.col("prompt_tokens") >= limit).alias("prompt_at_or_over"),
    )


def length_view(rows: DataFrame, limit: int, tokens: str = "n_tokens") -> DataFrame:
    """The rows that fit; what is longer is left out whole, never cut."""
    return rows.where(F.col(tokens) <= limit)


def view_statistics(rows: DataFrame, limit: int, by: str = "split", tokens: str = "n_tokens", labels: str = "labels") -> DataFrame:
    """By split: source, kept and rejected records, negatives and their ratio (8 places), the
    largest source length, and if the view keeps all labels and 20 to 30 in 100 negatives.
    One pass; distinct labels are a set of at most 14."""
    kept = F.col(tokens) <= limit
    negative = kept & (F.size(labels) == 0)
    seen = F.size(F.array_distinct(F.flatten(F.collect_set(F.when(kept, F.array_sort(F.array_distinct(F.filter(labels, lambda x: x.isin(*ENTITY_TYPES)))))))))
    share = F.try_divide(F.count_if(negative).cast("double"), F.count_if(kept))
    return rows.groupBy(by).agg(
        F.count("*").alias("source_records"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("rejected"), F.count_if(negative).alias("negatives"),
        ratio(F.count_if(negative), F.count_if(kept), 8).alias("negative_ratio"), F.max(tokens).alias("source_max"),
        ((seen == len(ENTITY_TYPES)) & F.coalesce(share.between(0.20, 0.30), F.lit(False))).alias("passes"),
    )


def split_summary(rows: DataFrame, by: str = "split", labels: str = "labels") -> DataFrame:
    """Long form: (split, measure, n) of records, negatives and each label's occurrences."""
    base = rows.groupBy(by).agg(F.count("*").alias("records"), F.count_if(F.size(labels) == 0).alias("negatives"))
    first = base.select(by, F.expr("stack(2, 'records', records, 'negatives', negatives) AS (measure, n)"))
    return first.unionByName(rows.select(by, F.explode(labels).alias("measure")).groupBy(by, "measure").agg(F.count("*").alias("n")))


def reconciled(one: DataFrame, two: DataFrame, key: str, value: str) -> DataFrame:
    """(key, first, second) where two independent counts differ; empty if they agree."""
    both = one.select(key, F.col(value).alias("first")).join(two.select(key, F.col(value).alias("second")), key, "full_outer")
    return both.where(~F.coalesce("first", F.lit(0)).eqNullSafe(F.coalesce("second", F.lit(0))))


def domain_difference(rows: DataFrame, label: str = "label") -> DataFrame:
    """(label, side) of types without a row and of rows outside the taxonomy."""
    known = rows.sparkSession.createDataFrame([(t,) for t in ENTITY_TYPES], f"{label} string")
    return set_difference(known, rows.select(label), label)


def first_faults(faults: DataFrame, *order: str, most: int = 200) -> DataFrame:
    """The first faults for a report."""
    return faults.orderBy(*order).limit(most)


def against_expected(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, wanted, found, agrees) of each expectation; what is not found counts as 0."""
    both = expected.select(key, F.col(value).alias("wanted")).join(found.select(key, F.col(value).alias("found")), key, "left")
    return both.select(key, "wanted", F.coalesce("found", F.lit(0)).alias("found")).withColumn("agrees", F.col("wanted") == F.col("found"))
