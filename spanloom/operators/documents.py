"""Long documents: segments, chunks with overlap, global spans, reconciliation, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import overlap

_PIECE = "array<struct<start:int,stop:int,text:string>>"
_SPAN = "array<struct<start:int,stop:int,type:string,text:string>>"
_FOUND = "array<struct<edge:int,size:int,start:int,stop:int,type:string>>"
#: A sentence ends with a mark, closing quotes or brackets and white space, or with a line.
SENTENCE = r"(?Us).+?(?:[.!?…]+[\"'”’)\]]*(?:\s+|\z)|[。！？]+\s*|\n\s*|\z)"
PARAGRAPH = r"[^\n]*\n+|[^\n]+$"
#: A token, when none are counted by a tokenizer: a word with the white space before it.
TOKEN = r"(?U)\s*\S+|\s+$"


def _fold(items: Column, start: Column, step, out: str) -> Column:
    return F.aggregate(items, start, step, lambda acc: acc[out])


def placed(pieces: Column) -> Column:
    """Spans (start, stop, text) of pieces that lie one after another from 0."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_PIECE).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        stop = (acc["at"] + F.length(x)).cast("int")
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"), x.alias("text")))).alias("out"))

    return _fold(pieces, empty, step, "out")


def segments(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = PARAGRAPH) -> DataFrame:
    """(id, k, start, stop, text): paragraphs with the line ends after them, or with
    ``unit=SENTENCE`` sentences with the white space after them, so that the pieces put together
    are the text; an empty text has none."""
    pieces = F.filter(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(unit), F.lit(0)), lambda x: x != "")
    return df.select(F.col(id_col), F.posexplode(placed(pieces)).alias("k", "piece")).select(id_col, "k", "piece.*")


def chunks(df: DataFrame, size: int = 1024, shared: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, chunk, start, stop, text): pieces of ``size`` characters that share ``shared`` with
    the one before; they cover the text, and each goes on beyond the last."""
    if not 0 <= shared < size:
        raise ValueError("chunks must go forward: 0 <= shared < size")
    step = size - shared
    n = F.length(text_col)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = df.select(F.col(id_col), F.col(text_col).alias("whole"), F.explode(starts).alias("chunk"))
    rows = rows.withColumn("start", F.col("chunk") * step).withColumn("stop", F.least(F.col("start") + size, F.length("whole")))
    return rows.select(id_col, "chunk", "start", "stop", F.substring("whole", F.col("start") + 1, F.lit(size)).alias("text"))


def token_chunks(df: DataFrame, budget: int = 1024, shared: int = 128, id_col: str = "doc_id", text_col: str = "text", token: str = TOKEN) -> DataFrame:
    """(id, chunk, start, stop, tokens, text): sentences packed up to ``budget`` tokens. A sentence
    above it is cut into slices of ``budget - shared`` tokens. A chunk begins with the last
    sentences of the one before that hold at most ``shared`` tokens; it always goes on beyond it,
    and chunks cover the text. Tokens are the matches of ``token``, which must cover a sentence."""
    if not 0 <= shared < budget:
        raise ValueError("chunks must go forward: 0 <= shared < budget")
    text = F.coalesce(F.col(text_col), F.lit(""))
    sentences = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda x: x != "")
    tokens = F.transform(sentences, lambda s: F.regexp_extract_all(s, F.lit(token), F.lit(0)))
    slice_ = budget - shared
    # units: (characters, tokens) of whole sentences, and of slices of those above the budget
    sizes = lambda t: F.struct(F.length(F.array_join(t, "")).alias("chars"), F.size(t).alias("tokens"))
    parts = F.flatten(
        F.transform(
            tokens,
            lambda t: F.when(F.size(t) <= budget, F.array(sizes(t))).otherwise(
                F.transform(F.sequence(F.lit(0), F.ceil(F.size(t) / slice_).cast("int") - 1), lambda k: sizes(F.slice(t, k * slice_ + 1, F.lit(slice_))))
            ),
        )
    )
    # open: the units of the chunk being packed, as (start, stop, tokens); new: whether any of them is not shared
    unit = "array<struct<start:int,stop:int,tokens:int>>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(unit).alias("open"), F.array().cast(unit).alias("out"))
    total = lambda units: F.aggregate(units, F.lit(0), lambda a, u: (a + u["tokens"]).cast("int"))
    closed = lambda units: F.struct(F.get(units, F.lit(0))["start"].alias("start"), F.element_at(units, -1)["stop"].alias("stop"), total(units).alias("tokens"))

    def kept(units: Column, room: Column) -> Column:
        """The last units that hold at most ``shared`` tokens and leave room for the next."""
        none = F.struct(F.lit(0).alias("held"), F.lit(True).alias("open"), F.array().cast(unit).alias("units"))

        def back(acc: Column, u: Column) -> Column:
            held = (acc["held"] + u["tokens"]).cast("int")
            fits = acc["open"] & (held <= F.least(F.lit(shared), room))
            return F.struct(F.when(fits, held).otherwise(acc["held"]).alias("held"), fits.alias("open"), F.when(fits, F.concat(F.array(u), acc["units"])).otherwise(acc["units"]).alias("units"))

        return _fold(F.reverse(units), none, back, "units")

    def pack(acc: Column, x: Column) -> Column:
        stop = (acc["at"] + x["chars"]).cast("int")
        own = F.array(F.struct(acc["at"].alias("start"), stop.alias("stop"), x["tokens"].alias("tokens")))
        full = (F.size(acc["open"]) > 0) & (total(acc["open"]) + x["tokens"] > budget)
        return F.struct(
            stop.alias("at"),
            F.when(full, F.concat(kept(acc["open"], F.lit(budget) - x["tokens"]), own)).otherwise(F.concat(acc["open"], own)).alias("open"),
            F.when(full, F.concat(acc["out"], F.array(closed(acc["open"])))).otherwise(acc["out"]).alias("out"),
        )

    packed = F.aggregate(parts, empty, pack, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["out"], F.array(closed(acc["open"])))).otherwise(acc["out"]))
    rows = df.select(F.col(id_col), text.alias("whole"), F.posexplode(packed).alias("chunk", "c")).select(id_col, "whole", "chunk", "c.*")
    return rows.select(id_col, "chunk", "start", "stop", "tokens", F.substring("whole", F.col("start") + 1, F.col("stop") - F.col("start")).alias("text"))


def to_global(found: DataFrame) -> DataFrame:
    """Detections in a chunk (start, stop, chunk_start, chunk_stop, ...) with offsets in the
    document and edge, the distance to the nearer end of the chunk."""
    edge = F.least(F.col("start"), F.col("chunk_stop") - F.col("chunk_start") - F.col("stop"))
    return found.withColumn("edge", edge).withColumn("start", F.col("start") + F.col("chunk_start")).withColumn("stop", F.col("stop") + F.col("chunk_start"))


def misplaced(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The global spans (id, start, stop, text) whose text is not what the document holds there."""
    rows = found.join(docs.select(id_col, F.col(text_col).alias("whole")), id_col, "left")
    there = F.substring("whole", F.col("start") + 1, F.col("stop") - F.col("start"))
    right = (there == F.col("text")) & (F.col("stop") > F.col("start")) & (F.length("text") == F.col("stop") - F.col("start"))
    return rows.where(~F.coalesce(right, F.lit(False))).drop("whole")


def reconcile(found: DataFrame, id_col: str = "doc_id", same: float = 0.7) -> DataFrame:
    """Detections (id, type, start, stop, edge) without overlaps, and conflict: whether a span
    displaced one of another type. Equal spans count once, with their best edge. Spans are taken
    by largest edge, then the longer, the earlier, the first type, if they overlap nothing taken;
    so each span that is left out overlaps one that stays. One of the same type with an overlap
    of at least ``same`` of their union is the same find and no conflict, nor is any other of its
    type. The spans of one document meet in one row."""
    single = found.groupBy(id_col, "type", "start", "stop").agg(F.max("edge").alias("edge"))
    span = F.struct((-F.col("edge")).cast("int").alias("edge"), (F.col("start") - F.col("stop")).cast("int").alias("size"), F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"), "type")
    ranked = single.groupBy(id_col).agg(F.sort_array(F.collect_list(span)).alias("ranked"))
    hits = lambda x, y: overlap(x["start"], x["stop"], y["start"], y["stop"])
    taken = F.aggregate("ranked", F.array().cast(_FOUND), lambda acc, x: F.when(F.exists(acc, lambda y: hits(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    rows = ranked.select(id_col, "ranked", F.explode(taken).alias("s"))
    shared = lambda x, y: F.least(x["stop"], y["stop"]) - F.greatest(x["start"], y["start"])
    union = lambda x, y: F.greatest(x["stop"], y["stop"]) - F.least(x["start"], y["start"])
    merged = F.size(F.filter("ranked", lambda y: (y["type"] == F.col("s.type")) & (shared(F.col("s"), y) >= same * union(F.col("s"), y))))
    conflict = F.exists("ranked", lambda y: hits(F.col("s"), y) & (y["type"] != F.col("s.type")))
    return rows.select(id_col, "s.type", "s.start", "s.stop", (-F.col("s.edge")).alias("edge"), merged.cast("long").alias("merged"), conflict.alias("conflict"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """(id, redacted): each span of the sorted, non-overlapping array becomes [TYPE]; all other
    characters stay."""
    empty = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(F.col(text_col), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(s["stop"].alias("at"), F.concat(acc["out"], kept, F.lit("["), s["type"], F.lit("]")).alias("out"))

    rest = lambda acc: F.concat(acc["out"], F.substring(F.col(text_col), acc["at"] + 1, F.length(text_col)))
    return df.select(F.col(id_col), F.aggregate(F.coalesce(F.col(spans_col), F.array().cast(_SPAN)), empty, step, rest).alias("redacted"))
