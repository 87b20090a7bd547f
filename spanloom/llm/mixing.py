"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a seeded hash. Each copy (pass 0, 1, 2 over the source)
gets a virtual finish time: the source's tokens up to and including it, over the source's
target. At time 1 a source has its target, but for the document that would end later. What that
one leaves is a deficit, filled by later documents of the source that fit into it: first those
that come first in the queue, up to the deficit, then FITS times the largest that still fits.
They finish at time 1. Last, a source takes the smallest document left if it comes nearer to its
target with it; that one finishes after time 1, by what it is too much. A global range sort by
finish time, cut at the total budget, is the mix.

Nothing here sorts a whole source, all sources or the whole corpus in one task: running sums are
taken in hash buckets of a bounded row count and shifted by sums over whole buckets; sources are
ranked in ranges; the level up to which targets rise is found by sums over the sources; the
global order is binned by finish time and only the bin in which the budget ends is ordered by
row.

Defined cases: null and empty texts have size 0 and are never taken; a null source is a source
of its own, ranked last; repeated rows are mixed row by row; ties in the shuffle are broken by
doc_id, then size; an empty table gives an empty table; other columns are ignored by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, pick

SEED = "mix-1"
PASSES = 3
WEIGHTS = (1, 2, 3)
#: Largest documents that fit into what a source's queue leaves of its target.
FITS = 3
#: Rows that one hash bucket or one bin of finish times holds, about.
BUCKET_ROWS = 1_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked_sources(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """source, source_size, source_rank (from 1 by code point, null last): ranges of sources are
    numbered by themselves and shifted by the counts of the ranges before."""
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    dealt = scratch.stage(sources.repartitionByRange(F.asc_nulls_last("source")).withColumn("range", F.spark_partition_id()), "sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    shifts = dealt.groupBy("range").agg(F.count("*").alias("n")).select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    within = F.row_number().over(Window.partitionBy("range").orderBy(F.asc_nulls_last("source")))
    return dealt.withColumn("within", within).join(shifts, "range").select("source", "source_size", (F.col("shift") + F.col("within")).alias("source_rank"))


def source_targets(rows: DataFrame, scratch: Scratch, budget_share: float = 1.0) -> DataFrame:
    """source, source_rank, source_size, target: shares of the budget by weight; a target stops
    at PASSES times its source's size and the excess is shared again by weight, so one level
    (words for a weight of 1) serves all sources below their stop. The level only rises, and each
    step stops the sources that it passes."""
    weights = F.array(*map(F.lit, WEIGHTS))
    weight = F.element_at(weights, ((F.col("source_rank") - 1) % len(WEIGHTS) + 1).cast("int")).cast("long")
    sources = ranked_sources(rows, scratch).withColumn("weight", weight).withColumn("stop", F.col("source_size") * PASSES)
    sources = scratch.stage(sources, "shares")
    total, every = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    budget = total if budget_share == 1.0 else total * budget_share
    level, stopped = (budget / every if every else math.inf), 0
    while every:
        passed = F.col("stop") / F.col("weight") < F.lit(level)
        n, held, share = sources.where(passed).agg(F.count("*"), F.coalesce(F.sum("stop"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if n == stopped:
            break
        level, stopped = ((budget - held) / (every - share) if every > share else math.inf), n
    target = F.least(F.col("stop").cast("double"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_rank", "source_size", target.alias("target"))


def running_sum(rows: DataFrame, name: str) -> DataFrame:
    """Adds the sum of sizes of a source up to and including each row, in the shuffled order:
    within buckets, plus what the buckets before hold. rows: source_rank, bucket, key, doc_id, size."""
    before = Window.partitionBy("source_rank").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("held"))
    totals = totals.select("source_rank", "bucket", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    within = F.sum("size").over(Window.partitionBy("source_rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(totals, ["source_rank", "bucket"]).withColumn(name, F.col("before") + F.col("within")).drop("before", "within")


def filled(queued: DataFrame, scratch: Scratch) -> DataFrame:
    """(source_rank, done, fills) of the rows whose next copy is taken, at the time ``fills``, for
    its source's deficit. ``done`` names a row of its source: it rises with each row that has words."""
    state = queued.groupBy("source_rank").agg((F.first("target") - F.sum(F.col("size") * F.col("base"))).alias("deficit"), F.min("base").alias("least"), F.first("target").alias("target"))
    state = scratch.stage(state.where(f"least < {PASSES} and deficit > 0"), "deficits")
    spare = queued.drop("target").join(state, "source_rank").where(f"base < {PASSES} and size < 2 * deficit")
    turn = spare.where("base = least and size <= deficit").select("source_rank", "bucket", "key", "doc_id", "size", "done", "deficit")
    first = scratch.stage(running_sum(turn, "sum").where("sum <= deficit").select("source_rank", "done", "size"), "first")
    spare = scratch.stage(spare.select("source_rank", "done", "size").join(first.select("source_rank", "done"), ["source_rank", "done"], "left_anti"), "spare")
    spent = first.groupBy("source_rank").agg(F.sum("size").alias("spent"))
    state = state.join(spent, "source_rank", "left").select("source_rank", "target", (F.col("deficit") - F.coalesce("spent", F.lit(0))).alias("deficit"), F.array().cast("array<bigint>").alias("picked"))
    state = scratch.stage(state, "deficits")
    unpicked = lambda: spare.join(state, "source_rank").where(~F.array_contains("picked", F.col("done")))
    for _ in range(FITS):
        best = unpicked().where("size <= deficit").groupBy("source_rank").agg(F.min(F.struct((-F.col("size")).alias("minus"), "done")).alias("best"))
        state = state.join(best, "source_rank", "left").select(
            "source_rank",
            "target",
            F.coalesce(F.col("deficit") + F.col("best.minus"), "deficit").alias("deficit"),
            F.when(F.col("best").isNull(), F.col("picked")).otherwise(F.concat("picked", F.array("best.done"))).alias("picked"),
        )
        state = scratch.stage(state, "deficits")
    near = unpicked().where("size < 2 * deficit").groupBy("source_rank").agg(F.min(F.struct("size", "done")).alias("near"), F.first("deficit").alias("deficit"), F.first("target").alias("target"))
    over = near.select("source_rank", "near.done", (1 + F.greatest(F.col("near.size") - F.col("deficit"), F.lit(0.0)) / F.col("target")).alias("fills"))
    fits = first.select("source_rank", "done").unionByName(state.select("source_rank", F.explode("picked").alias("done")))
    return fits.withColumn("fills", F.lit(1.0)).unionByName(over)


def shuffle_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, passes (copies that the mix takes) and taken
    (their words) of every row."""
    queued = queue(df, id_col, text_col, source_col, seed, Scratch(df.sparkSession, "mix"))
    return queued.select("doc_id", "source", "size", "source_size", "target", "passes", (F.col("size") * F.col("passes")).cast("long").alias("taken"))


def queue(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, scratch: Scratch) -> DataFrame:
    """doc_id, source, size, key (place in the shuffle), source_size, target, base (copies that
    finish by time 1) and passes of every row."""
    rows = scratch.stage(pick(df, doc_id=id_col, source=source_col, text=text_col).select("doc_id", "source", word_count(F.col("text")).alias("size")), "rows")
    n_rows = rows.count()
    buckets = min(1 << 20, -(-max(n_rows, 1) // BUCKET_ROWS))
    keyed = rows.withColumn("key", shuffle_key(F.col("doc_id"), seed)).withColumn("bucket", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("long"))
    r, s = keyed.alias("r"), source_targets(rows, scratch).alias("s")
    keyed = r.join(s, F.col("r.source").eqNullSafe(F.col("s.source"))).select("r.*", "s.source_rank", "s.source_size", "s.target")

    def finish(turn, done="done") -> Column:
        return (turn * F.col("source_size") + F.col(done)) / F.col("target")

    base = sum((F.when((F.col("size") > 0) & (finish(F.lit(e)) <= 1), 1).otherwise(0) for e in range(PASSES)), F.lit(0))
    queued = scratch.stage(running_sum(keyed, "done").withColumn("base", base), "queue")
    fill = scratch.stage(filled(queued.where("size > 0"), scratch), "fill")
    before, queued = queued, scratch.stage(queued.join(fill, ["source_rank", "done"], "left").withColumn("fills", F.when(F.col("size") > 0, F.col("fills"))), "queue")
    scratch.free(before)

    def time(turn) -> Column:
        """When a copy finishes; null for one that is never taken."""
        return F.when((F.col("size") > 0) & (turn < F.col("base")), finish(turn)).when(turn == F.col("base"), F.col("fills"))

    def place(turn) -> Column:
        return F.struct(time(turn).alias("at"), F.col("source_rank").alias("rank"), F.col("key").alias("key"), F.col("doc_id").alias("id"), F.col("size").alias("size"), turn.alias("turn"))

    bins = 2 * buckets
    copies = queued.where("size > 0").select(F.explode(F.sequence(F.lit(0), F.lit(PASSES - 1))).alias("turn"), *queued.columns)
    copies = copies.where(time(F.col("turn")).isNotNull()).withColumn("bin", F.floor(time(F.col("turn")) * bins).cast("long"))
    by_bin = copies.groupBy("bin").agg(F.sum("size").alias("bin_size"))
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    budget = queued.agg(F.sum("size")).first()[0] or 0
    cut_bin = by_bin.withColumn("before", F.coalesce(F.sum("bin_size").over(upto), F.lit(0))).where(f"before + bin_size > {budget}").orderBy("bin").first()
    if cut_bin is None:
        passes: Column = sum((F.when(time(F.lit(e)).isNotNull(), 1).otherwise(0) for e in range(PASSES)), F.lit(0))
    else:
        running = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
        last = copies.where(F.col("bin") == cut_bin["bin"]).withColumn("place", place(F.col("turn"))).withColumn("sum", F.sum("size").over(running) + cut_bin["before"])
        over = last.where(f"sum > {budget}").orderBy("place").select("place.*").first()
        cut = F.struct(F.lit(over["at"]).alias("at"), F.lit(over["rank"]).alias("rank"), F.lit(over["key"]).alias("key"), F.lit(over["id"]).alias("id"), F.lit(over["size"]).alias("size"), F.lit(over["turn"]).alias("turn"))
        passes = sum((F.when(time(F.lit(e)).isNotNull() & (place(F.lit(e)) < cut), 1).otherwise(0) for e in range(PASSES)), F.lit(0))
    scratch.free_all(queued)
    return queued.withColumn("passes", passes).select("doc_id", "source", "size", "key", "source_size", "target", "base", "passes")


def mixed_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The mix itself: every row as often as it is taken, with all its columns. Rows that agree
    in id, source and size (repeated rows) are all taken as often as the first-queued of them.

    Texts are not exchanged: up to a place in a source's shuffle its rows are taken once more
    than behind it, so a row only meets that place of its source, and the few rows of which
    another number is taken (those that fill a deficit)."""
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    id_, text, source = (F.col(f"_{names.index(c)}") for c in (id_col, text_col, source_col))
    scratch = Scratch(df.sparkSession, "mix")
    queued = queue(df, id_col, text_col, source_col, seed, scratch).where("size > 0")
    place = F.struct("key", "doc_id", "size")
    ends = queued.groupBy(F.col("source").alias("of")).agg(F.max(F.struct("base", place.alias("place"))).alias("last"), F.min("base").alias("behind"))
    ends = scratch.stage(ends.select("of", F.col("last.base").alias("upto"), F.col("last.place").alias("end"), "behind"), "ends")
    other = queued.where("passes != base").groupBy("doc_id", "source", "size").agg(F.max("passes").alias("passes"))
    other = scratch.stage(other.toDF("other_id", "other_source", "other_size", "other_passes"), "other")
    scratch.free_all(ends, other)

    sized = plain.withColumn("words", word_count(text)).where("words > 0")
    sized = sized.join(ends, source.eqNullSafe(ends["of"]))
    same = id_.eqNullSafe(F.col("other_id")) & source.eqNullSafe(F.col("other_source")) & (F.col("words") == F.col("other_size"))
    own = F.struct(shuffle_key(id_, seed).alias("key"), id_.alias("doc_id"), F.col("words").alias("size"))
    base = F.when(own <= F.col("end"), F.col("upto")).otherwise(F.col("behind"))
    joined = sized.withColumn("base", base).join(other, same, "left").withColumn("passes", F.coalesce("other_passes", "base")).where("passes > 0")
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    return copies.select(*[F.col(f"_{i}").alias(n) for i, n in enumerate(names)])


#: The same mix said otherwise: targets by trying every number of stopped sources, running sums
#: over whole sources, and fills by counting what fits.
SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix-1:' || doc_id::VARCHAR) AS key FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS own, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
shares AS (SELECT *, 1 + (rank - 1) % 3 AS weight, row_number() OVER (ORDER BY 3.0 * own / (1 + (rank - 1) % 3), rank) AS nth FROM src),
tried AS (
  SELECT k.k, ((SELECT sum(own) FROM src) - coalesce((SELECT sum(3 * own) FROM shares WHERE nth <= k.k), 0))::DOUBLE / (SELECT sum(weight) FROM shares WHERE nth > k.k)::DOUBLE AS level
  FROM (SELECT unnest(range(0, (SELECT count(*) FROM src))) AS k) k),
level AS (
  SELECT level FROM tried WHERE NOT EXISTS (SELECT 1 FROM shares WHERE nth > k AND 3.0 * own / weight < level) ORDER BY k LIMIT 1),
queue AS (
  SELECT z.*, s.own, s.rank, least(3.0 * s.own, (SELECT level FROM level) * s.weight)::DOUBLE AS target,
    sum(size) OVER (PARTITION BY s.rank ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS done
  FROM sized z JOIN shares s ON z.source IS NOT DISTINCT FROM s.source),
based AS (SELECT *, (SELECT count(*) FROM range(0, 3) e(turn) WHERE size > 0 AND (turn * own + done)::DOUBLE / target <= 1) AS base FROM queue),
missing AS (SELECT rank, any_value(target) AS target, any_value(target) - sum(size * base)::DOUBLE AS lacks, min(base) AS least FROM based WHERE size > 0 GROUP BY rank),
spare AS (SELECT b.rank, b.done, b.size, b.base, m.least, m.lacks FROM based b JOIN missing m USING (rank) WHERE b.size > 0 AND b.base < 3 AND m.least < 3 AND m.lacks > 0),
turns AS (SELECT *, sum(size) OVER (PARTITION BY rank ORDER BY done) AS upto FROM spare WHERE base = least AND size <= lacks),
picks(rank, step, lacks, chosen) AS (
  SELECT rank, 0, lacks - coalesce((SELECT sum(size) FROM turns t WHERE t.rank = m.rank AND upto <= t.lacks), 0)::DOUBLE, coalesce((SELECT list(done) FROM turns t WHERE t.rank = m.rank AND upto <= t.lacks), []) FROM missing m WHERE least < 3 AND lacks > 0
  UNION ALL SELECT rank, step + 1, lacks - best.size, list_append(chosen, best.done) FROM (
    SELECT p.rank, p.step, p.lacks, p.chosen, (SELECT {'size': s.size, 'done': s.done} FROM spare s WHERE s.rank = p.rank AND s.size <= p.lacks AND NOT list_contains(p.chosen, s.done) ORDER BY s.size DESC, s.done LIMIT 1) AS best
    FROM picks p WHERE step < 3) x WHERE best IS NOT NULL),
ends AS (SELECT rank, arg_max(lacks, step) AS lacks, arg_max(chosen, step) AS chosen FROM picks GROUP BY rank),
nearer AS (
  SELECT e.rank, e.lacks, (SELECT {'size': s.size, 'done': s.done} FROM spare s WHERE s.rank = e.rank AND NOT list_contains(e.chosen, s.done) ORDER BY s.size, s.done LIMIT 1) AS best FROM ends e),
fills AS (
  SELECT rank, unnest(chosen) AS done, 1.0::DOUBLE AS finish FROM ends
  UNION ALL SELECT rank, best.done, 1 + greatest(best.size - n.lacks, 0) / m.target FROM nearer n JOIN missing m USING (rank) WHERE best.size < 2 * n.lacks),
copies AS (
  SELECT b.*, e.turn, CASE WHEN e.turn < base THEN (e.turn * own + b.done)::DOUBLE / target ELSE f.finish END AS finish
  FROM based b CROSS JOIN range(0, 3) e(turn) LEFT JOIN fills f ON f.rank = b.rank AND f.done = b.done AND e.turn = b.base WHERE size > 0),
mixed AS (
  SELECT doc_id, sum(size)::BIGINT AS taken FROM (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, key, doc_id, size, turn ROWS UNBOUNDED PRECEDING) AS upto FROM copies WHERE finish IS NOT NULL)
  WHERE upto <= (SELECT sum(own) FROM src) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.own AS source_size, q.target, coalesce(m.taken, 0)::BIGINT AS taken FROM queue q LEFT JOIN mixed m USING (doc_id)
"""
