"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct word shingles. Documents with equal sets form a class
and are represented by the smallest id. Each class gets a SuperMinHash signature: every
element walks a random permutation of the slots, step j giving a value in [j, j+1) to the
j-th slot, and a document stops as soon as no slot is empty, since later steps only give
larger values. Signature rows are banded; classes that share a band are candidates.

Inside a band's group not all pairs are formed. Each class is first checked against the
smallest ids of its groups; verified links join classes into components. In groups that still
hold several components, the classes outside their hub's component are compared with the
group's other classes in blocks of bounded size, which return links and no pairs. Every pair
that shares a band is thus verified on full shingle sets or already in one component: no link
is lost, and a group of n near copies costs about n checks.

With 32 bands of 5 rows a pair at similarity 0.8 shares no band with probability 3.1e-6.

Sets meet in lots: a lot holds whole blocks, up to a bounded number of rows and of shingles, and
a hub's set comes once in each block, however many classes are checked against it there.

Defined cases: texts without words (null, empty, blank) have no shingles and are linked with
nothing; a text with fewer words than a shingle is one shingle; rows that share an id count as
one document, linked by each of its texts; a row with a null id is linked with nothing, has a
null component and is kept; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, full_texts, map_slices, pick, spread
from .components import components

BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
_U = np.uint64
_STEP = _U(0x9E3779B97F4A7C15)
_EMPTY = _U(0xFFFFFFFFFFFFFFFF)
#: Elements whose first steps are taken together.
_TOGETHER = 1 << 15
#: Bytes of text that one step shingles.
_STEP_BYTES = 1 << 20
#: Classes, and shingles, on each side of a block; a larger set is a side of its own.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Rows, and shingles, that one call compares, about.
LOT_ROWS, LOT_SHINGLES = 4 * 512, 1 << 21


@dataclass(frozen=True)
class Shingling:
    words: int = 5
    percent: int = 80


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_ODD = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP) | _U(1)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle keys of each text."""
    lists = pc.ascii_split_whitespace(texts)
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.slice(at[0], at[-1] - at[0])
    full = pc.greater(pc.binary_length(flat), 0)
    starts = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])[at - at[0]]
    coded = flat.filter(full).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    keys = np.fromiter((digest(w.lower()) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(coded.dictionary))  # bytes.lower: A-Z only
    words = keys[coded.indices.to_numpy(zero_copy_only=False)]
    sets = []
    with np.errstate(over="ignore"):
        n = max(0, words.size - k + 1)
        shingles = np.zeros(n, np.uint64)
        for i in range(k):
            shingles += words[i : i + n] * _ODD[i]
        shingles = _mix(shingles)
        for begin, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if end - begin >= k:
                own = np.sort(shingles[begin : end - k + 1])
                sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
            elif end > begin:
                short = (words[begin:end] * _ODD[k : k + end - begin]).sum(dtype=np.uint64, keepdims=True)
                sets.append(_mix(short + _U(end - begin)))
            else:
                sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """SuperMinHash: a row of SLOTS values for each set; an empty set keeps empty slots."""
    found = np.full(len(sets) * SLOTS, _EMPTY)
    begin = 0
    while begin < len(sets):  # runs of sets with a bounded number of elements
        end, held = begin, 0
        while end < len(sets) and (held == 0 or held + sets[end].size <= _TOGETHER):
            held += sets[end].size
            end += 1
        _walk(sets[begin:end], found[begin * SLOTS : end * SLOTS])
        begin = end
    return found.reshape(len(sets), SLOTS)


def _walk(sets: list[np.ndarray], found: np.ndarray) -> None:
    sizes = np.array([s.size for s in sets])
    if not sizes.sum():
        return
    elements = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    order = None  # rows: the not yet visited slots of each element, by Fisher-Yates
    with np.errstate(over="ignore"):
        for j in range(SLOTS):
            bits = _mix(elements + _U(2 * j + 1) * _STEP)
            k = j + (((bits & _U(0xFFFFFFFF)) * _U(SLOTS - j)) >> _U(32)).astype(np.int64)
            slot = k if order is None else order[np.arange(k.size), k].astype(np.int64)
            np.minimum.at(found, doc * SLOTS + slot, (_U(j) << _U(32)) | (bits >> _U(32)))
            open_ = (found.reshape(-1, SLOTS) == _EMPTY).any(axis=1)
            stay = open_[doc]
            if not stay.any():
                return
            if order is None:
                order = np.tile(np.arange(SLOTS, dtype=np.uint8), (int(stay.sum()), 1))
                elements, doc, k = elements[stay], doc[stay], k[stay]
                order[np.arange(k.size), k] = 0
            else:
                order[np.arange(k.size), k] = order[:, j]
                if stay.sum() < 0.7 * stay.size:
                    elements, doc, order = elements[stay], doc[stay], order[stay]


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        rows = signature.reshape(-1, BANDS, ROWS)
        keys = (_mix(rows) * _ODD[:ROWS]).sum(axis=2, dtype=np.uint64) + _ODD[ROWS : ROWS + BANDS]
        return _mix(keys).view(np.int64)


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, the 128-bit key of the set (hi, lo) and its bands."""

    def run(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(full_texts(part.column(1)), k)
        marks = _marks(sets)
        keys = band_keys(signatures(sets))
        empty = np.array([s.size == 0 for s in sets])
        bands = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel(), mask=pa.array(empty))
        return {"doc_id": part.column(0).cast(pa.int64()), "n_shingles": pa.array([s.size for s in sets], pa.int64()), "hi": marks[:, 0], "lo": marks[:, 1], "bands": bands}

    return map_slices(docs, "doc_id long, n_shingles long, hi long, lo long, bands array<long>", run, limit=_STEP_BYTES)


def _marks(sets: list[np.ndarray]) -> np.ndarray:
    """The 128-bit key of each set, as two columns."""
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, text, hi, lo) -> (id, shingles) of the rows whose set has the key (hi, lo)."""

    def run(part: pa.RecordBatch) -> dict:
        sets = shingle_sets(full_texts(part.column(1)), k)
        right = (_marks(sets) == np.column_stack([part.column(i).to_numpy() for i in (2, 3)])).all(axis=1)
        sets = [x for x, r in zip(sets, right, strict=True) if r]
        ends = np.concatenate([[0], np.cumsum([s.size for s in sets])]).astype(np.int32)
        keys = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return {"id": part.column(0).cast(pa.int64()).filter(pa.array(right)), "shingles": pa.ListArray.from_arrays(ends, keys)}

    return map_slices(docs, "id long, shingles array<long>", run, limit=_STEP_BYTES)


def _fits(a: str, b: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return F.expr(f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})")


def _parts(rows: str, shingles: str) -> Column:
    """Into how many a side of so many rows and shingles is cut."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES), F.lit(1))


def _place(count: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(count))


def hub_blocks(spokes: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks in which each class (rep, n) of spokes meets its hub (hub, hub_n), and nothing else."""
    sizes = spokes.groupBy("hub").agg(F.count("*").alias("all"), F.sum("n").alias("shingles"), F.max("hub_n").alias("hub_n"))
    sizes = scratch.stage(sizes.select("hub", "hub_n", _parts("all", "shingles").alias("rows")), "sizes")
    spoke = spokes.select("hub", F.col("rep").alias("id"), "n").join(sizes.select("hub", "rows"), "hub")
    spoke = spoke.select("hub", "id", "n", F.col("id").alias("group"), F.lit(True).alias("side"), _place("rows").alias("row"), F.lit(0).cast("long").alias("column"))
    hub = sizes.select("hub", F.col("hub").alias("id"), F.col("hub_n").alias("n"), F.col("hub").alias("group"), F.lit(False).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)).alias("row"), F.lit(0).cast("long").alias("column"))
    return spoke.unionByName(hub)


def open_blocks(open_: DataFrame, scratch: Scratch) -> DataFrame:
    """Blocks across components inside groups. open_ (hub, id, n, group, main): the classes of a
    hub's groups, their component, and if it is the hub's. Classes outside the hub's component
    meet all classes of the group."""
    rest = ~F.col("main")
    sizes = open_.groupBy("hub").agg(F.count("*").alias("all"), F.sum("n").alias("all_n"), F.count_if(rest).alias("rest"), F.sum(F.when(rest, F.col("n"))).alias("rest_n")).where("rest > 0")
    sizes = scratch.stage(sizes.select("hub", _parts("all", "all_n").alias("columns"), _parts("rest", "rest_n").alias("rows")), "sizes")
    dealt = open_.join(sizes, "hub")
    every = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))
    left = dealt.where(rest).select("hub", "id", "n", "group", F.lit(True).alias("side"), _place("rows").alias("row"), every("columns").alias("column"))
    right = dealt.select("hub", "id", "n", "group", F.lit(False).alias("side"), every("rows").alias("row"), _place("columns").alias("column"))
    return left.unionByName(right)


def block_links(blocks: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) between the two sides of each block, across groups, on full shingle sets."""
    blocks = scratch.stage(blocks, "blocks")
    rows, shingles = blocks.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    lots = max(1, -(-rows // LOT_ROWS), -(-shingles // LOT_SHINGLES))  # small blocks share a call
    dealt = blocks.withColumn("lot", F.pmod(F.xxhash64("hub", "row", "column"), F.lit(lots))).join(sets, "id").select("lot", "hub", "row", "column", "side", "id", "group", "shingles")

    def compare(lot: pa.Table) -> pa.Table:
        lot = lot.combine_chunks()
        hub, row, column, group, ids = (lot[c].to_numpy() for c in ("hub", "row", "column", "group", "id"))
        side = lot["side"].to_numpy(zero_copy_only=False)
        lists = lot["shingles"].chunk(0) if lot.num_rows else pa.array([], pa.list_(pa.int64()))
        at, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        order = np.lexsort((side, column, row, hub))
        key = np.stack([hub, row, column])[:, order]
        edges = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        found: list[tuple[int, int]] = []
        for block in np.split(order, edges):
            theirs, mine = np.split(block, [int((~side[block]).sum())])  # side sorts False first
            if not mine.size or not theirs.size:
                continue
            few, many = (mine, theirs) if mine.size <= theirs.size else (theirs, mine)
            pieces = [flat[at[i] : at[i + 1]] for i in (*many, *few)]
            _, codes = np.unique(np.concatenate(pieces), return_inverse=True)
            n = np.array([x.size for x in pieces])
            starts = np.concatenate([[0], np.cumsum(n)])
            others, other_starts, other_n = codes[: starts[many.size]], starts[: many.size], n[: many.size]
            present = np.zeros(codes.max() + 1, np.int64)
            for k, i in enumerate(few, many.size):
                own = codes[starts[k] : starts[k + 1]]
                present[own] = 1
                both = np.add.reduceat(present[others], other_starts)
                present[own] = 0
                near = (100 * both >= percent * (other_n + n[k] - both)) & (group[many] != group[i])
                found += [(min(ids[i], x), max(ids[i], x)) for x in ids[many[near]]]
        return pa.table({"a": pa.array([int(x) for x, _ in found], pa.int64()), "b": pa.array([int(y) for _, y in found], pa.int64())})

    links = scratch.stage(dealt.groupBy("lot").applyInArrow(compare, "a long, b long").distinct(), "links")
    scratch.free(blocks)
    return links


def near_duplicates(df: DataFrame, how: Shingling = Shingling(), id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id of the group) and kept (it is its
    group's smallest id) of every row."""
    docs = pick(df, doc_id=id_col, text=text_col)
    scratch = scratch or Scratch(df.sparkSession, "neardup")
    profiled = scratch.stage(profiles(spread(docs), how.words), "profiles")
    usable = "n_shingles > 0 and doc_id is not null"
    classes = scratch.stage(profiled.where(usable).groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")
    seen = scratch.stage(profiled.select("doc_id", "n_shingles", "hi", "lo"), "seen")
    scratch.free(profiled)
    banded = classes.select("rep", "n", F.explode("bands").alias("band"))
    groups = banded.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    members = scratch.stage(banded.join(groups, "band").select("rep", "n", F.col("hub.rep").alias("hub"), F.col("hub.n").alias("hub_n")).distinct(), "members")

    # the sets of the classes that meet others; an id may stand for several classes
    wanted = classes.select("rep", "hi", "lo").join(members.select("rep").distinct(), "rep", "left_semi")
    texts = docs.join(wanted, docs["doc_id"] == wanted["rep"]).select("doc_id", "text", "hi", "lo").dropDuplicates()
    sets = scratch.stage(full_sets(texts, how.words), "sets")

    # the classes of an id with several texts belong together
    mark = F.struct("hi", "lo")
    several = seen.where(usable).groupBy("doc_id").agg((F.min(mark) != F.max(mark)).alias("several")).where("several")
    links = seen.where(usable).join(several, "doc_id", "left_semi").join(classes.select("hi", "lo", "rep"), ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    links = scratch.stage(links.distinct(), "own")

    def labelled(rows: DataFrame, labels: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            own = labels.select(F.col("node").alias(f"{c}_node"), F.col("component").alias(f"{c}_found"))
            rows = rows.join(own, F.col(c) == F.col(f"{c}_node"), "left").withColumn(f"{c}_of", F.coalesce(f"{c}_found", c)).drop(f"{c}_node", f"{c}_found")
        return rows

    # first each class against one hub only, then against hubs in other components
    spokes = scratch.stage(members.where((F.col("rep") != F.col("hub")) & _fits("n", "hub_n", how.percent)), "spokes")
    nearest = spokes.groupBy("rep", "n").agg(F.min(F.struct("hub", "hub_n")).alias("first")).select("rep", "n", "first.*")
    links = links.union(block_links(hub_blocks(nearest, scratch), sets, how.percent, scratch))
    found = components(links, scratch)
    rest = labelled(spokes.join(nearest.select("rep", "hub"), ["rep", "hub"], "left_anti"), found, "rep", "hub").where("rep_of != hub_of").select("rep", "n", "hub", "hub_n")
    rest = scratch.stage(rest, "rest")
    if not rest.isEmpty():
        links = links.union(block_links(hub_blocks(rest, scratch), sets, how.percent, scratch))
        before, found = found, components(links, scratch)
        scratch.free(before)
    scratch.free(spokes)

    # groups that still hold several components
    open_ = labelled(members.where("rep != hub").select("hub", "rep", "n"), found, "hub", "rep")
    open_ = scratch.stage(open_.select("hub", F.col("rep").alias("id"), "n", F.col("rep_of").alias("group"), (F.col("rep_of") == F.col("hub_of")).alias("main")), "open")
    if not open_.where("not main").isEmpty():
        found = components(links.union(block_links(open_blocks(open_, scratch), sets, how.percent, scratch)), scratch)

    of_class = scratch.stage(labelled(classes.select("hi", "lo", "rep"), found, "rep").select("hi", "lo", F.col("rep_of").alias("group")), "groups")
    scratch.free_all(seen, of_class)
    out = seen.join(of_class, ["hi", "lo"], "left")
    component = F.when(F.expr(usable), F.col("group")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(df: DataFrame, how: Shingling = Shingling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, one document of each group, with all their columns."""
    scratch = Scratch(df.sparkSession, "neardup")
    found = near_duplicates(df, how, id_col, text_col, scratch)
    gone = scratch.stage(found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    scratch.free_all(gone)
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    stay = plain.join(gone, plain[f"_{names.index(id_col)}"] == gone["gone_id"], "left_anti")
    return stay.toDF(*names)


def sql(how: Shingling) -> str:
    """DuckDB SQL for ``near_duplicates`` of documents: all pairs that share a shingle."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
WITH RECURSIVE words_ AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{letters}', '{letters.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
runs AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {how.words - 1}, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS pos FROM words_),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[pos : pos + {how.words - 1}], ' ') AS shingle FROM runs),
sizes AS (SELECT doc_id, count(*)::BIGINT AS n FROM shingles GROUP BY doc_id),
both_ AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_.n >= {how.percent} * (x.n + y.n - both_.n)),
sides AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, s.b FROM reached r JOIN sides s ON r.other = s.a),
groups_ AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN groups_ USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
