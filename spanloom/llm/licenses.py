"""License scans on JVM expressions only.

Words are lower-case runs of letters and digits, joined by inner dots or hyphens; shingles are
hashes of five words. Templates fall into classes by their number of shingles m: class c has
m in [2^c, 2^(c+1)). For each class a text is cut into overlapping windows of 2^(c+1) + s
shingles with a stride s of max(1, 2^(c-1)), so that every run of up to 2^(c+1) shingles lies
whole in some window. Window and template then have a Jaccard similarity of at least

    0.8 * 2^c / (2^(c+1) + s + 0.2 * 2^c)  >=  0.29

when the window holds 0.8 of the template. With BANDS = 24 bands of one row each, their
MinHash signatures meet with probability 1 - (1 - 0.29)^24 > 0.9997; neighbouring windows give
further chances. What meets is verified by exact containment of the template's shingles.

Only windows that hold a shingle of some template are hashed: any other has containment 0. And
only texts with a cue word are cut into shingles: cue words are chosen so that more than 0.2 of
each template's shingles hold one, so a text without any contains less than 0.8 of a template.

A template under five words has one shingle, of all its words, and the windows of class 0 over
shingles of that length; it is found by comparing the words, without MinHash. A template without
any word is refused.

Defined cases: null and empty texts match nothing, texts under five words only such short
templates; repeated rows with
one id are one document; a row with a null id is scanned and reported with that id; ties
between windows go to the first one; an empty table gives an empty table; other columns are
ignored; a text is never cut short.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, pick
from .license_texts import SHORT_NOTICES, TEMPLATES

SHINGLE_WORDS = 5
CONTAINED = 0.8
BANDS = 24
#: Template shingles that a plan may hold as constants, and bytes of templates by band to broadcast;
#: a larger library is joined.
MOST_CONSTANTS, MOST_BROADCAST = 20_000, 64 << 20
#: Window starts of a block: texts are cut into blocks that overlap by the longest window.
BLOCK = 1024
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"


def words_of(lowered: str) -> Column:
    return F.regexp_extract_all(F.col(lowered), F.lit(WORD), F.lit(0))


def with_keys(df: DataFrame, lowered: str = "lowered") -> DataFrame:
    """Adds keys: hashes of the runs of five words of a lower-case text without nulls, in order."""
    df = held(df, "words", words_of(lowered))
    runs = F.transform(
        F.slice("words", F.lit(1), F.greatest(F.size("words") - (SHINGLE_WORDS - 1), F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get("words", i + k) for k in range(1, SHINGLE_WORDS)]),
    )
    return held(df, "keys", runs).drop("words", lowered)


def window_plan(classes: set[int]) -> list[tuple[int, int, int]]:
    """(class, window length, stride) of each class that a template has."""
    stride = lambda c: max(1, (1 << c) >> 1)
    return [(c, (1 << (c + 1)) + stride(c), stride(c)) for c in sorted(classes or {0})]


def template_rows(spark: SparkSession, templates: dict[str, str]) -> tuple[list[tuple[str, int, list[int]]], list[str]]:
    """(name, class, distinct shingle keys) of each template of at least five words, and their
    cue words. The templates are a constant of the code, so this is a few thousand values."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", F.lower("text").alias("lowered"))
    keyed = with_keys(rows.withColumn("said", words_of("lowered"))).select("license", "said", F.array_distinct("keys").alias("keys")).collect()
    known = [r for r in keyed if r["keys"]]
    return [(r["license"], len(r["keys"]).bit_length() - 1, list(r["keys"])) for r in known], cue_words([list(r["said"]) for r in known])


def short_rows(spark: SparkSession, templates: dict[str, str]) -> dict[str, list[str]]:
    """The words of each template under a shingle's length. One without words can't be found."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, text string").select("license", F.lower("text").alias("lowered"))
    said = {r["license"]: list(r["words"]) for r in rows.select("license", words_of("lowered").alias("words")).collect()}
    if empty := [name for name, words in said.items() if not words]:
        raise ValueError(f"templates without a word: {', '.join(empty)}")
    return {name: words for name, words in said.items() if len(words) < SHINGLE_WORDS}


def short_matches(texts: DataFrame, short: dict[str, list[str]]) -> DataFrame:
    """doc_id, license, containment, at of the texts (doc_id, lowered) that hold a short template."""
    cues = [F.contains("lowered", F.lit(max(words, key=len))) for words in short.values()]
    said = held(texts.where(reduce(or_, cues)), "words", words_of("lowered")).drop("lowered")

    def first(words: list[str]) -> Column:
        """Place of the first run of these words, from 1; 0 without one."""
        starts = F.slice("words", F.lit(1), F.greatest(F.size("words") - (len(words) - 1), F.lit(0)))
        same = lambda w, i: reduce(and_, (F.get("words", i + k) == x for k, x in enumerate(words[1:], 1)), w == words[0])
        return F.array_position(F.transform(starts, same), True)

    found = F.array(*[F.struct(F.lit(name).alias("license"), first(words).alias("place")) for name, words in sorted(short.items())])
    (_, length, _), = window_plan({0})
    at = F.greatest(F.col("f.place") - length, F.lit(0)).cast("int").alias("at")
    return said.select("doc_id", F.explode(found).alias("f")).where("f.place > 0").select("doc_id", "f.license", F.lit(1.0).alias("containment"), at)


def cue_words(texts: list[list[str]]) -> list[str]:
    """A few words, long ones first, such that a text without any of them can't hold CONTAINED
    of the shingles of one of these texts."""
    left = [{tuple(w[i : i + SHINGLE_WORDS]) for i in range(len(w) - SHINGLE_WORDS + 1)} for w in texts]
    sizes = [len(x) for x in left]
    chosen: list[str] = []
    while open_ := [k for k, x in enumerate(left) if len(x) / sizes[k] >= CONTAINED]:
        worth: Counter[tuple[bool, str]] = Counter()
        for k in open_:
            for word, n in Counter(w for shingle in left[k] for w in set(shingle)).items():
                worth[len(word) >= 6, word] += min(n / sizes[k], 1.0 - CONTAINED)
        chosen.append(max(worth, key=lambda x: (x[0], worth[x], x[1]))[1])
        left = [{shingle for shingle in x if chosen[-1] not in shingle} for x in left]
    return chosen


def with_own(docs: DataFrame, words: list[int]) -> DataFrame:
    """Adds own: the template shingles among a document's keys, for documents that have any."""
    known = docs.sparkSession.createDataFrame([(w,) for w in words], "key long")
    hits = docs.select("doc_id", F.explode(F.array_distinct("keys")).alias("key")).join(known, "key")
    held_ = hits.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("key").alias("own"))
    return docs.join(held_, F.col("doc_id").eqNullSafe(F.col("id"))).drop("id")


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, containment (of the license's shingles in the best window), first_word
    (of the first window that reaches it, from 0), for each license found in a document."""
    spark = df.sparkSession
    short = short_rows(spark, templates)
    known, cues = template_rows(spark, templates)
    words = sorted({k for _, _, keys in known for k in keys})
    few = len(words) <= MOST_CONSTANTS
    # a hash set of constants, or the template shingles that the document holds
    of_template = lambda key: key.isin(words) if few else F.array_contains("own", key)

    texts = held(pick(df, doc_id=id_col, text=text_col).where("text is not null"), "lowered", F.lower("text")).drop("text")
    cued = texts.where(reduce(or_, (F.contains("lowered", F.lit(w)) for w in cues), F.lit(False)))
    docs = with_keys(cued)
    docs = (docs if few else with_own(docs, words)).where(F.exists("keys", of_template))
    own = [] if few else ["own"]

    # blocks of bounded size, so that a row never carries a long text's keys into its windows
    plan = window_plan({c for _, c, _ in known})
    longest = max((length for _, length, _ in plan), default=0)
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("keys") - 1) / BLOCK).cast("int")),
        lambda k: F.struct((k * BLOCK).alias("base"), F.slice("keys", k * BLOCK + 1, F.lit(BLOCK + longest)).alias("keys")),
    )
    blocks = docs.select("doc_id", *own, F.explode(parts).alias("block")).select("doc_id", *own, "block.base", "block.keys")
    found = F.filter(F.transform("keys", lambda key, i: F.when(of_template(key), i + F.col("base"))), lambda i: i.isNotNull())
    blocks = held(blocks.where(F.exists("keys", of_template)), "found", found)

    def starts(length: int, stride: int) -> Column:
        """Of the windows that hold a template shingle, the starts that lie in the block."""
        around = F.flatten(
            F.transform(
                "found",
                lambda i: F.sequence(F.greatest(F.ceil((i - (length - 1)) / stride), F.lit(0)).cast("int"), F.floor(i / stride).cast("int")),
            )
        )
        at = F.transform(F.array_distinct(around), lambda k: k * stride)
        return F.filter(at, lambda x: (x >= F.col("base")) & (x < F.col("base") + BLOCK))

    def of_class(c: int, length: int, stride: int) -> Column:
        window = lambda at: F.array_distinct(F.slice("keys", at - F.col("base") + 1, F.lit(length)))
        return F.transform(starts(length, stride), lambda at: F.struct(F.lit(c).alias("class"), at.alias("at"), window(at).alias("window")))

    classes = F.flatten(F.array(*[of_class(*p) for p in plan]))
    windows = blocks.select("doc_id", F.explode(classes).alias("w")).select("doc_id", "w.class", "w.at", "w.window")

    def bands(keys: Column) -> Column:
        def least(b: int) -> Column:
            return F.array_min(F.transform(keys, lambda k: F.xxhash64(k, F.lit(b))))

        return F.array(*map(least, range(BANDS)))

    rows = spark.createDataFrame(known or [("", 0, [])], "license string, class int, keys array<long>").where("size(keys) > 0")
    sides = rows.select("license", "class", F.col("keys").alias("template"), F.posexplode(bands(F.col("keys"))).alias("band", "low"))
    if 8 * BANDS * sum(len(keys) for _, _, keys in known) <= MOST_BROADCAST:
        sides = F.broadcast(sides)
    met = (
        windows.select("doc_id", "class", "at", "window", F.posexplode(bands(F.col("window"))).alias("band", "low"))
        .join(sides, ["class", "band", "low"])
        .withColumn("containment", F.size(F.array_intersect("window", "template")) / F.size("template"))
        .where(F.col("containment") >= CONTAINED)
    )
    if short:
        met = met.select("doc_id", "license", "containment", "at").unionByName(short_matches(texts, short))
    best = F.max_by(F.struct("containment", "at"), F.struct(F.col("containment"), -F.col("at"))).alias("best")
    return met.groupBy("doc_id", "license").agg(best).select("doc_id", "license", F.col("best.containment").alias("containment"), F.col("best.at").cast("long").alias("first_word"))


_QUOTED = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))


def _keys_sql(name: str, rows: str) -> str:
    return rf"""
    SELECT {name}, unnest(range(1, len(w) - {SHINGLE_WORDS - 2})) AS pos, array_to_string(w[pos : pos + {SHINGLE_WORDS - 1}], ' ') AS key
    FROM (SELECT {name}, regexp_extract_all(lower(text), '{WORD}') AS w FROM {rows}) WHERE len(w) >= {SHINGLE_WORDS}"""


#: All windows of all templates, without MinHash.
SQL = rf"""
WITH templates(license, text) AS (VALUES {_QUOTED}),
known AS (SELECT DISTINCT license, key FROM ({_keys_sql("license", "templates")})),
classed AS (SELECT license, count(*) AS m, floor(log2(count(*)) + 1e-9)::INT AS c FROM known GROUP BY license),
shaped AS (SELECT *, greatest(1, (1 << c) // 2) AS stride, (1 << (c + 1)) + greatest(1, (1 << c) // 2) AS length FROM classed),
keys AS (SELECT doc_id, pos - 1 AS pos, key FROM ({_keys_sql("doc_id", "documents")})),
hits AS (SELECT k.doc_id, s.license, s.m, s.stride, s.length, k.pos, k.key FROM keys k JOIN known USING (key) JOIN shaped s USING (license)),
windows AS (
  SELECT doc_id, license, m, key, stride * unnest(range(greatest(0, ceil((pos - length + 1) / stride)::BIGINT), pos // stride + 1)) AS first_word FROM hits),
held AS (
  SELECT doc_id, license, first_word::BIGINT AS first_word, count(DISTINCT key)::DOUBLE / m AS containment FROM windows
  GROUP BY doc_id, license, m, first_word HAVING count(DISTINCT key)::DOUBLE / m >= {CONTAINED})
SELECT doc_id, license, containment, first_word FROM held
QUALIFY row_number() OVER (PARTITION BY doc_id, license ORDER BY containment DESC, first_word) = 1
"""

#: The short notices by comparing runs of words.
SHORT_SQL = rf"""
WITH said AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents),
notices AS (SELECT license, regexp_extract_all(lower(text), '{WORD}') AS t FROM (VALUES {", ".join(f"('{name}', '{text}')" for name, text in sorted(SHORT_NOTICES.items()))}) v(license, text)),
runs AS (SELECT doc_id, license, w, t, unnest(range(len(w) - len(t) + 1)) AS pos FROM said, notices)
SELECT doc_id, license, 1.0::DOUBLE AS containment, greatest(min(pos) - 2, 0)::BIGINT AS first_word FROM runs WHERE w[pos + 1 : pos + len(t)] = t GROUP BY doc_id, license
"""
