"""The pipeline's stages, one on another, each against a brute-force version of its own."""

import hashlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from spanloom.llm import bpe, mixing, neardup, pu_quality, repetition

SF = "/root/testdata/sf0.001"
NAMES = ["quality rules", "quality classifier", "near-duplicates", "mixing", "byte-level BPE"]
STAGES = dict(corpus_pipeline.STAGES)


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=lambda i: (i is None, i or 0))


def by_sql(docs, query):
    """What DuckDB says of a query over these documents."""
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.sql(query).df()


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "byte-level BPE":
            assert docs.columns == columns
        if name == "quality rules":
            found = by_sql(before, repetition.SQL)
            assert ids(docs) == sorted(found[found.kept].doc_id)
        if name == "quality classifier":
            model = pu_quality.fitted(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert ids(docs) == ids(pu_quality.score(before, model).where("predicted = 1"))
        if name == "near-duplicates":
            found = by_sql(before, neardup.sql(neardup.Shingling()))
            assert ids(docs) == sorted(found[found.kept].doc_id)
        if name == "mixing":
            found = by_sql(before, mixing.SQL)
            assert ids(docs) == sorted(np.repeat(found.doc_id, (found.taken / found["size"].clip(lower=1)).round().astype(int)))
        if name == "byte-level BPE":
            ranks = bpe.codec(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
            library = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(ranks.tokens) if t}, special_tokens={})
            expected = []
            for r in before.collect():
                tokens = np.array(library.encode_ordinary(r["text"] or ""), "<u4")
                expected.append((r["doc_id"], len(tokens), hashlib.sha256(tokens.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
            assert sorted(map(tuple, docs.collect())) == sorted(expected)
        kept.append(docs.count())
    assert kept[1] < kept[0] and kept[3] < kept[2]
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.collect())) == sorted(map(tuple, docs.collect()))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, clashing names."""
    plain = " ".join(f"word{i} of text{i}." for i in range(70))
    texts = [None, "", " \n", plain, plain, plain + " more", "x" * 50_000, "Another line of plain words here. " * 40, " ".join(f"w{i}" for i in range(20_000))]
    rows = [(i, t, "en", None if i % 2 else "s", None, "n", 1, True) for i, t in enumerate(texts)]
    rows += [rows[3], (None, plain, None, None, None, None, None, None), (None, plain, None, None, None, None, None, None)]
    names = "doc_id long, text string, lang string, source string, n_chars long, Text_ string, size int, kept boolean"
    return spark.createDataFrame(rows, names).withColumnRenamed("Text_", "TEXT").repartition(3)


@pytest.mark.parametrize("name", NAMES)
def test_stages_on_odd_rows(spark, odd, name):
    """Every stage takes such rows and an empty table; only encoding changes the columns."""
    got = STAGES[name](spark, odd, SF)
    assert STAGES[name](spark, odd.limit(0), SF).count() == 0
    if name == "byte-level BPE":
        assert ids(got) == ids(odd)
        return
    assert got.columns == odd.columns
    rows = sorted(map(tuple, got.collect()), key=str)
    every = sorted(map(tuple, odd.collect()), key=str)
    assert set(map(str, rows)) <= set(map(str, every))
    if name == "quality rules":
        assert [r[0] for r in rows] == [3, 3, 4, 5, 8, None, None]
    if name == "near-duplicates":  # 4 copies 3 and 5 nearly; no words, no links; a null id stays
        assert [r[0] for r in rows] == [0, 1, 2, 3, 3, 6, 7, 8, None, None]
    if name == "mixing":
        assert not {0, 1, 2} & {r[0] for r in rows}
