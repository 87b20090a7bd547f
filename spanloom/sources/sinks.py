"""Sinks: canonical line files, snapshots, inventories, reports, immutable outputs."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def canonical(df: DataFrame) -> DataFrame:
    """value: one compact JSON object for each row, with sorted keys and without nulls."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Canonical lines by the text sink, whose commit makes a job's files appear together."""
    canonical(df).write.mode(mode).text(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """A columnar snapshot, a folder for each split; never over an old one."""
    df.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_labels_csv(labels: DataFrame, path: str) -> None:
    """The label inventory (a few rows), sorted, with a header."""
    labels.orderBy("label").coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def append_new(df: DataFrame, path: str, key: str = "sample_id") -> int:
    """Append the rows whose key the folder doesn't hold yet; how many. The rows are counted as
    they are written, so they are computed once."""
    spark = df.sparkSession
    try:
        df = df.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except AnalysisException as e:  # nothing was written yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    seen = Observation()
    df.observe(seen, F.count("*").alias("n")).write.mode("append").parquet(path)
    return seen.get["n"]


def pretty(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True, indent=2) + "\n"


def write_text(path: str | Path, text: str) -> None:
    """Atomic: a temporary file beside the target is renamed over it, or removed on failure."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_immutable(folder: str | Path, files: dict[str, str]) -> bool:
    """Write a bundle once. True if written, False if the same bundle is there; anything else
    there (other content, other files, links) is refused."""
    folder = Path(folder)
    if folder.is_symlink():
        raise FileExistsError("the folder is a link")
    if folder.exists():
        there = {p.name for p in folder.iterdir()}
        same = there == files.keys() and all(not (folder / n).is_symlink() and (folder / n).read_text(encoding="utf-8") == t for n, t in files.items())
        if not same:
            raise FileExistsError("another bundle is there")
        return False
    staging = Path(tempfile.mkdtemp(dir=folder.parent))
    for name, text in files.items():
        (staging / name).write_text(text, encoding="utf-8")
    staging.rename(folder)
    return True


def manifest(files: dict[str, str], **more) -> dict:
    """Digest and size of each artifact, with counts and policy versions given as ``more``."""
    return more | {"artifacts": {n: {"bytes": len(t.encode()), "sha256": hashlib.sha256(t.encode()).hexdigest()} for n, t in sorted(files.items())}}


def markdown_table(title: str, columns: list[str], rows: list[tuple]) -> str:
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(columns), line(["---"] * len(columns)), *map(line, rows), ""])


#: Characters of a corpus that the driver may hold as one string.
LARGEST_CORPUS = 64 << 20


def joined_corpus(texts: DataFrame, separator: str, most: int = LARGEST_CORPUS) -> str:
    """Texts (place, text) of a small ordered frame as one string; a larger one is refused
    before any text is fetched. ``write_corpus`` takes any size."""
    size = texts.agg(F.coalesce(F.sum(F.length("text") + len(separator)), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"a corpus of {size} characters is too large for the driver")
    return separator.join(r["text"] for r in texts.orderBy("place").select("text").collect())


def write_corpus(texts: DataFrame, separator: str, path: str) -> None:
    """Texts in order of place, each followed by the separator, as the parts of a folder: put
    together in order of their names they are the corpus."""
    texts.orderBy("place").select(F.concat("text", F.lit(separator)).alias("value")).write.mode("errorifexists").option("lineSep", "\n").text(path)
