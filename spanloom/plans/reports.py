"""Reports of finished plans. Only aggregates reach the driver; no text, value or id is written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import errors, scoring
from ..sources import sinks
from .evaluation import Evaluation

_MOST_ROWS = 1000


def _table(title: str, df: DataFrame) -> str:
    """A small frame as a section; reports hold aggregates of at most ``_MOST_ROWS`` rows."""
    rows = df.limit(_MOST_ROWS + 1).collect()
    if len(rows) > _MOST_ROWS:
        raise ValueError(f"{title}: a report holds at most {_MOST_ROWS} rows")
    return sinks.markdown_table(title, df.columns, [tuple(r) for r in rows])


def _document(df: DataFrame, key: str) -> dict:
    return {r[key]: {c: r[c] for c in df.columns if c != key} for r in df.collect()}


def evaluation_report(run: Evaluation) -> dict[str, str]:
    """metrics.json and report.md: averages, each class, documents, validity, error groups."""
    groups = errors.error_groups(run.errors).orderBy("error_group")
    metrics = {
        "averages": _document(run.averages, "average"),
        "per_class": _document(run.per_class, "label"),
        "documents": run.documents.first().asDict(),
        "validity": run.validity.first().asDict(),
        "error_groups": _document(groups, "error_group"),
    }
    parts = [_table("Averages", run.averages), _table("Classes", run.per_class), _table("Documents", run.documents), _table("Validity", run.validity), _table("Errors", groups)]
    return {"metrics.json": sinks.pretty(metrics), "report.md": "\n".join(parts)}


def comparison_report(runs: DataFrame) -> dict[str, str]:
    """comparison.md: runs as ``scoring.ranked_candidates`` takes them, best first."""
    return {"comparison.md": _table("Runs", scoring.ranked_candidates(runs).orderBy("place"))}


def inspection_report(found: dict[str, DataFrame]) -> dict[str, str]:
    """inspection.md and summary.json of ``evaluation.inspect``: lengths, thresholds, and counts of
    duplicate groups and shared ids."""
    counts = {name: found[name].count() for name in ("exact_duplicates", "normal_duplicates", "shared_ids")}
    crossing = {f"{name}_across_splits": found[name].where("crosses").count() for name in ("exact_duplicates", "normal_duplicates")}
    summary = counts | crossing
    tables = [_table("Lengths", found["lengths"].orderBy("split")), _table("Long texts", found["thresholds"].orderBy("split"))]
    return {"summary.json": sinks.pretty(summary), "inspection.md": "\n".join([*tables, sinks.markdown_table("Duplicates", ["measure", "n"], sorted(summary.items()))])}


def validation_report(checked: DataFrame) -> dict[str, str]:
    """validation.md and validation.json of ``validation.check_records`` rows: how often each
    fault comes up. Positions in a fault are left out, so its kinds are few."""
    kinds = checked.selectExpr("explode(faults) AS fault").selectExpr("regexp_replace(fault, '[0-9]+', 'n') AS fault").groupBy("fault").count().orderBy("fault")
    totals = checked.selectExpr("count(*) AS records", "count_if(size(faults) > 0) AS faulty", "count_if(usable) AS usable").first().asDict()
    return {"validation.json": sinks.pretty(totals | {"faults": {r["fault"]: r["count"] for r in kinds.collect()}}), "validation.md": _table("Faults", kinds)}
