"""Strict parsing of annotations and of detector responses.

Spark's own JSON readers accept trailing text and turn numbers into strings, so both parsers
are Arrow functions; they return a value or an error for each row and never fail a job.
"""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..labels import CANONICAL, ENTITY_TYPES, EXCLUDED

PARSED_ENTITIES = "struct<entities:array<struct<entity:string,types:array<string>>>,error:string>"
PARSED_RESPONSE = "struct<json_valid:boolean,schema_valid:boolean,entities:array<struct<type:string,text:string>>,error:string>"
_TYPES = frozenset(ENTITY_TYPES)


def parse_entities(value: str | None) -> tuple[list[dict] | None, str | None]:
    """(entities, None) or (None, error) of an annotation column: JSON, else a Python literal."""
    if value is None or not value.strip():
        return None, "empty"
    try:
        found = json.loads(value)
    except ValueError:
        try:
            found = ast.literal_eval(value)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            return None, "not a literal"
    if not isinstance(found, list):
        return None, "not a list"
    for k, item in enumerate(found):
        if not isinstance(item, dict) or item.keys() != {"entity", "types"}:
            return None, f"item {k}: keys"
        entity, types = item["entity"], item["types"]
        if not isinstance(entity, str) or not entity:
            return None, f"item {k}: entity"
        if not isinstance(types, list | tuple) or not types or not all(isinstance(t, str) and t for t in types):
            return None, f"item {k}: types"
    return [{"entity": x["entity"], "types": list(x["types"])} for x in found], None


def parse_response(raw: str | None) -> tuple[bool, bool, list[dict], str | None]:
    """(json_valid, schema_valid, entities, error); one bad item discards all entities."""
    if raw is None:
        return False, False, [], "not text"
    try:
        found = json.loads(raw)
    except (ValueError, RecursionError):
        return False, False, [], "not JSON"
    if not isinstance(found, dict) or found.keys() != {"entities"}:
        return True, False, [], "keys"
    items = found["entities"]
    if not isinstance(items, list):
        return True, False, [], "entities"
    for k, item in enumerate(items):
        if not isinstance(item, dict) or item.keys() != {"type", "text"}:
            return True, False, [], f"item {k}: keys"
        value, label = item["text"], item["type"]
        if not (isinstance(value, str) and value):
            return True, False, [], f"item {k}: text"
        if not (isinstance(label, str) and label in _TYPES):
            return True, False, [], f"item {k}: type"
    return True, True, [{"type": x["type"], "text": x["text"]} for x in items], None


def entities_column(value: Column) -> Column:
    @F.arrow_udf(PARSED_ENTITIES)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("entities", pa.list_(pa.struct([("entity", pa.string()), ("types", pa.list_(pa.string()))]))), ("error", pa.string())])
        for batch in batches:
            yield pa.array([dict(zip(("entities", "error"), parse_entities(x), strict=True)) for x in batch.to_pylist()], kind)

    return parsed(value)


def response_column(value: Column) -> Column:
    @F.arrow_udf(PARSED_RESPONSE)
    def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("json_valid", "schema_valid", "entities", "error")
        item = pa.list_(pa.struct([("type", pa.string()), ("text", pa.string())]))
        kind = pa.struct([("json_valid", pa.bool_()), ("schema_valid", pa.bool_()), ("entities", item), ("error", pa.string())])
        for batch in batches:
            yield pa.array([dict(zip(names, parse_response(x), strict=True)) for x in batch.to_pylist()], kind)

    return parsed(value)


def _lookup() -> Column:
    return F.create_map(*[F.lit(x) for pair in sorted(CANONICAL.items()) for x in pair])


def canonical_types(types: Column) -> Column:
    """Distinct canonical types of source labels, in the order in which they are first seen."""
    policy = _lookup()
    return F.array_distinct(F.filter(F.transform(types, lambda t: F.try_element_at(policy, t)), lambda t: t.isNotNull()))


def classification(types: Column) -> Column:
    """struct<canonical, included, excluded, unknown, ambiguous> of an annotation's labels."""
    included, excluded = sorted(CANONICAL), sorted(EXCLUDED)
    canonical = canonical_types(types)
    return F.struct(
        canonical.alias("canonical"),
        F.filter(types, lambda t: t.isin(included)).alias("included"),
        F.filter(types, lambda t: t.isin(excluded)).alias("excluded"),
        F.filter(types, lambda t: ~t.isin(included + excluded)).alias("unknown"),
        (F.size(canonical) > 1).alias("ambiguous"),
    )


def response_json(entities: Column) -> Column:
    """The compact response of (type, text) structs."""
    return F.to_json(F.struct(F.transform(entities, lambda e: F.struct(e["type"].alias("type"), e["text"].alias("text"))).alias("entities")))


def candidate_output(entities: Column) -> Column:
    """The response that annotations of one canonical type would give, in annotation order."""
    single = F.filter(entities, lambda e: F.size(canonical_types(e["types"])) == 1)
    return response_json(F.transform(single, lambda e: F.struct(F.element_at(canonical_types(e["types"]), 1).alias("type"), e["entity"].alias("text"))))
