"""JSON_EXTRACT and JSON_SET over JSON text.

Paths name object keys only (``$.a.b``).  JSON_EXTRACT is the JVM's own JSON and variant functions; JSON_SET gives
compact text with sorted keys, which an Arrow UDF makes."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def keys(path: str) -> list[str]:
    return path[2:].split(".") if path.startswith("$.") else []


def _quoted(path: str) -> str:
    return "$" + "".join("['" + k.replace("'", "\\'") + "']" for k in keys(path))


def compact(v) -> str:
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def _load(doc):
    try:
        return json.loads(doc) if isinstance(doc, str) else None
    except ValueError:
        return None


def _at(v, path: str):
    for k in keys(path):
        if not isinstance(v, dict) or k not in v:
            return None
        v = v[k]
    return v


def extract_value(doc: str | None, path: str):
    """Text, an integer, a boolean, NULL, or compact text for other values."""
    v = _at(_load(doc), path)
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, int) and -(2**63) <= v < 2**63:
        return v
    return compact(v)


def put_value(doc: str | None, path: str, new) -> str | None:
    root = _load(doc)
    if not isinstance(root, dict):
        return None
    at, ks = root, keys(path)
    if not ks:
        return None
    for k in ks[:-1]:
        at = at.setdefault(k, {})
        if not isinstance(at, dict):
            return None
    at[ks[-1]] = new
    return compact(root)


def extract(doc: Column, path: str) -> Column:
    """The value as text, wholly in the JVM: scalars as they stand, objects and arrays as compact text with sorted keys."""
    raw = F.get_json_object(doc, _quoted(path))
    v = F.variant_get(F.try_parse_json(doc), _variant(path), "variant")
    # a text that only looks like an object stays as it is
    nested = raw.rlike(r"^\s*[\[{]") & F.coalesce(~(F.schema_of_variant(v) == "STRING"), F.lit(False))
    return F.when(nested, F.to_json(v)).otherwise(raw)


def kind(doc: Column, path: str) -> Column:
    """INT, BOOL or TEXT (all else); NULL where there is no value."""
    found = F.schema_of_variant(F.variant_get(F.try_parse_json(doc), _variant(path), "variant"))
    return F.when(found == "BIGINT", "INT").when(found == "BOOLEAN", "BOOL").when(found != "VOID", "TEXT")


def _variant(path: str) -> str:
    return "$" + "".join('["' + k.replace('"', '\\"') + '"]' for k in keys(path))


def extract_as(doc: Column, path: str, kind: str) -> Column:
    """The value where it has the type, NULL elsewhere."""
    v = F.variant_get(F.try_parse_json(doc), _variant(path), "variant")
    found = F.schema_of_variant(v)
    if kind == "INT":
        return F.when(found.eqNullSafe(F.lit("BIGINT")), F.try_variant_get(v, "$", "bigint"))
    if kind == "BOOL":
        return F.when(found.eqNullSafe(F.lit("BOOLEAN")), F.try_variant_get(v, "$", "boolean"))
    return F.when(~(found.eqNullSafe(F.lit("BIGINT")) | found.eqNullSafe(F.lit("BOOLEAN"))), extract(doc, path))


def encode(t) -> Column:
    """A typed value as a JSON literal."""
    c = t.column
    if t.type in ("INT", "BOOL", "DOUBLE"):
        text = c.cast("string")
    elif t.type == "NULL":
        return F.lit("null")
    else:
        quoted = F.to_json(F.struct(c.alias("v")))
        text = F.when(c.isNotNull(), F.regexp_replace(F.substring(quoted, 6, 2**31 - 1), r"\}$", ""))
    return F.coalesce(text, F.lit("null"))


def put(doc: Column, path: str, new: Column) -> Column:
    """JSON_SET; ``new`` is a JSON literal."""

    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([put_value(d, path, _load(v)) for d, v in zip(docs, values, strict=True)], dtype=object)

    run.__annotations__ = {"docs": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(doc, new)


def valid(doc: Column) -> Column:
    return doc.isNull() | F.try_parse_json(doc).isNotNull()
