"""Changes to JSON payloads that Spark has no function for."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the greatest size of a payload in bytes.
MAX_PAYLOAD_BYTES = 64 * 1024


def merged(target, patch):
    """JSON merge patch: null removes a key, objects merge, anything else replaces."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for key, value in patch.items():
        if value is None:
            out.pop(key, None)
        else:
            out[key] = merged(out.get(key), value)
    return out


def _text(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


@F.pandas_udf(StringType())
def _merge(documents: pd.Series, patches: pd.Series) -> pd.Series:
    return pd.Series([_text(merged(json.loads(d or "{}"), json.loads(p))) if p is not None else d for d, p in zip(documents, patches)], dtype=object)


def merge_patch(document: Column, patch: Column) -> Column:
    """``document`` (null counts as {}) with an RFC 7396 patch; a null patch changes nothing."""
    return _merge(document, patch)


def delete_keys(document: Column, keys: list[str]) -> Column:
    """``document`` without these top-level keys, which aren't paths; those that it lacks don't matter."""
    return _merge(document, F.lit(json.dumps(dict.fromkeys(keys))))


def payload_error(payload: Column) -> Column:
    """Why a payload can't be stored: not a JSON object, or too large. Null if it can."""
    parsed = F.try_parse_json(payload)
    return (
        F.when(payload.isNull(), F.lit(None).cast("string"))
        .when(F.octet_length(payload) > MAX_PAYLOAD_BYTES, F.lit(f"payload exceeds {MAX_PAYLOAD_BYTES} bytes"))
        .when(parsed.isNull(), F.lit("payload isn't JSON"))
        .when(~F.schema_of_variant(parsed).startswith("OBJECT<"), F.lit("payload must be an object"))
    )
