"""One text for all forms of a JSON document, and keyed digests."""

from __future__ import annotations

import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


class _Number(str):
    """A number as it was written."""


def _refuse(name: str):
    raise ValueError(name)


def _text(value) -> str:
    if isinstance(value, _Number):
        return value
    if isinstance(value, list):
        return "[" + ",".join(map(_text, value)) + "]"
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(_text(k) + ":" + _text(value[k]) for k in keys) + "}"
    return re.sub("[\ud800-\udfff]", lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, ensure_ascii=False))


def canonical(text: str) -> str | None:
    """A document without white space, its keys in the order of their UTF-16 units and its numbers as written; the last
    of equal keys counts. Null for what is not JSON or is nested too deep for a worker's stack."""
    try:
        return _text(json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_refuse))
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    """canonical() of a column; null stays null."""
    return texts.map(canonical, na_action="ignore")


def hmac_sha256(message: Column, key: bytes) -> Column:
    """HMAC of a text under a key, in hex; null stays null. The key travels with the function and not as a literal, so no
    plan shows it."""

    @F.pandas_udf(StringType())
    def proof(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: hmac.new(key, t.encode(), "sha256").hexdigest(), na_action="ignore")

    return proof(message)
