"""Values that PHP serialised, as JSON: a small reader behind an Arrow batch function."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def _value(data: bytes, at: int):
    kind = data[at : at + 1]
    if kind == b"N":
        return None, at + 2
    if kind in b"bid":
        end = data.index(b";", at)
        text = data[at + 2 : end].decode()
        return {b"b": lambda: text == "1", b"i": lambda: int(text), b"d": lambda: float(text)}[kind](), end + 1
    colon = data.index(b":", at + 2)
    n = int(data[at + 2 : colon])
    if kind == b"s":
        return data[colon + 2 : colon + 2 + n].decode(errors="replace"), colon + n + 4
    if kind == b"a":
        out, at = {}, colon + 2
        for _ in range(n):
            key, at = _value(data, at)
            out[key], at = _value(data, at)
        if list(out) == list(range(n)):
            return list(out.values()), at + 1
        return {str(k): v for k, v in out.items()}, at + 1
    raise ValueError(f"unknown kind {kind!r}")


def unserialize(text: str | None):
    """The plain value; None where there is none or it is broken."""
    if not text:
        return None
    try:
        return _value(text.encode(), 0)[0]
    except (ValueError, IndexError, KeyError):
        return None


@F.pandas_udf(StringType())
def php_to_json(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if (v := unserialize(t)) is None else json.dumps(v))


def lat_lng(text: Column) -> tuple[Column, Column]:
    """Latitude and longitude of a serialised map value; null unless both are numbers."""
    found = php_to_json(text)
    lat, lng = (F.get_json_object(found, f"$.{k}").try_cast("double") for k in ("lat", "lng"))
    return F.when(lng.isNotNull(), lat), F.when(lat.isNotNull(), lng)
