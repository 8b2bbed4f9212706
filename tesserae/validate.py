"""Validation of inputs; every fault names its field. Limits are checked, never clamped."""
from __future__ import annotations

import datetime as dt
import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae import constants as C
from tesserae.errors import ValidationError

_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")


def limit(value, most: int, field: str = "limit") -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= most:
        raise ValidationError(field, f"{field} must be an integer from 1 to {most}")
    return value


def text(value, field: str, most: int) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValidationError(field, f"{field} must not be blank")
    if len(value) > most:
        raise ValidationError(field, f"{field} is longer than {most} characters")
    return value


def texts(value, field: str, most: int, each: int) -> list[str]:
    value = list(value or [])
    if len(value) > most:
        raise ValidationError(field, f"at most {most} {field}")
    return list(dict.fromkeys(text(v, field, each).strip() for v in value))


def uuid(value, field: str) -> str:
    low = value.lower() if isinstance(value, str) else ""
    if not _UUID.fullmatch(low):
        raise ValidationError(field, f"{field} must be a UUID")
    return low


def timestamp(value, field: str) -> dt.datetime:
    """An ISO string with an explicit offset, or an aware datetime; UTC without zone comes out."""
    if isinstance(value, str):
        if not re.search(r"(?:Z|[+-]\d{2}:\d{2})$", value):
            raise ValidationError(field, f"{field} needs an explicit offset")
        try:
            value = dt.datetime.fromisoformat(value)
        except ValueError:
            raise ValidationError(field, f"{field} is no timestamp") from None
    if not isinstance(value, dt.datetime) or value.tzinfo is None:
        raise ValidationError(field, f"{field} needs an explicit offset")
    return value.astimezone(dt.timezone.utc)


def number(value, field: str, low: float, high: float) -> float:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not math.isfinite(value) or not low <= value <= high:
        raise ValidationError(field, f"{field} must be a number from {low} to {high}")
    return float(value)


def one_of(value, field: str, allowed) -> str:
    if value not in allowed:
        raise ValidationError(field, f"{field} must be one of {', '.join(allowed)}")
    return value


def embedding(vector, dims: int, field: str = "embedding") -> list[float]:
    out = [float(x) for x in vector]
    if len(out) != dims or not all(map(math.isfinite, out)):
        raise ValidationError(field, f"{field} must hold {dims} finite numbers")
    return out


def metadata(value) -> str:
    if value is not None and not isinstance(value, dict):
        raise ValidationError("metadata", "metadata must be an object")
    try:
        return json.dumps(value or {}, sort_keys=True, allow_nan=False)
    except (TypeError, ValueError):
        raise ValidationError("metadata", "metadata must be JSON") from None


def remember(i: dict) -> dict:
    content = text(i.get("content"), "content", C.MAX_CONTENT)
    importance = i.get("importance", 3)
    limit(importance, 5, "importance")
    return {"content": content, "category": one_of(i.get("category", "general"), "category", C.CATEGORIES), "importance": importance,
            "tags": texts(i.get("tags"), "tags", C.MAX_TAGS, C.MAX_TAG), "entities": texts(i.get("entities"), "entities", C.MAX_ENTITIES, C.MAX_ENTITY),
            "source": text(i.get("source", "user"), "source", C.MAX_SOURCE), "created_at": timestamp(i["created_at"], "created_at") if i.get("created_at") is not None else None, "deduplicate": i.get("deduplicate", True)}


def faults(rows: DataFrame) -> Column:
    """Array of (field, code): every fault of a row to be loaded; the columns that rows has of content, importance,
    category, tags, entities, source and created_at are looked at. Null is a fault where a value is needed."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    blank = lambda c: F.col(c).isNull() | (F.trim(F.regexp_replace(c, r"(?U)\s+", " ")) == "")
    longest = lambda c, n: F.coalesce(F.exists(c, lambda x: F.char_length(x) > n), F.lit(False))
    empty = lambda c: F.coalesce(F.exists(c, lambda x: x.isNull() | (F.trim(x) == "")), F.lit(False))
    rules = {
        "content": [("blank", blank("content")), ("too_long", F.char_length("content") > C.MAX_CONTENT)],
        "importance": [("out_of_range", F.col("importance").isNull() | ~F.col("importance").between(1, 5))],
        "category": [("not_allowed", F.col("category").isNull() | ~F.col("category").isin(*C.CATEGORIES))],
        "tags": [("too_many", size("tags") > C.MAX_TAGS), ("too_long", longest("tags", C.MAX_TAG)), ("blank", empty("tags"))],
        "entities": [("too_many", size("entities") > C.MAX_ENTITIES), ("too_long", longest("entities", C.MAX_ENTITY)), ("blank", empty("entities"))],
        "source": [("blank", blank("source")), ("too_long", F.char_length("source") > C.MAX_SOURCE)],
        "created_at": [("missing", F.col("created_at").isNull())],
    }
    found = [F.when(bad, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"))) for field, own in rules.items() if field in rows.columns for code, bad in own]
    return F.array_compact(F.array(*found))
