"""Values from dynamic trees (JSON, YAML): dot paths, text forms, tags."""

from __future__ import annotations

import json
import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = object()


def get_path(root, path: str):
    """The value at a path such as ``a.b``, ``a[0].b`` or ``a.0.b``; MISSING if there is none."""
    if not path:
        return MISSING
    here = root
    for part in path.split("."):
        if not part:
            return MISSING
        key, bracket, rest = part.partition("[")
        if key:
            here = _step(here, key)
        while bracket and here is not MISSING:
            number, close, rest = rest.partition("]")
            here = _at(here, number) if close else MISSING
            if rest.startswith("["):
                rest = rest[1:]
            elif rest:
                key, bracket, rest = rest.partition("[")
                here = _step(here, key) if here is not MISSING else MISSING
            else:
                bracket = ""
        if here is MISSING:
            return MISSING
    return here


def _number(text: str) -> int | None:
    try:
        return int(text) if text.isascii() and "_" not in text and text == text.strip() else None
    except ValueError:
        return None


def _at(here, text: str):
    n = _number(text)
    return here[n] if isinstance(here, list) and n is not None and 0 <= n < len(here) else MISSING


def _step(here, key: str):
    if isinstance(here, list):
        return _at(here, key)
    return here.get(key, MISSING) if isinstance(here, dict) else MISSING


def stringify(value) -> str:
    """The text of a value: null is empty, lists are joined by blanks, maps are JSON, floats have no exponent."""
    if value is None or value is MISSING:
        return ""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        if value != value or value in (float("inf"), float("-inf")):
            return {"inf": "+Inf", "-inf": "-Inf"}.get(str(value), "NaN")
        return format(Decimal(repr(value)), "f").removesuffix(".0")
    if isinstance(value, int):
        return str(value)
    if isinstance(value, list):
        return " ".join(map(stringify, value))
    try:
        return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except TypeError:
        return str(value)


def to_tags(value) -> list[str] | None:
    """Tags of a list or a text; None of anything else."""
    if isinstance(value, list):
        return [s for s in (stringify(v).strip() for v in value) if s]
    return value.split() if isinstance(value, str) else None


def json_path(column: Column, path: str) -> Column:
    """A static dot path into a JSON column, by Spark's own parser: stays in the JVM.

    A part that is a number is looked up as a list's place or as a map's key, as the value has it. Null if there is nothing.
    """
    ways = [""]
    if not path:
        return F.lit(None).cast("string")
    for part in path.split("."):
        steps = re.findall(r"^[^\[\]]+|\[\d+\]", part)
        if not part or "".join(steps) != part:
            return F.lit(None).cast("string")
        for step in steps:
            if step.startswith("["):
                ways = [w + step for w in ways]
            elif step.isdigit():
                ways = [w + x for w in ways for x in (f"['{step}']", f"[{int(step)}]")]
            else:
                ways = [f"{w}['{step}']" for w in ways]
    return F.coalesce(*[F.get_json_object(column, "$" + w) for w in ways])


def split_words(column: Column) -> Column:
    """Split at blanks, tabs and line ends; no empty words."""
    return F.filter(F.split(column, "[ \t\n]+"), lambda x: x != "")


def join_tags(column: Column) -> Column:
    return F.array_join(column, " ")


def clean_tags(column: Column) -> Column:
    return F.filter(F.transform(column, lambda x: F.trim(x)), lambda x: x != "")


def merge_tags(field: Column, tags: Column) -> Column:
    """A tags field followed by the item's tags."""
    none = F.lit(None).cast("string")
    return F.concat_ws(" ", F.when(field == "", none).otherwise(field), F.when(F.size(tags) <= 0, none).otherwise(join_tags(tags)))
