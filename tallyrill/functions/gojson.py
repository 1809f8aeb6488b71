"""Texts of JSON values as the gateway writes them: arguments on one line, values flattened for matching."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def value_text(value: object) -> str:
    """A JSON value as matching text: numbers in shortest form, exponent from 21 digits on, lists in brackets, null as <nil>."""
    if value is None:
        return "<nil>"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        number = float(value)
        if number == 0:
            return "-0" if str(number).startswith("-") else "0"
        exponent = Decimal(repr(number)).adjusted()
        if -4 <= exponent < 21:
            plain = format(Decimal(repr(number)), "f")
            return plain.rstrip("0").rstrip(".") if "." in plain else plain
        digits = "".join(map(str, Decimal(repr(number)).normalize().as_tuple().digits))
        sign = "-" if number < 0 else ""
        return f"{sign}{digits[0]}{'.' + digits[1:] if len(digits) > 1 else ''}e{'-' if exponent < 0 else '+'}{abs(exponent):02d}"
    if isinstance(value, list):
        return "[" + " ".join(map(value_text, value)) + "]"
    if isinstance(value, dict):
        return "map[" + " ".join(f"{k}:{value_text(value[k])}" for k in sorted(value)) + "]"
    return str(value)


def flatten(arguments: dict) -> str:
    """``key: value`` lines, nested objects in place; keys are sorted, so that the text doesn't vary."""
    return "\n".join(f"{k}: {flatten(v) if isinstance(v, dict) else v if isinstance(v, str) else value_text(v)}" for k, v in sorted(arguments.items()))


def canonical(arguments: object) -> str:
    """JSON with sorted keys and without spaces, where <, >, & and the line separators are escaped."""
    text = json.dumps(arguments, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    for sign in "<>&  ":
        text = text.replace(sign, f"\\u{ord(sign):04x}")
    return text


def _object(text: str | None) -> dict | None:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        return None
    return value if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def flatten_json(arguments: pd.Series) -> pd.Series:
    """The flattened text of a JSON object; the empty string where the text is none."""
    return arguments.map(lambda t: flatten(_object(t) or {}))


@F.pandas_udf(StringType())
def canonical_json(arguments: pd.Series) -> pd.Series:
    """The canonical text of a JSON object; null where the text is none."""
    return arguments.map(lambda t: None if (v := _object(t)) is None else canonical(v))
