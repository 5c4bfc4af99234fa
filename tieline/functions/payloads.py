"""Model output to JSON objects, in Arrow batches."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F, types as T

_FENCE = re.compile(r"```(?:json)?\s*(.*?)\s*```", re.S)
_TOKEN = re.compile(r'\\.|"(?:\\.|[^"\\])*(?:"|$)|[{}]', re.S)


def _balanced(text: str) -> str | None:
    """First balanced ``{…}``; braces inside strings do not count."""
    depth, start = 0, 0
    for m in _TOKEN.finditer(text):
        mark = m.group()
        if mark == "{":
            if depth == 0:
                start = m.start()
            depth += 1
        elif mark == "}":
            depth -= 1
            if depth == 0:
                return text[start : m.end()]
    return None


def parse_object(text: str | None) -> str | None:
    """JSON text of the first object in a fenced block, else in the whole text; None when nothing parses."""
    if not text:
        return None
    fence = _FENCE.search(text)
    found = (_balanced(fence.group(1)) if fence else None) or _balanced(text)
    try:
        value = json.loads(found) if found else None
    except ValueError:
        return None
    return json.dumps(value, ensure_ascii=False) if isinstance(value, dict) else None


@F.pandas_udf(T.StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    return texts.map(parse_object, na_action="ignore")
