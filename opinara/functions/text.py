"""Text helpers: stripping, fences, prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is stripped, ideographic and no-break spaces included.
SPACES = " \t\n\x0b\f\r\u3000\u00a0\u0085"


def strip_ws(col: Column) -> Column:
    """Strip whitespace including ideographic and no-break spaces at both ends."""
    return F.btrim(col, F.lit(SPACES))


def strip_fence(text: Column) -> Column:
    """Remove one leading and one trailing Markdown code fence."""
    body = F.regexp_replace(strip_ws(text), r"^```(?:json)?\s*", "")
    return F.regexp_replace(body, r"\s*```$", "")


def system_part(template: Column, marker: str) -> Column:
    """Template text before ``marker``, stripped; null when the marker is absent."""
    head = strip_ws(F.substring_index(template, marker, 1))
    return F.when(F.contains(template, F.lit(marker)), head)


def user_message(text: Column, before: str, after: str) -> Column:
    return F.concat(F.lit(before), text, F.lit(after))
