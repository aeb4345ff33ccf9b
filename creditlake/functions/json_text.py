"""JSON object text of selected columns, as Python's ``json.dumps`` writes it.

``to_json`` writes ``{"a":1}``; the reference stores ``{"a": 1}`` (", " and
": " separators) and hashes the same text with keys sorted.  The text is
built with ``concat_ws``, which skips the null entries, exactly like the
reference drops null attributes from its packs.  NaN counts as null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, FloatType, NumericType

from .pytext import py_str


# ---- fixed values: JSON's short escapes, the backslash first ----
_SHORT = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_PLAIN = r"^[\x20\x21\x23-\x5B\x5D-\x7F]*$"
_ODD = r"[^\x20-\x7F]"
_RUN = rf"[\x20-\x7F]+|{_ODD}+"


def _runs(c: Column) -> Column:
    """A text cut where characters that are written as they are and others meet."""
    return F.regexp_extract_all(c, F.lit(_RUN), F.lit(0))


def _json_string(c: Column) -> Column:
    """A JSON string as ``json.dumps`` writes it: quotes, backslashes and
    control characters escaped, every character beyond ASCII as \\uXXXX (two
    of them beyond the 16-bit range), hex digits in lower case.  Whole runs of
    such characters are written at once, from their UTF-16 units."""
    short = c
    for raw, escaped in _SHORT.items():
        short = F.replace(short, F.lit(raw), F.lit(escaped))

    def run(r: Column) -> Column:
        units = F.lower(F.hex(F.encode(r, "UTF-16BE")))
        return F.when(r.rlike(f"^{_ODD}"), F.regexp_replace(units, "(.{4})", r"\\u$1")).otherwise(r)
    body = F.when(c.rlike(_PLAIN), c).otherwise(F.array_join(F.transform(_runs(short), run), ""))
    return F.concat(F.lit('"'), body, F.lit('"'))


def _json_value(c: Column, dtype) -> Column:
    """Numbers as Python prints them, booleans in JSON, the rest as the text
    of the value.  NaN is a missing value (see ``_packed``)."""
    if isinstance(dtype, BooleanType):
        return F.when(c, F.lit("true")).otherwise(F.lit("false"))
    if isinstance(dtype, (FloatType, DoubleType)):
        text = py_str(c, dtype)
        return F.when(text == "inf", F.lit("Infinity")).when(text == "-inf", F.lit("-Infinity")).otherwise(text)
    if isinstance(dtype, NumericType) and not isinstance(dtype, DecimalType):
        return py_str(c, dtype)
    return _json_string(c.cast("string"))


def _packed(c: Column, dtype) -> Column:
    return c.isNotNull() & ~F.isnan(c) if isinstance(dtype, (FloatType, DoubleType)) else c.isNotNull()


def json_entries(fields: list[tuple[str, Column, object]]) -> list[tuple[str, Column]]:
    """(name, '"k": v') of each field, null if it is not packed."""
    return [(name, F.when(_packed(c, t), F.concat(F.lit(f'"{name}": '), _json_value(c, t)))) for name, c, t in fields]


def json_of_entries(entries: list[tuple[str, Column]], sort_keys: bool = False) -> Column:
    """The object text of entries, in given or sorted key order."""
    items = sorted(entries, key=lambda e: e[0]) if sort_keys else entries
    if not items:
        return F.lit("{}")
    return F.concat(F.lit("{"), F.concat_ws(", ", *[e for _, e in items]), F.lit("}"))


def json_object_text(fields: list[tuple[str, Column, object]], sort_keys: bool = False) -> Column:
    """'{"k": v, ...}' over the non-null fields, in given or sorted key order."""
    return json_of_entries(json_entries(fields), sort_keys)


def json_hashdiff(fields: list[tuple[str, Column, object]]) -> Column:
    """md5 of the sorted-key JSON text (the reference's ``hashdiff_json``)."""
    return F.md5(json_object_text(fields, sort_keys=True))


def json_get_double(text: Column, key: str) -> Column:
    """Read one packed attribute back as a double (``F-07``)."""
    return F.get_json_object(text, f"$.{key}").cast("double")
