"""Request-text parsing (P-18, P-19) as Column expressions.

A request is either a JSON object (``{"application_id": 7, "features":
{...}}``) or the short form ``7 | income=50000 | channel=web``: parts split
on '|', blanks dropped, a leading all-digit part is the application id,
``key=value`` parts are features (split on the first '=').
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python float() accepts these forms; Spark's cast would also take '1.5d'.
_NUMBER = r"^[+-]?(([0-9]+\.?[0-9]*)|(\.[0-9]+))([eE][+-]?[0-9]+)?$"


def py_float(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def _is_json_object(text: Column) -> Column:
    t = F.trim(text)
    return t.startswith("{") & F.get_json_object(t, "$").isNotNull()


def request_id(text: Column) -> Column:
    """application_id of a request (null when absent)."""
    t = F.trim(text)
    parts = _parts(t)
    pipe_id = F.when(F.get(parts, 0).rlike(r"^[0-9]+$"), F.get(parts, 0).try_cast("bigint"))
    json_id = F.get_json_object(t, "$.application_id").try_cast("bigint")
    return F.when(_is_json_object(t), json_id).otherwise(pipe_id)


def _parts(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, r"\|"), lambda p: F.trim(p)), lambda p: p != "")


def request_features(text: Column) -> Column:
    """P-18 + P-19: features as map<string,double>; null and non-numeric
    values are dropped (the reference fails the whole request on them)."""
    t = F.trim(text)
    parts = _parts(t)
    body = F.when(F.get(parts, 0).rlike(r"^[0-9]+$"), F.slice(parts, 2, 1 << 30)).otherwise(parts)
    kv = F.filter(body, lambda p: p.contains("="))
    entries = F.transform(kv, lambda p: F.struct(
        F.trim(F.substring_index(p, "=", 1)).alias("key"),
        py_float(F.substring(p, F.instr(p, "=") + 1, 1 << 30)).alias("value")))
    pipe_map = F.map_filter(F.map_from_entries(entries), lambda k, v: v.isNotNull())
    raw = F.from_json(F.get_json_object(t, "$.features"), "map<string,string>")
    json_map = F.map_filter(F.transform_values(raw, lambda k, v: py_float(v)), lambda k, v: v.isNotNull())
    empty = F.create_map().cast("map<string,double>")
    return F.when(_is_json_object(t), F.coalesce(json_map, empty)).otherwise(F.coalesce(pipe_map, empty))
