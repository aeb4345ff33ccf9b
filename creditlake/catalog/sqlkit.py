"""Helpers that write oracle SQL (DuckDB dialect) for the registered queries.

DuckDB's ``CAST(double AS VARCHAR)`` already prints Python's ``str(float)``,
and casting through that text to DECIMAL rounds like Spark's double ->
decimal cast, so oracles use these two forms.
"""

from __future__ import annotations

from ..sources.fixtures import adapter_sql


def with_ctes(sql: str, adapters=(), **ctes: str) -> str:
    parts = [f"{n} AS ({adapter_sql(n)}\n)" for n in adapters]
    parts += [f"{n} AS ({body}\n)" for n, body in ctes.items()]
    if not parts:
        return sql
    return "WITH " + ",\n".join(parts) + "\n" + sql


def dec(expr: str, p: int, s: int) -> str:
    return f"CAST(CAST({expr} AS VARCHAR) AS DECIMAL({p},{s}))"


def txt(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


def md5_key(prefix: str, *keys: str) -> str:
    inner = " || '|' || ".join([f"'{prefix}'"] + [txt(k) for k in keys])
    return f"md5({inner})"


def hashdiff(*cols: str) -> str:
    return "md5(concat_ws('|', " + ", ".join(f"coalesce({txt(c)}, '')" for c in cols) + "))"


def json_text(fields: list[tuple[str, str]], sort_keys: bool = False) -> str:
    """fields: (name, kind) with kind 'num' or 'str'."""
    items = sorted(fields) if sort_keys else fields
    if not items:
        return "'{}'"
    ents = []
    for name, kind in items:
        val = f"to_json({name})" if kind == "str" else txt(name)
        ents.append(f"CASE WHEN {name} IS NOT NULL THEN '\"{name}\": ' || {val} END")
    return "'{' || concat_ws(', ', " + ", ".join(ents) + ") || '}'"


def reduce_cte(source: str, keys: list[str], rest: list[str]) -> str:
    """Greatest row per key (struct order, nulls lowest) as a CTE body."""
    order = ", ".join(f"{c} DESC NULLS LAST" for c in rest)
    cols = ", ".join(keys + rest)
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {', '.join(keys)} "
            f"ORDER BY {order}) AS _rn FROM {source}) WHERE _rn = 1")


LOAD_TS = "TIMESTAMP '2024-01-01 00:00:00'"
