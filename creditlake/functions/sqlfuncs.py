"""Session-scoped SQL functions for the two heavy scalar helpers.

Python's float text (``str(x)``) and Python's ``round(x, d)`` are long
expressions.  Written once as SQL functions (``CREATE TEMPORARY FUNCTION
... RETURN <expr>``), they are inlined by the analyzer as ordinary built-in
expressions (JVM-side, no Python worker), while a DataFrame that uses them
a hundred times costs one function call each to build.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Significant digits of Java's exponent-form mantissa ('1.0E16' -> 1,
# '-1.2345E-7' -> 5), with plain string functions only (no regex).
_M = "substring_index(j, 'E', 1)"
_NDIG = (f"CASE WHEN endswith({_M}, '.0') THEN 1 "
         f"ELSE length(replace(replace({_M}, '-', ''), '.', '')) END")


def _sci(prec: str) -> str:
    return f"format_string(concat('%.', CAST({prec} AS STRING), 'E'), x)"


# Java 17's Double.toString is not always the shortest round-trip text: at
# most two digits too many have been seen (large values, subnormals), so
# the shortest exponent form is among n-2 .. n digits.
_PREC = (f"CASE WHEN n >= 3 AND try_cast({_sci('n - 3')} AS DOUBLE) = x THEN n - 3 "
         f"WHEN n >= 2 AND try_cast({_sci('n - 2')} AS DOUBLE) = x THEN n - 2 "
         f"ELSE n - 1 END")


def _java_style(t: str) -> str:
    """'%.pE' text ('-1.2300E+07', '5E-324') -> Java layout ('-1.23E7', '5.0E-324')."""
    s1 = f"regexp_replace({t}, '^(-?[0-9]+)E', '$1.0E')"
    s2 = f"regexp_replace({s1}, '0+E', 'E')"
    s3 = f"regexp_replace({s2}, '[.]E', '.0E')"
    return f"regexp_replace({s3}, 'E[+]?(-?)0*([0-9])', 'E$1$2')"


def _trim(t: str) -> str:
    """'117000000.0000000000' -> '117000000.0', '0.000290' -> '0.00029'; the
    text is made once."""
    return f"replace(replace(concat(TRIM(TRAILING '0' FROM {t}), '|'), '.|', '.0|'), '|', '')"


def _exp_form(j: str) -> str:
    """Java '1.5E-7' / '1.0E16' -> Python '1.5e-07' / '1e+16'."""
    m = f"substring_index({j}, 'E', 1)"
    e = f"CAST(substring_index({j}, 'E', -1) AS INT)"
    mant = f"CASE WHEN endswith({m}, '.0') THEN substring({m}, 1, length({m}) - 2) ELSE {m} END"
    digits = f"CASE WHEN abs({e}) < 10 THEN concat('0', CAST(abs({e}) AS STRING)) ELSE CAST(abs({e}) AS STRING) END"
    return f"concat({mant}, 'e', CASE WHEN {e} < 0 THEN '-' ELSE '+' END, {digits})"


# name -> (parameters, return type, body).  A call's arguments are computed
# once, for every row, so only cheap expressions are passed as arguments and
# the rare branches are written inline (text macros above).
FUNCTIONS = {
    # shortest text in Java layout, given Java's text j and its digit count n
    "cl_java_pick": ("x DOUBLE, j STRING, n INT", "STRING",
                     f"CASE WHEN NOT contains(j, 'E') OR (n <= 16 AND abs(x) >= 2.2250738585072014E-308) THEN j "
                     f"ELSE {_java_style(_sci(_PREC))} END"),
    "cl_java_shortest": ("x DOUBLE, j STRING", "STRING", f"cl_java_pick(x, j, {_NDIG})"),
    # Python layout from the shortest digits: plain for 1e-4 <= |d| < 1e16
    "cl_py_layout": ("d DOUBLE, j STRING", "STRING", f"""
CASE WHEN d IS NULL THEN CAST(NULL AS STRING)
     WHEN isnan(d) THEN 'nan'
     WHEN d = double('inf') THEN 'inf'
     WHEN d = double('-inf') THEN '-inf'
     WHEN d = 0 THEN j
     WHEN abs(d) >= 1e-3 AND abs(d) < 1e7 THEN j
     WHEN abs(d) >= 1e7 AND abs(d) < 9007199254740992.0 AND d = floor(d) THEN concat(CAST(CAST(d AS BIGINT) AS STRING), '.0')
     WHEN abs(d) >= 1e7 AND abs(d) < 1e16 THEN {_trim("CAST(try_cast(j AS DECIMAL(38,10)) AS STRING)")}
     WHEN abs(d) >= 1e-4 AND abs(d) < 1e-3 THEN {_trim("CAST(try_cast(j AS DECIMAL(38,28)) AS STRING)")}
     ELSE {_exp_form("j")} END"""),
    # str(float(v)): Java's text is computed once per value
    "cl_py_double_str": ("v DOUBLE", "STRING", "cl_py_layout(v, cl_java_shortest(v, CAST(v AS STRING)))"),
    # Python round(v, d) with scale = 10^d: Dekker two-product (Veltkamp
    # split) gives the exact error of v*scale, which decides the direction;
    # ties to even; the division by scale is correctly rounded.  Three nested
    # calls, so every intermediate is computed once.
    "cl_round_final": ("x DOUBLE, a DOUBLE, p DOUBLE, n DOUBLE, err DOUBLE, scale DOUBLE", "DOUBLE", """
CASE WHEN x IS NULL OR isnan(x) OR x = 0 THEN x
     ELSE (CASE WHEN x < 0 THEN -1.0 ELSE 1.0 END) *
          (CASE WHEN p >= 4503599627370496.0 THEN a
                ELSE (n + CASE WHEN (p - n - 0.5) + err > 0 THEN 1.0
                               WHEN (p - n - 0.5) + err < 0 THEN 0.0
                               WHEN n % 2.0 = 1.0 THEN 1.0 ELSE 0.0 END) / scale END) END"""),
    "cl_round_split": ("x DOUBLE, a DOUBLE, p DOUBLE, hi DOUBLE, scale DOUBLE", "DOUBLE", """
cl_round_final(x, a, p, CAST(floor(p) AS DOUBLE), (hi * scale - p) + (a - hi) * scale, scale)"""),
    "cl_round_prod": ("x DOUBLE, a DOUBLE, sp DOUBLE, scale DOUBLE", "DOUBLE",
                      "cl_round_split(x, a, a * scale, sp - (sp - a), scale)"),
    "cl_py_round": ("v DOUBLE, scale DOUBLE", "DOUBLE", "cl_round_prod(v, abs(v), abs(v) * 134217729.0, scale)"),
}

_REGISTERED: set[int] = set()


def ensure(spark: SparkSession | None = None) -> None:
    """Register the functions in ``spark`` (the active session by default)."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session")
    key = id(spark._jsparkSession)
    if key in _REGISTERED and spark.catalog.functionExists("cl_py_round"):
        return
    for name, (params, ret, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURNS {ret} RETURN {body}")
    _REGISTERED.add(key)


def call(name: str, *cols: Column) -> Column:
    ensure()
    return F.call_function(name, *cols)
