"""Python-style text of values (``str(v)``), as a Spark Column expression.

Hash keys and hashdiffs are md5 over ``str(value)`` as Python writes it.
Spark's own cast of a double to text uses Java notation (``1.17E8``,
``2.9E-4``), Python uses plain digits for 1e-4 <= |v| < 1e16 and a two-digit
exponent otherwise (``1e-05``, ``1e+16``).  The digits themselves agree (both
print the shortest round-trip form), so only the layout is rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, FloatType, StringType

from .sqlfuncs import call


def py_double_str(c: Column) -> Column:
    """``str(float(x))`` for a double column; null stays null.  The
    expression is the session SQL function ``cl_py_double_str``."""
    return call("cl_py_double_str", c.cast("double"))


def py_str(c: Column, dtype) -> Column:
    """Python ``str()`` of a value of Spark type ``dtype`` (null stays null)."""
    if isinstance(dtype, (DoubleType, FloatType)):
        return py_double_str(c)
    if isinstance(dtype, BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(dtype, DecimalType):
        # psycopg2 hands NUMERIC out as decimal.Decimal; str keeps the scale.
        return c.cast("string")
    if isinstance(dtype, StringType):
        return c
    return c.cast("string")
