"""Data Vault hash keys and hashdiffs as Column expressions.

Fixed values that must equal the reference for identical keys:
  hub prefixes   'application', 'bureau', 'prev_application'
  link prefixes  'link_app_bureau', 'link_app_prev'
  separator      '|'
  digest         lower-case hex md5 of the UTF-8 text
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import py_str

# ---- fixed values (must match the reference byte for byte) ----
HUB_PREFIX_APPLICATION = "application"
HUB_PREFIX_BUREAU = "bureau"
HUB_PREFIX_PREV_APPLICATION = "prev_application"
LINK_PREFIX_APP_BUREAU = "link_app_bureau"
LINK_PREFIX_APP_PREV = "link_app_prev"
SEPARATOR = "|"


def _key_text(c: Column) -> Column:
    # business keys are integers; text as Python writes an int
    return c.cast("string")


def hash_key(prefix: str, *keys: Column) -> Column:
    """md5('prefix|k1|k2...'); null when any key is null."""
    parts = [F.lit(prefix)] + [_key_text(k) for k in keys]
    return F.when(_all_not_null(keys), F.md5(F.concat_ws(SEPARATOR, *parts)))


def _all_not_null(keys) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & k.isNotNull()
    return cond


def hk_application(sk_id_curr: Column) -> Column:
    return hash_key(HUB_PREFIX_APPLICATION, sk_id_curr)


def hk_bureau_credit(sk_id_bureau: Column) -> Column:
    return hash_key(HUB_PREFIX_BUREAU, sk_id_bureau)


def hk_prev_application(sk_id_prev: Column) -> Column:
    return hash_key(HUB_PREFIX_PREV_APPLICATION, sk_id_prev)


def hk_link_application_bureau(sk_id_curr: Column, sk_id_bureau: Column) -> Column:
    return hash_key(LINK_PREFIX_APP_BUREAU, sk_id_curr, sk_id_bureau)


def hk_link_application_prev(sk_id_curr: Column, sk_id_prev: Column) -> Column:
    return hash_key(LINK_PREFIX_APP_PREV, sk_id_curr, sk_id_prev)


def hashdiff(parts: list[tuple[Column, object]]) -> Column:
    """md5 of the '|'-joined Python text of each part, null as ''.

    ``parts`` is a list of (column, spark data type).  ``concat_ws`` would drop
    nulls entirely, so every part is coalesced to '' first.
    """
    texts = [F.coalesce(py_str(c, t), F.lit("")) for c, t in parts]
    return F.md5(F.concat_ws(SEPARATOR, *texts))


def hashdiff_of_texts(texts: list[Column]) -> Column:
    """Same digest from parts already rendered as Python text."""
    return F.md5(F.concat_ws(SEPARATOR, *[F.coalesce(t, F.lit("")) for t in texts]))
