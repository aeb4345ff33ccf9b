"""Driver contract: entry runs, every query has a callable, oracles agree at sf0.001."""

import __spark_entry__ as E
import pytest

from tests.conftest import SF001

CHECKED = ["training_mart", "dv_sat_documents", "dv_sat_bureau_balance", "explain_batch", "file_features",
           "crm_upsert_score", "auc_rank", "stratified_split", "checksum", "parse_requests"]


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "sk_id_curr" in df.columns


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    import decimal
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if isinstance(v, list):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_oracle(spark, duck, name):
    sdf = E.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    s = sorted((tuple(_norm(r.asDict(recursive=True)[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = duck.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    o = sorted((tuple(_norm(dict(zip(names, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert s == o


def test_stream_equals_batch(spark):
    from pyspark.sql import functions as F
    from creditlake.sources.fixtures import staged
    from creditlake.streaming import jobs as S
    stream = E.queries()["stream_score"](spark, SF001)
    batch = S.latest_per_key(S.score_requests(staged(spark, SF001, "stream_score_request")),
                             "application_id", ["requested_at", "request_id"])
    assert stream.exceptAll(batch).count() == 0 and batch.exceptAll(stream).count() == 0
    assert F is not None
