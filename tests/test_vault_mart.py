"""Vault invariants (key uniqueness, idempotent reload, change detection,
orphans) and training-mart row conservation."""

from pyspark.sql import functions as F

from creditlake.operators.vault import changed_rows, current_rows, insert_new, reduce_to_key
from creditlake.plans import mart as M
from creditlake.plans import vault_specs as V
from creditlake.plans.vault_load import LOAD_DTS, SECOND_LOAD_DTS, staged_dataset, vault_tables
from tests.conftest import SF001


def test_hub_keys_unique_and_reload_is_noop(spark):
    v = vault_tables(spark, SF001)
    hub = v["dv_hub_application"]
    assert hub.count() == hub.select("hk_application").distinct().count()
    again = vault_tables(spark, SF001, SECOND_LOAD_DTS)["dv_hub_application"]
    assert insert_new(again, hub, "hk_application").count() == 0


def test_change_detection_finds_only_changed(spark):
    from creditlake.operators.vault import sat_frame
    app = staged_dataset(spark, SF001, "stg_application")
    first = sat_frame(app, V.SAT_CONTRACT, "2024-01-01 00:00:00")
    changed = app.withColumn("amt_credit", F.when(F.col("sk_id_curr") == 3, F.lit(1.0)).otherwise(F.col("amt_credit")))
    second = sat_frame(changed, V.SAT_CONTRACT, SECOND_LOAD_DTS)
    diff = changed_rows(second, first, ["hk_application"])
    assert diff.count() == 1
    history = first.unionByName(second)            # mode "always": every offered row appended
    cur = current_rows(history, ["hk_application"])
    assert cur.count() == first.count()
    assert cur.where(F.col("load_dts") != F.lit(SECOND_LOAD_DTS).cast("timestamp_ntz")).count() == 0


def test_reduce_to_key_is_order_free(spark):
    df = spark.createDataFrame([(1, 1, "A"), (1, 1, "C"), (1, 1, None), (2, 1, None)], "k long, m int, s string")
    got = sorted(tuple(r) for r in reduce_to_key(df, ["k", "m"]).collect())
    assert got == [(1, 1, "C"), (2, 1, None)]
    got2 = sorted(tuple(r) for r in reduce_to_key(df.orderBy(F.desc("s")), ["k", "m"]).collect())
    assert got == got2


def test_mart_one_row_per_application(spark):
    v = vault_tables(spark, SF001)
    mart = M.training_mart(v)
    n_hub = v["dv_hub_application"].count()
    assert mart.count() == n_hub
    assert mart.select("sk_id_curr").distinct().count() == n_hub
    assert [c for c, _ in M.MART_COLUMNS] == mart.columns[:len(M.MART_COLUMNS)]


def test_satellites_unique_per_key(spark):
    v = vault_tables(spark, SF001)
    for spec in (V.SAT_BUREAU_BALANCE, V.SAT_POS, V.SAT_CARD, V.SAT_INSTALLMENT, V.SAT_CONTRACT):
        sat = v[spec.table]
        keys = spec.key_columns + ["load_dts"]
        assert sat.count() == sat.select(*keys).distinct().count(), spec.table


def test_versioned_upsert_and_fallback(spark, tmp_path):
    from creditlake.sources import sinks
    from creditlake.sources.synthetic import training_source
    root = str(tmp_path / "scores")
    b1 = spark.createDataFrame([(1, 0.2, 1), (2, 0.4, 1)], "k int, p double, ts int")
    b2 = spark.createDataFrame([(2, 0.9, 2), (3, 0.1, 2)], "k int, p double, ts int")
    sinks.upsert_versioned(spark, b1, root, "k", "ts")
    sinks.upsert_versioned(spark, b2, root, "k", "ts")
    cur = {r.k: r.p for r in sinks.read_current(spark, root).collect()}
    assert cur == {1: 0.2, 2: 0.9, 3: 0.1}
    assert sinks.versions(spark, root) == [0, 1]
    syn = training_source(spark, str(tmp_path / "missing"))
    assert syn.count() == 1000 and syn.select("sk_id_curr").distinct().count() == 1000
    assert syn.exceptAll(training_source(spark, None)).count() == 0


def test_bucketed_vault_mart_joins_without_shuffle(spark, tmp_path):
    from creditlake.plans.vault_load import read_vault_tables, write_vault_bucketed
    v = vault_tables(spark, SF001)
    write_vault_bucketed(spark, {k: v[k] for k in v}, str(tmp_path / "vault"), 8, database="cl_test_vault")
    write_vault_bucketed(spark, {k: v[k] for k in v}, str(tmp_path / "vault"), 8, database="cl_test_vault")
    stored = read_vault_tables(spark, "cl_test_vault")
    assert stored["dv_hub_application"].count() == v["dv_hub_application"].count()   # retry: no duplicates
    lazy = M.training_mart(v)
    mart = M.training_mart(stored)
    assert mart.exceptAll(lazy).count() == 0 and lazy.exceptAll(mart).count() == 0
    old = (spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = mart._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old[0])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old[1])
    # only the small per-application aggregate exchanges remain (2 per child table)
    shuffled = [l for l in plan.split("\n") if "Exchange hashpartitioning" in l]
    assert len(shuffled) <= 10 and all("hk_application" in l for l in shuffled)


def test_file_vault_load_is_idempotent_and_keeps_history(spark, tmp_path):
    from creditlake.plans.vault_load import read_vault, write_vault
    root = str(tmp_path / "dv")
    names = ["dv_hub_bureau_credit", "dv_link_application_bureau", "dv_sat_bureau_credit"]
    v1 = vault_tables(spark, SF001)
    write_vault({n: v1[n] for n in names}, root)
    write_vault({n: v1[n] for n in names}, root)                     # retry of the same load
    v2 = vault_tables(spark, SF001, SECOND_LOAD_DTS)
    write_vault({n: v2[n] for n in names}, root, SECOND_LOAD_DTS)    # a later load
    stored = read_vault(spark, root, names)
    sat = stored["dv_sat_bureau_credit"]
    n1 = v1["dv_sat_bureau_credit"].count()
    assert sat.count() == 2 * n1
    assert current_rows(sat, ["hk_bureau_credit"]).count() == n1


def test_second_load_keeps_history_and_unique_keys(spark, tmp_path):
    """First a part of the applications, then all of them at a later date, in
    both layouts: both loads stay, hubs and mart have one row per key."""
    from creditlake.plans.vault_load import read_vault, read_vault_tables, write_vault, write_vault_bucketed
    names = ["dv_hub_application", "dv_sat_app_contract"]
    early, late = vault_tables(spark, SF001), vault_tables(spark, SF001, SECOND_LOAD_DTS)
    part = {n: early[n].where("hk_application < '8'") for n in names}
    n_part, n_all = part[names[0]].count(), late[names[0]].count()
    assert 0 < n_part < n_all
    whole = {n: late[n] for n in names}
    files, database = str(tmp_path / "files"), "cl_test_reload"
    for write in (lambda t, d: write_vault(t, files, d),
                  lambda t, d: write_vault_bucketed(spark, t, str(tmp_path / "buckets"), 4, database, d)):
        assert write(part, LOAD_DTS) == {n: (n_part, n_part) for n in names}
        for _ in range(2):                                   # the second time is a retry
            assert write(whole, SECOND_LOAD_DTS) == {names[0]: (n_all, n_all - n_part), names[1]: (n_all, n_all)}
    for stored in (read_vault(spark, files, names), read_vault_tables(spark, database)):
        assert stored[names[0]].count() == stored[names[0]].select("hk_application").distinct().count() == n_all
        assert {r.load_dts.month: r["count"] for r in stored[names[1]].groupBy("load_dts").count().collect()} == {1: n_part, 2: n_all}


def test_reduced_satellites_are_shuffled_once(spark):
    """Reducing a load, picking versions and grouping by the parent's key share one shuffle."""
    from creditlake.operators.vault import current_rows
    from creditlake.plans import vault_specs as V
    from creditlake.plans.vault_load import multi_active_targets
    rows = spark.createDataFrame([(1, 7, -1, 3.0, "A"), (1, 7, -1, 2.0, "A"), (2, 7, -1, None, None), (None, 7, -2, 1.0, "B")],
                                 "sk_id_prev bigint, sk_id_curr bigint, months_balance int, cnt_instalment double, name_contract_status string")
    per_loan = current_rows(multi_active_targets(rows, V.SAT_POS), V.SAT_POS.key_columns).groupBy("hk_prev_application").count()
    assert sorted(r["count"] for r in per_loan.collect()) == [1, 1]
    assert per_loan._jdf.queryExecution().sparkPlan().toString().count("Exchange") <= 1
    plan = per_loan._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_links_are_one_row_per_pair_and_dealt_by_the_child(spark):
    from creditlake.operators.vault import link_frame
    from creditlake.plans import vault_specs as V
    rows = spark.createDataFrame([(1, 7), (1, 7), (2, 7), (2, None), (None, 7)], "sk_id_prev bigint, sk_id_curr bigint")
    links = link_frame(rows, V.LINK_APP_PREV, "2024-01-01 00:00:00")
    assert len(links.collect()) == 2
    per_loan = links.groupBy("hk_prev_application").count()
    # the distinct pairs, and the deal by the loan's key; none for the group
    assert per_loan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 2


def test_child_tables_are_aggregated_once_for_both_frames(spark):
    from pyspark.sql import functions as F

    from creditlake.plans.file_features import file_features
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return x
    row = counted.asNondeterministic()(F.col("amt"))
    app = spark.createDataFrame([(1, 0, "a"), (2, 1, None)], "sk_id_curr bigint, target int, kind string")
    child = spark.createDataFrame([(k, 5, 1.5, "x") for k in (1, 1, 2, 3)], "sk_id_curr bigint, sk_id_bureau bigint, amt double, status string")
    other = child.select("sk_id_curr", F.col("sk_id_bureau").alias("sk_id_prev"), "amt", F.col("status").alias("name_contract_status"))
    train, test = file_features(app, app.drop("target"), child.withColumn("amt", row), other, other, other)
    assert sorted(r["bureau_amt"] for r in train.collect()) == sorted(r["bureau_amt"] for r in test.collect()) == [1.5, 1.5]
    assert seen.value == 4


def test_rows_of_child_tables_are_shuffled_once_and_not_as_sums(spark):
    from creditlake.operators.features import child_aggregate
    rows = [(1, 5, 1.5, 2, "x"), (1, 6, 2.5, None, None), (1, 6, float("nan"), 4, "x"), (2, 7, None, 1, "y"), (None, 8, 9.0, 9, "z")]
    child = spark.createDataFrame(rows, "sk_id_curr bigint, sk_id_prev bigint, amt double, n int, status string")
    out = child_aggregate(child.repartition(3), "sk_id_curr", ["sk_id_prev"], ["status"], "c", lambda c: "nunique_status")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan[plan.index("Exchange hashpartitioning(sk_id_curr"):]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(sk_id_curr") == 1
    got = {r["sk_id_curr"]: (r["c_amt"], r["c_n"], r["c_nunique_status"]) for r in out.collect()}
    assert got == {1: (2.0, 3.0, 2.0), 2: (None, 1.0, 1.0)}
