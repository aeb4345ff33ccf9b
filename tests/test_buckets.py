"""Bucketed tables, snapshots and loads in any order."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from creditlake.operators.vault import changed_rows, current_rows
from creditlake.plans import mart as M
from creditlake.plans.vault_load import (
    LOAD_DTS, SECOND_LOAD_DTS, read_vault, read_vault_current, vault_tables, write_vault,
)
from creditlake.sources import buckets
from tests.conftest import SF001

#: files of shuffles that a session holds
def shuffle_files(spark):
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}


SCHEMA = "k string, ts int, v string"


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def live(spark, root):
    """Files of the current version."""
    table = buckets.read(spark, root)
    return {f.removeprefix("file://").removeprefix("file:") for f in table.inputFiles()} if table is not None else set()


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    assert buckets.read(spark, root) is None
    first = spark.createDataFrame([(f"k{i}", 1, "a") for i in range(200)], SCHEMA)
    assert buckets.upsert(first, root, ["k"], ["ts"], buckets=16) == 0
    before = live(spark, root)
    assert len(before) == 16
    batch = spark.createDataFrame([("k3", 2, "b"), ("k3", 3, "c"), ("k7", 0, "old"), ("k9", 1, "tie"), ("new", None, "n"), (None, 1, "null")], SCHEMA)
    assert buckets.upsert(batch, root, ["k"], ["ts"], buckets=16) == 1
    after = live(spark, root)
    touched = {r[0] for r in batch.select(buckets.bucket_of(["k"], 16)).collect()}
    assert len(before & after) == 16 - len(touched) and len(after) == 16
    assert {int(f.split(f"{buckets.BUCKET}=")[1].split("/")[0]) for f in after - before} == touched
    got = {r.k: (r.ts, r.v) for r in buckets.read(spark, root).collect()}
    want = {f"k{i}": (1, "a") for i in range(200)} | {"k3": (3, "c"), "k9": (1, "tie"), "new": (None, "n"), None: (1, "null")}
    assert got == want
    # a repeated version and an empty batch change nothing
    stored = files(root)
    assert buckets.upsert(spark.createDataFrame([("k1", 9, "x")], SCHEMA), root, ["k"], ["ts"], version=1, buckets=16) == 1
    assert files(root) == stored
    assert buckets.upsert(batch.limit(0), root, ["k"], ["ts"], buckets=16) == 2 and live(spark, root) == after
    # a version that failed before its manifest is written anew
    spark.range(3).write.parquet(f"{root}/data/v=3/{buckets.BUCKET}=0")
    assert buckets.upsert(spark.createDataFrame([("k1", 9, "x")], SCHEMA), root, ["k"], ["ts"], buckets=16) == 3
    assert {r.k: r.v for r in buckets.read(spark, root).collect()}["k1"] == "x"


def test_upserts_equal_the_latest_of_all(spark, tmp_path):
    rnd = random.Random(1)
    root, rows = str(tmp_path / "t"), []
    for n in range(4):
        some = [(f"k{rnd.randrange(30)}", rnd.randrange(50), f"v{n}-{i}") for i in range(25)]
        some = list({(k, t): (k, t, v) for k, t, v in some if (k, t) not in {r[:2] for r in rows}}.values())
        rows += some
        buckets.upsert(spark.createDataFrame(some, SCHEMA), root, ["k"], ["ts"], buckets=8)
    want = {}
    for k, t, v in rows:
        want[k] = max(want.get(k, (-1, "")), (t, v))
    assert {r.k: (r.ts, r.v) for r in buckets.read(spark, root).collect()} == want


def _loads(spark):
    """Three extracts of the applications: some, all, all with a change."""
    from creditlake.plans.vault_load import application_targets, staged_dataset
    app = staged_dataset(spark, SF001, "stg_application")
    some = app.where("sk_id_curr % 3 = 0")
    changed = app.withColumn("amt_credit", F.when(F.col("sk_id_curr") % 5 == 0, F.col("amt_credit") + 1).otherwise(F.col("amt_credit")))
    names = ("dv_hub_application", "dv_sat_app_contract")
    made = {}
    for load, frame in zip((LOAD_DTS, SECOND_LOAD_DTS, "2024-03-01 00:00:00"), (some, app, changed)):
        t = application_targets(frame, load)
        made[load] = {n: t[n] for n in names}
    return names, made


@pytest.mark.parametrize("mode", ["always", "changed"])
def test_loads_in_any_order(spark, tmp_path, mode):
    names, loads = _loads(spark)
    hub, sat = names
    n_all = loads[SECOND_LOAD_DTS][hub].count()
    history = None
    for load in sorted(loads):                              # what loads in their order keep of a changed-rows history
        rows = loads[load][sat]
        new = rows if history is None else changed_rows(rows, history, ["hk_application"])
        history = new if history is None else history.unionByName(new)
    want = {(r.hk_application, r.hashdiff) for r in current_rows(history, ["hk_application"]).collect()}
    for i, order in enumerate(itertools.permutations(loads)):
        if i not in ((0, 3) if mode == "changed" else (5,)):
            continue
        root = str(tmp_path / f"{mode}{i}")
        for load in (*order, order[0]):                     # the first one again, as a retry
            counts = write_vault(loads[load], root, load, mode=mode, snapshots=True)
            assert counts[hub][0] == counts[sat][0] == loads[load][hub].count()
        stored = read_vault(spark, root, names)
        assert stored[hub].count() == stored[hub].select("hk_application").distinct().count() == n_all
        now = read_vault_current(spark, root, names)[sat]
        assert now.count() == n_all and {(r.hk_application, r.hashdiff) for r in now.collect()} == want
        if mode == "always":
            assert {(r.hk_application, r.hashdiff) for r in current_rows(stored[sat], ["hk_application"]).collect()} == want
        elif list(order) == sorted(order):
            assert stored[sat].exceptAll(history.select(*stored[sat].columns)).count() == 0 and stored[sat].count() == history.count()


def test_known_keys_are_pruned_and_counted_in_the_write(spark, tmp_path):
    from creditlake.plans.vault_load import PREFIX, _known_keys, _stored
    names, loads = _loads(spark)
    root = str(tmp_path / "v")
    write_vault(loads[SECOND_LOAD_DTS], root, SECOND_LOAD_DTS)
    few = loads[LOAD_DTS][names[0]].where("hk_application like 'a%'")
    known = _known_keys(_stored(spark, f"{root}/{names[0]}"), few, "hk_application")
    plan = known.select("hk_application")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and PREFIX in plan.split("PartitionFilters")[1]
    assert {r[0][0] for r in known.select("hk_application").collect()} == {"a"}


def test_mart_from_snapshots_has_no_window(spark, tmp_path):
    root = str(tmp_path / "v")
    for load in (LOAD_DTS, SECOND_LOAD_DTS):
        tables = vault_tables(spark, SF001, load)
        write_vault(tables, root, load, mode="changed", snapshots=True)
    now = M.training_mart(read_vault_current(spark, root, list(tables)))
    assert "Window" not in now._jdf.queryExecution().executedPlan().toString()
    window = M.training_mart(read_vault(spark, root, list(tables)))
    assert now.exceptAll(window).count() == 0 and window.exceptAll(now).count() == 0


def test_stream_repeats_change_nothing(spark, tmp_path):
    from creditlake.streaming.jobs import score_requests, score_stream
    from creditlake.sources.fixtures import staged
    out = str(tmp_path / "out")
    score_stream(spark, SF001, out, str(tmp_path / "ckpt")).awaitTermination()
    rows = sorted(buckets.read(spark, out).collect(), key=lambda r: r.application_id)
    batch = score_requests(staged(spark, SF001, "stream_score_request"))
    assert rows == sorted(buckets.latest(batch, ["application_id"], ["requested_at", "request_id"]).collect(), key=lambda r: r.application_id)
    assert all(r.key_factors and r.recommendations for r in rows)
    stored = files(out)
    score_stream(spark, SF001, out, str(tmp_path / "again")).awaitTermination()      # all events again, as batch 0
    assert files(out) == stored


def test_tables_of_a_kind_are_written_at_once(spark, tmp_path):
    """Four hubs meet at a barrier that a single writer never passes; links
    wait for all hubs.  Files of both layouts hold zstd pages."""
    import threading

    import pyarrow.parquet as pq

    from creditlake.plans import vault_load as L
    from creditlake.plans import vault_specs as V
    hubs, done = threading.Barrier(4, timeout=60), []

    def write(name, df):
        if "_hub_" in name:
            hubs.wait()
        done.append(name)
        return 1, 1
    df = spark.range(1)
    names = [f"dv_hub_{k}" for k in "abcd"] + ["dv_link_a", "dv_sat_a"]
    assert L._write_all(dict.fromkeys(reversed(names), df), write) == dict.fromkeys(names, (1, 1))
    assert set(done[:4]) == set(names[:4]) and done[4:] == names[4:]

    app = spark.createDataFrame([(1, 0), (2, 1)], "sk_id_curr long, target int")
    tables = {n: t for n, t in L.application_targets(app).items() if n in (V.HUB_APPLICATION.table, "dv_sat_app_target")}
    L.write_vault(tables, str(tmp_path / "plain"))
    L.write_vault_bucketed(spark, tables, str(tmp_path / "bucketed"), 2, f"w{abs(hash(str(tmp_path)))}")
    files = [pq.ParquetFile(f).metadata for f in tmp_path.rglob("*.parquet")]
    assert {f.row_group(0).column(0).compression for f in files if f.num_row_groups} == {"ZSTD"}


def test_upserts_leave_no_copy_and_no_shuffle_files(spark, tmp_path, monkeypatch):
    import time

    from creditlake.sources import sinks
    kept = str(tmp_path / "kept")
    monkeypatch.setattr(buckets, "scratch_path", lambda *_: kept)
    copies = lambda: {f for d in (spark.sparkContext.getCheckpointDir(),) if d for _, _, fs in os.walk(d.removeprefix("file:")) for f in fs}
    before, shuffles, setting = copies(), shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(f"k{i % 40}", i, "a") for i in range(200)], SCHEMA)
    for few in (True, False):
        buckets.upsert(rows, root, ["k"], ["ts"], buckets=4, few_per_key=few)
        assert {r.k: r.ts for r in buckets.read(spark, root).collect()} == {f"k{i}": 160 + i for i in range(40)}
    assert copies() == before and not os.path.exists(kept) and len(live(spark, root)) == 4
    assert sinks.numbered(spark, f"{root}/data", "v") == [0, 1] and sinks.numbered(spark, f"{root}/none", "v") == []
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == setting
    for _ in range(50):                                     # files go in the background
        if not shuffle_files(spark) - shuffles:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - shuffles
    once = buckets._latest_dealt(rows, ["k"], ["ts"], 4)
    assert once._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_changes_of_the_last_load_need_the_snapshot_alone(spark):
    from creditlake.plans.vault_load import _changed
    schema = "hk_application string, hashdiff string, load_dts timestamp_ntz"
    rows = lambda at, *kd: spark.sql(" union all ".join(
        f"select '{k}' hk_application, '{d}' hashdiff, timestamp_ntz '{at}' load_dts" for k, d in kd))
    now = rows("2024-01-01", ("a", "1"), ("b", "1"))
    new = rows("2024-02-01", ("a", "1"), ("b", "2"), ("c", "1"))
    got = _changed(new, "dv_sat_app_contract", now, None, "2024-02-01 00:00:00")
    assert sorted(r.hk_application for r in got.collect()) == ["b", "c"]
    empty = spark.createDataFrame([], schema)
    assert _changed(new, "dv_sat_app_contract", empty, None, "2024-02-01 00:00:00").count() == 3


def test_writes_of_a_vault_leave_no_shuffle_files(spark, tmp_path):
    import time

    from creditlake.plans.vault_load import write_vault_bucketed
    tables = vault_tables(spark, SF001)
    names = ("dv_hub_prev_application", "dv_sat_pos_cash_balance")
    shuffles = shuffle_files(spark)
    write_vault({n: tables[n] for n in names}, str(tmp_path / "files"))
    write_vault_bucketed(spark, {n: tables[n] for n in names}, str(tmp_path / "buckets"), 8, f"x{abs(hash(str(tmp_path)))}")
    for _ in range(50):
        if not shuffle_files(spark) - shuffles:
            break
        time.sleep(0.2)
    assert not shuffle_files(spark) - shuffles


def test_rows_of_files_are_dealt_once_and_parts_are_stored(spark, tmp_path):
    """The mart over plain files: one shuffle for a child's versions and
    groups, one for its link, one for the applications."""
    root = str(tmp_path / "v")
    for load in (LOAD_DTS, SECOND_LOAD_DTS):
        tables = vault_tables(spark, SF001, load)
        write_vault(tables, root, load)
    files = read_vault(spark, root, list(tables))
    setting = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for features in (M.pos_features, M.card_features):
            assert features(files)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", setting)
    parts = []
    mart = M.training_mart(files, part=lambda df: parts.append(M.stored(df)) or parts[-1])
    assert len(parts) == 4 and all(p.inputFiles() for p in parts)
    lazy = M.training_mart(tables)
    assert mart.exceptAll(lazy).count() == 0 and lazy.exceptAll(mart).count() == 0
