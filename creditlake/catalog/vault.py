"""Vault load queries (C-01..C-05, K-03, K-06, W-03, W-04, J-06, J-10)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.vault import changed_rows, current_rows, insert_new, orphans, sat_frame
from ..plans import vault_specs as V
from ..plans.vault_load import (
    LOAD_DTS, SECOND_LOAD_DTS, application_targets, read_vault, read_vault_current, staged_dataset, vault_tables, write_vault,
)
from ..schemas import ADAPTER_DATASET, DATASETS
from ..session import scratch_path
from ..sources.fixtures import adapter_columns
from . import register
from .sqlkit import LOAD_TS, dec, hashdiff, json_text, md5_key, reduce_cte, with_ctes

# ---------------------------------------------------------------- oracle SQL


def _sql_type(t: str) -> str:
    return {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT",
            "double": "DOUBLE"}.get(t, t.upper())


def _attr_sql(src: str, vtype: str, have: set[str]) -> str:
    if src not in have:
        return f"CAST(NULL AS {_sql_type(vtype)})"
    if vtype.startswith("decimal"):
        p, s = vtype[8:-1].split(",")
        return dec(src, int(p), int(s))
    return f"CAST({src} AS {_sql_type(vtype)})"


def _kind(dataset: str, col: str) -> str:
    return "str" if DATASETS[dataset].types()[col] == "string" else "num"


def sat_oracle(spec, adapter: str, extra_where: str | None = None, reduce: bool = False) -> str:
    dataset = ADAPTER_DATASET[adapter]
    have = set(adapter_columns(adapter)) - set(DATASETS[dataset].junk)
    keys = list(spec.parent.bk) + [s for s, _ in spec.subkeys]
    src = adapter
    ctes = {}
    if reduce:
        rest = [c for c in DATASETS[dataset].data_columns if c in have and c not in keys]
        ctes["reduced"] = reduce_cte(f"{adapter} WHERE " + " AND ".join(f"{k} IS NOT NULL" for k in keys),
                                     keys, rest)
        src = "reduced"
    cols = [f"{md5_key(spec.parent.prefix, *spec.parent.bk)} AS {spec.parent.hk}"]
    cols += [f"CAST({s} AS {_sql_type(t)}) AS {s}" for s, t in spec.subkeys]
    if spec.hashdiff_pack:
        keys_in_pack = dict(spec.packs)[spec.hashdiff_pack]
        fields = [(k, _kind(dataset, k)) for k in keys_in_pack if k in have]
        cols.append(f"md5({json_text(fields, sort_keys=True)}) AS hashdiff")
    else:
        names = ([s for s, _ in spec.subkeys] if spec.hashdiff_subkeys else []) + list(spec.hashdiff)
        cols.append(f"{hashdiff(*[n if n in have else 'NULL' for n in names])} AS hashdiff")
    cols += [f"{_attr_sql(src_col, t, have)} AS {n}" for n, t, src_col in spec.attrs]
    for name, pack_keys in spec.packs:
        fields = [(k, _kind(dataset, k)) for k in pack_keys if k in have]
        cols.append(f"{json_text(fields)} AS {name}")
    cols += [f"'{spec.record_source}' AS record_source", f"{LOAD_TS} AS load_dts",
             f"{LOAD_TS} AS effective_from"]
    where = [f"{k} IS NOT NULL" for k in spec.parent.bk]
    if extra_where:
        where.append(extra_where)
    if spec.where:
        where.append(spec.where)
    body = f"SELECT {', '.join(cols)}\nFROM {src} WHERE {' AND '.join(where)}"
    return with_ctes(body, (adapter,), **ctes)


def hub_oracle(spec, adapter: str, need=()) -> str:
    ref = spec.ref
    where = " AND ".join(f"{k} IS NOT NULL" for k in tuple(ref.bk) + tuple(need))
    body = (f"SELECT DISTINCT {md5_key(ref.prefix, *ref.bk)} AS {ref.hk}, "
            f"{', '.join(ref.bk)}, '{spec.record_source}' AS record_source, {LOAD_TS} AS load_dts\n"
            f"FROM {adapter} WHERE {where}")
    return with_ctes(body, (adapter,))


def link_oracle(spec, adapter: str) -> str:
    where = " AND ".join(f"{k} IS NOT NULL" for k in spec.bk)
    refs = ", ".join(f"{md5_key(r.prefix, *r.bk)} AS {r.hk}" for r in spec.refs)
    body = (f"SELECT DISTINCT {md5_key(spec.prefix, *spec.bk)} AS {spec.hk}, {refs}, "
            f"'{spec.record_source}' AS record_source, {LOAD_TS} AS load_dts\n"
            f"FROM {adapter} WHERE {where}")
    return with_ctes(body, (adapter,))


# ------------------------------------------------------------------ queries

def _target(table: str):
    def q(spark, sf_dir) -> DataFrame:
        return vault_tables(spark, sf_dir)[table]
    return q


_APP_QUERIES = {
    "dv_sat_contract": V.SAT_CONTRACT, "dv_sat_profile": V.SAT_PROFILE,
    "dv_sat_process": V.SAT_PROCESS, "dv_sat_contact": V.SAT_CONTACT,
    "dv_sat_scores": V.SAT_SCORES, "dv_sat_enquiries": V.SAT_ENQUIRIES,
    "dv_sat_documents": V.SAT_DOCUMENTS, "dv_sat_building": V.SAT_BUILDING,
    "dv_sat_target": V.SAT_TARGET,
}


def _app_sat(spec):
    def q(spark, sf_dir) -> DataFrame:
        return sat_frame(staged_dataset(spark, sf_dir, "stg_application"), spec, LOAD_DTS)
    return q


register("dv_hub_application", hub_oracle(V.HUB_APPLICATION, "stg_application"))(
    lambda spark, sf_dir: application_targets(staged_dataset(spark, sf_dir, "stg_application"))[
        V.HUB_APPLICATION.table])
for _name, _spec in _APP_QUERIES.items():
    register(_name, sat_oracle(_spec, "stg_application"))(_app_sat(_spec))

register("dv_hub_bureau", hub_oracle(V.HUB_BUREAU, "stg_bureau", need=("sk_id_curr",)))(
    _target(V.HUB_BUREAU.table))
register("dv_bureau_link", link_oracle(V.LINK_APP_BUREAU, "stg_bureau"))(_target(V.LINK_APP_BUREAU.table))
register("dv_sat_bureau", sat_oracle(V.SAT_BUREAU, "stg_bureau", "sk_id_curr IS NOT NULL"))(
    _target(V.SAT_BUREAU.table))
register("dv_sat_bureau_balance", sat_oracle(V.SAT_BUREAU_BALANCE, "stg_bureau_balance", reduce=True))(
    _target(V.SAT_BUREAU_BALANCE.table))
register("dv_hub_prev", hub_oracle(V.HUB_PREV, "stg_previous_application", need=("sk_id_curr",)))(
    _target(V.HUB_PREV.table))
register("dv_prev_link", link_oracle(V.LINK_APP_PREV, "stg_previous_application"))(
    _target(V.LINK_APP_PREV.table))
register("dv_sat_prev", sat_oracle(V.SAT_PREV, "stg_previous_application", "sk_id_curr IS NOT NULL"))(
    _target(V.SAT_PREV.table))
register("dv_sat_installment", sat_oracle(V.SAT_INSTALLMENT, "stg_installments_payments", reduce=True))(
    _target(V.SAT_INSTALLMENT.table))
register("dv_sat_card", sat_oracle(V.SAT_CARD, "stg_credit_card_balance", reduce=True))(
    _target(V.SAT_CARD.table))
register("dv_sat_pos", sat_oracle(V.SAT_POS, "stg_pos_cash_balance", reduce=True))(
    _target(V.SAT_POS.table))


# ---- K-03 / J-06: insert-ignore of hub keys against an existing hub ----
# batch: applications referenced by bureau credits; target: applications
# already loaded from previous-application rows.  Result: rows to append.

def dv_insert_ignore(spark, sf_dir) -> DataFrame:
    bureau = staged_dataset(spark, sf_dir, "stg_bureau").where(F.col("sk_id_curr").isNotNull())
    batch = bureau.select(
        V.APP.column().alias("hk_application"), "sk_id_curr",
        F.lit(V.RS_BUREAU).alias("record_source"),
        F.lit(SECOND_LOAD_DTS).cast("timestamp_ntz").alias("load_dts"))
    prev = staged_dataset(spark, sf_dir, "stg_previous_application").where(F.col("sk_id_curr").isNotNull())
    target = prev.select(V.APP.column().alias("hk_application")).distinct()
    return insert_new(batch, target, "hk_application")


register("dv_insert_ignore", with_ctes(f"""
SELECT DISTINCT {md5_key('application', 'sk_id_curr')} AS hk_application, sk_id_curr,
       '{V.RS_BUREAU}' AS record_source, TIMESTAMP '2024-02-01 00:00:00' AS load_dts
FROM stg_bureau b
WHERE sk_id_curr IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM stg_previous_application p WHERE p.sk_id_curr = b.sk_id_curr)""",
                                     ("stg_bureau", "stg_previous_application")))(dv_insert_ignore)


# ---- W-04 / W-03: second load with changed rows, change detection, current view ----

# the second extract changes the credit amount of one market segment's
# applications (a data attribute, not a key range)
CHANGED_SEGMENT = "AUTOMOBILE"


def _second_load_app(spark, sf_dir) -> DataFrame:
    """Second staging extract: applications of one contract type carry a
    new credit amount; every other row is offered unchanged."""
    app = staged_dataset(spark, sf_dir, "stg_application")
    return app.withColumn(
        "amt_credit",
        F.when(F.col("name_contract_type") == CHANGED_SEGMENT, F.col("amt_credit") + 1000.0)
        .otherwise(F.col("amt_credit")))


def dv_sat_changed(spark, sf_dir) -> DataFrame:
    first = sat_frame(staged_dataset(spark, sf_dir, "stg_application"), V.SAT_CONTRACT, LOAD_DTS)
    second = sat_frame(_second_load_app(spark, sf_dir), V.SAT_CONTRACT, SECOND_LOAD_DTS)
    return changed_rows(second, first, ["hk_application"])


def dv_sat_current(spark, sf_dir) -> DataFrame:
    first = sat_frame(staged_dataset(spark, sf_dir, "stg_application"), V.SAT_CONTRACT, LOAD_DTS)
    history = first.unionByName(dv_sat_changed(spark, sf_dir))
    return current_rows(history, ["hk_application"])


def _contract_sql(amt: str, ts: str) -> str:
    return (f"SELECT {md5_key('application', 'sk_id_curr')} AS hk_application, "
            f"{hashdiff('name_contract_type', amt, 'amt_annuity', 'amt_goods_price', 'amt_income_total')} AS hashdiff, "
            f"name_contract_type, {dec(amt, 18, 2)} AS amt_credit, {dec('amt_annuity', 18, 2)} AS amt_annuity, "
            f"{dec('amt_goods_price', 18, 2)} AS amt_goods_price, {dec('amt_income_total', 18, 2)} AS amt_income_total, "
            f"'{V.RS_APP}' AS record_source, {ts} AS load_dts, {ts} AS effective_from "
            f"FROM stg_application WHERE sk_id_curr IS NOT NULL")


_SECOND = "TIMESTAMP '2024-02-01 00:00:00'"
_CHANGED_CTES = dict(
    l1=_contract_sql("amt_credit", LOAD_TS),
    stg2=(f"SELECT *, CASE WHEN name_contract_type = '{CHANGED_SEGMENT}' THEN amt_credit + 1000.0 "
          "ELSE amt_credit END AS amt_credit2 FROM stg_application"),
    l2=_contract_sql("amt_credit2", _SECOND).replace("FROM stg_application", "FROM stg2"),
    changed="SELECT l2.* FROM l2 LEFT JOIN l1 USING (hk_application) "
            "WHERE l1.hashdiff IS NULL OR l1.hashdiff <> l2.hashdiff",
)
register("dv_sat_changed", with_ctes("SELECT * FROM changed", ("stg_application",), **_CHANGED_CTES))(
    dv_sat_changed)
register("dv_sat_current", with_ctes(
    "SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY hk_application "
    "ORDER BY load_dts DESC) AS _rn FROM (SELECT * FROM l1 UNION ALL SELECT * FROM changed)) WHERE _rn = 1",
    ("stg_application",), **_CHANGED_CTES))(dv_sat_current)


# ---- K-06: rows per vault target of one load ----

def dv_load_stats(spark, sf_dir) -> DataFrame:
    tables = vault_tables(spark, sf_dir)
    parts = [df.agg(F.count(F.lit(1)).alias("rows_loaded")).select(
        F.lit(name).alias("table_name"), "rows_loaded") for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _stats_sql() -> str:
    counts = {
        "dv_hub_application": "SELECT count(DISTINCT sk_id_curr) FROM stg_application",
        "dv_hub_bureau_credit": "SELECT count(DISTINCT sk_id_bureau) FROM stg_bureau WHERE sk_id_curr IS NOT NULL",
        "dv_link_application_bureau": "SELECT count(*) FROM (SELECT DISTINCT sk_id_curr, sk_id_bureau FROM stg_bureau WHERE sk_id_curr IS NOT NULL AND sk_id_bureau IS NOT NULL)",
        "dv_sat_bureau_credit": "SELECT count(*) FROM stg_bureau WHERE sk_id_curr IS NOT NULL AND sk_id_bureau IS NOT NULL",
        "dv_sat_bureau_balance": "SELECT count(*) FROM (SELECT DISTINCT sk_id_bureau, months_balance FROM stg_bureau_balance)",
        "dv_hub_prev_application": "SELECT count(DISTINCT sk_id_prev) FROM stg_previous_application WHERE sk_id_curr IS NOT NULL",
        "dv_link_application_prev_application": "SELECT count(*) FROM (SELECT DISTINCT sk_id_curr, sk_id_prev FROM stg_previous_application)",
        "dv_sat_prev_application": "SELECT count(*) FROM stg_previous_application WHERE sk_id_curr IS NOT NULL",
        "dv_sat_installment_payment": "SELECT count(*) FROM (SELECT DISTINCT sk_id_prev, num_instalment_version, num_instalment_number FROM stg_installments_payments)",
        "dv_sat_credit_card_balance": "SELECT count(*) FROM (SELECT DISTINCT sk_id_prev, months_balance FROM stg_credit_card_balance)",
        "dv_sat_pos_cash_balance": "SELECT count(*) FROM (SELECT DISTINCT sk_id_prev, months_balance FROM stg_pos_cash_balance)",
        "dv_sat_app_target": "SELECT count(*) FROM stg_application WHERE target IS NOT NULL",
    }
    for spec in V.APPLICATION_SATS:
        counts.setdefault(spec.table, "SELECT count(*) FROM stg_application")
    sel = "\nUNION ALL ".join(f"SELECT '{t}' AS table_name, ({q}) AS rows_loaded" for t, q in sorted(counts.items()))
    return with_ctes(sel, ("stg_application", "stg_bureau", "stg_bureau_balance", "stg_previous_application",
                           "stg_installments_payments", "stg_credit_card_balance", "stg_pos_cash_balance"))


register("dv_load_stats", _stats_sql())(dv_load_stats)


# ---- K-03 / K-06: the same source delivered twice into a stored vault ----

def vault_reload_stats(spark, sf_dir) -> DataFrame:
    """Rows offered and inserted by a second load: hubs and links take no key
    twice, satellites keep every version."""
    root = scratch_path(spark, "vault_reload")
    write_vault(vault_tables(spark, sf_dir), root)
    counts = write_vault(vault_tables(spark, sf_dir, SECOND_LOAD_DTS), root, SECOND_LOAD_DTS)
    return spark.createDataFrame([(t, i, n) for t, (i, n) in sorted(counts.items())],
                                 "table_name string, rows_in long, rows_inserted long")


register("vault_reload_stats", "SELECT table_name, rows_loaded AS rows_in, "
         "CASE WHEN table_name LIKE 'dv_sat%' THEN rows_loaded ELSE 0 END AS rows_inserted "
         f"FROM ({_stats_sql()})")(vault_reload_stats)


# ---- J-10: referential audit of every link and satellite ----

_RELATIONS = (
    ("dv_link_application_bureau", "hk_application", "dv_hub_application", "hk_application"),
    ("dv_link_application_bureau", "hk_bureau_credit", "dv_hub_bureau_credit", "hk_bureau_credit"),
    ("dv_sat_bureau_credit", "hk_bureau_credit", "dv_hub_bureau_credit", "hk_bureau_credit"),
    ("dv_sat_bureau_balance", "hk_bureau_credit", "dv_hub_bureau_credit", "hk_bureau_credit"),
    ("dv_link_application_prev_application", "hk_application", "dv_hub_application", "hk_application"),
    ("dv_link_application_prev_application", "hk_prev_application", "dv_hub_prev_application", "hk_prev_application"),
    ("dv_sat_prev_application", "hk_prev_application", "dv_hub_prev_application", "hk_prev_application"),
    ("dv_sat_installment_payment", "hk_prev_application", "dv_hub_prev_application", "hk_prev_application"),
    ("dv_sat_credit_card_balance", "hk_prev_application", "dv_hub_prev_application", "hk_prev_application"),
    ("dv_sat_pos_cash_balance", "hk_prev_application", "dv_hub_prev_application", "hk_prev_application"),
    *[(s.table, "hk_application", "dv_hub_application", "hk_application") for s in V.APPLICATION_SATS],
)


def dv_orphans(spark, sf_dir) -> DataFrame:
    v = vault_tables(spark, sf_dir)
    out = None
    for child, fk, parent, pk in _RELATIONS:
        o = orphans(v[child].select(fk), fk, v[parent], pk).agg(F.count(F.lit(1)).alias("orphan_rows")).select(
            F.lit(f"{child}.{fk}").alias("relation"), "orphan_rows")
        out = o if out is None else out.unionByName(o)
    return out


def _orphans_sql() -> str:
    # hubs hold every key of their own source; the orphans are child keys
    # whose business key never reached the parent hub's source.
    q = {
        "dv_link_application_bureau.hk_application":
            "SELECT count(*) FROM stg_bureau b WHERE sk_id_bureau IS NOT NULL AND sk_id_curr IS NOT NULL "
            "AND NOT EXISTS (SELECT 1 FROM stg_application a WHERE a.sk_id_curr = b.sk_id_curr)",
        # loaded from the rows that fill their hub
        "dv_link_application_bureau.hk_bureau_credit": "SELECT 0",
        "dv_sat_bureau_credit.hk_bureau_credit": "SELECT 0",
        "dv_link_application_prev_application.hk_prev_application": "SELECT 0",
        "dv_sat_prev_application.hk_prev_application": "SELECT 0",
        **{f"{s.table}.hk_application": "SELECT 0" for s in V.APPLICATION_SATS},
        "dv_sat_bureau_balance.hk_bureau_credit":
            "SELECT count(*) FROM (SELECT DISTINCT sk_id_bureau, months_balance FROM stg_bureau_balance) x "
            "WHERE NOT EXISTS (SELECT 1 FROM stg_bureau b WHERE b.sk_id_bureau = x.sk_id_bureau AND b.sk_id_curr IS NOT NULL)",
        "dv_link_application_prev_application.hk_application":
            "SELECT count(*) FROM (SELECT DISTINCT sk_id_curr, sk_id_prev FROM stg_previous_application) p "
            "WHERE NOT EXISTS (SELECT 1 FROM stg_application a WHERE a.sk_id_curr = p.sk_id_curr)",
    }
    for t, src in (("dv_sat_installment_payment", "SELECT DISTINCT sk_id_prev, num_instalment_version, num_instalment_number FROM stg_installments_payments"),
                   ("dv_sat_credit_card_balance", "SELECT DISTINCT sk_id_prev, months_balance FROM stg_credit_card_balance"),
                   ("dv_sat_pos_cash_balance", "SELECT DISTINCT sk_id_prev, months_balance FROM stg_pos_cash_balance")):
        q[f"{t}.hk_prev_application"] = (
            f"SELECT count(*) FROM ({src}) x WHERE NOT EXISTS (SELECT 1 FROM stg_previous_application p "
            f"WHERE p.sk_id_prev = x.sk_id_prev AND p.sk_id_curr IS NOT NULL)")
    sel = "\nUNION ALL ".join(f"SELECT '{r}' AS relation, ({s}) AS orphan_rows" for r, s in q.items())
    return with_ctes(sel, ("stg_application", "stg_bureau", "stg_bureau_balance", "stg_previous_application",
                           "stg_installments_payments", "stg_credit_card_balance", "stg_pos_cash_balance"))


register("dv_orphans", _orphans_sql())(dv_orphans)


# ---- W-03 / W-04 / K-03: loads in any order, current rows kept per key ----

_SNAPSHOT_TABLES = (V.HUB_APPLICATION.table, V.SAT_CONTRACT.table)


def _two_loads(spark, sf_dir, mode: str) -> str:
    """A vault into which the second extract came first and the first one last."""
    root = scratch_path(spark, "vault_snapshot")
    loads = ((SECOND_LOAD_DTS, _second_load_app(spark, sf_dir)), (LOAD_DTS, staged_dataset(spark, sf_dir, "stg_application")))
    for load, app in loads:
        tables = application_targets(app, load)
        write_vault({n: tables[n] for n in _SNAPSHOT_TABLES}, root, load, mode=mode, snapshots=True)
    return root


def dv_snapshot_current(spark, sf_dir) -> DataFrame:
    """The maintained current rows after loads in the wrong order."""
    return read_vault_current(spark, _two_loads(spark, sf_dir, "always"), _SNAPSHOT_TABLES)[V.SAT_CONTRACT.table]


def dv_hub_any_order(spark, sf_dir) -> DataFrame:
    """One row per key: the load that came first brought them all."""
    root = _two_loads(spark, sf_dir, "changed")
    return read_vault(spark, root, [V.HUB_APPLICATION.table])[V.HUB_APPLICATION.table]


register("dv_snapshot_current", with_ctes("SELECT * FROM l2", ("stg_application",), **_CHANGED_CTES))(dv_snapshot_current)
register("dv_hub_any_order", with_ctes(
    f"SELECT DISTINCT {md5_key('application', 'sk_id_curr')} AS hk_application, sk_id_curr, '{V.RS_APP}' AS record_source, "
    f"{_SECOND} AS load_dts FROM stg_application WHERE sk_id_curr IS NOT NULL", ("stg_application",)))(dv_hub_any_order)
