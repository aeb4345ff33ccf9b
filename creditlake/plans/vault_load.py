"""Staging -> Data Vault loads (C-01 .. C-05, K-06).

``vault_tables`` returns every vault target of one load as lazy DataFrames.
Writing them (hub -> link -> satellite order, append) is ``write_vault``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import groupby
from multiprocessing.pool import ThreadPool

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.conform import conform
from ..operators.vault import (
    changed_rows, dealt_by, hub_frame, insert_new, link_frame, reduce_to_key, sat_frame,
)
from ..schemas import ADAPTER_DATASET, DATASETS
from ..session import DROP_SHUFFLES, session_conf
from ..sources import buckets
from ..sources.fixtures import staged
from . import vault_specs as V

# Fixed load timestamp for repeatable test loads; jobs pass their own
# (one ``current_timestamp`` captured per run, F-19).
LOAD_DTS = "2024-01-01 00:00:00"
SECOND_LOAD_DTS = "2024-02-01 00:00:00"
#: key columns of each satellite
SAT_KEYS = {s.table: s.key_columns for s in (*V.APPLICATION_SATS, V.SAT_BUREAU, V.SAT_BUREAU_BALANCE, V.SAT_PREV, V.SAT_INSTALLMENT,
                                              V.SAT_CARD, V.SAT_POS)}


def staged_dataset(spark: SparkSession, sf_dir: str, adapter: str, full: bool = False) -> DataFrame:
    """Adapter output cast to its staging schema, junk stripped.  Narrow by
    default: attributes the extract lacks are treated as null downstream."""
    return conform(staged(spark, sf_dir, adapter), DATASETS[ADAPTER_DATASET[adapter]], full=full)


def application_targets(app: DataFrame, load_dts=LOAD_DTS) -> dict[str, DataFrame]:
    """C-01: one application staging frame -> hub + 9 satellites."""
    out = {V.HUB_APPLICATION.table: hub_frame(app, V.HUB_APPLICATION, load_dts)}
    for spec in V.APPLICATION_SATS:
        out[spec.table] = sat_frame(app, spec, load_dts)
    return out


def bureau_targets(bureau: DataFrame, load_dts=LOAD_DTS) -> dict[str, DataFrame]:
    """C-02: bureau -> hub + link + satellite (rows need both keys)."""
    both = bureau.where(F.col("sk_id_bureau").isNotNull() & F.col("sk_id_curr").isNotNull())
    return {
        V.HUB_BUREAU.table: hub_frame(both, V.HUB_BUREAU, load_dts),
        V.LINK_APP_BUREAU.table: link_frame(both, V.LINK_APP_BUREAU, load_dts),
        V.SAT_BUREAU.table: sat_frame(both, V.SAT_BUREAU, load_dts),
    }


def bureau_balance_targets(bb: DataFrame, load_dts=LOAD_DTS) -> dict[str, DataFrame]:
    """C-03: multi-active satellite by month; the source may repeat a key,
    so it is first reduced to one row per (bureau, month)."""
    bb = bb.where(F.col("sk_id_bureau").isNotNull() & F.col("months_balance").isNotNull())
    return {V.SAT_BUREAU_BALANCE.table: _reduced_sat(bb, V.SAT_BUREAU_BALANCE, load_dts)}


def _reduced_sat(df: DataFrame, spec, load_dts) -> DataFrame:
    """Reduce a multi-active source to one row per (hash key, sub-keys) and
    build the satellite.  Dealing the rows by the hash key (not the business
    key) leaves them partitioned the way the satellite's readers need them: the
    current-version window, groups and joins after it add no shuffle."""
    hk = spec.parent.hk
    keyed = dealt_by(df, spec.parent.column()).withColumn(hk, spec.parent.column())
    return sat_frame(reduce_to_key(keyed, [hk] + [s for s, _ in spec.subkeys]), spec, load_dts)


def prev_targets(prev: DataFrame, load_dts=LOAD_DTS) -> dict[str, DataFrame]:
    """C-04: previous application -> hub + link + satellite."""
    both = prev.where(F.col("sk_id_prev").isNotNull() & F.col("sk_id_curr").isNotNull())
    return {
        V.HUB_PREV.table: hub_frame(both, V.HUB_PREV, load_dts),
        V.LINK_APP_PREV.table: link_frame(both, V.LINK_APP_PREV, load_dts),
        V.SAT_PREV.table: sat_frame(both, V.SAT_PREV, load_dts),
    }


def multi_active_targets(df: DataFrame, spec, load_dts=LOAD_DTS) -> DataFrame:
    """C-05: instalments / card / POS satellites keyed by previous application."""
    keys = list(spec.parent.bk) + [s for s, _ in spec.subkeys]
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return _reduced_sat(df.where(cond), spec, load_dts)


class Vault(Mapping):
    """Every vault target of one load over the driver tables.  Targets are
    built lazily, one source group at a time, on first access (a query that
    needs two tables does not plan twenty)."""

    _GROUPS = {
        "application": [V.HUB_APPLICATION.table] + [s.table for s in V.APPLICATION_SATS],
        "bureau": [V.HUB_BUREAU.table, V.LINK_APP_BUREAU.table, V.SAT_BUREAU.table],
        "bureau_balance": [V.SAT_BUREAU_BALANCE.table],
        "prev": [V.HUB_PREV.table, V.LINK_APP_PREV.table, V.SAT_PREV.table],
        "installments": [V.SAT_INSTALLMENT.table],
        "card": [V.SAT_CARD.table],
        "pos": [V.SAT_POS.table],
    }

    def __init__(self, spark: SparkSession, sf_dir: str, load_dts=LOAD_DTS):
        self.spark, self.sf_dir, self.load_dts = spark, sf_dir, load_dts
        self._built: dict[str, DataFrame] = {}

    def _build(self, group: str) -> dict[str, DataFrame]:
        sp, sf, ld = self.spark, self.sf_dir, self.load_dts
        if group == "application":
            return application_targets(staged_dataset(sp, sf, "stg_application"), ld)
        if group == "bureau":
            return bureau_targets(staged_dataset(sp, sf, "stg_bureau"), ld)
        if group == "bureau_balance":
            return bureau_balance_targets(staged_dataset(sp, sf, "stg_bureau_balance"), ld)
        if group == "prev":
            return prev_targets(staged_dataset(sp, sf, "stg_previous_application"), ld)
        adapter, spec = {"installments": ("stg_installments_payments", V.SAT_INSTALLMENT),
                         "card": ("stg_credit_card_balance", V.SAT_CARD),
                         "pos": ("stg_pos_cash_balance", V.SAT_POS)}[group]
        return {spec.table: multi_active_targets(staged_dataset(sp, sf, adapter), spec, ld)}

    def __getitem__(self, table: str) -> DataFrame:
        if table not in self._built:
            group = next((g for g, ts in self._GROUPS.items() if table in ts), None)
            if group is None:
                raise KeyError(table)
            self._built.update(self._build(group))
        return self._built[table]

    def __iter__(self):
        for ts in self._GROUPS.values():
            yield from ts

    def __len__(self) -> int:
        return sum(len(ts) for ts in self._GROUPS.values())


def vault_tables(spark: SparkSession, sf_dir: str, load_dts=LOAD_DTS) -> Vault:
    """Every vault target of one load over the driver tables, lazily."""
    return Vault(spark, sf_dir, load_dts)


_RANK = {"hub": 0, "link": 1, "sat": 2}


def _rank(table: str) -> int:
    return _RANK[table.split("_")[1]]


# hubs first, then links, then satellites: the order the foreign keys need
def load_order(tables: dict[str, DataFrame]) -> list[str]:
    return sorted(tables, key=lambda t: (_rank(t), t))


#: tables written at once: most of a small table's write is waiting for its few tasks
WRITERS = 4
#: hex digits take half the room of the default codec
CODEC = {"compression": "zstd"}
#: rows of a load are dealt by the parent's key: a join on it and on sub-keys
#: deals the other side alike and leaves the rows where they are
WRITE_CONF = DROP_SHUFFLES | {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def _write_all(tables, write: Callable[[str, DataFrame], tuple[int, int]]) -> dict[str, tuple[int, int]]:
    """``write`` for every table, several of one kind at once: all hubs are
    written before any link, and these before any satellite."""
    counts = {}
    with ThreadPool(WRITERS) as pool:
        for _, names in groupby(load_order(tables), _rank):
            # frames are made here, one after the other: their makers share what they have made
            rows = [(n, tables[n]) for n in names]
            run = inheritable_thread_target(rows[0][1].sparkSession)(write)
            counts.update(zip([n for n, _ in rows], pool.starmap(run, rows, chunksize=1)))
    return counts


def _load_key(load_dts) -> str:
    return str(load_dts).replace(" ", "T").replace(":", "")


def _is_sat(name: str) -> bool:
    return name.split("_")[1] == "sat"


PREFIX = "key_prefix"
#: hex digits of the hash key by which hubs and links are stored in partitions
PREFIX_CHARS = 1


def _prefix(key: str) -> Column:
    # the letter keeps Spark from reading digits as a number
    return F.concat(F.lit("k"), F.substring(key, 1, PREFIX_CHARS))


def _known_keys(stored: DataFrame | None, offered: DataFrame, key: str) -> DataFrame | None:
    """Keys of the stored loads, of the prefixes alone that the offered rows
    have: the other partitions are not read."""
    if stored is None or PREFIX not in stored.columns:
        return stored
    brought = [r[0] for r in offered.select(_prefix(key).alias("p")).distinct().collect()]
    return stored.where(F.col(PREFIX).isin(brought))


def _counted(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame, and its row count once it has been run (K-06)."""
    seen = Observation()
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def _n(seen: Observation) -> int:
    """The observed count.  An input that turns out to have no rows is planned
    away at run time, and its observation with it: then there is nothing to get."""
    try:
        return seen.get["n"]
    except Py4JJavaError:
        return 0


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _changed(rows: DataFrame, name: str, current: DataFrame | None, history: DataFrame | None, load_dts) -> DataFrame:
    """W-04: the rows whose hashdiff is not that of the version before them.
    Where the snapshot's row is older than the load it is that version; keys
    that a later load (or this one, in a retry) brought already are looked up
    in the history, and only these."""
    if current is None:
        return rows
    keys = SAT_KEYS[name]
    at = F.lit(str(load_dts)).cast("timestamp_ntz")
    if not current.agg(F.max("load_dts") >= at).first()[0]:
        # no key is of this load or a later one: the snapshot alone decides
        last = current.select(*keys, F.col("hashdiff").alias("_hd"), F.lit(True).alias("_met"))
        met = rows.join(last, keys, "left")
        return met.where(F.col("_met").isNull() | (F.col("_hd") != F.col("hashdiff"))).drop("_hd", "_met")
    now = current.select(*keys, F.col("hashdiff").alias("_hd"), F.col("load_dts").alias("_at"))
    met = rows.join(now, keys, "left")
    plain = met.where(F.col("_at").isNull() | ((F.col("_at") < at) & (F.col("_hd") != F.col("hashdiff")))).drop("_hd", "_at")
    late = met.where(F.col("_at") >= at).drop("_hd", "_at")
    before = history.where(F.col("load_dts") < at).join(late.select(*keys).distinct(), keys, "left_semi")
    return plain.unionByName(changed_rows(late, before, keys))


def write_vault(tables, root: str, load_dts=LOAD_DTS, mode: str = "always", snapshots: bool = False) -> dict[str, tuple[int, int]]:
    """Insert-only vault on files: each load of each target is one folder
    ``root/<table>/load=<ts>``, written in load order (hubs, links,
    satellites).  Hubs and links skip keys of all other loads, earlier or later
    ones, so loads may come in any order; they are stored in partitions by the
    first digits of their key, and only the prefixes that a load brings are
    read again.  Satellites take every offered row (``mode`` "always") or those
    that changed ("changed", which needs the snapshots).  Re-running a load
    after a failure overwrites exactly that load's folder, so a retry never
    duplicates rows; other loads are never touched.

    ``snapshots`` keeps one current row per key of every satellite in
    ``root/<table>__current``, upserted from the rows of the load (W-03).

    Returns (rows offered, rows inserted) per table, observed while writing."""
    key = _load_key(load_dts)

    def write(name: str, table: DataFrame) -> tuple[int, int]:
        path = f"{root.rstrip('/')}/{name}"
        spark = table.sparkSession
        stored = _stored(spark, path)
        others = None if stored is None else stored.where(F.col("load") != key)
        df, offered = _counted(table)
        if _is_sat(name):
            now = buckets.read(spark, f"{path}__current") if snapshots else None
            rows = _changed(df, name, now, others, load_dts) if mode == "changed" else df
            rows, inserted = _counted(rows)
            rows.write.mode("overwrite").options(**CODEC).parquet(f"{path}/load={key}")
            if snapshots:
                buckets.upsert(spark.read.parquet(f"{path}/load={key}"), f"{path}__current", SAT_KEYS[name], ["load_dts"],
                               few_per_key=True)
        else:
            hk = df.columns[0]
            rows, inserted = _counted(insert_new(df, _known_keys(others, table, hk), hk))
            (rows.withColumn(PREFIX, _prefix(hk)).write.mode("overwrite").options(**CODEC).partitionBy(PREFIX)
             .parquet(f"{path}/load={key}"))
        return _n(offered), _n(inserted)
    with session_conf(_session(tables), WRITE_CONF):
        return _write_all(tables, write)


def _session(tables) -> SparkSession:
    return tables[next(iter(tables))].sparkSession


class FileVault(dict):
    """Tables read from plain files, their rows in no order."""


def read_vault(spark: SparkSession, root: str, names) -> FileVault:
    """All loads of each target (history), without the folder columns."""
    return FileVault({n: spark.read.parquet(f"{root.rstrip('/')}/{n}").drop("load", PREFIX) for n in names})


class CurrentVault(FileVault):
    """Tables of which the satellites have one row per key: nothing has to be
    picked from a history."""


def read_vault_current(spark: SparkSession, root: str, names) -> CurrentVault:
    """Hubs and links, and the snapshot of each satellite (W-03)."""
    root = root.rstrip("/")
    hubs = read_vault(spark, root, [n for n in names if not _is_sat(n)])
    return CurrentVault(hubs | {n: buckets.read(spark, f"{root}/{n}__current") for n in names if _is_sat(n)})


def bucket_key(table: str, df: DataFrame) -> str:
    """Storage clustering key of a vault table: the parent hash key for hubs
    and satellites, the child hash key for links (the side the child
    satellites join on).  Every table joined on the same key shares buckets."""
    if table == V.LINK_APP_BUREAU.table:
        return "hk_bureau_credit"
    if table == V.LINK_APP_PREV.table:
        return "hk_prev_application"
    return df.columns[0]


def write_vault_bucketed(spark: SparkSession, tables, root: str, n_buckets: int,
                         database: str = "creditlake_vault", load_dts=LOAD_DTS) -> dict[str, tuple[int, int]]:
    """At-scale layout: every vault table bucketed (and sorted) by its join
    key with the same bucket count, partitioned by load, as catalog tables
    over ``root``.  The mart then joins hub, satellites and links bucket to
    bucket: the chain of joins and the current-version windows need no
    shuffle.  A load replaces only its own partition (dynamic partition
    overwrite), so a retried load never duplicates rows and earlier loads stay;
    hubs and links skip keys of all other loads.  Returns (rows offered, rows
    inserted) per table, observed while writing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{root.rstrip('/')}'")
    load = _load_key(load_dts)

    def write(name: str, df: DataFrame) -> tuple[int, int]:
        table, key = f"{database}.{name}", bucket_key(name, df)
        exists = spark.catalog.tableExists(table)
        others = spark.table(table).where(F.col("load") != load) if exists else None
        df, offered = _counted(df)
        rows = df if _is_sat(name) else insert_new(df, others, df.columns[0])
        rows, inserted = _counted(rows)

        # one shuffle on the bucket key first: each task then holds exactly one
        # bucket and writes one file for it (not one file per bucket per task)
        out = rows.repartition(n_buckets, key).withColumn("load", F.lit(load))
        if exists:
            out.write.insertInto(table, overwrite=True)
        else:
            (out.write.option("path", f"{root.rstrip('/')}/{name}").options(**CODEC).partitionBy("load")
             .bucketBy(n_buckets, key).sortBy(key).saveAsTable(table))
        return _n(offered), _n(inserted)

    # a load replaces only the partitions that its rows have (none, where it
    # brings no new key); insertInto takes the overwrite mode from the session
    # alone, not from a writer option
    with session_conf(spark, DROP_SHUFFLES | {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
        return _write_all(tables, write)


def read_vault_tables(spark: SparkSession, database: str = "creditlake_vault") -> dict[str, DataFrame]:
    names = [t.name for t in spark.catalog.listTables(database)]
    return {n: spark.table(f"{database}.{n}").drop("load") for n in names}
