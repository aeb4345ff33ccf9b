"""Generic Data Vault 2.0 operators: hubs, links, satellites, history.

A vault target is described by a spec (see ``plans.vault_specs``); one
staging DataFrame produces every target of its source with one ``select``
each.  Keys are md5 hash keys (``functions.hashing``).  Loads are
insert-only; history is kept by ``load_dts``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.hashing import hash_key, hashdiff
from ..functions.json_text import json_hashdiff, json_object_text
from ..schemas import staging_types


@dataclass(frozen=True)
class KeyRef:
    """A hub reference: output hash-key column, hash prefix, business key(s)."""
    hk: str
    prefix: str
    bk: tuple[str, ...]

    def column(self) -> Column:
        return hash_key(self.prefix, *[F.col(b) for b in self.bk])


@dataclass(frozen=True)
class HubSpec:
    table: str
    ref: KeyRef
    record_source: str


@dataclass(frozen=True)
class LinkSpec:
    table: str
    hk: str
    prefix: str
    bk: tuple[str, ...]              # business keys hashed into the link key
    refs: tuple[KeyRef, ...]         # hub keys carried by the link
    record_source: str


@dataclass(frozen=True)
class SatSpec:
    table: str
    parent: KeyRef
    attrs: tuple[tuple[str, str, str], ...]        # (output name, vault type, staging column)
    hashdiff: tuple[str, ...] = ()                 # staging columns hashed
    subkeys: tuple[tuple[str, str], ...] = ()      # multi-active (name, type)
    packs: tuple[tuple[str, tuple[str, ...]], ...] = ()   # JSON pack columns
    hashdiff_pack: str | None = None               # hash the sorted-key JSON of this pack
    hashdiff_subkeys: bool = False                 # sub-keys lead the hashdiff parts
    where: str | None = None                       # emit condition (P-09)
    record_source: str = ""

    @property
    def key_columns(self) -> list[str]:
        return [self.parent.hk] + [s for s, _ in self.subkeys]


def _ts(load_dts) -> Column:
    if isinstance(load_dts, Column):
        return load_dts
    return F.lit(str(load_dts)).cast("timestamp_ntz")


def dealt_by(rows: DataFrame, key: Column) -> DataFrame:
    """The rows dealt over the tasks by a hash key that is computed after the
    shuffle: what travels are the business keys, not 32 hex digits, and Spark
    knows the rows to be partitioned by the key's column, so that reducing,
    picking versions, grouping and joining on it need no further shuffle."""
    return rows.repartition(key)


def hub_frame(staged: DataFrame, spec: HubSpec, load_dts) -> DataFrame:
    """Hub rows: one per business key (K-03 within the batch)."""
    ref = spec.ref
    # every column is a function of the business key: a plain distinct
    # (hash aggregate on the key columns) equals dropDuplicates on the hash key
    keys = dealt_by(staged.where(_not_null(ref.bk)).select(*ref.bk).distinct(), ref.column())
    return (keys.select(ref.column().alias(ref.hk), *ref.bk)
            .withColumn("record_source", F.lit(spec.record_source))
            .withColumn("load_dts", _ts(load_dts)))


def link_frame(staged: DataFrame, spec: LinkSpec, load_dts) -> DataFrame:
    # satellites join on the child's key, the last one
    keys = list(dict.fromkeys([*spec.bk, *[b for r in spec.refs for b in r.bk]]))
    rows = dealt_by(staged.where(_not_null(spec.bk)).select(*keys).distinct(), spec.refs[-1].column()).select(
        hash_key(spec.prefix, *[F.col(b) for b in spec.bk]).alias(spec.hk),
        *[r.column().alias(r.hk) for r in spec.refs],
    )
    return (rows.distinct()
            .withColumn("record_source", F.lit(spec.record_source))
            .withColumn("load_dts", _ts(load_dts)))


def sat_frame(staged: DataFrame, spec: SatSpec, load_dts) -> DataFrame:
    """Satellite rows for one load.  ``staged`` must carry staging types
    (the hashdiff is computed on the staging values, as the source system
    saw them) and be unique per parent key (+ sub-keys)."""
    types = {f.name: f.dataType for f in staged.schema.fields}
    declared = staging_types()
    df = staged.where(_not_null(spec.parent.bk + tuple(s for s, _ in spec.subkeys)))
    if spec.where:
        df = df.where(spec.where)
    pack_cols = {
        name: [(k, F.col(k), types[k]) for k in keys if k in types]
        for name, keys in spec.packs
    }
    if spec.hashdiff_pack:
        hd = json_hashdiff(pack_cols[spec.hashdiff_pack])
    else:
        names = ([s for s, _ in spec.subkeys] if spec.hashdiff_subkeys else []) + list(spec.hashdiff)
        parts = []
        for n in names:
            if n in types:
                parts.append((F.col(n), types[n]))
            else:       # attribute absent from this extract: null, i.e. '' in the hash
                t = _parse_datatype_string(declared.get(n, "string"))
                parts.append((F.lit(None).cast(t), t))
        hd = hashdiff(parts)
    ld = _ts(load_dts)
    # a hash key computed upstream (e.g. by the reduce step) is reused, so the
    # partitioning on it carries through to the current-version window
    hk = F.col(spec.parent.hk) if spec.parent.hk in types else spec.parent.column()
    out = [hk.alias(spec.parent.hk)]
    out += [F.col(s).cast(t).alias(s) for s, t in spec.subkeys]
    out.append(hd.alias("hashdiff"))
    for name, vtype, src in spec.attrs:
        c = F.col(src) if src in types else F.lit(None)
        out.append(c.cast(vtype).alias(name))
    for name, _ in spec.packs:
        out.append(json_object_text(pack_cols[name]).alias(name))
    out += [F.lit(spec.record_source).alias("record_source"),
            ld.alias("load_dts"), ld.alias("effective_from")]
    return df.select(*out)


def reduce_to_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Make a staging frame unique per ``keys`` with an order-free rule: keep
    the greatest row (struct order over the remaining columns, null lowest).
    The aggregate is partial (map-side) before the shuffle, so a hot key is
    reduced where it is read."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    agg = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(c) for c in rest])).alias("_r"))
    return agg.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def current_rows(sat: DataFrame, keys: list[str], order: str = "load_dts",
                 cluster_by: str | None = None) -> DataFrame:
    """W-03: latest version per key.  ``row_number() = 1`` is planned as a
    WindowGroupLimit, so each task keeps only its local latest row before
    the shuffle.  ``cluster_by`` (a prefix of the key, e.g. the parent hash
    key of a multi-active satellite) shuffles on that column only, so a
    per-parent aggregation after it needs no second exchange; use it only
    where one parent cannot hold a large share of the rows (it gives up the
    map-side top-1 and sends each parent to one task)."""
    if cluster_by:
        sat = sat.repartition(cluster_by)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return sat.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def insert_new(batch: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """K-03 / J-06: ``INSERT ... ON CONFLICT (key) DO NOTHING`` as a frame of
    the rows to append: unique within the batch and absent from the target."""
    rows = batch.dropDuplicates([key])
    if target is None:
        return rows
    return rows.join(target.select(key), key, "left_anti")


def changed_rows(batch: DataFrame, target: DataFrame | None, keys: list[str]) -> DataFrame:
    """W-04: satellite rows whose hashdiff differs from the current version
    (or whose key is new).  This is the ``mode="changed"`` load; the
    reference appends every offered row (``mode="always"``)."""
    if target is None:
        return batch
    cur = current_rows(target, keys).select(*keys, F.col("hashdiff").alias("_cur_hd"))
    joined = batch.join(cur, keys, "left")
    return joined.where(F.col("_cur_hd").isNull() | (F.col("_cur_hd") != F.col("hashdiff"))).drop("_cur_hd")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """J-10: child rows whose foreign key has no parent row."""
    return child.join(parent.select(F.col(pk).alias(fk)).distinct(), fk, "left_anti")


def _not_null(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull()
    return cond


def parse_type(t: str):
    return _parse_datatype_string(t)
