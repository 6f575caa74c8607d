"""D. Objects: schema sizes, object counts, statistics age, unused indexes."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.operators.scope import sort_if
from fleetscope.functions.exprs import elapsed_s, pct, pretty_bytes
from fleetscope.operators.scope import salted_lookup, with_totals

# Relation kind letters and the labels the object count shows;
# other letters print as themselves.
RELKIND_LABELS = [
    ("r", "table"),
    ("i", "index"),
    ("S", "sequence"),
    ("v", "view"),
    ("m", "materialized view"),
    ("c", "composite type"),
    ("t", "toast table"),
    ("f", "foreign table"),
    ("p", "partitioned table"),
    ("I", "partitioned index"),
    ("G", "global index"),
]

DB = SCOPE + ["datname"]


def schema_size(relations: DataFrame, databases: DataFrame, ordered: bool = False) -> DataFrame:
    """Bytes per schema of each database snapshot, share of the
    database size, and the database size; largest first."""
    sizes = relations.groupBy(*DB, F.col("nspname").alias("sch_name")).agg(F.sum("size_bytes").alias("sch_bytes"))
    db = databases.select(*DB, F.col("size_bytes").alias("db_bytes"))
    rows = (sizes.join(db, on=DB, how="left")
            .select(*DB, "sch_name", F.col("sch_bytes").cast("bigint").alias("sch_bytes"),
                    pretty_bytes("sch_bytes").alias("sch_size"),
                    pct("sch_bytes", "db_bytes", 2).alias("sch_ratio"),
                    pretty_bytes("db_bytes").alias("db_size")))
    return sort_if(rows, ordered, *DB, F.col("sch_bytes").desc_nulls_first(), "sch_name")


def object_counts(relations: DataFrame, tablespaces: DataFrame, databases: DataFrame, ordered: bool = False) -> DataFrame:
    """Objects of each database snapshot by owner, schema, tablespace
    (its own, or the database default when 0) and kind: count, share, total."""
    kinds = F.create_map(*[F.lit(x) for x in chain.from_iterable(RELKIND_LABELS)])
    own_ts = tablespaces.select(*SCOPE, F.col("oid").alias("tablespace_oid"), F.col("spcname").alias("own_tbs"))
    db_ts = (databases.select(*DB, F.col("tablespace_oid").alias("db_ts_oid"))
             .join(tablespaces.select(*SCOPE, F.col("oid").alias("db_ts_oid"), F.col("spcname").alias("db_tbs")),
                   on=[*SCOPE, "db_ts_oid"], how="left")
             .drop("db_ts_oid"))
    # both lookups have one row per key while one scope or database may hold most relations: salted
    rel = salted_lookup(salted_lookup(relations, own_ts, [*SCOPE, "tablespace_oid"]), db_ts, DB)
    g = (rel.groupBy(*DB,
                     F.col("relowner").alias("obj_owner"),
                     F.col("nspname").alias("obj_schema"),
                     F.when(F.col("tablespace_oid") != 0, F.col("own_tbs")).otherwise(F.col("db_tbs")).alias("obj_tbs"),
                     F.coalesce(F.element_at(kinds, F.col("relkind")), F.col("relkind")).alias("obj_type"))
         .agg(F.count(F.lit(1)).alias("obj_count")))
    g = with_totals(g, {"obj_total": F.sum("obj_count")}, scope=DB)
    rows = (g.select(*DB, "obj_owner", "obj_schema", "obj_tbs", "obj_type", "obj_count",
                     pct("obj_count", "obj_total", 2).alias("obj_ratio"),
                     F.col("obj_total").cast("bigint").alias("obj_total")))
    return sort_if(rows, ordered, *DB, F.col("obj_count").desc(), "obj_owner", "obj_schema", "obj_tbs", "obj_type")


ROLLUP_LEVELS = {7: "server", 3: "database", 1: "schema", 0: "kind"}


def size_rollup(relations: DataFrame, ordered: bool = False) -> DataFrame:
    """R07, R28 and R29 in one pass: objects and bytes of every server,
    database, schema and kind within a schema, with the share of the level
    above. One scan and one shuffle of partial sums serve all levels
    (grouping sets, told apart by ``grouping_id``); the shares come from
    windows over the rolled-up rows of a server."""
    kinds = F.create_map(*[F.lit(x) for x in chain.from_iterable(RELKIND_LABELS)])
    labelled = relations.select(*DB, F.col("nspname").alias("schema"), F.coalesce(F.element_at(kinds, F.col("relkind")), F.col("relkind")).alias("kind"),
                                "size_bytes")
    sets = [[*SCOPE], DB, [*DB, "schema"], [*DB, "schema", "kind"]]
    rolled = labelled.groupingSets(sets, *DB, "schema", "kind").agg(
        F.grouping_id().alias("_gid"), F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"))
    levels = F.create_map(*[F.lit(x) for x in chain.from_iterable(ROLLUP_LEVELS.items())])
    rolled = rolled.withColumn("level", F.element_at(levels, F.col("_gid").cast("int"))).repartition(*SCOPE)

    def above(level: str, *keys: str) -> F.Column:
        return F.max(F.when(F.col("level") == level, F.col("bytes"))).over(Window.partitionBy(*SCOPE, *keys))

    whole = (F.when(F.col("level") == "kind", above("schema", "datname", "schema")).when(F.col("level") == "schema", above("database", "datname"))
             .when(F.col("level") == "database", above("server")).otherwise(F.col("bytes")))
    rows = rolled.select(*DB, "schema", "kind", "level", "objects", F.col("bytes").cast("bigint").alias("bytes"),
                         pretty_bytes("bytes").alias("size"), whole.alias("_whole"))
    rows = rows.withColumn("pct_of_above", pct("bytes", "_whole", 2)).drop("_whole")
    return sort_if(rows, ordered, *SCOPE, F.col("datname").asc_nulls_first(), F.col("schema").asc_nulls_first(), F.col("kind").asc_nulls_first())


def stats_age(databases: DataFrame) -> DataFrame:
    """Since when each database's counters accumulate (statistics reset,
    else server start) and how long ago that was."""
    since = F.coalesce("stats_reset", "start_time")
    return databases.select(*SCOPE, F.col("snap_ts").alias("check_date"), "datname",
                            since.alias("stats_or_start_time"),
                            elapsed_s(F.col("snap_ts"), since).alias("age_since_reset_or_start_s"))


def _unused(index_stats: DataFrame, indexes: DataFrame) -> DataFrame:
    return (index_stats.where(F.col("idx_scan") == 0)
            .join(indexes.where(~F.col("indisunique")), on=[*DB, "indexrelid"], how="inner"))


def unused_indexes(index_stats: DataFrame, indexes: DataFrame, ordered: bool = False) -> DataFrame:
    """Never-scanned non-unique indexes with their size, largest first."""
    rows = (_unused(index_stats, indexes)
            .select(*DB, "schemaname", F.col("relname").alias("table_name"),
                    F.col("idxname").alias("index_name"), "idx_scan", "indisunique",
                    F.col("size_bytes").alias("index_bytes"), pretty_bytes("size_bytes").alias("index_size")))
    return sort_if(rows, ordered, *DB, F.col("index_bytes").desc_nulls_first(), "index_name")


def unused_indexes_total(index_stats: DataFrame, indexes: DataFrame) -> DataFrame:
    """Total size of the indexes of R31 per database; ``0 bytes`` if none."""
    scopes = index_stats.select(*DB).distinct()
    total = _unused(index_stats, indexes).groupBy(*DB).agg(F.sum("size_bytes").alias("_bytes"))
    return (scopes.join(total, on=DB, how="left")
            .select(*DB, F.coalesce("_bytes", F.lit(0)).cast("bigint").alias("total_unused_idx_bytes"),
                    F.coalesce(pretty_bytes("_bytes"), F.lit("0 bytes")).alias("total_unused_idx_size")))
