"""E. Bloat: table and btree-index size estimates from column statistics.

Estimates are per database snapshot, keyed by (instance, snap_ts, datname):
databases of one server share oids (all catalogs, and clones of a template).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope import SCOPE
from fleetscope.operators.scope import sort_if
from fleetscope.functions.exprs import pretty_bytes, round_div
from fleetscope.operators.scope import top_k

DB = SCOPE + ["datname"]

# Fixed values of the estimate: 64-bit alignment, page header bytes, btree
# page special space, default fill factors, heap tuple header bytes.
MAXALIGN = 8
PAGE_HEADER = 24
BTREE_OPAQUE = 16
TABLE_FILLFACTOR = 100
INDEX_FILLFACTOR = 90
HEAP_TUPLE_HEADER = 23
INDEX_TUPLE_HEADER = 8
INDEX_TUPLE_HEADER_NULLS = 12
MISSING_INDEX_WIDTH = 1024
TRUSTED_INDEX_PAGES = 10

SYSTEM_SCHEMAS = ["pg_catalog", "information_schema"]


def _user_schema(c: str = "nspname") -> Column:
    return (~F.col(c).isin(SYSTEM_SCHEMAS) & ~F.col(c).like("pg_temp%") & ~F.col(c).like("pg_toast_temp%"))


def _fillfactor(options: str, default: int) -> Column:
    ff = F.regexp_extract(F.array_join(F.col(options), " "), r"fillfactor=([0-9]+)", 1)
    return F.coalesce(F.when(ff != "", ff.cast("int")), F.lit(default))


def _pad(x: Column) -> Column:
    """Alignment remainder: ``ma`` when ``x`` is aligned, else ``x % ma``."""
    r = F.pmod(x, F.lit(MAXALIGN))
    return F.when(r == 0, F.lit(MAXALIGN)).otherwise(r)


def column_facts(attributes: DataFrame, column_stats: DataFrame) -> DataFrame:
    """Every column with its statistics, if it has any: the one frame that
    both estimates read."""
    stats = column_stats.select(*DB, "relid", "attname", "null_frac", "avg_width", F.lit(True).alias("has_stats"))
    return attributes.withColumnRenamed("attrelid", "relid").join(stats, on=[*DB, "relid", "attname"], how="left")


def table_page_estimate(relations: DataFrame, attributes: DataFrame, column_stats: DataFrame,
                        block_size: int = 8192) -> DataFrame:
    """Per table (kinds r, t, m outside system and temp schemas) the
    estimated tuple size and page count at 100% and at the fill factor.
    Columns are summed per (scope, database, oid) before names are attached."""
    null_share = F.coalesce("null_frac", F.lit(0.0))
    per_table = (column_facts(attributes, column_stats).where(~F.col("attisdropped"))
                 .groupBy(*DB, "relid")
                 .agg(F.max(null_share).alias("most_null"),
                      F.count("has_stats").alias("n_stats"),
                      F.bool_or((F.col("attname") == "oid") & (F.col("attnum") < 0)).alias("has_oid"),
                      F.sum((1 - null_share) * F.coalesce(F.col("avg_width"), F.lit(0))).alias("row_data"),
                      F.bool_or(F.col("typname") == "name").alias("has_name"),
                      F.count_if(F.col("attnum") > 0).alias("n_user")))
    tables = (relations.where(F.col("relkind").isin("r", "t", "m") & _user_schema())
              .select(*DB, F.col("oid").alias("relid"), "nspname", "relname", "reltuples",
                      (F.col("relpages") + F.coalesce("toast_pages", F.lit(0))).alias("pages"),
                      F.ceil(F.coalesce("toast_tuples", F.lit(0.0)) / 4).alias("toast_est"),
                      _fillfactor("reloptions", TABLE_FILLFACTOR).alias("fillfactor")))
    header = (F.lit(HEAP_TUPLE_HEADER)
              + F.when(F.col("most_null") > 0, F.expr("(n_stats + 7) div 8")).otherwise(F.lit(0))
              + F.when(F.col("has_oid"), F.lit(4)).otherwise(F.lit(0))).cast("bigint")
    row_bytes = (F.lit(4) + F.col("header") + F.col("row_data") + F.lit(2 * MAXALIGN)
                 - _pad(F.col("header")) - _pad(F.ceil("row_data"))).cast("double")
    sized = (tables.join(per_table, on=[*DB, "relid"], how="inner")
             .withColumn("header", header).withColumn("row_bytes", row_bytes))
    room = F.lit(float(block_size - PAGE_HEADER))
    full = F.ceil(F.col("reltuples") / (room / F.col("row_bytes"))) + F.col("toast_est")
    filled = F.ceil(F.col("reltuples") / (room * F.col("fillfactor") / (F.col("row_bytes") * 100))) + F.col("toast_est")
    return sized.select(
        *DB, F.col("relid").alias("tblid"), F.col("nspname").alias("schemaname"), F.col("relname").alias("tblname"),
        F.col("pages").alias("tblpages"),
        full.cast("bigint").alias("est_tblpages"),
        filled.cast("bigint").alias("est_tblpages_ff"),
        "fillfactor",
        (F.coalesce(F.col("has_name"), F.lit(False)) | (F.col("n_user") != F.col("n_stats"))).alias("is_na"),
        F.lit(block_size).cast("bigint").alias("bs"))


def _table_sizes(est: DataFrame) -> DataFrame:
    extra_pages = F.col("tblpages") - F.col("est_tblpages")
    bloat_pages = F.col("tblpages") - F.col("est_tblpages_ff")
    return est.select(
        "*",
        (F.col("bs") * F.col("tblpages")).alias("real_bytes"),
        (extra_pages * F.col("bs")).alias("extra_bytes"),
        F.when((F.col("tblpages") > 0) & (extra_pages > 0), 100 * extra_pages / F.col("tblpages").cast("double"))
        .otherwise(F.lit(0.0)).alias("_extra_pct"),
        F.when((F.col("tblpages") > 0) & (extra_pages > 0), round_div(100 * extra_pages, "tblpages", 2))
        .otherwise(F.lit(0.0)).alias("extra_pct"),
        F.when(bloat_pages > 0, bloat_pages * F.col("bs")).otherwise(F.lit(0)).alias("bloat_bytes"),
        (bloat_pages * F.col("bs")).alias("_raw_bloat_bytes"),
        F.when((F.col("tblpages") > 0) & (bloat_pages > 0), 100 * bloat_pages / F.col("tblpages").cast("double"))
        .otherwise(F.lit(0.0)).alias("_bloat_pct"),
        F.when((F.col("tblpages") > 0) & (bloat_pages > 0), round_div(100 * bloat_pages, "tblpages", 2))
        .otherwise(F.lit(0.0)).alias("bloat_pct"))


def table_bloat(relations: DataFrame, attributes: DataFrame, column_stats: DataFrame, table_stats: DataFrame,
                n: int = 10, block_size: int = 8192, ordered: bool = False) -> DataFrame:
    """The ``n`` tables per database with the most estimated bloat
    (bloat above 0 only); extra size may be negative."""
    sizes = _table_sizes(table_page_estimate(relations, attributes, column_stats, block_size))
    stat = table_stats.select(*DB, F.col("relid").alias("tblid"), "last_analyze", "last_autoanalyze")
    rows = (sizes.where(F.col("_raw_bloat_bytes") > 0)
            .join(stat, on=[*DB, "tblid"], how="left")
            .select(*DB, "tblid", "schemaname", "tblname", "real_bytes",
                    pretty_bytes("real_bytes").alias("real_size"), "extra_bytes",
                    pretty_bytes("extra_bytes").alias("extra_size"), "extra_pct", "fillfactor",
                    "bloat_bytes", pretty_bytes("bloat_bytes").alias("bloat_size"), "bloat_pct", "is_na",
                    "last_analyze", "last_autoanalyze"))
    order = [F.col("bloat_bytes").desc(), F.col("tblid")]
    return sort_if(top_k(rows, order, n, scope=DB), ordered, *DB, *order)


def _table_totals(relations, attributes, column_stats, block_size) -> DataFrame:
    sizes = _table_sizes(table_page_estimate(relations, attributes, column_stats, block_size))
    return (sizes.groupBy(*DB)
            .agg(F.sum("real_bytes").alias("t_real"), F.sum("extra_bytes").alias("t_extra"),
                 F.avg("_extra_pct").alias("t_extra_pct"), F.sum("bloat_bytes").alias("t_bloat"),
                 F.avg("_bloat_pct").alias("t_bloat_pct"), F.count(F.lit(1)).alias("t_count"),
                 F.sum("_raw_bloat_bytes").alias("_raw_bloat"))
            .where(F.col("_raw_bloat") > 0))


def table_bloat_total(relations: DataFrame, attributes: DataFrame, column_stats: DataFrame,
                      block_size: int = 8192) -> DataFrame:
    """Per database the summed real, extra and bloat sizes, the average
    of the per-table clipped percentages and the table count; no row when
    the summed unclipped bloat is not positive."""
    t = _table_totals(relations, attributes, column_stats, block_size)
    return t.select(*DB,
                    F.col("t_real").cast("bigint").alias("total_real_bytes"),
                    pretty_bytes("t_real").alias("total_real_size"),
                    F.col("t_extra").cast("bigint").alias("total_extra_bytes"),
                    pretty_bytes("t_extra").alias("total_extra_size"),
                    F.round("t_extra_pct", 2).alias("avg_extra_pct"),
                    F.col("t_bloat").cast("bigint").alias("total_bloat_bytes"),
                    pretty_bytes("t_bloat").alias("total_bloat_size"),
                    F.round("t_bloat_pct", 2).alias("avg_bloat_pct"),
                    F.col("t_count").alias("total_tables_count"))


def index_page_estimate(indexes: DataFrame, relations: DataFrame, attributes: DataFrame,
                        column_stats: DataFrame, block_size: int = 8192) -> DataFrame:
    """Per btree index with pages, the estimated page count at 100% and
    at the fill factor. A key of the key vector names a table column by its
    number; key 0 is an expression column of the index itself, at the key's
    position. Both are one lookup on computed keys, summed per (scope,
    database, index) before names are attached."""
    btree = indexes.where((F.col("amname") == "btree") & (F.col("relpages") > 0))
    keys = (btree.select(*DB, "indexrelid", "indrelid", F.posexplode(F.split("indkey", " ")).alias("at", "key"))
            .withColumn("key", F.col("key").cast("int")))
    on_table = F.col("key") != 0
    keys = keys.select(*DB, "indexrelid", F.when(on_table, F.col("indrelid")).otherwise(F.col("indexrelid")).alias("relid"),
                       F.when(on_table, F.col("key")).otherwise(F.col("at") + 1).alias("attnum"))
    known = column_facts(attributes, column_stats).where("has_stats")
    null_share = F.coalesce("null_frac", F.lit(0.0))
    per_index = (keys.join(known, on=[*DB, "relid", "attnum"], how="inner")
                 .groupBy(*DB, "indexrelid")
                 .agg(F.max(null_share).alias("most_null"),
                      F.sum((1 - null_share) * F.coalesce(F.col("avg_width"), F.lit(MISSING_INDEX_WIDTH))).alias("key_data"),
                      F.bool_or(F.col("typname") == "name").alias("has_name")))
    tables = relations.where(_user_schema()).select(*DB, F.col("oid").alias("indrelid"), F.col("relname").alias("tblname"),
                                                    F.col("nspname").alias("schemaname"))
    data = F.col("key_data")
    rounded = F.rint(data).cast("bigint")  # float to integer rounds half to even
    header = F.when(F.col("most_null") == 0, F.lit(INDEX_TUPLE_HEADER)).otherwise(F.lit(INDEX_TUPLE_HEADER_NULLS))
    entry = (F.col("header") + MAXALIGN - _pad(F.col("header")) + data + MAXALIGN
             - F.when(data == 0, F.lit(0)).otherwise(_pad(rounded))).cast("double")
    sized = (btree.join(per_index, on=[*DB, "indexrelid"], how="inner").join(tables, on=[*DB, "indrelid"], how="inner")
             .withColumn("fillfactor", _fillfactor("reloptions", INDEX_FILLFACTOR))
             .withColumn("header", header).withColumn("entry", entry))
    room = F.lit(float(block_size - BTREE_OPAQUE - PAGE_HEADER))

    def pages(per_page: Column) -> Column:
        return F.coalesce(1 + F.ceil(F.try_divide(F.col("reltuples"), F.floor(per_page).cast("double"))), F.lit(0)).cast("bigint")

    return sized.select(*DB, F.col("indexrelid").alias("idxoid"), "schemaname", "tblname", "idxname", "relpages",
                        pages(room / (4 + F.col("entry"))).alias("est_pages"),
                        pages(room * F.col("fillfactor") / (100 * (4 + F.col("entry")))).alias("est_pages_ff"),
                        "fillfactor", F.col("has_name").alias("is_na"), F.lit(block_size).cast("bigint").alias("bs"))


def _index_sizes(est: DataFrame) -> DataFrame:
    extra_pages = F.col("relpages") - F.col("est_pages")
    bloat_pages = F.col("relpages") - F.col("est_pages_ff")
    return est.select(
        "*",
        (F.col("bs") * F.col("relpages")).alias("real_bytes"),
        (F.col("bs") * extra_pages).alias("extra_bytes"),
        round_div(100 * extra_pages, "relpages", 2, signed=True).alias("extra_pct"),
        (100 * extra_pages / F.col("relpages").cast("double")).alias("_extra_pct"),
        F.when(F.col("relpages") > F.col("est_pages_ff"), F.col("bs") * bloat_pages)
        .otherwise(F.lit(0)).alias("bloat_bytes"),
        (F.col("bs") * bloat_pages).alias("_raw_bloat_bytes"),
        round_div(100 * bloat_pages, "relpages", 2, signed=True).alias("bloat_pct"),
        (100 * bloat_pages / F.col("relpages").cast("double")).alias("_bloat_pct"))


def index_bloat(indexes: DataFrame, relations: DataFrame, attributes: DataFrame, column_stats: DataFrame,
                n: int = 10, block_size: int = 8192, ordered: bool = False) -> DataFrame:
    """The ``n`` btree indexes per database with the most estimated
    bloat (bloat above 0 only; untrusted estimates included)."""
    sizes = _index_sizes(index_page_estimate(indexes, relations, attributes, column_stats, block_size))
    rows = (sizes.where(F.col("_raw_bloat_bytes") > 0)
            .select(*DB, "idxoid", "schemaname", "tblname", "idxname", "real_bytes",
                    pretty_bytes("real_bytes").alias("real_size"), "extra_bytes",
                    pretty_bytes("extra_bytes").alias("extra_size"), "extra_pct", "fillfactor",
                    "bloat_bytes", pretty_bytes("bloat_bytes").alias("bloat_size"), "bloat_pct", "is_na"))
    order = [F.col("bloat_bytes").desc(), F.col("idxoid")]
    return sort_if(top_k(rows, order, n, scope=DB), ordered, *DB, *order)


def _index_totals(indexes, relations, attributes, column_stats, block_size) -> DataFrame:
    sizes = _index_sizes(index_page_estimate(indexes, relations, attributes, column_stats, block_size))
    trusted = sizes.where(~F.col("is_na") & (F.col("relpages") > TRUSTED_INDEX_PAGES) & (F.col("bloat_bytes") > 0))
    zero = F.lit(0)
    agg = (trusted.groupBy(*DB)
           .agg(F.sum("real_bytes").alias("i_real"),
                F.sum(F.greatest(zero, F.col("extra_bytes"))).alias("i_extra"),
                F.avg(F.greatest(F.lit(0.0), F.col("_extra_pct"))).alias("i_extra_pct"),
                F.sum(F.greatest(zero, F.col("bloat_bytes"))).alias("i_bloat"),
                F.avg(F.greatest(F.lit(0.0), F.col("_bloat_pct"))).alias("i_bloat_pct"),
                F.count(F.lit(1)).alias("i_count")))
    dbs = relations.select(*DB).distinct()
    return dbs.join(agg, on=DB, how="left").select(
        *DB, *[F.coalesce(c, F.lit(0)).alias(c) for c in ["i_real", "i_extra", "i_bloat", "i_count"]],
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ["i_extra_pct", "i_bloat_pct"]])


def index_bloat_total(indexes: DataFrame, relations: DataFrame, attributes: DataFrame, column_stats: DataFrame,
                      block_size: int = 8192) -> DataFrame:
    """Per database totals over trusted btree indexes (statistics
    usable, more than 10 pages, bloat above 0), values clipped at 0."""
    t = _index_totals(indexes, relations, attributes, column_stats, block_size)
    return t.select(*DB,
                    F.col("i_real").cast("bigint").alias("total_idx_bytes"),
                    pretty_bytes("i_real").alias("total_idx_size"),
                    F.col("i_extra").cast("bigint").alias("total_extra_bytes"),
                    pretty_bytes("i_extra").alias("total_extra_size"),
                    F.round("i_extra_pct", 2).alias("avg_extra_pct"),
                    F.col("i_bloat").cast("bigint").alias("total_bloat_bytes"),
                    pretty_bytes("i_bloat").alias("total_bloat_size"),
                    F.round("i_bloat_pct", 2).alias("avg_bloat_pct"),
                    F.col("i_count").cast("bigint").alias("total_idx_count"))


def total_bloat(relations: DataFrame, attributes: DataFrame, column_stats: DataFrame, indexes: DataFrame,
                block_size: int = 8192) -> DataFrame:
    """Table and index totals of each database in one line: size,
    extra and bloat with their weighted percentages; a missing side is 0."""
    t = _table_totals(relations, attributes, column_stats, block_size).select(*DB, "t_real", "t_extra", "t_bloat")
    i = _index_totals(indexes, relations, attributes, column_stats, block_size).select(*DB, "i_real", "i_extra",
                                                                                       "i_bloat")
    j = t.join(i, on=DB, how="full")

    def z(c):
        return F.coalesce(F.col(c), F.lit(0))

    real = z("t_real") + z("i_real")
    extra = z("t_extra") + z("i_extra")
    bloat = z("t_bloat") + z("i_bloat")
    return j.select(*DB, F.col("datname").alias("db"),
                    real.cast("bigint").alias("db_bytes"), pretty_bytes(real).alias("db_size"),
                    extra.cast("bigint").alias("db_extra_bytes"), pretty_bytes(extra).alias("db_extra_size"),
                    F.when(real > 0, round_div(100 * extra, real, 2, signed=True)).otherwise(F.lit(0.0))
                    .alias("db_extra_pct"),
                    bloat.cast("bigint").alias("db_bloat_bytes"), pretty_bytes(bloat).alias("db_bloat_size"),
                    F.when(real > 0, round_div(100 * bloat, real, 2, signed=True)).otherwise(F.lit(0.0))
                    .alias("db_bloat_pct"))


# Bytes of the fixed-width types (PostgreSQL storage sizes).
FIXED_WIDTH = {
    "byte": 1, "short": 2, "integer": 4, "long": 8, "float": 4, "double": 8,
    "boolean": 1, "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def column_profile(df: DataFrame, table: str) -> DataFrame:
    """The statistics the estimates consume, computed from the data in
    one pass: per column the NULL fraction and the average width in bytes of
    the non-NULL values (text: UTF-8 length; fixed types: their size)."""
    n = F.count(F.lit(1)).alias("_n")
    aggs = [n]
    fields = df.schema.fields
    for i, f in enumerate(fields):
        c = F.col(f.name)
        aggs.append(F.sum(c.isNull().cast("bigint")).alias(f"_nulls{i}"))
        if f.dataType.typeName() in ("string", "binary"):
            aggs.append(F.avg(F.octet_length(c)).alias(f"_w{i}"))
        elif f.dataType.typeName() in FIXED_WIDTH:
            size = float(FIXED_WIDTH[f.dataType.typeName()])
            aggs.append(F.when(F.count(c) > 0, F.lit(size)).alias(f"_w{i}"))
        else:  # nested and arbitrary-precision values: width of their text form
            aggs.append(F.avg(F.octet_length(c.cast("string"))).alias(f"_w{i}"))
    one = df.agg(*aggs)
    rows = ", ".join(f"'{f.name}', _nulls{i}, _w{i}" for i, f in enumerate(fields))
    long = one.selectExpr("_n", f"stack({len(fields)}, {rows}) as (attname, nulls, width)")
    return long.select(F.lit(table).alias("tablename"), "attname",
                       (F.col("nulls") / F.col("_n")).alias("null_frac"),
                       F.round("width").cast("int").alias("avg_width"),
                       F.col("_n").alias("n_rows"))
