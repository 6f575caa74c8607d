"""Column expressions shared by the reports.

All are built-in Spark expressions (JVM side, whole-stage codegen); none is a
Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def wait_label(type_col="wait_event_type", event_col="wait_event") -> Column:
    """``CPU`` when no wait event, else ``type:event`` (NULL if the type is NULL)."""
    return F.when(col(event_col).isNull(), F.lit("CPU")).otherwise(
        F.concat(col(type_col), F.lit(":"), col(event_col)))


def one_line(text="query", width: int | None = None) -> Column:
    r"""Collapse line breaks and runs of white space to single spaces, then cut
    to ``width`` characters (the report's column width). With a width, the
    text is read only as far as it prints: ``width`` units, each a whole
    white-space run or another character, give the same result for any text."""
    if width is None:
        return F.regexp_replace(col(text), r"\s+", " ")
    shown = F.regexp_extract(col(text), rf"\A(?>\s+|\S){{0,{width}}}", 0)
    return F.regexp_replace(shown, r"\s+", " ")


def elapsed_us(end, start) -> Column:
    """Microseconds from ``start`` to ``end`` (exact integer)."""
    return F.unix_micros(col(end)) - F.unix_micros(col(start))


def elapsed_s(end, start) -> Column:
    """Seconds from ``start`` to ``end`` as DOUBLE (microsecond precision)."""
    return elapsed_us(end, start) / F.lit(1000000)


def elapsed_whole_s(end, start) -> Column:
    """Elapsed time cut to whole seconds (``date_trunc('second', ...)``)."""
    return F.floor(elapsed_us(end, start) / F.lit(1000000)).cast("bigint")


def _floor_div(a: Column, b: Column) -> Column:
    """Exact floor division of decimal ``a`` by positive decimal ``b``."""
    return ((a - F.pmod(a, b)) / b).cast("decimal(38,0)")


def round_div(num, den, digits: int = 0, scale: int = 0, signed: bool = False) -> Column:
    """``round(num / den, digits)`` rounded half away from zero in exact
    decimal arithmetic, returned as DOUBLE; NULL when ``den`` is 0.

    ``scale`` is the number of decimal places of the inputs (they are scaled
    to integers first). Exact arithmetic keeps results identical across
    engines where float rounding would differ on ties. With ``signed=False``
    the inputs are taken as non-negative (counts, sizes, durations), which
    keeps the generated code small.
    """
    n = (col(num) * F.lit(10 ** scale)).cast("decimal(38,0)")
    d = (col(den) * F.lit(10 ** scale)).cast("decimal(38,0)")
    k = 10 ** digits
    if signed:
        mag = _floor_div(F.lit(2 * k) * F.abs(n) + F.abs(d), F.lit(2) * F.abs(d))
        q = mag * F.signum(n).cast("int") * F.signum(d).cast("int")
    else:
        q = _floor_div(F.lit(2 * k) * n + d, F.lit(2) * d)
    return F.when(d != 0, q.cast("double") / F.lit(k))


def pct(num, den, digits: int = 2, scale: int = 0, signed: bool = False) -> Column:
    """``round(100 * num / nullif(den, 0), digits)`` as DOUBLE, exact."""
    return round_div(col(num) * F.lit(100), den, digits, scale, signed)


def pretty_bytes(n) -> Column:
    """Human-readable size: ``N bytes`` below 10240, else the first of kB, MB,
    GB, TB, PB whose half-unit count is below 20479, printed rounded half away
    from zero with the sign kept. Shifts on BIGINT keep it exact and cheap."""
    v = col(n).cast("bigint")
    a = F.abs(v)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))

    def unit(shift: int, name: str) -> tuple[Column, Column]:
        halves = F.shiftright(a, shift)
        return halves, F.concat(sign, F.shiftright(halves + 1, 1).cast("string"), F.lit(" " + name))

    kb_h, kb = unit(9, "kB")
    mb_h, mb = unit(19, "MB")
    gb_h, gb = unit(29, "GB")
    tb_h, tb = unit(39, "TB")
    _, pb = unit(49, "PB")
    return (F.when(v.isNull(), F.lit(None).cast("string"))
            .when(a < 10240, F.concat(v.cast("string"), F.lit(" bytes")))
            .when(kb_h < 20479, kb)
            .when(mb_h < 20479, mb)
            .when(gb_h < 20479, gb)
            .when(tb_h < 20479, tb)
            .otherwise(pb))


def xid_age(next_xid, xid) -> Column:
    """Age of a transaction id: ``next_xid - xid`` (NULL for NULL xid)."""
    return col(next_xid) - col(xid)


def lsn_to_pos(lsn_text) -> Column:
    """WAL position text ``HI/LO`` (hexadecimal) to an exact DECIMAL(20,0)."""
    hi = F.conv(F.split_part(col(lsn_text), F.lit("/"), F.lit(1)), 16, 10).cast("decimal(20,0)")
    lo = F.conv(F.split_part(col(lsn_text), F.lit("/"), F.lit(2)), 16, 10).cast("decimal(20,0)")
    return (hi * F.lit(4294967296) + lo).cast("decimal(20,0)")


def pos_to_lsn(pos) -> Column:
    """WAL position as the text ``HI/LO`` (upper-case hexadecimal)."""
    p = col(pos).cast("bigint")
    return F.concat(F.hex(F.shiftrightunsigned(p, 32)), F.lit("/"), F.hex(p.bitwiseAND(F.lit(4294967295))))


def quote_ident(name) -> Column:
    """Identifier quoting as ``format('%I')``: bare when lower-case simple,
    else in double quotes with inner quotes doubled."""
    c = col(name)
    return F.when(c.rlike("^[a-z_][a-z0-9_$]*$"), c).otherwise(
        F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))
