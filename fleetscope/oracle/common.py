"""SQL-text helpers for the DuckDB oracle queries.

The oracle restates every report as plain SQL over the snapshot CTEs of
``fleetscope.sources.fixtures`` so the driver can compare results.
"""

from __future__ import annotations

from fleetscope.sources.fixtures import oracle_cte

SCOPE = "instance, snap_ts"


def with_tables(*names: str, extra: str = "") -> str:
    """``with`` clause holding the snapshot CTEs, plus report CTEs ``extra``."""
    parts = [oracle_cte(n) for n in names]
    if extra:
        parts.append(extra)
    return "with " + ",\n".join(parts) + "\n"


def us(end: str, start: str) -> str:
    return f"(epoch_us({end}) - epoch_us({start}))"


def secs(end: str, start: str) -> str:
    return f"({us(end, start)} / 1000000)"


def whole_secs(end: str, start: str) -> str:
    return f"cast(floor({us(end, start)} / 1000000) as bigint)"


def rdiv(num: str, den: str, digits: int = 0, scale: int = 0) -> str:
    """round(num/den, digits) half away from zero in exact integers, DOUBLE."""
    f = 10 ** scale
    n = f"cast(({num}) * {f} as hugeint)"
    d = f"cast(({den}) * {f} as hugeint)"
    k = 10 ** digits
    return (f"(case when {d} = 0 then null else "
            f"sign({n}) * sign({d}) * ((2 * {k} * abs({n}) + abs({d})) // (2 * abs({d}))) / {k} end)")


def pct(num: str, den: str, digits: int = 2, scale: int = 0) -> str:
    return rdiv(f"({num}) * 100", den, digits, scale)


def pretty(v: str) -> str:
    a = f"abs(cast({v} as hugeint))"
    sign = f"(case when cast({v} as hugeint) < 0 then '-' else '' end)"
    arms = []
    for i, unit in enumerate(["kB", "MB", "GB", "TB"]):
        h = f"({a} // {512 * 1024 ** i})"
        arms.append(f"when {h} < 20479 then {sign} || cast(({h} + 1) // 2 as varchar) || ' {unit}'")
    h = f"({a} // {512 * 1024 ** 4})"
    return (f"(case when {v} is null then null "
            f"when {a} < 10240 then cast(cast({v} as hugeint) as varchar) || ' bytes' "
            + " ".join(arms)
            + f" else {sign} || cast(({h} + 1) // 2 as varchar) || ' PB' end)")


def wait_label(t: str = "wait_event_type", e: str = "wait_event") -> str:
    return f"(case when {e} is null then 'CPU' else {t} || ':' || {e} end)"


def one_line(q: str = "query", width: int | None = None) -> str:
    flat = f"regexp_replace(regexp_replace({q}, '[\\n\\r]+', ' ', 'g'), '\\s+', ' ', 'g')"
    return f"substr({flat}, 1, {width})" if width else flat


def top_k(inner: str, order: str, n: int) -> str:
    return (f"select * exclude (_rank) from (select *, row_number() over "
            f"(partition by instance, snap_ts order by {order}) as _rank from ({inner}) _t) _r where _rank <= {n}")
