"""Secret scans over an incremental blob ledger.

Every version of every file is addressed by the SHA-256 of its text. The
ledger is a table of (blob, rule version) pairs already scanned, with what was
found; a scan reads only blobs with a pair that is not in it, once per
distinct text, and appends. Findings are then joined back to all paths and
versions that hold the blob. Rules carry a version, so a changed rule set
rescans old blobs for the new version alone.

Everything is DataFrame expressions. A match list is kept as runs of (gap,
length), where ``gap`` is the text between two matches: ``regexp_extract_all``
gives the matches, ``split`` on the same pattern gives the gaps, and positions
are running sums. Copies of a text are reduced to one row before the shuffle,
so a blob held by a third of all paths is scanned once.

Edge cases: a null text is the empty text; empty texts and texts without
matches are in the ledger with no finding; repeated (path, version) rows are
reported alike; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetscope.llm.common import free_name

COPIES = 16  # parts that the copies of one text are dealt over


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern``; a match counts if
    ``group`` (0: all of it) has at least ``min_length`` characters."""

    version: str
    kind: str
    pattern: str
    group: int
    min_length: int


# The contract's base rules, then added kinds in their own
# version. Long runs carry their minimum in the pattern where that cannot
# change which matches are found (a run is one match or none).
BASE_RULES = (
    Rule("base-1", "assign", r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("base-1", "access", r"AKIA[A-Z0-9]{12,}", 0, 16),
    Rule("base-1", "hex", r"[0-9a-f]{32,}", 0, 32),
)
ADDED_RULES = (
    Rule("added-1", "github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("added-1", "jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 28),
    Rule("added-1", "pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 0, 27),
    Rule("added-1", "userinfo", r"[a-z][a-z0-9+.-]{1,15}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~-]{4,64}@", 0, 10),
)
RULES = BASE_RULES + ADDED_RULES

RUNS = "array<struct<kind:string,gap:int,len:int,keep:boolean>>"


def blob_id(text: Column) -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def match_runs(text: Column, rule: Rule) -> Column:
    """All matches of one rule in order, as (kind, gap, len, keep)."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    gaps = F.split(text, rule.pattern, -1)
    runs = F.transform(F.arrays_zip(found.alias("m"), tested.alias("t"), F.slice(gaps, 1, F.size(found)).alias("g")),
                       lambda x: F.struct(F.lit(rule.kind).alias("kind"), F.length(x["g"]).alias("gap"),
                                          F.length(x["m"]).alias("len"), (F.length(x["t"]) >= rule.min_length).alias("keep")))
    return F.when(text.rlike(rule.pattern), runs).otherwise(F.array().cast(RUNS))


def scan(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rule_version, runs) for ``versions`` (text).
    ``ledger``: the rows of earlier scans; their pairs are not scanned again.
    The caller appends the result to the ledger table."""
    names = list(dict.fromkeys(r.version for r in rules))
    text = F.coalesce(F.col("text"), F.lit(""))
    blobs = versions.select(text.alias("text"), blob_id(F.col("text")).alias("blob")).dropDuplicates(["blob"])
    if ledger is None:
        blobs = blobs.withColumn("seen", F.array().cast("array<string>"))
    else:
        seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
        blobs = (blobs.join(seen, "blob", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<string>")))
                 .where(F.size(F.array_except(F.array(*map(F.lit, names)), "seen")) > 0))
    pairs = [F.when(~F.array_contains("seen", v), F.struct(
        F.lit(v).alias("rule_version"),
        F.concat(*[match_runs(F.col("text"), r) for r in rules if r.version == v]).alias("runs"))) for v in names]
    return (blobs.select("blob", F.explode(F.array(*pairs)).alias("p")).where("p is not null")
            .select("blob", "p.rule_version", "p.runs"))


def findings(ledger: DataFrame, rules=RULES) -> DataFrame:
    """Spans (blob, kind, start, end) of the ledger's kept matches for the
    given rules; positions in code points, end exclusive."""
    names = list(dict.fromkeys(r.version for r in rules))
    order = Window.partitionBy("blob", "rule_version", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    runs = (ledger.where(F.col("rule_version").isin(names)).dropDuplicates(["blob", "rule_version"])
            .select("blob", "rule_version", F.posexplode("runs").alias("at", "r"))
            .select("blob", "rule_version", "at", "r.*"))
    ends = F.sum((F.col("gap") + F.col("len")).cast("long")).over(order)
    return (runs.withColumn("end", ends).where("keep")
            .select("blob", "kind", (F.col("end") - F.col("len")).alias("start"), "end"))


def spans_by_path(versions: DataFrame, found: DataFrame, rules=RULES) -> DataFrame:
    """``versions`` columns but the text, plus ``spans``: the blob's findings
    as array<struct<start,ord,kind,end>> by start and rule order (empty if
    none). One narrow join on the blob; only paths and spans are shuffled."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    spans = found.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct(
        "start", F.array_position(kinds, F.col("kind")).alias("ord"), "kind", "end"))).alias("spans"))
    keys = versions.withColumn("blob", blob_id(F.col("text"))).drop("text")
    out = keys.join(spans, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(spans.schema["spans"].dataType)))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def masked(docs: DataFrame, found: DataFrame, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span of its text replaced by ``mask`` and
    ``n_chars``, if there, brought up to date. Overlapping spans become one.
    Rows without a finding come back as they were. The copies of a hot text
    are dealt over ``COPIES`` parts, each with the text's spans."""
    blob, spans_of, part = (free_name(docs, name) for name in ("_blob", "_spans", "_part"))
    order = Window.partitionBy("blob").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    merged = (found.withColumn("fresh", F.when(F.col("start") < before, 0).otherwise(1))
              .withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("blob", "island").agg(F.min("start").cast("int").alias("start"), F.max("end").cast("int").alias("end"))
              .groupBy(F.col("blob").alias(blob)).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias(spans_of))
              .withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))))
    dealt = docs.withColumn(blob, blob_id(F.col("text"))).withColumn(part, F.pmod(F.xxhash64("doc_id"), F.lit(COPIES)).cast("int"))
    rows = dealt.join(merged, [blob, part], "left")
    text, spans = F.col("text"), F.col(spans_of)
    last = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    parts = F.transform(spans, lambda s, i: F.concat(text.substr(F.get(last, i) + 1, s["start"] - F.get(last, i)), F.lit(mask)))
    tail = text.substr(F.element_at(last, -1) + 1, F.length(text))
    rows = rows.withColumn("text", F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(parts, ""), tail)))
    if "n_chars" in docs.columns:
        size = F.when(spans.isNull(), F.col("n_chars")).otherwise(F.length("text"))
        rows = rows.withColumn("n_chars", size.cast(docs.schema["n_chars"].dataType))
    return rows.select(*docs.columns)
