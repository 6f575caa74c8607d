"""URL filters: host/path rules plus an exact Bloom filter cascade.

A cascade stores a listed key set exactly, relative to the complete key
universe of the corpus. Level 0 is a Bloom filter of the listed keys; level 1
holds the unlisted universe keys that level 0 passes by mistake; level 2 the
listed keys that level 1 passes; and so on until no mistake is left. A key
is listed if the first level that rejects it has an odd number. The levels are
small bit arrays held by the plan, so pages are judged without a join.

Everything is DataFrame expressions: bits are set with ``bit_or`` over
64-bit words and tested with shifts.

Edge cases: a null url or one without ``://`` has an empty host and path, fits
no rule and is never listed; repeated rows are judged alike; an empty
table, or a universe without listed keys, gives a cascade without levels that
lists nothing. Extra input columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetscope.workspace import Workspace

# Rules of the contract, (verdict, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))

# Words that put a host on the block list when one of its
# labels contains them as a whole hyphen-separated part.
BLOCK_TERMS = ("adult", "ads", "bets", "casino", "gambling", "malware", "phishing", "pills", "porn", "spam", "warez")

BITS_PER_KEY, MAX_BITS = 10, 1 << 28  # of a level: 32 MB at most

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """From after the first ``://`` to ``/``, ``?``, ``#`` or the end; A-Z
    lower-cased; empty without ``://`` or for null."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest fitting rule, else null. A rule
    fits its host and all subdomains when the path starts with its path."""
    arms = []
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        arms.append(F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*arms)


def listed_host(host: Column, terms=BLOCK_TERMS) -> Column:
    """Whether a host belongs on the block list."""
    return host.rlike(rf"(^|[.-])({'|'.join(terms)})([.-]|$)")


@dataclass
class Cascade:
    """Levels of (bits, table of one row with the words of the filter)."""

    levels: list[tuple[int, DataFrame]]
    hashes: int

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            bits, words = self.levels[level]
            out = F.when(passes(key, level, bits, self.hashes, words.scalar()), out).otherwise(F.lit(level % 2 == 1))
        return out


def _position(key: Column, level: int, i: Column | int, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), i if isinstance(i, Column) else F.lit(i)), F.lit(bits))


def passes(key: Column, level: int, bits: int, hashes: int, words: Column) -> Column:
    """Whether all of the key's bits are set in one level's words."""
    out = F.lit(True)
    for i in range(hashes):
        at = _position(key, level, i, bits)
        word = F.get(words, (F.shiftright(at, 6)).cast("int"))
        out &= F.call_function("getbit", word, (at % 64).cast("int")) == 1
    return out


def build_cascade(universe: DataFrame, run: Workspace, bits_per_key: int = BITS_PER_KEY, hashes: int = 5,
                  max_bits: int = MAX_BITS, name: str = "") -> Cascade:
    """``universe``: distinct ``key`` (not null) and ``listed`` (boolean) of
    the whole corpus. Each level is one aggregation; sizes fall by about the
    false-positive rate, so a handful of levels suffice. A level of more than
    ``max_bits`` bits would not fit the plan: ValueError (``judge_pages`` deals
    the keys to several cascades before that)."""
    keys = run.table(universe.select("key", "listed"), f"{name}universe")
    include, exclude = keys.where("listed").select("key"), keys.where("not listed").select("key")
    levels: list[tuple[int, DataFrame]] = []
    while n := include.count():
        level, bits = len(levels), 64 * ceil(max(n * bits_per_key, 64) / 64)
        if bits > max_bits:
            raise ValueError(f"{n} keys need {bits} filter bits, more than {max_bits}")
        at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(hashes - 1)), lambda i: _position(F.col("key"), level, i, bits)))
        words = (include.select(at.alias("at"))
                 .groupBy(F.shiftright("at", 6).alias("idx"))
                 .agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("word")))
        every = keys.sparkSession.range(bits // 64).select(F.col("id").alias("idx"), F.lit(0).cast("long").alias("word"))
        packed = (words.unionByName(every).groupBy("idx").agg(F.bit_or("word").alias("word"))
                  .agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "word"))), lambda x: x["word"]).alias("words")))
        levels.append((bits, run.table(packed, f"{name}level{level}")))
        wrong = exclude.where(passes(F.col("key"), level, bits, hashes, levels[-1][1].scalar()))
        include, exclude = run.table(wrong, f"{name}wrong{level}"), include
    return Cascade(levels, hashes)


def judge_pages(pages: DataFrame, run: Workspace, rules=RULES, terms=BLOCK_TERMS, listed: DataFrame | None = None,
                max_bits: int = MAX_BITS) -> DataFrame:
    """Every page with host, path, rule and verdict: the longest rule's
    verdict, else ``block`` for a listed host and ``allow`` otherwise. Listed
    are the hosts of ``listed`` (host, A-Z lower-cased here), or without it
    those with one of ``terms``. Where one filter would exceed ``max_bits``,
    hosts are dealt by a hash to as many cascades as it takes, and pages are
    judged part by part, each part written before the next."""
    parts = pages.select("page_id", "url", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    parts = parts.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit(""))}).drop("url")
    keys = parts.where("host <> ''").select(F.col("host").alias("key")).distinct()
    if listed is None:
        universe = keys.withColumn("listed", listed_host(F.col("key"), terms))
    else:
        named = listed.where("host <> ''").select(F.translate("host", UPPER, LOWER).alias("key")).distinct().withColumn("named", F.lit(True))
        universe = keys.join(named, "key", "left").select("key", F.col("named").isNotNull().alias("listed"))
    universe = run.table(universe, "keys")
    dealt = ceil(2 * BITS_PER_KEY * universe.where("listed").count() / max_bits)  # half full at most, on average
    if dealt <= 1:
        judged = parts.withColumn("listed", build_cascade(universe, run, max_bits=max_bits).contains(F.col("host")))
    else:
        judged = None
        for turn in range(dealt):
            own = build_cascade(universe.where(_share("key", dealt) == turn), run, max_bits=max_bits, name=f"part{turn}-")
            found = parts.where(_share("host", dealt) == turn).withColumn("listed", own.contains(F.col("host")))
            found = run.table(found, f"judged{turn}")
            judged = found if judged is None else judged.unionByName(found)
    hit = rule_for(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("listed") & (F.col("host") != ""), "block").otherwise("allow")
    return judged.withColumn("hit", hit).select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", method).alias("verdict"))


def _share(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(parts))
