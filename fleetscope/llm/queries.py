"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetscope.llm import curriculum, decontaminate, fingerprints, hard_negatives, language_id, lm_score, near_dups, packing, secret_scan, sharding, source_divergence, suffix_dedup, url_filter
from fleetscope.llm.common import read
from fleetscope.operators.scope import salted_lookup
from fleetscope.workspace import Workspace


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text; ``n_near`` counts
    the documents within the radius of every 20th document's fingerprint."""
    run = Workspace(spark, "op1")
    out = run.table(fingerprints.compare_neighbours(read(spark, sf_dir, "documents"), run), "compared")
    run.drop("parts")
    asked = F.col("doc_id") % 20 == 0
    counts = fingerprints.neighbour_counts(out.withColumnRenamed("fingerprint", "fp"), run, asked)
    named = salted_lookup(out, counts.withColumnRenamed("fp", "fingerprint"), ["fingerprint"])  # copies share a fingerprint
    return named.select(*out.columns, F.when(asked, F.col("n_near")).alias("n_near"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language and calibrated score of every document; learns from
    the documents that aren't held out."""
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language_id.train(docs.where(language_id.fold(F.col("doc_id"), 4) != 2))
    out = docs.select("doc_id", held_out.alias("held_out"), language_id.predict(F.col("text"), model, spark).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents: 4-word shingles, 4 bits."""
    out = near_dups.near_duplicates(read(spark, sf_dir, "documents"), Workspace(spark, "op3"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@cache
def word_tokens() -> packing.WordTokens:
    """The contract's tokenizer, loaded once per Python worker."""
    import public_tokenizers

    return packing.WordTokens(public_tokenizers.path("word_bpe_49k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"), Workspace(spark, "op4"), word_tokens)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in each document within their edit budget."""
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Workspace(spark, "op5"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lattice log10 probability of every document under the vocabulary's
    scores, adapted to the documents that aren't held out, and the word
    baseline."""
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    pieces = lm_score.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    out = lm_score.score(docs, lm_score.fold(F.col("doc_id"), 7) != 2, pieces, Workspace(spark, "op6"), F.col("lang"))
    held_out = F.coalesce(lm_score.fold(F.col("doc_id"), 7) == 2, F.lit(False))
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return url_filter.judge_pages(read(spark, sf_dir, "pages"), Workspace(spark, "op7"))


_RULE_ARMS = "\n".join(
    f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}') then {{{i}}}"
    for i, (_, h, p) in enumerate(sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))))
_SORTED = sorted(url_filter.RULES, key=lambda r: -len(r[1] + r[2]))

OP7_SQL = f"""
with rest as (
  select page_id, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') as host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest)
select page_id, host, path,
       case {_RULE_ARMS.format(*[f"'{h}{p}'" for _, h, p in _SORTED])} else null end as rule,
       case {_RULE_ARMS.format(*[f"'{v}'" for v, _, _ in _SORTED])}
            when regexp_matches(host, '(^|[.-])({'|'.join(url_filter.BLOCK_TERMS)})([.-]|$)') then 'block'
            else 'allow' end as verdict
from parts"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each document loses to 100-byte strings that start earlier."""
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), Workspace(spark, "op8"))
    digest = F.pandas_udf(suffix_dedup.removal_columns, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.select("doc_id", digest("text", "spans").alias("d")).select("doc_id", "d.*")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: the texts are the versions of the ledger's
    blobs, scanned for all rules into a fresh ledger and joined back."""
    run = Workspace(spark, "op9")
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = run.table(secret_scan.scan(docs), "ledger")
    spans = F.col("spans")
    base = [r.kind for r in secret_scan.BASE_RULES]
    out = secret_scan.spans_by_path(docs, secret_scan.findings(ledger))
    return out.select(
        "doc_id", *[F.size(_of_kinds(spans, [k])).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(secret_scan.span_text(_of_kinds(spans, base)), 256).alias("base_sha256"),
        secret_scan.span_text(spans).alias("spans"))


def _of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def _sql_matches(rule: secret_scan.Rule, order: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""
  select doc_id, '{rule.kind}' as kind, {order} as ord, i,
         len(m[i]) as n, len(t[i]) >= {rule.min_length} as keep,
         list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: len(x))), 0) as s
  from (select *, unnest(range(1, len(m) + 1)) as i from (
    select doc_id, regexp_extract_all(text, '{pattern}') as m, regexp_extract_all(text, '{pattern}', {rule.group}) as t,
           string_split_regex(text, '{pattern}') as p from d))"""


OP9_SQL = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
found as ({' union all '.join(_sql_matches(r, i) for i, r in enumerate(secret_scan.RULES))}),
spans as (select doc_id, kind, ord, cast(s as bigint) as s, kind || ':' || cast(s as bigint) || ':' || cast(s + n as bigint) as span
          from found where keep),
agg as (
  select doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
         count(*) filter (kind = 'hex') as n_hex,
         string_agg(span, ',' order by s, ord) filter (ord < {len(secret_scan.BASE_RULES)}) as base,
         string_agg(span, ',' order by s, ord) as spans from spans group by doc_id)
select d.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join agg using (doc_id)"""


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 24 shards of near equal bytes."""
    out = sharding.shard(read(spark, sf_dir, "documents"), Workspace(spark, "op10"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                      F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the sources' targets: weights 3, 1 and 2 in
    turn, falling, even and rising over the training time; with the place of
    each document's first take (position, words before it)."""
    run = Workspace(spark, "op11")

    def knots(start: float, end: float) -> Column:
        return F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, start), (1.0, end))])

    turn = F.col("rank") % 3
    schedule = F.when(turn == 0, knots(4.5, 1.5)).when(turn == 1, knots(1.0, 1.0)).otherwise(knots(1.0, 3.0))
    mixed = curriculum.mix(read(spark, sf_dir, "documents"), schedule, run, budget=F.sum("has") * 1.5)
    takes = curriculum.training_order(mixed, run).where(F.coalesce("round", F.lit(0)) == 0)
    return takes.select("doc_id", "size", "source_size", "target", "taken", "position", "first_word")


OP11_SQL = r"""
with recursive d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size, md5(cast(doc_id as varchar)) as draw
  from documents),
s as (
  select *, case r % 3 when 0 then 3.0::double when 1 then 1.0::double else 2.0::double end as weight,
         case r % 3 when 0 then 4.5::double else 1.0::double end as w0,
         case r % 3 when 0 then -3.0::double when 1 then 0.0::double else 2.0::double end as slope
  from (select source, cast(sum(size) as bigint) as has, row_number() over (order by source nulls last) - 1 as r from d group by source)),
rates(rate, capped) as (
  select 1.5 * sum(has) / sum(weight), 0::bigint from s
  union all
  select (x.total - x.taken) / x.rest, x.n from (
    select r.capped, (select 1.5 * sum(has) from s) as total, count(*) filter (s.weight * r.rate >= 2 * s.has) as n,
           coalesce(sum(2 * s.has) filter (s.weight * r.rate >= 2 * s.has), 0)::double as taken,
           sum(s.weight) filter (s.weight * r.rate < 2 * s.has) as rest
    from rates r, s group by r.capped, r.rate) x where x.n > x.capped and x.rest > 0),
t as (select *, least((2 * has)::double, weight * (select max(rate) from rates)) as target from s),
q as (
  select d.*, t.* exclude (source), cast(round(target) as bigint) as whole,
         coalesce(cast(sum(size) over (partition by d.source order by draw rows between unbounded preceding and 1 preceding) as bigint), 0) as place
  from d join t on d.source is not distinct from t.source),
u as (
  select q.*, k, greatest(least(whole - (k * has + place), size), 0) as words, (k * has + place) / nullif(target, 0) * weight as wanted
  from q, (values (0), (1)) as v(k)),
p as (
  select *, least(1.0::double, 2.0::double * wanted / nullif(w0 + sqrt(greatest(w0 * w0 + 2.0::double * slope * wanted, 0.0::double)), 0)) as position
  from u where target > 0 and (words > 0 or size = 0 and k = 0)),
o as (
  select *, coalesce(cast(sum(words) over (order by position, source nulls first, doc_id, k rows between unbounded preceding and 1 preceding) as bigint), 0) as first_word
  from p)
select q.doc_id, q.size, q.has as source_size, q.target, coalesce(x.taken, 0) as taken, o.position, o.first_word
from q left join (select doc_id, cast(sum(words) as bigint) as taken from p group by doc_id) x using (doc_id)
left join o on o.doc_id = q.doc_id and o.k = 0"""


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergences of every (lang, source) from its language's other sources,
    and its ten leading terms."""
    return source_divergence.audit(read(spark, sf_dir, "documents"), Workspace(spark, "op12"))


OP12_SQL = r"""
with d as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
  from documents),
w as (select row_number() over () as doc, * from d),
e as (select doc, lang, source, unnest(terms) as term from w),
kept as (select lang, term from e group by lang, term having count(distinct doc) >= 10),
c as (select lang, source, term, count(*)::hugeint as n from e join kept using (lang, term) group by all),
v as (select lang, count(*)::hugeint as v from kept group by lang),
g as (
  select x.lang, x.source, coalesce(sum(c.n), 0)::hugeint as total, coalesce(any_value(v.v), 0)::hugeint as v
  from (select distinct lang, source from d) x left join c using (lang, source) left join v on v.lang = x.lang group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.total + 2 * g.v) as p
  from g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
l as (
  select lang, term, 1 + 1000000000 * (sum(n) + 2) // ((select sum(total) from g where g.lang = p.lang) + 2 * (select v from v where v.lang = p.lang)) as q
  from p group by lang, term),
pairs as (
  select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
  from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
parts as (
  select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(x.value, 0) as bigint) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join pairs x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all
  select p.lang, p.source, 'term', p.term, cast((p.p - l.q) * (p.p - l.q) // (p.p + l.q) as bigint)
  from p join l using (lang, term) where p.n > 0 and p.p > l.q)
select lang, source, part, item, value, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank
from parts qualify part = 'pair' or rank <= 10"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 100th vector, for its first 5 positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.quantised(read(spark, sf_dir, "embeddings"), F.col("vec_id"), label, F.col("embedding"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0, Workspace(spark, "op13"))


OP13_SQL = """
with r as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)),
s as (
  select a.id as anchor, a.label as own, r.id, r.label, cast(list_inner_product(a.v, r.v) as bigint) as score
  from r a join r on a.id % 100 = 0),
p as (
  select anchor, id as positive_id, score as positive_score from s where label = own and id <> anchor
  qualify row_number() over (partition by anchor order by score desc, id) <= 5)
select anchor as anchor_id, positive_id,
       cast(row_number() over (partition by anchor, positive_id order by score desc, id) as int) as rank,
       id as negative_id, positive_score, score as negative_score
from p join s using (anchor)
where label <> own and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_fingerprints, op2_language_id, op3_near_dups, op4_packing, op5_decontamination, op6_lm_score, op7_url_filter,
        op8_suffix_dedup, op9_secret_scan, op10_sharding, op11_curriculum, op12_source_divergence,
        op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op7_url_filter": OP7_SQL, "op9_secret_scan": OP9_SQL, "op11_curriculum": OP11_SQL,
            "op12_source_divergence": OP12_SQL, "op13_hard_negatives": OP13_SQL}
