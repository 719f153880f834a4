"""Registered queries of this package and, where SQL can express one, its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerflow.llm import (
    collocations, dac_tokens, decontaminate, language_id, license_scan, merkle_manifest, multiset_fingerprint, ngram_join, paragraph_dedup, secret_scan, source_mix,
    toxicity, unigram_count)
from ledgerflow.llm.common import id_crc32, ship, table
from ledgerflow.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as token ids in directly addressable segments, read back."""
    out = dac_tokens.token_output(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in whole texts."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets have a Jaccard similarity of
    0.75 or more."""
    return ngram_join.cluster(table(spark, sf_dir, "documents"))


def op4_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages that repeat across documents, per document."""
    return paragraph_dedup.cluster(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and best scores of whole texts under a unigram vocabulary."""
    return unigram_count.count_tokens(table(spark, sf_dir, "documents"))


def op6_multiset_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of whole texts and of their edited texts."""
    return multiset_fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of whole texts inside occurrences of benchmark windows."""
    return decontaminate.find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole restored texts; labels of held-out documents are not learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn_from=toxicity.fifth() != 0)
    out = toxicity.score(docs, model)
    return out.select("doc_id", (toxicity.fifth() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of whole texts; held-out documents are not learned."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = language_id.predict(docs, language_id.train(language_id.labelled(docs)))
    return out.select("doc_id", (F.pmod(id_crc32(), F.lit(4)) == 2).alias("held_out"), "lang_pred", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    return source_mix.taken_words(table(spark, sf_dir, "documents"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in whole texts: base patterns and runs that pass for random."""
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language whose weakest cut scores highest."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash tree over all documents, with each row's proof checked after tampering."""
    return merkle_manifest.verified(table(spark, sf_dir, "documents"))


def _shipped(query: Query) -> Query:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    """Name -> query, each over its whole tables."""
    found = [op1_token_output, op2_license_scan, op3_ngram_join, op4_paragraph_dedup, op5_token_counts, op6_multiset_fingerprint, op7_benchmark_decontamination,
             op8_toxicity, op9_language_id, op10_source_mix, op11_secret_scan, op12_collocations, op13_merkle_manifest]
    return {f.__name__: _shipped(f) for f in found}


OP7_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
b as (
  select row_number() over () as i, coalesce(cast(item_id as varchar), '') as item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark),
bw as (
  select distinct item, least(10, len(w)) as size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') as win
  from b, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(k) where len(w) > 0),
sizes as (select distinct size from bw),
dw as (
  select r, k, size, array_to_string(w[k:k + size - 1], ' ') as win
  from d, sizes, unnest(range(1, len(w) - size + 2)) as t(k) where len(w) >= size),
hit as (select dw.r, dw.k, dw.size, bw.item from dw join bw on dw.size = bw.size and dw.win = bw.win),
words as (select r, count(distinct p) as n_hit from hit, unnest(range(k, k + size)) as t(p) group by r),
items as (select r, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as names from hit group by r)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""

_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op2_sql() -> str:
    """Every block against every template, without any filter, on word slices."""
    pairs = [list(dict.fromkeys(f"{a} {b}" for a, b in zip(text.split(), text.split()[1:]))) for _, text in license_scan.TEMPLATES]
    templates = ", ".join(f"({k}, '{label}', {own})" for k, ((label, _), own) in enumerate(zip(license_scan.TEMPLATES, pairs)))
    phrases = ", ".join(f"({phrase.split()}, '{label}')" for phrase, label in license_scan.PHRASES)
    stride = license_scan.STRIDE
    return rf"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all({_LOWER_SQL}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
phrases(p, label) as (values {phrases}),
base as (
  select r, k, label from d, phrases, unnest(range(0, len(w))) as t(k) where w[k + 1:k + len(p)] = p),
t(id, label, pairs) as (values {templates}),
blocks as (
  select r, b, w[b * {stride} + 1:(b + 2) * {stride}] as own
  from d, unnest(range(0, greatest(cast(ceil(len(w) / {stride}.0) as bigint) - 2, 0) + 1)) as u(b) where len(w) > 1),
paired as (select r, b, list_distinct(list_transform(range(1, len(own)), lambda k: own[k] || ' ' || own[k + 1])) as own from blocks),
met as (
  select r, b, id, label, pairs, len(list_intersect(pairs, own)) * 1.0e0 / len(pairs) as c
  from paired, t where len(list_intersect(pairs, own)) >= ceil({license_scan.THRESHOLD} * len(pairs) - 1e-9)),
kept as (
  select * from met m where not exists (
    select 1 from met o where o.r = m.r and o.b = m.b and o.id <> m.id and list_has_any(o.pairs, m.pairs)
    and (o.c > m.c or (o.c = m.c and m.c < 1 and len(o.pairs) > len(m.pairs))))),
per_base as (select r, count(*) as n_base, min(k) as first_word, max(k) as last_word, string_agg(distinct label, ',' order by label) as base_labels from base group by r),
per_met as (select r, max(c) as c from met group by r),
names as (select r, string_agg(distinct label, ',' order by label) as labels from (select r, label from base union all select r, label from kept) group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
       case when n_base > 0 then 1.0e0 else coalesce(c, 0) end as score
from d left join per_base using (r) left join per_met using (r) left join names using (r)
"""


OP10_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, source, md5('mix-1|' || coalesce(cast(doc_id as varchar), '') || '|' || md5(coalesce(text, ''))) as place,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size
  from documents),
p as (
  select source, cast(sum(size) as bigint) as source_size,
         [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source),
f as (
  select *, 3 * source_size as stop,
         (sum(source_size) over () - coalesce(sum(3 * source_size) over (o rows between unbounded preceding and 1 preceding), 0)) * 1.0e0
         / sum(weight) over (o rows between current row and unbounded following) as level
  from p window o as (order by 3 * source_size * 1.0e0 / weight, source nulls last)),
s as (
  select *, least(weight * coalesce((select level from f where weight * level <= stop order by stop * 1.0e0 / weight, level limit 1), 0),
                  stop * 1.0e0) as target
  from f),
h as (
  select *, row_number() over (order by source nulls last) as source_no, (source_size + 31) // 32 as blocks,
         cast(floor(sum(target) over (order by source nulls last rows unbounded preceding) / sum(target) over
              (order by source nulls last rows between unbounded preceding and unbounded following) * 2147483648 + 0.5) as bigint) as hi,
         cast(ceil(sum(target) over (order by source nulls last rows between unbounded preceding and unbounded following) / 32) as bigint) as slots
  from s),
plan as (select *, coalesce(lag(hi) over (order by source nulls last), 0) as lo from h),
slots as (select t as slot, ((t % 2147483648) * 1327217885) % 2147483648 as point from (select unnest(range(0, max(slots))) as t from plan)),
ranked as (
  select source_no, blocks, row_number() over (partition by source_no order by slot) - 1 as rnk
  from slots join plan on lo <= point and point < hi),
times as (select source_no, rnk % blocks as block, count(*) as times from ranked where rnk < 3 * blocks group by all),
laid as (
  select d.*, plan.source_no, plan.source_size, plan.target,
         sum(size) over (partition by d.source order by place, d.doc_id nulls first, r rows unbounded preceding) - size as start
  from d join plan on d.source is not distinct from plan.source),
cut as (
  select r, source_no, b as block, least((b + 1) * 32, start + size) - greatest(b * 32, start) as words
  from laid, unnest(range(cast(start // 32 as bigint), cast((start + size - 1) // 32 as bigint) + 1)) as t(b) where size > 0),
taken as (select r, sum(words * times) as taken from cut join times using (source_no, block) group by r)
select doc_id, size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken
from laid left join taken using (r)
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that SQL can express."""
    return {"op2_license_scan": op2_sql(), "op7_benchmark_decontamination": OP7_SQL, "op10_source_mix": OP10_SQL,
            "op11_secret_scan": OP11_SQL, "op12_collocations": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
