"""Queries of this subpackage: one per operator, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, idcodec, licenses, maxscore, mixing, pii, projections, simhash, toxicity, warc
from ._common import table

RANKS, IDS = "byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_file(RANKS))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idcodec.round_trip(table(spark, sf_dir, "documents"), tokenizer_file(IDS))


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_vectors(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_warc_round_trip, op3_byte_bpe, op4_simhash, op5_pii, op6_toxicity, op7_licenses, op8_token_ids, op9_maxscore, op10_near_vectors, pipeline)}

ORACLE: dict[str, str] = {
    "op1_mix_sources": r"""
with docs as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 12))::bigint as h
  from documents
), per as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank from docs group by source
), weighed as (
  select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, 2.0::double * source_size as cap from per
), filled as (
  select *, cap / weight as ratio, row_number() over (order by cap / weight, rank) as pos,
    coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0) as before_,
    sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as rest,
    sum(source_size) over () * 1.5::double as budget
  from weighed
), levels as (select *, (budget - before_) / rest as level from filled),
first_fit as (select pos, level from levels where level <= ratio order by pos limit 1),
plan as (
  select l.source, l.source_size, (case when f.pos is null or l.pos < f.pos then l.cap else f.level * l.weight end)::double as target
  from levels l left join first_fit f on true
), budgets as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as rounds from plan
), runs as (
  select d.*, b.source_size, b.target, b.rounds, b.target - b.rounds * b.source_size as left_,
    sum(d.size) over (partition by d.source order by d.h range between unbounded preceding and current row) as upto,
    sum(d.size) over (partition by d.source, d.h) as mass
  from docs d join budgets b on d.source is not distinct from b.source
)
select doc_id, size, source_size, target,
  (size * (rounds + case when upto <= left_ or (upto - mass <= left_ and upto - left_ < left_ - (upto - mass)) then 1 else 0 end))::bigint as taken
from runs
""",
    "op2_warc_round_trip": """
with p as (select page_id, coalesce(html, '') as payload from pages),
r as (select *, strlen(payload)::bigint as n, min(page_id) over (partition by payload) as first_ from p)
select page_id, n as payload_bytes, sha256(payload) as payload_digest,
  case when n >= 100 and page_id is distinct from first_ then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id is distinct from first_ then first_ end as refers_to
from r
""",
    "op7_licenses": licenses.oracle(),
    "op9_maxscore": """
with v as (
  select vec_id, row_number() over () as row_, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c as (select row_, vec_id, unnest(e) as x, unnest(range(len(e))) as i from v),
s as (
  select q.row_ as query_row, q.vec_id as query_id, c.row_, c.vec_id, sum(q.x * c.x)::bigint as score
  from c q join c on q.i = c.i and q.row_ <> c.row_ where q.vec_id % 100 = 0 group by all
), r as (select *, row_number() over (partition by query_row order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10
""",
    "op10_near_vectors": """
with recursive v as (
  select vec_id, embedding, len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0 as good from embeddings
), c as (select vec_id, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from v where good),
n as (select vec_id, sqrt(sum(x * x)) as norm from c group by vec_id),
u as (select c.vec_id, c.i, c.x / n.norm as x from c join n using (vec_id)),
link as (select a.vec_id as a, b.vec_id as b from u a join u b on a.i = b.i and a.vec_id <> b.vec_id group by all having sum(a.x * b.x) >= 0.95),
reach as (select a, b from link union select r.a, l.b from reach r join link l on r.b = l.a),
comp as (select a, min(b) as least from reach group by a),
deg as (select a, count(*) as n from link group by a)
select v.vec_id, coalesce(d.n, 0)::bigint as n_links, coalesce(least(v.vec_id, c.least), v.vec_id) as component_id,
  v.vec_id = coalesce(least(v.vec_id, c.least), v.vec_id) as kept
from v left join deg d on v.vec_id = d.a left join comp c on v.vec_id = c.a
""",
}
