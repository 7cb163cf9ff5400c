"""Queries of the corpus operators, by name, and the SQL that expresses them.

Each query reads whole tables; parameters are those meant for production.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import topk

    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


OP3_SQL = """
with q as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0
), s as (
  select a.vec_id as query_id, b.vec_id, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) as score
  from q a join q b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0
)
select query_id, cast(r as integer) as rank, vec_id, cast(score as bigint) as score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as r from s) t where r <= 20
"""


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid
    from .common import crc_mod

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.train(docs.where(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import neardup

    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfiles

    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.checked(table(spark, sf_dir, "documents").select("doc_id", "text"), count="n_replaced")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from . import toxicity
    from .common import crc_mod

    held_out = crc_mod("doc_id", 5) == 0
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out.alias("held_out"))
    scored = toxicity.fit_and_score(docs, table(spark, sf_dir, "labels"), allowed=~held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    return sharding.shard(table(spark, sf_dir, "documents"), shards=24)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.shares(table(spark, sf_dir, "documents"))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of op2_quality, which SQL can express; the forest's verdict it can't."""
    from . import quality

    return quality.measure(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


QUALITY_SQL = r"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws from d),
line as (select rid, unnest(string_split(t, chr(10))) as l from d),
dup as (select rid, count(*) - count(distinct l) as n from line where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
win as (select rid, unnest(range(1, len(ws) - 6)) as i, ws from w where len(ws) >= 8),
text_of as (select rid, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') as x from win),
often as (select rid, i from text_of qualify count(*) over (partition by rid, x) > 1),
rep as (select rid, count(distinct k) as n from (select rid, unnest(range(i, i + 8)) as k from often) t group by rid)
select doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
 coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ws) < 20 or 100 * coalesce(rep.n, 0) > 30 * len(ws) as base_failed
from w left join dup using (rid) left join rep using (rid)
"""


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op10_mix; which rows are drawn SQL can't tell."""
    from pyspark.sql import functions as F

    from . import mixing

    return mixing.shares(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


MIX_SQL = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
n as (select *, [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from s),
r as (select *, row_number() over (order by 2.0 * source_size / weight, source nulls last) as k from n),
p as (select k, 2.0 * source_size / weight as stop, 1.5 * sum(source_size) over () - coalesce(sum(2.0 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as left_over,
      sum(weight) over (order by k rows between current row and unbounded following) as open_weight from r),
unit as (select coalesce(min(left_over / open_weight), 1e300) as u from (select * from p where left_over / open_weight <= stop order by k limit 1) t)
select d.doc_id, d.size, r.source_size, round(least(2.0 * r.source_size, u * r.weight), 4) as target from d join r on r.source is not distinct from d.source, unit
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_quality, op3_topk, op4_langid, op5_neardup, op6_token_files, op7_pii, op8_toxicity, op9_ring_shards, op10_mix, quality_counts, mix_targets)}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "quality_counts": QUALITY_SQL, "mix_targets": MIX_SQL}
