"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.ann import neighbours
from tidemill.llm.base import table
from tidemill.llm.exact_dedup import exact_dedup
from tidemill.llm.html_extract import extract
from tidemill.llm.jaccard_join import jaccard_components
from tidemill.llm.language_id import identify
from tidemill.llm.mixing import mix_sources
from tidemill.llm.pieces import encoded
from tidemill.llm.pii import personal_data
from tidemill.llm.sharding import BITS, DIMS, SHARDS, curve_tables, shard
from tidemill.llm.toxicity import toxicity


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op4_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_exact_dedup, op2_toxicity, op3_mix_sources, op4_hnsw_neighbours, op5_sentencepiece, op6_language_id, op7_html_extract, op8_hilbert_shards, op9_personal_data, op10_jaccard_join]
    return {f.__name__: f for f in found}


OP1_SQL = """
with d as (
  select doc_id, row_number() over () as row,
    sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents
), g as (
  select *, row_number() over (partition by text_sha256 order by doc_id desc nulls last, row desc) as place,
    max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size
  from d
)
select doc_id, keep_id, group_size::bigint as group_size, place = 1 as kept, text_sha256 from g
"""

OP3_SQL = r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size,
    [5, 2, 1][(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::bigint as weight
  from d group by source
), c as (
  select *, source_size * 2 as cap, sum(source_size) over ()::bigint * 1.5::double as total,
    coalesce(sum(source_size * 2) over (order by (source_size * 2)::double / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0)::bigint as capped,
    sum(weight) over (order by (source_size * 2)::double / weight, source asc nulls last rows between current row and unbounded following)::bigint as open
  from s
), l as (
  select *, (total - capped) / open as own_level from c
), f as (
  select *, first_value(case when cap >= own_level * weight then own_level end ignore nulls) over (
      order by cap::double / weight, source asc nulls last rows between unbounded preceding and unbounded following) as level
  from l
), t as (
  select source, source_size, least(cap::double, coalesce(level * weight, cap::double)) as target,
    ('0x' || left(md5('20240|' || coalesce('=' || source, 'null')), 8))::bigint::double / 4294967296.0::double as offset_
  from f
), r as (
  select d.*, t.source_size, t.target, t.offset_,
    case when t.source_size > 0 then t.target / t.source_size else 0 end as rate,
    row_number() over (partition by d.source order by d.size, d.doc_id) as k
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  size * (floor(offset_ + rate * k)::bigint - floor(offset_ + rate * (k - 1))::bigint) as taken
from r
"""


def crc32_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, a half byte a step, in a table made by the rule of the reversed polynomial."""
    table = []
    for k in range(16):
        for _ in range(4):
            k = (k >> 1) ^ (0xEDB88320 if k & 1 else 0)
        table.append(k)
    half = lambda c, v: f"xor(({table}::bigint[])[(xor({c}, {v}) & 15) + 1], {c} >> 4)"
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::bigint)"
    return f"xor(list_reduce(list_prepend({0xFFFFFFFF}::bigint, {data}), lambda c, b: {half(half('c', '(b & 15)'), '(b >> 4)')}), {0xFFFFFFFF}::bigint)"


def op8_sql() -> str:
    """The curve's steps written out: h and s are its index and state after each bit, from the highest."""
    digits, nexts = curve_tables(DIMS)
    size, steps = 1 << DIMS, []
    for k in range(BITS - 1, -1, -1):
        before = f"c{k + 1}" if k < BITS - 1 else "cells"
        at = f"s * {size} + ((_source >> {k}) & 1) + 2 * ((_lang >> {k}) & 1) + 4 * ((_size >> {k}) & 1) + 1"
        steps.append(f"c{k} as (select * replace (h * {size} + ({digits})[{at}] as h, ({nexts})[{at}] as s) from {before})")
    place = f"((row_number() over (order by {{0}} asc nulls last) - 1) * {1 << BITS} // count(*) over ())"
    return f"""
with d as (
  select doc_id, source, lang, (strlen(coalesce(text, '')) + 8)::bigint as size, coalesce(text, '') as text from documents
), s as (select source, {place.format("source")} as _source from (select distinct source from d)
), l as (select lang, {place.format("lang")} as _lang from (select distinct lang from d)
), cells as (
  select doc_id, text, size, _source, _lang, least({(1 << BITS) - 1}, length(bin(size)) - 1) as _size, 0::bigint as h, 0 as s
  from d join s on d.source is not distinct from s.source join l on d.lang is not distinct from l.lang
), {", ".join(steps)}, r as (
  select doc_id, size, {crc32_sql('text')} as text_crc32, h as curve from c0
), k as (select *, row_number() over (order by curve, text_crc32, size, doc_id asc nulls last) - 1 as place, count(*) over () as n from r
), p as (select *, (place * {SHARDS}) // n as shard from k)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, (place - (shard * n + {SHARDS - 1}) // {SHARDS})::bigint as slot, null::int as grown_shard, curve from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_mix_sources": OP3_SQL, "op8_hilbert_shards": op8_sql()}
