"""The registered queries of this subpackage, with production parameters, and SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from geomarket.llm import jaccard, prefix_trie, quality, sharding, toxicity, url_filter, warc, whitening
from geomarket.llm.decontaminate import judge_documents
from geomarket.llm.packing import pack
from geomarket.llm.pii import find_personal_data
from geomarket.llm.suffix_dedup import remove_repeats
from geomarket.llm.tables import documents
from geomarket.llm.token_counts import count_documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return count_documents(documents(spark, sf), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))


@query
def op5_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return judge_documents(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


# Windows by string joins, against hashes in the operator.
ORACLE["op5_decontamination"] = r"""
with words as (
  select 'd' as kind, cast(doc_id as varchar) as id, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
  union all
  select 'b', cast(item_id as varchar), null,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark),
items as (
  select distinct id as item, least(10, len(w)) as n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') as win
  from words, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(i) where kind = 'b' and len(w) > 0),
sizes as (select distinct n from items),
spots as (
  select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win
  from words, sizes, unnest(range(1, len(w) - n + 2)) as t(i) where kind = 'd' and len(w) >= n),
hits as (select doc_id, n, i, item from spots join items using (n, win)),
hit_words as (select doc_id, count(distinct j) as n_hit from hits, unnest(range(i, i + n)) as t(j) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as names
  from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words d left join hit_words using (doc_id) left join named using (doc_id) where kind = 'd'"""


@query
def op6_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge_documents(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op8_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.judge_pages(spark.read.parquet(f"{sf}/pages.parquet"))


@query
def op9_extendible_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shards(documents(spark, sf))


# The shortest prefix whose sum fits, tried at every depth. No row of these tables is above the limit.
ORACLE["op9_extendible_sharding"] = """
with d as (
  select doc_id, cast(strlen(coalesce(text, '')) as bigint) as n_bytes,
    lpad(bin(cast('0x' || left(md5(coalesce(cast(doc_id as varchar), '')), 15) as bigint)), 60, '0') as bits
  from documents),
p as (select doc_id, n_bytes, left(bits, depth) as shard, depth,
    sum(n_bytes) over (partition by left(bits, depth)) as total from d, unnest(range(0, 40)) as t(depth))
select doc_id, n_bytes, arg_min(shard, depth) as shard, cast(min(depth) as int) as shard_depth, false as oversized
from p where total <= 16777216 group by doc_id, n_bytes"""


@query
def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.judge_documents(documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet"))


@query
def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.near_duplicates(documents(spark, sf))


@query
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return remove_repeats(documents(spark, sf))


@query
def op4_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    return find_personal_data(documents(spark, sf))


@query
def op11_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.trie(spark.read.parquet(f"{sf}/conversations.parquet"))


# Prefixes as lists, compared whole; the checksum bit by bit, as the engine has no function for it.
ORACLE["op11_prefix_trie"] = """
with turns as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null),
own as (select c, list(struct_pack(role := role, text := text) order by pos) as seq from turns group by c),
heads as (
  select c, seq, c - c % 5 as base, xor(list_reduce(list_prepend(4294967295::bigint,
      list_transform(string_split(cast(c as varchar), ''), lambda x: ascii(x)::bigint)),
      lambda a, x: list_reduce([xor(a, x), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[],
        lambda y, z: xor(y >> 1, 3988292384::bigint * (y & 1)))), 4294967295) % 9 as h
  from own),
whole as (
  select a.c, list_concat(coalesce(b.seq[1:a.h], []), a.seq[a.h + 1:]) as seq
  from heads a left join own b on b.c = a.base),
members as (select c, seq[1:d] as node, d::bigint as depth, len(seq) = d as is_end from whole, unnest(range(0, len(seq) + 1)) as t(d)),
nodes as (
  select node, depth, min(c) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (is_end), '')) as ends_sha256
  from members group by node, depth),
children as (select node[1:depth - 1] as node, count(*) as n_children from nodes where depth > 0 group by 1),
valued as (
  select n.*, coalesce(n_children, 0) as n_children,
    case when depth = 0 then 0 else (n_convs - 1) * strlen(node[depth].text) end as saved
  from nodes n left join children using (node)),
above as (
  select node[1:d] as node, sum(saved)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves
  from valued, unnest(range(0, depth + 1)) as t(d) group by 1)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, v.n_children, n_leaves, saved_tokens, v.ends_sha256
from valued v join above using (node) left join nodes p on v.depth > 0 and p.node = v.node[1:v.depth - 1]"""


@query
def op12_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whiten(spark.read.parquet(f"{sf}/embeddings.parquet"))


@query
def op13_warc_normaliser(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archive_pages(spark.read.parquet(f"{sf}/pages.parquet"))


ORACLE["op13_warc_normaliser"] = """
with p as (
  select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as hex,
    max(page_id) over (partition by coalesce(html, '')) as kept
  from pages)
select page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(hex, i // 4 * 5 + 1, 5))::bigint >> (15 - i % 4 * 5)) & 31)::int + 1, 1) for i in range(0, 32)], '') as payload_digest,
  case when page_id = kept then 'response' else 'revisit' end as record_type,
  case when page_id = kept then null else kept end as refers_to
from p"""
