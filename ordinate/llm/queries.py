"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ordinate.llm.byte_bpe import encode_digests
from ordinate.llm.embedding_dedup import embedding_groups
from ordinate.llm.exact_dedup import exact_dedup_groups
from ordinate.llm.mixing import mix_sizes
from ordinate.llm.near_dedup import near_groups
from ordinate.llm.substring_dedup import repeated_passages
from ordinate.llm.token_counts import token_counts
from ordinate.llm.toxicity import fitted, toxicity
from ordinate.llm.url_filter import url_filter
from ordinate.llm.warc import archive
from ordinate.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup_groups(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, fitted(docs, table(spark, sf_dir, "labels")))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_exact_dedup, op2_url_filter, op3_byte_bpe, op4_warc, op5_token_counts, op6_embedding_dedup, op7_toxicity, op8_mix_sources, op9_substring_dedup, op10_near_dedup)
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents),
             g as (select doc_id, sha256(norm) as text_sha256, min(doc_id) over (partition by norm) as keep_id,
                          count(*) over (partition by norm) as group_size from d)
        select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from g""",
    "op2_url_filter": r"""
        with u as (select page_id,
                          translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
                          regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
             f as (select *, host = 'org' or ends_with(host, '.org') as org, host = 'com' or ends_with(host, '.com') as com,
                          host = 'example.org' or ends_with(host, '.example.org') as example from u),
             r as (select *, case when example and starts_with(path, '/en/1') then 'example.org/en/1'
                                  when example and starts_with(path, '/es/') then 'example.org/es/'
                                  when org and starts_with(path, '/') then 'org/'
                                  when com and starts_with(path, '/fr/') then 'com/fr/'
                                  when com and starts_with(path, '/de/') then 'com/de/' end as rule from f)
        select page_id, host, path, rule, case when rule in ('example.org/en/1', 'example.org/es/', 'com/de/') then 'block' else 'allow' end as verdict from r""",
    "op4_warc": r"""
        with p as (select page_id, coalesce(html, '') as html from pages),
             g as (select page_id, strlen(html)::bigint as payload_bytes, sha1(html) as payload_digest, max(page_id) over (partition by html) as top from p)
        select page_id, payload_bytes, payload_digest, case when payload_bytes >= 1000 and page_id < top then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id < top then top end as refers_to from g""",
    "op8_mix_sources": r"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
                          ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || ':17'), 1, 13))::bigint / 4503599627370496.0::double as toss from documents),
             s as (select source, sum(size)::double as source_size, row_number() over (order by source nulls last) as rn from d group by source),
             w as (select *, case (rn - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s),
             b as (select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
                          coalesce(sum(source_size * 3) over (order by source_size / weight, rn rows between unbounded preceding and 1 preceding), 0) as full_before,
                          coalesce(sum(weight) over (order by source_size / weight, rn rows between unbounded preceding and 1 preceding), 0) as weight_before from w),
             f as (select *, source_size * 3 <= weight * (total - full_before) / (all_weight - weight_before) as is_full from b),
             u as (select *, sum(case when is_full then source_size * 3 else 0 end) over () as used, sum(case when is_full then weight else 0 end) over () as gone from f),
             t as (select source, source_size, case when is_full then source_size * 3 else weight * (total - used) / (all_weight - gone) end as target from u),
             r as (select d.doc_id, d.size, t.source_size::bigint as source_size, t.target, d.toss,
                          case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
                   from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target, ((floor(rate) + case when toss < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from r""",
}
