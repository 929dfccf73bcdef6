"""The corpus queries: each applies its operator, with production parameters, to its whole table and returns the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_model, media, packing, pieces, quality, sharding, simhash, substrings, toxicity, vectors
from .common import hash_bucket


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, quality.learn(docs, labels))
    return scored.select("doc_id", (hash_bucket(quality.FOLDS) == quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = toxicity.score(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", (hash_bucket(toxicity.FOLDS) == toxicity.HELD_OUT).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids_sha256 is of the packed ids, which are little-endian already; spans_sha256 is of the packed span ends."""
    found = pieces.encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("span_ends", 256).alias("spans_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_media_columns": op2_media_columns,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash": op4_simhash,
    "op5_quality": op5_quality,
    "op6_passages": op6_passages,
    "op7_toxicity": op7_toxicity,
    "op8_embeddings": op8_embeddings,
    "op9_language_model": op9_language_model,
    "op10_sentencepiece": op10_sentencepiece,
}

def _crc_table() -> str:
    table = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return f"[{', '.join(map(str, table))}]::bigint[]"


def _bytes(hexed: str) -> str:
    return f"list_transform(regexp_extract_all({hexed}, '..'), lambda y: ('0x' || y)::bigint)"


def _crc(hexed: str) -> str:
    """CRC-32 of hexadecimal text, by the table `crc`; a reduction over its bytes."""
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {_bytes(hexed)}), lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8)))"


def _little_endian(n: str) -> str:
    return "printf('%02X%02X%02X%02X', " + ", ".join(f"(({n}) >> {k}) & 255" for k in (0, 8, 16, 24)) + ")"


_OP1 = f"""with t as (select {_crc_table()} as crc),
b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
s as (select doc_id, length(h) // 2 + 1 as size, {_crc("h")} as text_crc32 from b, t),
r as (select *, sum(size) over (order by doc_id nulls first, text_crc32, size rows unbounded preceding) as here, row_number() over (order by doc_id nulls first, text_crc32, size) as n, sum(size) over () as total from s),
d as (select *, ({sharding.SHARDS} * (2 * here - size)) // (2 * total) as shard from r)
select doc_id, size::bigint as size, text_crc32, 'bytes' as law, shard::int as shard, (n - min(n) over (partition by shard))::bigint as slot, null::int as grown_shard from d"""

_OP2 = f"""with t as (select {_crc_table()} as crc),
b as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
p as (select doc_id, length(h) // 2 as n, h || repeat('00', case when h = '' then {media.UNIT} else ({media.UNIT} - (length(h) // 2) % {media.UNIT}) % {media.UNIT} end) as p from b),
m as (select *, length(p) // 2 as k, '52494646' || {_little_endian("length(p) // 2 + 36")} || '57415645666D7420100000000100010' || '0401F0000401F00000100080064617461' || {_little_endian("length(p) // 2")} || p as wav, {_bytes("p")} as x from p)
select doc_id, n::bigint as n_bytes, k::bigint as payload_bytes, sha256(unhex(p)) as payload_sha256, {_crc(f"right(p, {2 * media.UNIT})")} as tail_crc32, (k + 44)::bigint as media_bytes, sha256(unhex(wav)) as media_sha256,
'audio/wav;rate={media.RATE};samples=' || k || ';peak=' || list_max(x) || ';sum=' || list_sum(x)::bigint || ';energy=' || list_sum(list_transform(x, lambda v: v * v))::bigint
|| ';crossings=' || list_sum(list_transform(list_zip(x[2:], x), lambda z: case when (z[1] >= 128) <> (z[2] >= 128) then 1 else 0 end))::bigint as feature from m, t"""

_OP8 = f"""with recursive v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a, v b where a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= {vectors.COSINE}),
r as (select vec_id as id, vec_id as other from embeddings union select r.id, l.b from r join l on l.a = r.other),
n as (select a, count(*) as n from l group by a)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept from embeddings e left join n on n.a = e.vec_id join (select id, min(other) as component_id from r group by id) c on c.id = e.vec_id"""

#: Queries that DuckDB can express; the others are tested against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {"op1_sharding": _OP1, "op2_media_columns": _OP2, "op8_embeddings": _OP8}
