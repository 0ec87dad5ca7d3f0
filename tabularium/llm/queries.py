"""The queries of this subpackage: op<N>_<name>(spark, sf_dir), with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fm, hamming, merkle, mixing, packing, ppm, quality, secrets, sharding, spelling, sql, tokenfile
from .minhash import near_duplicates
from .scratch import cut


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op2_toxicity_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return cut(fm.score(docs, fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))), "scores")


def op3_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score(_documents(spark, sf_dir))


def op4_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return hamming.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_documents(spark, sf_dir))


def tokenizer_path() -> str:
    """The public tokenizer file; installed with its package, not part of this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.packed_documents(_documents(spark, sf_dir), tokenizer_path())
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op7_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(_documents(spark, sf_dir), tokenizer_path()))


#: Small shards, that a reader fetches whole.
SHARD_BYTES = 128 << 10


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.shards(_documents(spark, sf_dir), SHARD_BYTES)
    return found.select("doc_id", "n_bytes", "depth", "prefix", "shard", "shard_bytes")


def op9_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.Mix(_documents(spark, sf_dir)).taken()


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("_spans", lambda s: s.kind != "guess")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("_spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return cut(found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(said(base), 256).alias("base_sha256"), said("_spans").alias("spans"), count("guess")), "spans")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return cut(chat.digests(chat.formatted(rows.union(hard))), "digests")


def op12_merkle_proofs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(_documents(spark, sf_dir))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_toxicity_fm": op2_toxicity_fm,
    "op3_ppm_score": op3_ppm_score,
    "op4_hamming_topk": op4_hamming_topk,
    "op5_line_quality": op5_line_quality,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_bit_packed_tokens": op7_bit_packed_tokens,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_block_mixing": op9_block_mixing,
    "op10_secret_scan": op10_secret_scan,
    "op11_chat_format": op11_chat_format,
    "op12_merkle_proofs": op12_merkle_proofs,
    "op13_spelling_variants": op13_spelling_variants,
}

SQL = {
    "op1_minhash_dedup": sql.NEAR_DUPLICATES,
    "op4_hamming_topk": sql.HAMMING,
    "op5_line_quality": sql.LINE_QUALITY,
    "op8_extendible_shards": sql.SHARDS.replace("{limit}", str(SHARD_BYTES)),
    "op11_chat_format": sql.CHAT,
    "op12_merkle_proofs": sql.MERKLE,
    "op13_spelling_variants": sql.SPELLING,
}
