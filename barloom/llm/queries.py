"""The registered queries of this subpackage and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bytebpe, conversations, decontaminate, hmm, licenses, negatives, oracles, pathjoin, records, sharding, suffixdedup, topk, toxicity, warc
from barloom.llm.work import Workspace

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run
    return register


@query("op1_shuffled_shards")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7; counts at most one apart.  A uniform shuffle deals copies of a text on their own."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return sharding.shuffle_into_shards(spark, table(spark, sf_dir, "documents"), 8).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op2_top_k", oracles.TOP_K)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best inner products of every 20th vector against all others."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), 20, 20)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_records")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, written as records in doc_id order and read back."""
    path = f"{Workspace(spark, 'records').path}"
    manifest = records.write_records(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), 2)
    return records.digests(spark, manifest)


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by the multilingual ranks, and the bytes decoded from them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bytebpe.digests(bytebpe.encode_and_decode(docs, vocabulary("byte_bpe_multi_50k.tiktoken")))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of every document; the fit uses labels of rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = toxicity.is_held_out()
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    return toxicity.with_score(docs, toxicity.fit(docs, labels)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op10_license_scan", oracles.LICENSES)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices in every document."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_hmm_scores")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document, trained on those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = hmm.is_held_out()
    found, language = hmm.scored(docs, ~held_out)
    return found.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(language.words.total).cast("long").alias("train_tokens"),
        "base_score", "score")


@query("op3_benchmark_leaks")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, as it is or with other numbers, names and units."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", F.round("share", 6).alias("share"), "exact")


@query("op5_repeated_strings", oracles.REPEATED_STRINGS)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that stand elsewhere too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixdedup.without_repeats(docs).select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "n_removed", "n_spans",
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_near_duplicates", oracles.NEAR_DUPLICATES)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class and links of every document."""
    return pathjoin.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("key", "class_key")


@query("op11_conversation_repair")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired text of every conversation, with damage planted."""
    return conversations.audited(table(spark, sf_dir, "conversations"), Workspace(spark, "conversations"))


@query("op12_warc_revisits", oracles.REVISITS)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as its record in the deduplicated archives says, read back and resolved."""
    work = Workspace(spark, "warc")
    index = warc.deduplicated(table(spark, sf_dir, "pages"), work.path)
    heads = work.store("heads", warc.read_archives(index, payloads=False))
    return warc.resolved_pages(heads).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op13_hard_negatives", oracles.HARD_NEGATIVES)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th vector, with wrong labels planted."""
    return negatives.hard_negatives(negatives.moved_labels(table(spark, sf_dir, "embeddings")))
