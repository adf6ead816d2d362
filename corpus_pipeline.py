"""Cleaning of a training corpus in five stages, each one an operator of barloom.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import bytebpe, decontaminate, pathjoin, suffixdedup, toxicity
from barloom.llm.queries import table, vocabulary
from barloom.llm.work import Workspace, free_name

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold; the classifier learns from labels that are not held out.

    Rows stay as they are, repeated ones repeated.  A null or empty text scores by the bias alone, a null id only takes no part in the
    fit, a text is scored whole whatever its length.  Columns keep their names, also one that is called like the score.
    An empty table stays empty.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~toxicity.is_held_out())
    score = free_name(docs, "_toxicity")
    scored = toxicity.with_score(docs, toxicity.fit(docs.select("doc_id", "text"), labels), score)
    return scored.where(F.col(score) < toxicity.THRESHOLD).drop(score)


def one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the least id (null last).

    Texts without a word, null ones too, are no copies of anything and stay; but of rows with equal id and text one stays.
    Whole texts are compared whatever their length.  Other columns stay as they are.  An empty table stays empty.
    """
    return pathjoin.one_of_each(docs)


def without_cut_characters(text: Column) -> Column:
    """UTF-8 that may hold parts of cut characters, without those parts; replacement characters of the text itself stay."""
    mark, own, lost = "\x01", "\x01b", "\ufffd"
    # The mark is a single byte that no part of a character equals, and is doubled where it stands in the text.
    escaped = F.replace(F.replace(text, F.lit(mark), F.lit("\x01a")), F.lit(lost), F.lit(own))
    cleaned = F.replace(F.make_valid_utf8(escaped), F.lit(lost), F.lit(""))
    return F.replace(F.replace(cleaned, F.lit(own), F.lit(lost)), F.lit("\x01a"), F.lit(mark))


def no_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without repeated strings; parts of characters that a cut leaves go, and n_chars, if there, follows the text.

    Texts that lose nothing stay as they are, null ones null.  Repeated rows lose whatever they share, so long ones become
    empty.  Other columns keep their values and names.  An empty table stays empty.
    """
    kept, spans, removed = (free_name(docs, x) for x in ("_kept", "_spans", "_removed"))
    left = F.col(kept).cast("string")
    clean = F.when(F.is_valid_utf8(left), left).otherwise(without_cut_characters(left))
    cut = suffixdedup.without_repeats(docs, kept, spans, removed).withColumn("text", F.when(F.col(removed) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(removed) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return cut.select(*[f"`{c}`" for c in docs.columns])


def no_benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item.

    Null and empty texts leak nothing and stay, as do repeated rows, null ids and all columns.  An empty table stays empty; an empty benchmark drops nothing.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and the digests of ids and decoded bytes, a row per document.

    A null text counts as empty and has no ids; repeated rows and null ids stay.  An empty table gives no rows.
    """
    coded = bytebpe.encode_and_decode(docs.select("doc_id", "text"), vocabulary("byte_bpe_multi_50k.tiktoken"))
    return bytebpe.digests(coded, "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", not_toxic),
    ("near duplicates", one_near_copy),
    ("repeated strings", no_repeated_strings),
    ("benchmark decontamination", no_benchmark_items),
    ("byte-level BPE", token_ids),
]

#: The trained classifier, the randomised join and the suffix sort have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's table is written and read again."""
    work = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.store(f"stage-{i}", stage(spark, docs, sf_dir))
    return docs
