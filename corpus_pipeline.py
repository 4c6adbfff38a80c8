"""A corpus pipeline of five stages; each works on all that the one before kept.

quality         drops documents that fail the base rules or stand on a rejected host
near_dedup      keeps one document, the smallest id, of each group of near duplicates (five-word shingles, 0.8);
                rows of one id and text are one document, those of one id and different texts several; a null id comes after all others
decontaminate   drops documents that hold ten words in a row of a benchmark item
secrets         replaces secrets in the texts that are left
packing         packs these into windows of tokens
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.llm.common import read_table, row_columns, text_key, with_rows, written
from quillmere.llm.decontaminate import clean_documents
from quillmere.llm.minhash import near_duplicates
from quillmere.llm.packing import packed
from quillmere.llm.quality import kept_documents
from quillmere.llm.secrets import redacted


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go (they fail the base rules); repeated rows, null ids and null hosts are judged like others; any further columns stay."""
    return kept_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal rows one stays; texts without words are alike to none and all stay; null ids come after all others; any further columns stay."""
    id_, key = F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), F.col("doc_id").isNull(), text_key())
    keyed = with_rows(docs, key=key, id=id_, text=F.col("text"), text_key=text_key())
    found = near_duplicates(keyed.select(F.col("key").alias("doc_id"), "text"), ngram=5, threshold=0.8).select(F.col("doc_id").alias("key"), "component_id").distinct()
    order = keyed.select("key", F.struct(F.col("id").isNull().alias("none"), "id", "text_key", "key").alias("first")).dropDuplicates(["key"])
    kept = found.join(order, "key").groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    return row_columns(keyed.join(written(kept, "kept-documents"), "key", "left_semi").dropDuplicates(["key"]), docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts stay (they hold no benchmark words), as do null ids; repeated rows go or stay together; any further columns stay."""
    return clean_documents(docs, read_table(spark, sf_dir, "benchmark"), span=10)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No row goes; null texts stay null; equal texts are changed alike under any id; any further columns stay."""
    return redacted(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece; null and empty texts are one id each; repeated rows and null ids are packed like others; further columns are left out."""
    import public_tokenizers

    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]
ORACLE_SQL = None  # the forest and the tokeniser are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
