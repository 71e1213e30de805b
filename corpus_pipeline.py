"""A training corpus from documents: five stages, each one operator on all that the stage before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.

Defined cases are those of the operators: null text is empty text, rows that
repeat an id and text are one document of which exact dedup keeps a single
row, an empty table gives no rows, extra columns are carried along up to
packing.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.exact_dedup import exact_groups
from tabulon.llm.ngram_join import deduplicate
from tabulon.llm.packing import pack
from tabulon.llm.quality import accepted
from tabulon.llm.shared import scratch, stored, table
from tabulon.llm.substring_dedup import remove_repeats


#: Words whose ids a worker of the packing stage remembers: the stages before it have filled the executors' memory.
REMEMBERED = 300_000


def _ids(rows: DataFrame) -> DataFrame:
    """The distinct ids of the given rows as a table that outlives a block of scratch tables."""
    return stored(rows.select("doc_id").distinct(), "gone", lasting=True)


def _without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among the given ones. A null id stays."""
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays (a null id only among null ids)."""
    with scratch(spark):
        groups = stored(exact_groups(docs).select("doc_id", "keep_id", "kept", "text_sha256"), "kept")
        gone = _ids(groups.where("doc_id is not null and not doc_id <=> keep_id"))
        # ids of which one text goes and another stays: of these the rows go by text
        stays = groups.where("doc_id <=> keep_id").select("doc_id").distinct()
        mixed = gone.join(stays, "doc_id", "left_semi")
        by_text = not mixed.isEmpty()
        if by_text:
            texts = stored(groups.where("not doc_id <=> keep_id").join(mixed, "doc_id", "left_semi").select(F.col("doc_id").alias("own"), F.col("text_sha256").alias("sha")).distinct(), "mixed", lasting=True)
            gone = _ids(gone.join(mixed, "doc_id", "left_anti"))
        nulls = not groups.where("doc_id is null and not kept").isEmpty()
        repeated = not groups.where("doc_id <=> keep_id and not kept").isEmpty()
        if nulls:
            lost = stored(groups.where("doc_id is null and keep_id is not null").select("text_sha256").distinct(), "nulls", lasting=True)
    kept = _without_ids(docs, gone)
    digest = F.sha2(F.coalesce(docs["text"], F.lit("")), 256)
    if by_text:
        kept = kept.join(texts, (docs["doc_id"] == texts["own"]) & (digest == texts["sha"]), "left_anti")
    if nulls:
        kept = kept.join(lost, F.when(docs["doc_id"].isNull(), digest) == lost["text_sha256"], "left_anti")
    return kept.dropDuplicates(["doc_id", "text"]) if repeated else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id."""
    return deduplicate(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go from all but their first document; documents of which nothing is left go."""
    cut = remove_repeats(docs)
    left = cut.where("n_removed = 0 or trim(text) != ''")
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024, every window with the sources' proportions."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), remembered=REMEMBERED)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("substring_dedup", substring_dedup), ("packing", packing)]

#: SQL expresses neither the trees nor the tokenizer; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
