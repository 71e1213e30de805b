"""Labelled rows for the classifiers: folds by crc32 of the id, bounded samples of the training folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.shared import stored, with_text

#: The fold of four that no classifier learns from.
HELD_OUT = 2


def held_out(id_col="doc_id"):
    """Whether crc32 of the id as text is 2 modulo 4 (a null id: no)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, y: at most ``rows`` labelled documents of either class from the training folds.

    The choice is by a hash of the id, and of several texts of one id it is the smallest, so it is the same on every run; ``rows``
    bounds what is broadcast, fetched and learnt from.
    """
    own = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
           .where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.max("y").alias("y")).where(~held_out()))
    order = F.xxhash64("doc_id")
    few = [own.where(f"y = {y}").orderBy(order, "doc_id").limit(rows) for y in (0, 1)]
    chosen = stored(few[0].union(few[1]), "sample-ids")
    texts = with_text(docs, id_col, text_col).where("doc_id is not null")
    return stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "sample")
