"""The bounded, repeatable sample of labelled documents from which the two text classifiers learn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, y of at most `most` labelled documents with different texts, least hashes of ids first.

    Labels other than 0 and 1, null ids and null texts are left out; an id labelled twice counts with its
    smaller label. Texts join by a list of at most `most` ids."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"))
    chosen = F.broadcast(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null").join(chosen, "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("k")).agg(F.min_by(F.struct("doc_id", "text", "y"), "doc_id").alias("r")).select("r.*")
