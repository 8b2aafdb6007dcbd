"""Bounded, documented samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, per_class: int) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` labelled training ids of each class.

    Ids are taken in the order of a hash, so the sample doesn't depend on the
    layout of the tables.  Null ids or labels don't count; an id labelled twice
    takes the larger label.  The id list is bounded by 2 * ``per_class``, so it
    is broadcast and the documents are not shuffled.
    """
    known = (labels.where(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg(F.max(label).cast("int").alias("label")))
    picked = None
    for value in (0, 1):
        some = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    return (docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .join(F.broadcast(picked), "doc_id"))
