"""Bounded samples of labelled documents, for the operators that learn from labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Column, bound: int, bound_bytes: int | None = None, per_id: int = 4) -> DataFrame:
    """doc_id, text and label (0 or 1) of at most `bound` labelled texts where train holds, and of no more than
    `bound_bytes` of text where that is given.

    Ids are taken in the order of their hash, so the same come whatever the layout: the first `bound` labelled ids, of each its
    distinct texts, at most per_id of them by the order of their hash, and of these the first `bound`. A text that
    doesn't fit into what is left of bound_bytes is left out and those behind it still get their turn, so one text longer than the
    bound costs itself alone. Copies of a text under one id are one example. Ids with several labels count as 1
    if any is; null texts count as empty. The driver sees two hashes and a size of at most `bound` texts and picks among them.
    """
    rows = labels.filter(train & F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    rows = rows.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(bound)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    found = texts.select("doc_id", "hash", F.octet_length("text").alias("size")).join(F.broadcast(rows), "doc_id").groupBy("doc_id", "label", "order", "hash").agg(F.max("size").alias("size"))
    few = found.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("hash"))).filter(F.col("place") <= per_id).drop("place")
    chosen, left = [], bound_bytes
    for r in few.orderBy("order", "doc_id", "hash").limit(bound).collect():
        if left is None or r["size"] <= left:
            chosen.append((r["doc_id"], r["hash"], r["label"]))
            left = left if left is None else left - r["size"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    picked = docs.sparkSession.createDataFrame(chosen, f"doc_id {kind}, hash long, label int")
    return texts.join(F.broadcast(picked), ["doc_id", "hash"]).groupBy("doc_id", "hash", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
