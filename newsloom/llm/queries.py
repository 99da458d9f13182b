"""Registered queries of the training-data operators, and their SQL where SQL can express them.

What SQL can't express of an operator (draws, tokens) has its laws as queries of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm import collocations, decontamination, exact_topk, hard_negatives, jaccard_join, substring_dedup, suffix_dedup
from newsloom.llm.collocations import op11_collocations
from newsloom.llm.decontamination import op6_decontamination
from newsloom.llm.exact_topk import op9_exact_topk
from newsloom.llm.hard_negatives import op12_hard_negatives
from newsloom.llm.html_extraction import op7_html_extraction
from newsloom.llm.jaccard_join import op10_jaccard_join
from newsloom.llm.packing import op5_packing
from newsloom.llm.quality import op2_quality_classifier
from newsloom.llm.sentencepieces import op13_sentencepiece
from newsloom.llm.sharding import op4_sharding
from newsloom.llm.substring_dedup import op1_substring_dedup
from newsloom.llm.suffix_dedup import op3_suffix_dedup
from newsloom.llm.toxicity import op8_toxicity



def sharding_laws(spark, sf_dir: str) -> DataFrame:
    """What op4 promises, by shard: rows at most one apart, slots gapless from 0."""
    out = op4_sharding(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("rows"), F.min("slot").alias("first"), F.max("slot").alias("last"), F.count_distinct("slot").alias("slots"))
    return out.select(F.col("shard").cast("long").alias("shard"), "rows", "first", "last", "slots")


def sharded_rows(spark, sf_dir: str) -> DataFrame:
    """That op4 returns every document once, with its size."""
    return op4_sharding(spark, sf_dir).select("doc_id", "size")


def packing_laws(spark, sf_dir: str) -> DataFrame:
    """What op5 promises, by document: whether its pieces make it up, and whether their sequences are gapless and hold
    at most 2048 ids."""
    out = op5_packing(spark, sf_dir)
    own = Window.partitionBy("sequence_id").orderBy("offset")
    end = F.lag(F.col("offset") + F.col("length"), 1, 0).over(own)
    ends = F.col("offset") + F.col("length")
    placed = out.withColumn("sound", (F.col("offset") == end) & (ends <= 2048) & (F.col("length") > 0))
    own = Window.partitionBy("doc_id").orderBy("start")
    placed = placed.withColumn("next", F.lag(F.col("start") + F.col("length"), 1, 0).over(own) == F.col("start"))
    return placed.groupBy("doc_id").agg((F.every("next") & (F.sum("length") == F.max("doc_tokens"))).alias("whole"), F.every("sound").alias("sound"))


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_decontamination": op6_decontamination,
    "op7_html_extraction": op7_html_extraction,
    "op8_toxicity": op8_toxicity,
    "op9_exact_topk": op9_exact_topk,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_sentencepiece": op13_sentencepiece,
    "sharding_laws": sharding_laws,
    "sharded_rows": sharded_rows,
    "packing_laws": packing_laws,
}
SQL: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.SQL,
    "op3_suffix_dedup": suffix_dedup.SQL,
    "op6_decontamination": decontamination.SQL,
    "op9_exact_topk": exact_topk.SQL,
    "op10_jaccard_join": jaccard_join.SQL,
    "op11_collocations": collocations.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "sharding_laws": "SELECT CAST(s AS BIGINT) AS shard, CAST(n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END AS BIGINT) AS rows, CAST(0 AS BIGINT) AS first, rows - 1 AS last, rows AS slots FROM (SELECT count(*) AS n FROM documents), range(8) r(s) WHERE n // 8 + CASE WHEN s < n % 8 THEN 1 ELSE 0 END > 0",
    "sharded_rows": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size FROM documents",
    "packing_laws": "SELECT doc_id, true AS whole, true AS sound FROM documents",
}
