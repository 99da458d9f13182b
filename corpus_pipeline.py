"""The corpus pipeline: documents in, packed token sequences out, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. Stages may be run one by one, each result written and read again as the next one's docs;
`run` does so in the shared checkpoint folder. A stage learns from and decides on its own input:

1. quality: documents that the quality classifier rejects (score under 0.5) go.
2. near_duplicates: of each group of documents linked by five-word n-gram similarity of 0.8 or more,
   the one with the least doc_id stays. Rows are told apart by id and text: exact repeats of both are one row, and
   near copies under one doc_id that is the least of their group all stay. Rows without an id stay if their group has
   no id.
3. repeated_passages: of passages of 35 words or more that stand at several places, the first occurrence (least
   doc_id, then place) stays and the others go; a document that has lost words is its kept words joined by one
   space, and goes if none are left.
4. benchmark: documents that hold a window of ten benchmark words go.
5. packing: the rest is cut and packed into sequences of at most 2048 tokens.

Nulls, empty texts, repeated rows and empty tables are handled as each operator's module states. doc_id is a whole
number. Columns beyond those of documents, of any name, travel along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.decontamination import decontaminate
from newsloom.llm.jaccard_join import jaccard_join
from newsloom.llm.packing import pack, tokenizer_path
from newsloom.llm.quality import quality_scores
from newsloom.llm.substring_dedup import substring_dedup
from newsloom.shared import removed, workspace


def _columns(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs again, with n_chars of a text that was changed."""
    chars = F.when(F.col(text).eqNullSafe(F.col("text")), F.col("rest.n_chars")).otherwise(F.length(text).cast("long"))
    own = {"doc_id": F.col("doc_id"), "text": F.col(text)} | ({"n_chars": chars} if text != "text" else {})
    return found.select(*((own[c] if c in own else F.col(f"rest.`{c}`")).alias(c) for c in docs.columns))


#: A column name that no input has.
_ROW = "pipeline row hash"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _columns(found.filter("predicted = 1"), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = jaccard_join(docs).filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).select("row").distinct()
    kept = docs.withColumn(_ROW, F.xxhash64("doc_id", "text")).join(found.withColumnRenamed("row", _ROW), _ROW, "left_semi")
    return kept.drop(_ROW).dropDuplicates(["doc_id", "text"])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = substring_dedup(docs, keep_first=True).filter("n_words = 0 OR n_removed < n_words")
    found = found.withColumn("new_text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    return _columns(found, docs, "new_text")


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _columns(found.filter("n_hit = 0"), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark", benchmark),
    ("packing", packing),
]

#: SQL can't express the trained classifier, so the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table is deleted once the next one's is written; the last one's stays, as
    the result may be read from it again."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = workspace(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            removed(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
