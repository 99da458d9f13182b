"""Ask-and-answer exchange: chunks of documents ask about hashes, buckets of hashes answer.

Documents are dealt to chunks by a hash of id and text; a chunk sends every distinct hash once to the
bucket of that hash, in one packed row a bucket, so that a hash that stands in a third of all
documents costs a bucket one value a chunk. A bucket sees all chunks' values of its hashes, decides,
and sends each chunk its answers. Sizes of chunks and buckets are bounded and their numbers follow
the input, so no task's memory grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.shared import removed, settled, workspace  # noqa: F401  (the operators take them from here)

MB = 1 << 20


def _length(value: Column, kind: T.DataType) -> Column:
    """About the bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.octet_length(value)
    if isinstance(kind, T.StructType):
        return sum((_known(_length(value[f.name], f.dataType)) for f in kind), F.lit(0).cast("long"))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.StructType, T.ArrayType, T.MapType)):
        return F.size(value) * 8
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.octet_length(F.to_json(value))
    return F.lit(8)


def _known(length: Column) -> Column:
    return F.coalesce(F.greatest(length, F.lit(0)), F.lit(0)).cast("long")


def size_of(df: DataFrame) -> int:
    """Bytes of df's values, measured by one aggregate. What Spark estimates follows compressed files, which for
    repetitive texts are thousands of times smaller, and would not bound what a task holds."""
    total = sum((_known(_length(F.col(f"`{f.name}`"), f.dataType)) for f in df.schema), F.lit(0).cast("long"))
    return int(df.agg(F.coalesce(F.sum(total), F.lit(0))).first()[0])


def dealt(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """docs with `chunk`, and the numbers of chunks and buckets for its size.

    A chunk is 4 to 128 MB of input and a bucket answers for 4 to 256 MB of it; both grow with the
    input between these bounds, so that the rows between them stay few.
    """
    size = size_of(docs)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(tasks, int(size / min(max(size / 300, 4 * MB), 128 * MB)) + 1)
    buckets = max(tasks // 2, int(size / min(max(size / 300, 4 * MB), 256 * MB)) + 1)
    return docs.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")), chunks, buckets


def pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each hash (from high bits), as ids; keys must be sorted, then the buckets are too."""
    return ((keys >> np.uint64(32)).astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), keys


def split(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets in sorted keys: bucket b holds keys[borders[b]:borders[b + 1]]."""
    ids, _ = by_bucket(keys, buckets)
    return np.searchsorted(ids, np.arange(buckets + 1))


def packed_rows(chunk: int, by: np.ndarray, buckets: int, /, **columns: np.ndarray) -> pa.Table:
    """Packed rows for the buckets of sorted hashes; these travel only if they are among the columns."""
    borders = split(by, buckets)
    full = np.flatnonzero(np.diff(borders))
    cut = lambda x: pa.array([pack(x[borders[b] : borders[b + 1]]) for b in full], pa.binary())
    return pa.table({"chunk": pa.array(np.full(len(full), chunk, np.int32)), "bucket": pa.array(full.astype(np.int32))} | {k: cut(v) for k, v in columns.items()})


def gathered(table: pa.Table, name: str, kind: type = np.uint64) -> np.ndarray:
    """The values of a packed column, one row after another."""
    return np.concatenate([np.frombuffer(x, kind) for x in table[name].to_pylist()] or [np.zeros(0, kind)])


def ids_of(table: pa.Table) -> np.ndarray:
    """Ids as whole numbers; a null comes after all others."""
    return table["doc_id"].cast(pa.int64()).fill_null(np.iinfo(np.int64).max).to_numpy()


def answered(requests: DataFrame, answer: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Every bucket's answers; `answer` gets the rows of one bucket."""
    return requests.groupBy("bucket").applyInArrow(answer, schema)


def loose(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """The same values in a type whose nested fields may all be null, as Spark expects of results."""

    def kind(t: pa.DataType) -> pa.DataType:
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, kind(f.type)) for f in t])
        if pa.types.is_list(t):
            return pa.list_(kind(t.value_type))
        if pa.types.is_map(t):
            return pa.map_(t.key_type, kind(t.item_type))
        return t

    return column.cast(kind(column.type))


def framed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, text, and all other columns in the struct `rest`, so that no name can clash."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text, doc_id)]
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), (F.struct(*rest) if rest else F.struct(F.lit(None).cast("int").alias("none"))).alias("rest"))


def stored(df: DataFrame) -> DataFrame:
    """df written as a table to the shared folder and read again."""
    path = workspace(df.sparkSession, "stage")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
