"""Vector search by cosine, weighted votes and pooling.

A search multiplies blocks of queries with shards of the table in numpy, both of bounded size, and keeps each
shard's best k; only those lists are shuffled and merged. Neither the driver nor a broadcast holds queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.best import best_cosines, empty_lists, first_copies

#: Components (of eight bytes) in a block of queries and in a shard of the table, at most and in a shard at least.
BLOCK, SHARD, SMALL = 1 << 20, 1 << 23, 1 << 19
DEFINITIONS = 10_000


def _packed(table: pa.Table, copies: int) -> pa.Table:
    """One row of ids in order and unit vectors. Of equal vectors only the first `copies` stay, as ties go to smaller ids."""
    ids = table["id"].to_numpy()
    m = pa.concat_arrays([c.flatten() for c in table["vec"].chunks]).to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    # Rows of one id are no candidates of its query, so where ids repeat there is no such bound.
    few = copies and len(np.unique(ids)) == len(ids)
    order = first_copies(ids, table["mark"].to_numpy(), m, copies) if few else np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]
    with np.errstate(invalid="ignore", over="ignore"):
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    whole = np.isfinite(m).all(1)
    ids, m = ids[whole], m[whole]
    return pa.table({"dim": table["dim"][:1], "part": table["part"][:1], "ids": pa.array([ids.tobytes()], pa.binary()), "body": pa.array([m.tobytes()], pa.binary())})


def knn(vectors: DataFrame, queries: DataFrame, k: int, exclude_self: bool = True, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest by cosine, score rounded to six digits, ties to smaller ids.

    Null and empty vectors and null ids take no part, nor do vectors of another length than the query's."""
    own = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec")).filter("id IS NOT NULL AND size(vec) > 0").withColumn("dim", F.size("vec")).withColumn("mark", F.xxhash64("vec"))
    table, asked = own(vectors), own(queries)
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = lambda df: int(df.agg(F.coalesce(F.sum("dim"), F.lit(0))).first()[0])
    held, asking = size(table), size(asked)
    shards = max(min(tasks, held // SMALL + 1), held // SHARD + 1)
    # Where there are few shards, smaller blocks keep all cores at work.
    blocks = max(min(2 * tasks // shards, asking // (BLOCK // 32)) + 1, asking // BLOCK + 1)
    deal = lambda df, n, copies: df.withColumn("part", F.pmod(F.xxhash64("id", "vec"), F.lit(n)).cast("int")).groupBy("dim", "part").applyInArrow(lambda t: _packed(t, copies), "dim int, part int, ids binary, body binary")
    # A stated set of queries against all rows: every block meets every shard.
    asked = deal(asked, blocks, 0).select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("part"), F.col("ids").alias("q_ids"), F.col("body").alias("q_body"))
    # The shard is the buffered side: it is one row, while a shard has many blocks.
    tiles = asked.join(deal(table, shards, k + 1), ["dim", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch[name][r].as_py() for name in batch.schema.names}
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, m = np.frombuffer(row["q_body"]).reshape(-1, row["dim"]), np.frombuffer(row["body"]).reshape(-1, row["dim"])
                best, score = empty_lists(len(q_ids), k)
                best_cosines(best, score, q_ids, q, ids, m, exclude_self=exclude_self)
                i, j = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_pydict({"query_id": q_ids[i], "vec_id": best[i, j], "score": score[i, j]})

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def similar_elsewhere(matches: DataFrame, items: DataFrame, n: int, key: str = "vec_id", source: str = "source") -> DataFrame:
    """The first n of over-fetched matches from another source than the query's; may be fewer."""
    s = items.select(F.col(key).alias("vec_id"), F.col(source).alias("their"))
    q = items.select(F.col(key).alias("query_id"), F.col(source).alias("own"))
    kept = matches.join(s, "vec_id").join(q, "query_id").filter(F.col("their") != F.col("own"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return kept.withColumn("place", place).filter(F.col("place") <= n).select("query_id", F.col("place").cast("int").alias("place"), "vec_id", "score")


def weighted_vote(matches: DataFrame, labels: DataFrame, label: str, key: str = "vec_id") -> DataFrame:
    """(query_id, label, share): the class with the largest sum of similarities and its share; ties to the class
    met first."""
    votes = matches.join(labels.select(F.col(key).alias("vec_id"), F.col(label).alias("label")), "vec_id").groupBy("query_id", "label").agg(F.sum("score").alias("weight"), F.min("rank").alias("met"))
    total = F.sum("weight").over(Window.partitionBy("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("weight", 9).desc(), "met"))
    return votes.withColumn("share", F.round(F.col("weight") / total, 6)).withColumn("place", place).filter("place = 1").select("query_id", "label", "share")


def similar_relevant(matches: DataFrame, labels: DataFrame, n: int, relevant: Column, key: str = "vec_id") -> DataFrame:
    """The first n of over-fetched matches (three times as many) that are relevant; may be fewer."""
    yes = labels.filter(relevant).select(F.col(key).alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return matches.join(yes, "vec_id", "left_semi").withColumn("place", place).filter(F.col("place") <= n).select("query_id", F.col("place").cast("int").alias("place"), "vec_id", "score")


def hierarchical_vote(matches: DataFrame, labels: DataFrame, key: str = "vec_id", k: int = 7, n: int = 5) -> DataFrame:
    """(query_id, relevant, relevant_share, priority, priority_share, ak, ak_share) from matches of rank 1 to 3 * n at
    least and labels (relevant, priority, ak).

    The first k vote on relevance. Where that is relevant, the first n relevant ones of 3 * n vote on priority and
    group; without any of them these are medium and QAG, at a half.
    """
    first = weighted_vote(matches.filter(F.col("rank") <= k), labels, "relevant", key).select("query_id", F.col("label").alias("relevant"), F.col("share").alias("relevant_share"))
    near = similar_relevant(matches.filter(F.col("rank") <= 3 * n), labels, n, F.col("relevant"), key).withColumnRenamed("place", "rank")
    near = near.join(first.filter("relevant").select("query_id"), "query_id", "left_semi")
    out = first
    for name, other in (("priority", "medium"), ("ak", "QAG")):
        vote = weighted_vote(near, labels, name, key).select("query_id", F.col("label").alias(name), F.col("share").alias(f"{name}_share"))
        out = out.join(vote, "query_id", "left").withColumn(f"{name}_share", F.when(F.col("relevant"), F.coalesce(f"{name}_share", F.lit(0.5)))).withColumn(name, F.when(F.col("relevant"), F.coalesce(name, F.lit(other))))
    return out


def mislabelled(matches: DataFrame, labels: DataFrame, label: str, agreement: float = 0.7, key: str = "vec_id") -> DataFrame:
    """Rows whose neighbours' majority class differs from their own, with at least that share of them."""
    own = labels.select(F.col(key).alias("query_id"), F.col(label).alias("own"))
    votes = matches.join(labels.select(F.col(key).alias("vec_id"), F.col(label).alias("label")), "vec_id").groupBy("query_id", "label").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("n").desc(), "label"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("query_id")), 6)
    best = votes.withColumn("share", share).withColumn("place", place).filter("place = 1")
    return best.join(own, "query_id").filter((F.col("label") != F.col("own")) & (F.col("share") >= agreement)).select("query_id", "own", F.col("label").alias("suggested"), "share")


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def mean_pooled(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """The mean of each key's vectors, by component; zero vectors don't count, and the mean is not made unit length."""
    kept = vectors.filter(F.exists(embedding, lambda x: x != 0))
    parts = kept.select(F.col(key).alias("key"), F.posexplode(embedding).alias("pos", "x")).groupBy("key", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda p: p["x"]).alias("vector"))


def nearest_definition(vectors: DataFrame, definitions: DataFrame, key: str, embedding: str) -> DataFrame:
    """The definition (name, vector) of highest cosine for each row. Definitions are a short list that is broadcast;
    for more than `DEFINITIONS` of them use `knn`."""
    if definitions.limit(DEFINITIONS + 1).count() > DEFINITIONS:
        raise ValueError(f"more than {DEFINITIONS} definitions; search them with knn")
    scored = vectors.select(F.col(key).alias("key"), F.col(embedding).alias("e")).crossJoin(F.broadcast(definitions)).withColumn("score", F.round(cosine(F.col("e"), F.col("vector")), 6))
    return scored.groupBy("key").agg(F.max_by("name", F.struct(F.col("score"), F.col("name"))).alias("name"), F.max("score").alias("score"))
