"""Operator 9: exact top-k search by tiled matrix products.

Vectors are dealt to shards and queries to blocks, both of bounded bytes. A task has one block and one shard and
multiplies tile by tile, `ROWS` queries with up to `TILE` rows, so that no more than their products are held at once. The
best k + 1 of the first few rows are selected; of later tiles only scores above a query's last one are looked at. Shards' lists are merged in a tree, `fan` at a time, until one
list a query is left. Only packed lists leave a task, so neither the driver nor any task holds all queries,
vectors or scores.

Components become floor(scale * x) and scores are exact integers: products run in float64 where all sums stay
under 2**53, in 64-bit integers where they stay under 2**63, and otherwise, for those rows alone, in whole numbers
of any size. A score beyond 64 bits ranks and is returned as the nearest of those from
-(2**63 - 1) to 2**63 - 1, and a component beyond the range of doubles as the largest double.

Every query block must meet every shard. With a fixed share of rows as queries the traffic (blocks times shards)
grows as the square of the rows, divided by the bytes of a shard.

Cases: vectors that are null or empty of numbers, or hold null, NaN or infinite components, take no part, nor do
vectors of another length than the query's. A row is never its own candidate, but a repeated row, or another of
the same id, is. Rows with a null id are candidates that rank last among ties. Ids are whole numbers, or text of
one; other ids raise an error. Fewer candidates than k give a shorter list; an empty table an empty result. Other
columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.best import FIRST, LAST, ROWS, TILE, merge_hits
from newsloom.llm.exchange import MB

LISTS = "dim int, block int, shard int, query binary, self binary, ids binary, scores binary"
_LISTS = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("query", pa.binary()), ("self", pa.binary()), ("ids", pa.binary()), ("scores", pa.binary())])
_BIG = np.finfo(np.float64).max


def _packed(table: pa.Table, scale: float) -> pa.Table:
    """One row with ids in order and the whole-number vectors, as 32-bit floats where these are exact."""
    ids = table["id"].cast(pa.int64()).fill_null(LAST).to_numpy()
    flat = pa.concat_arrays([c.flatten() for c in table["vec"].chunks]).cast(pa.float64()).to_numpy()
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * flat), -_BIG, _BIG).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    x = x[order]
    if np.abs(x).max() < 2**24:
        x = x.astype(np.float32)
    return pa.table({"dim": table["dim"][:1].cast(pa.int32()), "part": table["part"][:1], "ids": pa.array([ids[order].tobytes()], pa.binary()), "width": pa.array([x.itemsize], pa.int32()), "body": pa.array([x.tobytes()], pa.binary())})


def _body(body: bytes, width: int, rows: int) -> np.ndarray:
    return np.frombuffer(body, np.float32 if width == 4 else np.float64).reshape(rows, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors as 64-bit integers, exact or at the end of their range."""
    q, x = q.astype(np.float64, copy=False), x.astype(np.float64, copy=False)
    a, b = np.abs(q).max(1, initial=0), np.abs(x).max(1, initial=0)
    with np.errstate(over="ignore"):
        bound = q.shape[1] * a.max(initial=0) * b  # of any product with a row of x
        if (bound < 2**53).all():
            return (q @ x.T).astype(np.int64)
        out = np.zeros((len(q), len(x)), np.int64)
        small = bound < 2**53
        out[:, small] = (q @ x[small].T).astype(np.int64)
        for j in np.flatnonzero(~small):
            whole = q.shape[1] * a * b[j] < 2**62
            if whole.any() and b[j] < 2**62:
                out[whole, j] = q[whole].astype(np.int64) @ x[j].astype(np.int64)
            own = [int(v) for v in x[j].tolist()]
            for i in np.flatnonzero(~whole if b[j] < 2**62 else np.ones(len(q), bool)):
                out[i, j] = min(LAST, max(-LAST, sum(int(v) * w for v, w in zip(q[i].tolist(), own, strict=True))))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores the k highest, ties to the smaller id; ids are one ascending row, or a row for each."""
    if ids.ndim == 2:
        order = np.argsort(ids, axis=1, kind="stable")
        ids, scores = np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above, level = scores > edge, scores == edge
        chosen = above | (level & (level.cumsum(1) <= k - above.sum(1, keepdims=True)))
        column = np.nonzero(chosen)[1].reshape(len(scores), k)
        ids = ids[column] if ids.ndim == 1 else np.take_along_axis(ids, column, 1)
        scores = np.take_along_axis(scores, column, 1)
    order = np.argsort(-scores, axis=1, kind="stable")
    return np.take_along_axis(np.broadcast_to(ids, scores.shape), order, 1), np.take_along_axis(scores, order, 1)


def best_products(q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids (which ascend) and scores of the k rows of x of highest inner product with each query, ties to smaller ids."""
    bound = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0))
    kind = np.float32 if bound < 2**24 else np.float64  # in which all sums are exact
    held, lists = x.astype(kind, copy=False), []
    for c in range(0, len(q), ROWS):
        own = q[c : c + ROWS]
        asked = own.astype(kind, copy=False)
        best, score, a, step = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0), np.int64), 0, FIRST
        while a < len(ids):
            if score.shape[1] < k or bound >= 2**53:
                near, value = _best(ids[a : a + step], products(own, x[a : a + step]), k)
                best, score = _best(np.concatenate([best, near], 1), np.concatenate([score, value], 1), k)
            else:
                value = asked @ held[a : a + step].T
                # A later row has a larger id, so an equal score doesn't count.
                i, j = np.nonzero(value > score[:, -1:].astype(kind))
                if len(i):
                    merge_hits(best, score, i, ids[a + j], value[i, j].astype(np.int64))
            a, step = a + step, min(4 * step, TILE)
        lists.append((best, score))
    return np.concatenate([x[0] for x in lists]), np.concatenate([x[1] for x in lists])


def _with_self(q: np.ndarray) -> np.ndarray:
    """The product of each query with itself."""
    most = float(np.abs(q).max(initial=0))
    if q.shape[1] * most * most < 2**53:
        return np.einsum("ij,ij->i", q, q, dtype=np.float64).astype(np.int64)
    return np.array([products(v[None], v[None])[0, 0] for v in q], np.int64)


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, shard_bytes: int = 64 * MB, block_bytes: int = 8 * MB, fan: int = 16, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """The k rows of highest integer inner product for each row where is_query holds.

    Returns query_id, rank (from 1), vec_id, score. shard_bytes and block_bytes bound what a task holds of the
    vectors and of the queries, at eight bytes a component.
    """
    spark = vectors.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    vec = F.col(f"`{embedding}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), vec.alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number)).withColumn("dim", F.size("vec"))
    # Sizes are measured: eight bytes a component, of all rows and of the queries among them.
    total, asking = rows.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), F.col("dim") * 8)), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(min(tasks, total // (4 * MB) + 1), total // shard_bytes + 1)
    # A block and a shard make a task: where there are few of them, smaller blocks keep all cores at work.
    blocks = max(min(2 * tasks // shards, asking // (MB // 4)) + 1, asking // block_bytes + 1)
    key = F.xxhash64("id", "vec")
    deal = lambda count, seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(count)).cast("int")
    packed = "dim int, part int, ids binary, width int, body binary"
    pack_rows = lambda table: _packed(table, scale)
    asked = rows.filter("asks").withColumn("part", deal(blocks, 1)).groupBy("dim", "part").applyInArrow(pack_rows, packed)
    held = rows.withColumn("part", deal(shards, 2)).groupBy("dim", "part").applyInArrow(pack_rows, packed)
    asked = asked.select("dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("body").alias("q_body"))
    # Every block meets every shard: the stated query set against all rows, in blocks.
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # The shard is the buffered side: it is one row, while a shard has many blocks.
    tiles = asked.join(held, ["dim", "part"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch[name][r].as_py() for name in batch.schema.names}
                q_ids, ids = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
                q, x = _body(row["q_body"], row["q_width"], len(q_ids)), _body(row["body"], row["width"], len(ids))
                best, score = best_products(q, ids, x, k + 1)
                own = _with_self(q)
                yield pa.RecordBatch.from_pylist([{"dim": row["dim"], "block": row["block"], "shard": row["part"] // fan, "query": q_ids.tobytes(), "self": own.tobytes(), "ids": best.tobytes(), "scores": score.tobytes()}], schema=_LISTS)

    def merged(table: pa.Table) -> tuple[dict, np.ndarray, np.ndarray]:
        rows = table.to_pylist()
        n = len(rows[0]["query"]) // 8
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64).reshape(n, -1) for r in rows], 1)
        scores = np.concatenate([np.frombuffer(r["scores"], np.int64).reshape(n, -1) for r in rows], 1)
        return rows[0], *_best(ids, scores, k + 1)

    def merge(table: pa.Table) -> pa.Table:
        row, ids, scores = merged(table)
        return pa.Table.from_pylist([row | {"shard": row["shard"] // fan, "ids": ids.tobytes(), "scores": scores.tobytes()}], schema=_LISTS)

    def finish(table: pa.Table) -> pa.Table:
        row, ids, scores = merged(table)
        query, own = np.frombuffer(row["query"], np.int64), np.frombuffer(row["self"], np.int64)
        # The row itself is the entry of its id and of its product with itself; one entry, as other rows may look the same.
        same = (ids == query[:, None]) & (scores == own[:, None])
        drop = np.where(same.any(1), same.argmax(1), ids.shape[1] - 1 if ids.shape[1] > k else ids.shape[1])
        place = np.arange(ids.shape[1])
        keep = (place != drop[:, None]).nonzero()
        rank = keep[1] - (keep[1] > drop[keep[0]]) + 1
        found = ids[keep]
        return pa.table({"query_id": query[keep[0]], "rank": rank.astype(np.int32), "vec_id": pa.array(found, mask=found == LAST), "score": scores[keep]})

    out = tiles.mapInArrow(multiply, LISTS)
    count = -(-shards // fan)
    while count > fan:
        out = out.groupBy("dim", "block", "shard").applyInArrow(merge, LISTS)
        count = -(-count // fan)
    return out.groupBy("dim", "block").applyInArrow(finish, "query_id long, rank int, vec_id long, score long")


def op9_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return exact_topk(vectors, F.col("vec_id") % 50 == 0)


SQL = """
WITH parts AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), whole AS (
  SELECT vec_id, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM parts
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
