"""Operator 12: hard-negative mining by distributed radix selection.

Each anchor's positives are the best rows of its own label; each anchor and positive then have a window of scores,
from `low` to `high` hundredths of the positive's, and want the best rows of other labels inside. Both are selections of
the kth score, and both go by digits: vectors are dealt to shards and anchors to blocks, a task counts the integer
scores of one block and one shard in `digit` buckets of each window's zone, the counts are added up in a tree,
and the bucket that holds the kth score becomes the next, narrower zone. A zone is done when it is one score wide or when
few rows are left above its lower edge. Then one more pass gathers the rows from that edge on, and only those.

A task's counts leave it as a sparse list of its best buckets, up to the one that holds its own kth score: lower
buckets of a shard can't matter. So at most k counts a window travel from a shard, and at most k rows a window when
rows are gathered, however many rows tie. Blocks, their windows, and shards go from pass to pass as tables of
the shared folder; the driver sees only whether a zone is open. Passes are as many as the widest zone has digits.

The first zone of an anchor is bounded by its length and the greatest length of all vectors (Cauchy and Schwarz).
Every block meets every shard in every pass: the stated query set against all rows, in blocks.

Scores are exact as in `exact_topk`: integers of up to 64 bits, beyond which the ends of their range stand for them.

Cases: rows with a null label, or a vector that is null, empty, or holds null, NaN or infinite components, take no
part; nor do rows of another vector length than the anchor's. An anchor is never its own positive, but a repeated row, or
another of the same id, is. Repeated anchors give repeated rows. Ties go to the smaller id; rows with a null id rank last among ties
and are returned with a null. A positive of negative score has an empty window. Anchors without positives, and
positives without negatives, give no row. Labels and ids are whole numbers, or text of one; others raise an error.
An empty table gives an empty result. Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exact_topk import LAST, _body, _packed, products
from newsloom.llm.exchange import MB, removed, workspace

#: Scores that a task holds at once.
CELLS = 1 << 20
PACKED = "dim int, part int, ids binary, width int, body binary, labels binary"
COUNTS = "dim int, block int, shard int, window binary, bucket binary, n binary"
FOUND = "dim int, block int, shard int, window binary, score binary, id binary"
STATE = "dim int, block int, per int, open int, top binary, low binary, high binary, above binary, done binary, positive binary, p_score binary"
_COUNTS = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("window", pa.binary()), ("bucket", pa.binary()), ("n", pa.binary())])
_FOUND = pa.schema([("dim", pa.int32()), ("block", pa.int32()), ("shard", pa.int32()), ("window", pa.binary()), ("score", pa.binary()), ("id", pa.binary())])
I64, U64 = np.int64, np.uint64


def _ints(value: bytes) -> np.ndarray:
    return np.frombuffer(value, I64)


def _labelled(table: pa.Table, scale: float) -> pa.Table:
    """As `exact_topk` packs vectors, with their labels in the same order."""
    ids = table["id"].cast(pa.int64()).fill_null(LAST).to_numpy()
    labels = table["label"].cast(pa.int64()).to_numpy()[np.argsort(ids, kind="stable")]
    return _packed(table, scale).append_column("labels", pa.array([labels.tobytes()], pa.binary()))


def _step(low: np.ndarray, high: np.ndarray, digit: int) -> np.ndarray:
    """Scores in a bucket of each zone."""
    return (high.astype(U64) - low.astype(U64)) // U64(digit) + U64(1)


def _merged(window: np.ndarray, bucket: np.ndarray, n: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up by window and bucket, and of each window only those up to the bucket of its need-th row."""
    order = np.lexsort((bucket, window))
    window, bucket, n = window[order], bucket[order], n[order]
    if not len(n):
        return window, bucket, n
    new = np.flatnonzero(np.concatenate([[True], (window[1:] != window[:-1]) | (bucket[1:] != bucket[:-1])]))
    window, bucket, n = window[new], bucket[new], np.add.reduceat(n, new)
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
    before = np.cumsum(n) - n
    before -= np.repeat(before[first], np.diff(np.append(first, len(n))))
    keep = before < need
    return window[keep], bucket[keep], n[keep]


def _first(window: np.ndarray, score: np.ndarray, ids: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The need best rows of each window in order, ties to the smaller id."""
    order = np.lexsort((ids, -score, window))
    window, score, ids = window[order], score[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, I64)
    place = np.arange(len(window)) - np.repeat(first, np.diff(np.append(first, len(window))))
    keep = place < need
    return window[keep], score[keep], ids[keep]


def _cells(row: dict, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Windows, scores and ids of a block's anchors with a shard's rows, of equal or of other labels, tile by tile.
    Only rows from the lower edge of the window's zone up to the window's top."""
    q_labels, labels, ids = _ints(row["q_labels"]), _ints(row["labels"]), _ints(row["ids"])
    q, x = _body(row["q_body"], row["q_width"], len(q_labels)).astype(np.float64), _body(row["body"], row["width"], len(ids))
    per = row["per"]
    top, low = _ints(row["top"]).reshape(-1, per), _ints(row["low"]).reshape(-1, per)
    most, least = top.max(1)[:, None], low.min(1)[:, None]
    tile = max(1, CELLS // max(1, len(q)))
    for a in range(0, len(ids), tile):
        score = products(q, x[a : a + tile])
        own, at = np.nonzero(((q_labels[:, None] == labels[None, a : a + tile]) == same) & (score >= least) & (score <= most))
        score = score[own, at]
        for j in range(per):
            hit = np.flatnonzero((score >= low[own, j]) & (score <= top[own, j]))
            if len(hit):
                yield own[hit] * per + j, score[hit], ids[a + at[hit]]


def _state(dim: int, block: int, per: int, top: np.ndarray, low: np.ndarray, **more: np.ndarray) -> pa.Table:
    """Windows before the first pass; those with no score inside are done."""
    empty = low > top
    top, low = np.where(empty, -LAST, top), np.where(empty, LAST, low)
    none = np.zeros(0, I64)
    arrays = {"top": top, "low": low, "high": top, "above": np.zeros(len(top), I64), "done": empty.astype(I64), "positive": more.get("positive", none), "p_score": more.get("p_score", none)}
    head = {"dim": pa.array([dim], pa.int32()), "block": pa.array([block], pa.int32()), "per": pa.array([per], pa.int32()), "open": pa.array([int((~empty).sum())], pa.int32())}
    return pa.table(head | {k: pa.array([v.astype(I64).tobytes()], pa.binary()) for k, v in arrays.items()})


def _narrowed(state: pa.Table, counts: pa.Table, need: int, digit: int, few: int) -> pa.Table:
    """Zones after a pass: the bucket of the need-th row, or what is left where there are fewer rows."""
    row = state.to_pylist()[0]
    low, high, above, done = (_ints(row[k]).copy() for k in ("low", "high", "above", "done"))
    window, bucket, n = (np.concatenate([_ints(x) for x in counts[k].to_pylist()] or [np.zeros(0, I64)]) for k in ("window", "bucket", "n"))
    window, bucket, n = _merged(window, bucket, n, need)
    first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]])) if len(window) else np.zeros(0, I64)
    run = np.cumsum(n)
    total = run - np.repeat((run - n)[first], np.diff(np.append(first, len(n)))) + above[window]
    kth = np.flatnonzero((total >= need) & (total - n < need))
    w, step = window[kth], _step(low, high, digit)
    edge = high[w].astype(U64) - bucket[kth].astype(U64) * step[w]
    lower = np.maximum(low[w], (edge - np.minimum(step[w] - U64(1), edge - low[w].astype(U64))).astype(I64))
    found = np.zeros(len(low), bool)
    found[w] = True
    single = np.zeros(len(low), bool)
    single[w] = (step[w] == 1) | (total[kth] <= few)
    high[w], low[w], above[w] = edge.astype(I64), lower, (total - n)[kth]
    # A window with fewer rows than needed takes all rows of its zone.
    done = (done.astype(bool) | ~found | single).astype(I64)
    row |= {"low": low.tobytes(), "high": high.tobytes(), "above": above.tobytes(), "done": done.tobytes(), "open": int((done == 0).sum())}
    return pa.Table.from_pylist([row], schema=state.schema)


class _Selection:
    """Passes over all blocks and shards: narrowing of zones, then gathering of rows."""

    def __init__(self, asked: DataFrame, held: DataFrame, shards: int, digit: int, few: int, fan: int, home: str) -> None:
        self.asked, self.held, self.shards, self.digit, self.few, self.fan, self.home, self.step = asked, held, shards, digit, few, fan, home, 0

    def stored(self, df: DataFrame) -> DataFrame:
        self.step += 1
        path = f"{self.home}/{self.step}"
        df.write.parquet(path)
        return df.sparkSession.read.parquet(path)

    def tiles(self, state: DataFrame) -> DataFrame:
        asked = self.asked.join(state, ["dim", "block"]).drop("open", "above", "positive", "p_score")
        return asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1)))).join(self.held, ["dim", "part"])

    def tree(self, lists: DataFrame, merge, schema: str) -> DataFrame:
        count = -(-self.shards // self.fan)
        while count > self.fan:
            lists = lists.groupBy("dim", "block", "shard").applyInArrow(merge, schema)
            count = -(-count // self.fan)
        return lists

    def narrowed(self, state: DataFrame, same: bool, need: int) -> DataFrame:
        """Windows whose zones' lower edges are those of the need-th row, or near it."""
        digit, few, fan = self.digit, self.few, self.fan

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    low, high, open_ = _ints(row["low"]), _ints(row["high"]), _ints(row["done"]) == 0
                    step = _step(low, high, digit)
                    window, bucket, n = np.zeros(0, I64), np.zeros(0, I64), np.zeros(0, I64)
                    for w, score, _ in _cells(row, same):
                        inside = open_[w] & (score <= high[w])
                        w, score = w[inside], score[inside]
                        key, times = np.unique(w * digit + ((high[w].astype(U64) - score.astype(U64)) // step[w]).astype(I64), return_counts=True)
                        window, bucket, n = _merged(np.append(window, key // digit), np.append(bucket, key % digit), np.append(n, times), need)
                    out = {"dim": row["dim"], "block": row["block"], "shard": row["part"] // fan, "window": window.tobytes(), "bucket": bucket.tobytes(), "n": n.tobytes()}
                    yield pa.RecordBatch.from_pylist([out], schema=_COUNTS)

        def merge(table: pa.Table) -> pa.Table:
            parts = (np.concatenate([_ints(x) for x in table[k].to_pylist()]) for k in ("window", "bucket", "n"))
            head = table.slice(0, 1).to_pylist()[0]
            merged = {k: x.tobytes() for k, x in zip(("window", "bucket", "n"), _merged(*parts, need), strict=True)}
            return pa.Table.from_pylist([head | merged | {"shard": head["shard"] // fan}], schema=_COUNTS)

        def narrow(key, state: pa.Table, counts: pa.Table) -> pa.Table:
            return _narrowed(state, counts, need, digit, few)

        while state.filter("open > 0").limit(1).count():
            counts = self.tree(self.tiles(state.filter("open > 0")).mapInArrow(count, COUNTS), merge, COUNTS)
            # A block without counts keeps its windows, which are done then.
            state = self.stored(state.groupBy("dim", "block").cogroup(counts.groupBy("dim", "block")).applyInArrow(narrow, STATE))
        return state

    def gathered(self, state: DataFrame, same: bool, need: int) -> DataFrame:
        """The best rows of each window, in lists of a block."""
        fan = self.fan

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    best = (np.zeros(0, I64), np.zeros(0, I64), np.zeros(0, I64))
                    for cell in _cells(row, same):
                        best = _first(*(np.append(a, b) for a, b in zip(best, cell, strict=True)), need)
                    out = {"dim": row["dim"], "block": row["block"], "shard": row["part"] // fan}
                    yield pa.RecordBatch.from_pylist([out | {k: x.tobytes() for k, x in zip(("window", "score", "id"), best, strict=True)}], schema=_FOUND)

        def merge(table: pa.Table) -> pa.Table:
            head = table.slice(0, 1).to_pylist()[0]
            best = {k: x.tobytes() for k, x in zip(("window", "score", "id"), _best_of(table, need), strict=True)}
            return pa.Table.from_pylist([head | best | {"shard": head["shard"] // fan}], schema=_FOUND)

        return self.tree(self.tiles(state).mapInArrow(gather, FOUND), merge, FOUND)


def _best_of(table: pa.Table, need: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = (np.concatenate([_ints(x) for x in table[k].to_pylist()] or [np.zeros(0, I64)]) for k in ("window", "score", "id"))
    return _first(*parts, need)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, label: Column, k: int = 5, low: int = 80, high: int = 100, negatives: int = 5, scale: float = 256.0, shard_bytes: int = 64 * MB,
    block_bytes: int = 2 * MB, digit: int = 256, few: int = 64, fan: int = 16, vec_id: str = "vec_id", embedding: str = "embedding",
) -> DataFrame:
    """The first `negatives` rows of another label for each anchor and each of its k positives, among those that score from low
    to high hundredths of the positive's score.

    Returns anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. shard_bytes and
    block_bytes bound what a task holds of vectors and of anchors, at eight bytes a component; digit is the
    number of buckets of a pass, few how many rows above a zone's lower edge end its narrowing.
    """
    spark = vectors.sparkSession
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").cast("array<double>").alias("vec"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number)).withColumn("dim", F.size("vec"))
    total, asking = rows.agg(F.coalesce(F.sum(F.col("dim") * 8), F.lit(0)), F.coalesce(F.sum(F.when(F.col("asks"), F.col("dim") * 8)), F.lit(0))).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(min(tasks, total // (4 * MB) + 1), total // shard_bytes + 1)
    blocks = max(min(2 * tasks // shards, asking // (MB // 4)) + 1, asking // block_bytes + 1)
    deal = lambda count, seed: F.pmod(F.xxhash64("id", "vec", F.lit(seed)), F.lit(count)).cast("int")
    pack = lambda table: _labelled(table, scale)
    home = workspace(spark, "hard-negatives")
    asked = rows.filter("asks").withColumn("part", deal(blocks, 1)).groupBy("dim", "part").applyInArrow(pack, PACKED)
    held = rows.withColumn("part", deal(shards, 2)).groupBy("dim", "part").applyInArrow(pack, PACKED)
    asked = asked.select("dim", F.col("part").alias("block"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("body").alias("q_body"), F.col("labels").alias("q_labels"))
    asked.write.parquet(f"{home}/anchors")
    held.write.parquet(f"{home}/vectors")
    asked, held = spark.read.parquet(f"{home}/anchors"), spark.read.parquet(f"{home}/vectors")

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _body(row["body"], row["width"], len(row["ids"]) // 8).astype(np.float64)
                with np.errstate(over="ignore"):
                    yield pa.RecordBatch.from_pydict({"x": pa.array([float(np.sqrt((x * x).sum(1)).max())])})

    reach = held.mapInArrow(longest, "x double").agg(F.max("x")).first()[0] or 0.0

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q = _body(row["q_body"], row["q_width"], len(row["q_ids"]) // 8).astype(np.float64)
                with np.errstate(over="ignore"):
                    bound = np.sqrt((q * q).sum(1)) * reach * (1 + 1e-9) + 1
                top = np.where(bound < 2.0**62, np.minimum(bound, 2.0**62), 0).astype(I64)
                top[bound >= 2.0**62] = LAST
                yield from _state(row["dim"], row["block"], 1, top, -top).to_batches()

    want = k + 1
    chosen = _Selection(asked, held, shards, digit, few, fan, home)
    state = chosen.narrowed(chosen.stored(asked.mapInArrow(begin, STATE)), True, want)

    def windows(key, asked: pa.Table, found: pa.Table) -> pa.Table:
        """Windows of an anchor's k positives: the anchor's own row goes from its list, or else the last one."""
        row = asked.to_pylist()[0]
        ids = _ints(row["q_ids"])
        q = _body(row["q_body"], row["q_width"], len(ids)).astype(np.float64)
        own = np.array([products(v[None], v[None])[0, 0] for v in q], I64)
        window, score, near = _best_of(found, want)
        # The row itself is one entry of its id and of its product with itself, as other rows may look the same.
        place = np.arange(len(window))
        same = place[(near == ids[window]) & (score == own[window])]
        drop = np.full(len(ids), -1)
        drop[window[same[::-1]]] = same[::-1]
        last = np.full(len(ids), -1)
        last[window] = place
        full = np.bincount(window, minlength=len(ids)) == want
        drop = np.where((drop < 0) & full, last, drop)
        keep = np.ones(len(window), bool)
        keep[drop[drop >= 0]] = False
        window, score, near = window[keep], score[keep], near[keep]
        first = np.searchsorted(window, np.arange(len(ids)))
        at = window * k + np.arange(len(window)) - first[window]
        low_, top = np.full(len(ids) * k, LAST), np.full(len(ids) * k, -LAST)
        positive, p_score = np.zeros(len(ids) * k, I64), np.zeros(len(ids) * k, I64)
        positive[at], p_score[at] = near, score
        # In whole numbers of any size; a window beyond the range of scores ends there.
        low_[at] = [min(LAST, max(-LAST, -((-low * s) // 100))) for s in score.tolist()]
        top[at] = [min(LAST, max(-LAST, high * s // 100)) for s in score.tolist()]
        return _state(row["dim"], row["block"], k, top, low_, positive=positive, p_score=p_score)

    found = chosen.gathered(state, True, want)
    state = chosen.stored(asked.groupBy("dim", "block").cogroup(found.groupBy("dim", "block")).applyInArrow(windows, STATE))
    state = chosen.narrowed(state, False, negatives)

    def finish(key, asked: pa.Table, found: pa.Table) -> pa.Table:
        row = asked.to_pylist()[0]
        window, score, near = _best_of(found, negatives)
        positive, p_score = _ints(row["positive"])[window], _ints(row["p_score"])[window]
        first = np.searchsorted(window, window)
        rank = (np.arange(len(window)) - first + 1).astype(np.int32)
        anchor = _ints(row["q_ids"])[window // k]
        ids = lambda x: pa.array(x, pa.int64(), mask=x == LAST)
        return pa.table({"anchor_id": ids(anchor), "positive_id": ids(positive), "rank": pa.array(rank), "negative_id": ids(near), "positive_score": pa.array(p_score), "negative_score": pa.array(score)})

    found = chosen.gathered(state, False, negatives)
    known = asked.select("dim", "block", "q_ids").join(state.select("dim", "block", "positive", "p_score"), ["dim", "block"])
    out = known.groupBy("dim", "block").cogroup(found.groupBy("dim", "block")).applyInArrow(finish, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    # What is returned is kept; the tables of the passes go.
    result = workspace(spark, "hard-negatives-result")
    out.write.parquet(result)
    removed(spark, home)
    return spark.read.parquet(result)


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors, F.col("vec_id") % 100 == 0, label)


SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS r, vec_id, embedding, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), whole AS (
  SELECT r, vec_id, label, i, CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) AS x
  FROM (SELECT r, vec_id, label, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM rows)
), pairs AS (
  SELECT q.r AS anchor, q.vec_id AS anchor_id, c.r AS other, c.vec_id AS other_id, q.label = c.label AS same, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.i = c.i AND q.r <> c.r
  WHERE q.vec_id % 100 = 0
  GROUP BY ALL
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id) <= 5
), ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other_id) AS INTEGER) AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN pairs n ON p.anchor = n.anchor AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT * FROM ranked WHERE rank <= 5
"""
