"""Nearest neighbours by inverted lists: cells around centres, searched by probes and, for exact answers, by bounds.

Centres are fitted by k-means on a bounded sample. Every vector belongs to the cell of its nearest centre; a cell is stored as
shards of bounded rows, each one packed row with its reach, the largest angle between its vectors and the centre.
Queries are packed into blocks by their own cells, so the queries of a block lie together.

A search first visits the `probes` cells nearest to each block's centre, which gives every query a k-th best score so far. That
is the approximate answer. The exact one then visits each further cell that may hold something better: no vector of a
cell is nearer to a query than the angle between query and centre less the cell's reach (the triangle inequality on
the sphere), and a query takes part in a tile only if that angle allows its k-th best score. With `least`, scores below it are not asked for and
bound the visits from the start. Cells are dealt to groups of bounded bytes, and a task holds one group while blocks pass by; a block goes once to
each group that holds cells to visit. So what is shuffled is packed blocks, times the groups, and a group's lists of the best k, and
neither driver nor task holds a table. On vectors without any clusters no bound rules anything out, and the exact search
multiplies all pairs, as it must.

`VectorIndex` keeps such shards as a store that grows by batches: a batch adds a segment, a manifest names the segments that
count, and segments of one size class are merged as they get many, so a search reads a number of them that grows with
the logarithm of the batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsloom.functions.best import best_cosines, empty_lists
from newsloom.shared import removed, workspace

#: Most centres, rows of the sample that they are fitted on, and components (of eight bytes) in a shard and in a block.
CENTRES, SAMPLE, SHARD, BLOCK = 1024, 16_384, 1 << 21, 1 << 18
#: Bytes of shards in a group, and products that make a task of their own worth it.
GROUP, PRODUCTS = 64 << 20, 200_000_000
#: Scores are rounded to six digits: a bound must miss by more than that.
SLACK = 2e-6
KEYS = ["dim", "cell", "part"]
SHARDS = "dim int, cell int, part int, ids binary, body binary, reach double"
BLOCKS = SHARDS + ", kth binary"
_FOUND = pa.schema([("dim", pa.int32()), ("cell", pa.int32()), ("part", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()), ("products", pa.int64())])
_VISITS = pa.list_(pa.struct([("group", pa.int32()), ("cells", pa.list_(pa.int32()))]))
FOUND = "dim int, cell int, part int, query_id long, vec_id long, score double, products long"


def units(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """id and vec of rows with an id and a vector that is neither empty nor holds null, NaN or infinite components."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("vec"))
    return rows.filter(F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number))


def fitted(vectors: DataFrame, cells: int | None = None, rounds: int = 8) -> dict[int, np.ndarray]:
    """Unit centres by vector length: k-means on at most SAMPLE rows, in the order of a hash of id and vector.

    Without `cells` there are about as many as the square root of the rows, at most CENTRES.
    """
    total = vectors.count()
    sample = vectors.orderBy(F.xxhash64("id", "vec")).limit(SAMPLE).toArrow()
    out: dict[int, np.ndarray] = {}
    size = np.array([len(v) for v in sample["vec"]], np.int64)
    for dim in np.unique(size).tolist():
        x = units(np.array([v.as_py() for v, n in zip(sample["vec"], size, strict=True) if n == dim], float))
        want = min(cells or int(max(1, total) ** 0.5) + 1, CENTRES, len(x))
        centre = x[:want]
        for _ in range(rounds):
            own = (x @ centre.T).argmax(1)
            sums = np.zeros_like(centre)
            np.add.at(sums, own, x)
            full = np.linalg.norm(sums, axis=1) > 1e-9
            centre = np.where(full[:, None], units(sums), centre)
        out[dim] = centre
    return out


def _cells(table: pa.Table | pa.RecordBatch, centres: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of each vector length with their unit vectors and cells; a length without centres is one cell."""
    column = table["vec"].combine_chunks() if isinstance(table["vec"], pa.ChunkedArray) else table["vec"]
    size = np.diff(column.offsets.to_numpy())
    for dim in np.unique(size).tolist():
        rows = np.flatnonzero(size == dim)
        m = units(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim))
        yield dim, rows, m, (m @ centres[dim].T).argmax(1) if dim in centres else np.zeros(len(rows), np.int64)


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def packed(rows: DataFrame, centres: dict[int, np.ndarray], components: int) -> DataFrame:
    """rows (id, vec) as shards by cell, of about so many components each."""
    held = rows.sparkSession.sparkContext.broadcast(centres)  # at most CENTRES vectors of each length of the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, _, cell in _cells(batch, held.value):
                own, n = np.unique(cell, return_counts=True)
                yield pa.RecordBatch.from_pydict({"dim": pa.array(np.full(len(own), dim), pa.int32()), "cell": pa.array(own, pa.int32()), "n": pa.array(n, pa.int64())})

    counts = rows.select("id", "vec").mapInArrow(count, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()
    parts = {(r["dim"], r["cell"]): -(-r["n"] * r["dim"] // components) for r in counts}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, own, m, cell in _cells(batch, held.value):
                ids = batch["id"].to_numpy(zero_copy_only=False)[own]
                many = np.array([parts.get((dim, c), 1) for c in cell.tolist()], np.int64)
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (np.abs(m[:, 0]) * 2**40).astype(np.uint64)) >> np.uint64(33)
                yield pa.RecordBatch.from_pydict(
                    {"dim": pa.array(np.full(len(own), dim), pa.int32()), "cell": pa.array(cell, pa.int32()), "part": pa.array(mixed.astype(np.int64) % many, pa.int32()), "id": pa.array(ids, pa.int64()), "vec": pa.array([v.tobytes() for v in m], pa.binary())}
                )

    def pack(table: pa.Table) -> pa.Table:
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        m = np.frombuffer(b"".join(table["vec"].to_pylist())).reshape(len(ids), -1)[order]
        dim, cell = table["dim"][0].as_py(), table["cell"][0].as_py()
        reach = float(angle(m @ held.value[dim][cell]).max()) if dim in held.value else float(np.pi)
        head = {k: table[k][:1] for k in ("dim", "cell", "part")}
        return pa.table(head | {"ids": pa.array([ids[order].tobytes()], pa.binary()), "body": pa.array([m.tobytes()], pa.binary()), "reach": pa.array([reach])})

    return rows.select("id", "vec").mapInArrow(deal, "dim int, cell int, part int, id long, vec binary").groupBy("dim", "cell", "part").applyInArrow(pack, SHARDS)


def unpacked(shards: DataFrame) -> DataFrame:
    """(id, vec) of shards, as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], np.int64)
                m = np.frombuffer(row["body"])
                yield pa.RecordBatch.from_pydict({"id": pa.array(ids), "vec": pa.ListArray.from_arrays(pa.array(np.arange(len(ids) + 1) * row["dim"], pa.int32()), pa.array(m))})

    return shards.mapInArrow(run, "id long, vec array<double>")


class Search:
    """One search of shards: its blocks, tiles and lists in a workspace of the shared folder."""

    def __init__(self, shards: DataFrame, centres: dict[int, np.ndarray], queries: DataFrame, k: int, least: float = -2.0, probes: int = 4, exact: bool = True, exclude_self: bool = True) -> None:
        self.spark, self.shards, self.centres, self.k, self.least, self.exclude_self = shards.sparkSession, shards, centres, k, least, exclude_self
        self.home = workspace(self.spark, "neighbours")
        self.reach: dict[int, dict[int, float]] = {}
        self.held: list[tuple[int, int, int, int]] = []
        # At most CENTRES rows a vector length, and one for each 16 MB.
        for r in shards.groupBy("dim", "cell", "part").agg(F.max("reach").alias("reach"), F.sum(F.length("body")).alias("bytes")).collect():
            own = self.reach.setdefault(r["dim"], {})
            own[r["cell"]] = max(own.get(r["cell"], 0.0), r["reach"])
            self.held.append((r["dim"], r["cell"], r["part"], r["bytes"]))
        start = partial(_started, least=least)
        blocks = packed(queries, centres, BLOCK).mapInArrow(start, BLOCKS)
        blocks.write.parquet(f"{self.home}/blocks")
        self.blocks = self.spark.read.parquet(f"{self.home}/blocks")
        self._visit(self.blocks, "first", 0, probes)
        if exact:
            first = self.spark.read.parquet(f"{self.home}/first").filter("query_id IS NOT NULL").select(*KEYS, "query_id", "score")
            raised = self.blocks.groupBy(*KEYS).cogroup(first.groupBy(*KEYS)).applyInArrow(partial(_raised, k=k), BLOCKS)
            self._visit(raised, "rest", probes, None)

    def _visit(self, blocks: DataFrame, name: str, start: int, stop: int | None) -> None:
        """Multiply blocks with the cells from place start to stop in the order of nearness to the block's centre, where
        bounds don't rule that out."""
        groups, sets = self._groups(stop is not None)
        of: dict[tuple[int, int], list[int]] = {}
        for (dim, cell, _), group in groups.items():
            if group not in of.setdefault((dim, cell), []):
                of[dim, cell].append(group)
        held = self.spark.sparkContext.broadcast((self.centres, self.reach, of))
        k, exclude_self = self.k, self.exclude_self

        def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, reach, of = held.value
            for batch in batches:
                visits = []
                for row in batch.to_pylist():
                    known = np.array(sorted(reach.get(row["dim"], {})), np.int64)
                    if row["dim"] not in centres or not len(known):
                        near = known if start == 0 else known[:0]
                    else:
                        centre = centres[row["dim"]]
                        own = np.frombuffer(row["body"]).reshape(-1, row["dim"])
                        near = known[np.argsort(-(centre[known] @ centre[row["cell"]]), kind="stable")][start:stop]
                        bound = angle(own @ centre[near].T) - np.array([reach[row["dim"]][c] for c in near.tolist()])
                        may = np.cos(np.maximum(bound, 0.0)) + SLACK >= np.frombuffer(row["kth"])[:, None]
                        near = near[may.any(0)]
                    cells: dict[int, list[int]] = {}
                    for c in near.tolist():
                        for group in of[row["dim"], c]:
                            cells.setdefault(group, []).append(c)
                    visits.append([{"group": g, "cells": c} for g, c in cells.items()])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(visits, _VISITS)], names=[*batch.schema.names, "visits"])

        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each group its shards, then the blocks, one at a time."""
            centres, at, cells, stacked = held.value[0], None, {}, (None,)
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {name: batch[name][r].as_py() for name in batch.schema.names}
                    if (row["group"], row["set"]) != at:
                        at, cells, stacked = (row["group"], row["set"]), {}, (None,)
                    ids, body = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["body"]).reshape(-1, row["dim"])
                    if row["cells"] is None:
                        cells.setdefault((row["dim"], row["cell"]), []).append((ids, body, row["reach"]))
                        continue
                    kth, made = np.frombuffer(row["kth"]), 0
                    best, score = empty_lists(len(ids), k)
                    seen = [(cell, *shard) for cell in row["cells"] for shard in cells.get((row["dim"], cell), [])]
                    bound = np.full((len(ids), len(seen)), np.inf)
                    if row["dim"] in centres and seen:
                        bound = np.cos(np.maximum(angle(body @ centres[row["dim"]][[x[0] for x in seen]].T) - np.array([x[3] for x in seen]), 0.0)) + SLACK
                    # Shards that all queries take part in are multiplied as one.
                    every = (bound >= kth[:, None]).all(0)
                    for x in np.flatnonzero(~every).tolist():
                        _, own, m, _ = seen[x]
                        may = np.flatnonzero(bound[:, x] >= np.maximum(kth, score[:, -1]))
                        if len(may):
                            lists, values = best[may], score[may]
                            best_cosines(lists, values, ids[may], body[may], own, m, kth[may], exclude_self)
                            best[may], score[may] = lists, values
                            made += len(may) * len(own)
                    if every.any():
                        of_all = (row["dim"], *np.flatnonzero(every).tolist(), *(x[0] for x in seen))
                        if of_all != stacked[0]:
                            chosen = [seen[x] for x in np.flatnonzero(every).tolist()]
                            stacked = (of_all, np.concatenate([x[1] for x in chosen]), np.concatenate([x[2] for x in chosen]))
                        best_cosines(best, score, ids, body, stacked[1], stacked[2], kth, exclude_self)
                        made += len(ids) * len(stacked[1])
                    i, j = np.nonzero(np.isfinite(score))
                    yield _found(row, ids[i], best[i, j], score[i, j], made)

        blocks = blocks.mapInArrow(plan, BLOCKS + ", visits array<struct<group: int, cells: array<int>>>").withColumn("visit", F.explode("visits"))
        blocks = blocks.select(F.col("visit.group").alias("group"), F.pmod(F.hash("dim", "cell", "part"), F.lit(sets)).alias("set"), *KEYS, "ids", "body", "reach", "kth", F.col("visit.cells").alias("cells"))
        places = self.spark.createDataFrame([(*key, group) for key, group in groups.items()] or [(-1, -1, -1, -1)], "dim int, cell int, part int, group int")
        shards = self.shards.join(F.broadcast(places), KEYS).select("group", F.explode(F.sequence(F.lit(0), F.lit(sets - 1))).alias("set"), *KEYS, "ids", "body", "reach", F.lit(None).cast("binary").alias("kth"), F.lit(None).cast("array<int>").alias("cells"))
        number = max(1, sets * len(set(groups.values())))
        # Shards come first, as they have no cells to visit.
        dealt = shards.unionByName(blocks).repartition(number, "group", "set").withColumn("asks", F.col("cells").isNotNull()).sortWithinPartitions("group", "set", "asks")
        dealt.mapInArrow(multiply, FOUND).write.parquet(f"{self.home}/{name}")

    def _groups(self, few: bool) -> tuple[dict[tuple[int, int, int], int], int]:
        """The group of each shard's key, and the number of sets that blocks are dealt to: both so that tasks are enough. few: each block
        visits few cells, and one set will do."""
        total = sum(x[3] for x in self.held)
        asked = 0 if few else int(self.blocks.agg(F.coalesce(F.sum(F.length("body")), F.lit(0))).first()[0])
        dim = max((x[0] for x in self.held), default=1)
        tasks = max(1, min(2 * self.spark.sparkContext.defaultParallelism, (total // (8 * dim)) * ((total if few else asked) // (8 * dim)) // PRODUCTS))
        groups = max(-(-total // GROUP), tasks if few else round((tasks * total / max(1, asked)) ** 0.5), 1)
        # Cells in the order of their number, filled up to a group's share.
        out, group, filled = {}, 0, 0
        for d, cell, part, size in sorted(self.held):
            if filled and filled + size > max(1, total / groups):
                group, filled = group + 1, 0
            out[d, cell, part], filled = group, filled + size
        return out, 1 if few else max(1, -(-tasks // (group + 1)))

    def _lists(self) -> DataFrame:
        found = [self.spark.read.parquet(f"{self.home}/{x}") for x in ("first", "rest") if _there(self.spark, f"{self.home}/{x}")]
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def matches(self) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k nearest, score rounded to six digits, ties to smaller ids."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return self._lists().filter("query_id IS NOT NULL").withColumn("rank", rank).filter((F.col("rank") <= self.k) & (F.col("score") >= self.least)).select("query_id", "rank", "vec_id", "score")

    def products(self) -> int:
        """Inner products of queries with stored vectors that the search made."""
        return self._lists().agg(F.coalesce(F.sum("products"), F.lit(0))).first()[0]


def _found(row: dict, q: np.ndarray, ids: np.ndarray, score: np.ndarray, products: int) -> pa.RecordBatch:
    """Rows of a list; what a tile multiplied is a row of its own, without a query."""
    n = len(q)
    head = [pa.array(np.full(n + (products > 0), row[k]), pa.int32()) for k in KEYS]
    empty = [None] * (products > 0)
    body = [pa.concat_arrays([pa.array(x, t), pa.array(empty, t)]) for x, t in ((q, pa.int64()), (ids, pa.int64()), (score, pa.float64()))]
    return pa.RecordBatch.from_arrays([*head, *body, pa.array([0] * n + [products] * (products > 0), pa.int64())], schema=_FOUND)


def _started(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Blocks whose queries ask for scores of at least `least`."""
    for batch in batches:
        kth = pa.array([np.full(len(x) // 8, least).tobytes() for x in batch["ids"].to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, kth], names=[*batch.schema.names, "kth"])


def _raised(key, blocks: pa.Table, found: pa.Table, k: int) -> pa.Table:
    """A block whose queries ask for more than the k-th best score that they have already."""
    if not blocks.num_rows:
        return blocks
    row = blocks.to_pylist()[0]
    ids, kth = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["kth"]).copy()
    query, score = found["query_id"].to_numpy(), found["score"].to_numpy()
    order = np.lexsort((-score, query))
    query, score = query[order], score[order]
    first = np.searchsorted(query, ids, "left")
    full = np.searchsorted(query, ids, "right") - first >= k
    kth[full] = np.maximum(kth[full], score[first[full] + k - 1])
    return pa.Table.from_pylist([row | {"kth": kth.tobytes()}], schema=blocks.schema)


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def search(vectors: DataFrame, queries: DataFrame, k: int, least: float = -2.0, probes: int = 4, exact: bool = True, cells: int | None = None, exclude_self: bool = True, vec_id: str = "vec_id", embedding: str = "embedding") -> Search:
    """Cells of vectors, made for this search, and the search of queries among them; the answer is its matches().

    With exact, the same rows as `vectors.knn` returns; without, those of the nearest `probes` cells. Rows without an id or with a vector
    that is null, empty or not finite take no part, nor do vectors of another length than the query's.
    """
    rows = usable(vectors, vec_id, embedding)
    centres = fitted(rows, cells)
    home = workspace(vectors.sparkSession, "cells")
    packed(rows, centres, SHARD).write.parquet(home)
    return Search(vectors.sparkSession.read.parquet(home), centres, usable(queries, vec_id, embedding), k, least, probes, exact, exclude_self)


class VectorIndex:
    """A stored index that grows by batches: path/segments/*, path/centres/*, and path/manifest/<number>.

    A manifest is written after what it names and the newest complete one counts, so a batch that breaks off leaves the index
    as it was, and a batch number that is not above the last one is known and changes nothing. `fan` segments of one
    size class become one of the next. When the index has grown by `regrow` since its centres were fitted, they are fitted
    anew and all rows are dealt again, so that cells stay small. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = 8, regrow: int = 16) -> None:
        self.spark, self.path, self.fan, self.regrow = spark, path, fan, regrow

    def manifest(self) -> dict:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))) if fs.exists(p) else []
        if not done:
            return {"version": 0, "last": None, "segments": [], "centres": None, "fitted": 0}
        return json.loads(self.spark.read.text(f"{self.path}/manifest/{done[-1]:08d}").first()[0])

    def _commit(self, manifest: dict) -> None:
        manifest["version"] += 1
        self.spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/manifest/{manifest['version']:08d}")

    def _centres(self, manifest: dict) -> dict[int, np.ndarray]:
        if not manifest["centres"]:
            return {}
        rows = self.spark.read.parquet(f"{self.path}/centres/{manifest['centres']}").collect()
        return {r["dim"]: np.frombuffer(r["body"]).reshape(-1, r["dim"]) for r in rows}

    def _fit(self, rows: DataFrame, manifest: dict, total: int) -> None:
        manifest["centres"], manifest["fitted"] = f"c{manifest['version'] + 1}", total
        found = [(dim, bytearray(c.tobytes())) for dim, c in fitted(rows).items()]
        self.spark.createDataFrame(found, "dim int, body binary").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centres/{manifest['centres']}")

    def _read(self, names: list[str]) -> DataFrame:
        paths = [f"{self.path}/segments/{n}" for n in names]
        return self.spark.read.schema(SHARDS).parquet(*paths) if paths else self.spark.createDataFrame([], SHARDS)

    def append(self, batch: int, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> bool:
        """Add the batch's vectors; False if it was added before."""
        now = self.manifest()
        if now["last"] is not None and batch <= now["last"]:
            return False
        rows, old = usable(vectors, vec_id, embedding), []
        n = rows.count()
        total = n + sum(s["rows"] for s in now["segments"])
        if n and (not now["centres"] or total > self.regrow * now["fitted"]):
            old = now["segments"]
            rows = unpacked(self._read([s["name"] for s in old])).unionByName(rows) if old else rows
            self._fit(rows, now, total)
            now["segments"], n = [], total
        if n:
            self._add(now, f"b{batch}-{now['version'] + 1}", rows, n)
        now["last"] = batch
        old += self._merge(now)
        self._commit(now)
        # What no manifest needs any more goes once the new one stands.
        for s in old:
            removed(self.spark, f"{self.path}/segments/{s['name']}")
        return True

    def _add(self, manifest: dict, name: str, rows: DataFrame, n: int) -> None:
        packed(rows, self._centres(manifest), SHARD).write.mode("overwrite").parquet(f"{self.path}/segments/{name}")
        level = 0
        while n >= self.fan ** (level + 1) * 1000:
            level += 1
        manifest["segments"].append({"name": name, "rows": n, "level": level})

    def _merge(self, manifest: dict) -> list[dict]:
        gone = []
        while True:
            classes: dict[int, list[dict]] = {}
            for s in manifest["segments"]:
                classes.setdefault(s["level"], []).append(s)
            level = next((x for x in sorted(classes) if len(classes[x]) >= self.fan), None)
            if level is None:
                return gone
            own = classes[level]
            manifest["segments"] = [s for s in manifest["segments"] if s not in own]
            self._add(manifest, f"m{manifest['version'] + 1}-{level}", unpacked(self._read([s["name"] for s in own])), sum(s["rows"] for s in own))
            manifest["segments"][-1]["level"] = max(level + 1, manifest["segments"][-1]["level"])
            gone += own

    def search(self, queries: DataFrame, k: int, least: float = -2.0, probes: int = 4, exact: bool = True, exclude_self: bool = False, vec_id: str = "vec_id", embedding: str = "embedding") -> Search:
        now = self.manifest()
        shards = self._read([s["name"] for s in now["segments"]])
        return Search(shards, self._centres(now), usable(queries, vec_id, embedding), k, least, probes, exact, exclude_self)

    def rows(self) -> DataFrame:
        """(id, vec) of all that is stored."""
        return unpacked(self._read([s["name"] for s in self.manifest()["segments"]]))
