"""A history of items that a batch looks into by key, without reading it all.

Every item has an entry for its external id, its content hash and its address. Entries lie in buckets of a hash of the key, one
file a bucket and run; a run is a batch, or several batches merged. Beside each file stands a Bloom filter of its keys. A batch reads the
filters of the buckets that its keys fall into, and then only the files whose filter lets one of its keys through. Runs of one size class are
merged when there are `fan` of them, so a bucket has a number of files that grows with the logarithm of the batches,
and a key that is new opens about one file in a hundred.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.urls import normalize_url_exact
from newsloom.shared import removed

KNOWN = ["channel_id", "external_id", "content_hash", "url", "seq"]
SCHEMA = "key bigint, channel_id string, external_id string, content_hash string, url string, seq bigint, bucket int, run string"
#: Bits a key and hashes of a filter: about one new key in a hundred gets through.
BITS, HASHES = 10, 7
FILTERS = "bucket int, n bigint, bits binary"


def _keys(items: DataFrame, cleaned: bool) -> DataFrame:
    """An entry for each of an item's keys; with cleaned also one for the cleaned address, which batches ask for too."""
    own = [F.xxhash64(F.lit("id"), "channel_id", "external_id"), F.xxhash64(F.lit("content"), "content_hash"), F.when(F.col("url").isNotNull(), F.xxhash64(F.lit("url"), "url"))]
    if cleaned:
        clean = normalize_url_exact("url")
        own.append(F.when(clean.isNotNull(), F.xxhash64(F.lit("url"), clean)))
    return items.withColumn("key", F.explode(F.array_compact(F.array_distinct(F.array(*own)))))


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    """Places of each key in a filter of so many bits, by two halves of a mixed hash."""
    h = keys.astype(np.uint64)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    a, b = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(HASHES, dtype=np.uint64)) % np.uint64(bits)).astype(np.int64)


def bloom(keys: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(keys) * BITS // 8) * 8), bool)
    bits[_places(keys, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def passing(keys: np.ndarray, value: bytes) -> np.ndarray:
    """Which keys a filter lets through: all that it was made of, and few others."""
    bits = np.unpackbits(np.frombuffer(value, np.uint8)).astype(bool)
    return bits[_places(keys, len(bits))].all(1)


class History:
    """path/entries/run=<name>/bucket=<number>, path/filters/run=<name>/bucket=<number>, and path/runs/<version>, the newest of which counts.

    Batches are numbered; one that comes again changes nothing. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, fan: int = 4) -> None:
        self.spark, self.path, self.buckets, self.fan = spark, path, buckets, fan

    def runs(self) -> dict:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/runs")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        done = sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))) if fs.exists(p) else []
        if not done:
            return {"version": 0, "last": None, "runs": {}}
        return json.loads(self.spark.read.text(f"{self.path}/runs/{done[-1]:08d}").first()[0])

    def _write(self, name: str, entries: DataFrame) -> None:
        """A run: entries in a file a bucket, and their filters."""
        entries = entries.withColumn("bucket", F.pmod("key", F.lit(self.buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "key")
        entries.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/entries/run={name}")

        def made(table: pa.Table) -> pa.Table:
            keys = np.unique(table["key"].to_numpy())
            return pa.table({"bucket": table["bucket"][:1].cast(pa.int32()), "n": pa.array([len(keys)], pa.int64()), "bits": pa.array([bloom(keys)], pa.binary())})

        kept = self.spark.read.parquet(f"{self.path}/entries/run={name}").select("bucket", "key")
        kept.groupBy("bucket").applyInArrow(made, FILTERS).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/filters/run={name}")

    def append(self, batch: int, items: DataFrame) -> bool:
        """Add a batch's items (channel_id, external_id, content_hash, url, seq); False if it was added before."""
        now = self.runs()
        if now["last"] is not None and batch <= now["last"]:
            return False
        name, gone = f"b{batch}", []
        entries = _keys(items.select(*KNOWN), False)
        if not entries.isEmpty():
            self._write(name, entries)
            now["runs"][name] = 0
        level = 0
        while len(own := [r for r, x in now["runs"].items() if x == level]) >= self.fan:
            name = f"m{now['version'] + 1}-{level}"
            self._write(name, self._read(own, None).drop("bucket", "run"))
            gone += own
            now["runs"] = {r: x for r, x in now["runs"].items() if r not in own} | {name: level + 1}
            level += 1
        now["last"], now["version"] = batch, now["version"] + 1
        self.spark.createDataFrame([(json.dumps(now),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/runs/{now['version']:08d}")
        for r in gone:
            removed(self.spark, f"{self.path}/entries/run={r}")
            removed(self.spark, f"{self.path}/filters/run={r}")
        return True

    def _read(self, runs: list[str], buckets: dict[str, list[int]] | None) -> DataFrame:
        """Entries of runs, of all buckets or of those named for each run; only their folders are listed."""
        paths = [f"{self.path}/entries/run={r}" + (f"/bucket={b}" if buckets else "") for r in runs for b in (buckets[r] if buckets else [0])]
        return self.spark.read.schema(SCHEMA).option("basePath", f"{self.path}/entries").parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def files(self, batch: DataFrame) -> dict[str, list[int]]:
        """Buckets by run whose filter lets a key of the batch through. Filters of the batch's buckets are read, no entries."""
        runs = list(self.runs()["runs"])
        if not runs:
            return {}
        filters = self.spark.read.schema(FILTERS + ", run string").option("basePath", f"{self.path}/filters").parquet(*(f"{self.path}/filters/run={r}" for r in runs))
        asked = _keys(batch.select(*KNOWN[:-1]), True).select("key", F.pmod("key", F.lit(self.buckets)).cast("int").alias("of")).distinct()

        def some(keys: pa.Table, own: pa.Table) -> pa.Table:
            x = keys["key"].to_numpy() if keys.num_rows else np.zeros(0, np.int64)
            hit = [len(x) > 0 and bool(passing(x, v).any()) for v in own["bits"].to_pylist()]
            return own.select(["run", "bucket"]).filter(pa.array(hit, pa.bool_()))

        found = asked.groupBy("of").cogroup(filters.groupBy("bucket")).applyInArrow(some, "run string, bucket int")
        out: dict[str, list[int]] = {}
        for r in found.collect():  # at most one row for each file of the history
            out.setdefault(r["run"], []).append(r["bucket"])
        return out

    def lookup(self, batch: DataFrame) -> DataFrame:
        """All stored items that share an external id, a content hash or an address with a row of the batch (channel_id,
        external_id, content_hash, url), the cleaned address included: what `drop_known` and the links by address need."""
        some = self.files(batch)
        keys = _keys(batch.select(*KNOWN[:-1]), True).select("key").distinct()
        return self._read(list(some), some).join(keys, "key", "left_semi").select(*KNOWN).distinct()
