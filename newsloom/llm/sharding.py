"""Operator 4: sharding by a hypergeometric communication matrix, in DataFrame functions only.

Rows lie in parts (by a hash, so that a part is the same whenever it is computed again). How many
rows of each part go to each shard is drawn exactly as a uniform shuffle would have it: a part's
counts are multivariate hypergeometric given the seats that are left. The matrix is drawn down a tree of
`GROUP` children a node, first for the largest groups of parts, then within each of them, so no row or fold ever
holds more than `GROUP` groups and the depth is the logarithm of the parts. Each part permutes its rows and deals them out by its counts; shards
then permute again, in slices, so that no task holds a shard. Shard sizes are exact: at most one row
apart, whatever the data.

Each draw inverts the distribution over nine standard deviations (and twelve values) on both sides of its
mean; what lies outside is less than the 53 bits of the number that is inverted can tell. Its steps grow with the
square root of a group's rows; a group of the top is the only one with that of all rows.

Cases: a null in any column is hashed apart from every value. Equal rows are separate rows, each with a
slot of its own; which of two unlike rows comes first whose 64-bit hashes are equal is left open. Texts of any
length are hashed whole. Columns of maps are hashed as JSON. Empty tables give an empty result. Columns keep
their names, but for one called shard or slot (in any case), which comes back with `own_` before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.exchange import MB, size_of

GROUP = 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniform(*parts: Column | int) -> Column:
    """A number in (0, 1) that depends on the parts alone."""
    h = F.xxhash64(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hypergeometric(u: Column, total: Column, good: Column, n: Column) -> Column:
    """How many of n draws without replacement from total are among its good ones, by inversion at u."""

    def bounds(share: Column) -> Column:
        mean = n * share
        wide = F.sqrt(mean * (1 - share) * (total - n) / F.greatest(total - 1, F.lit(1))) * 9 + 12
        low = F.greatest(F.lit(0).cast("long"), n - (total - good), F.floor(mean - wide))
        high = F.least(n, good, F.ceil(mean + wide))
        return F.struct(low.alias("low"), F.greatest(low, high).alias("high"))

    def walk(b: Column) -> Column:
        steps = F.sequence(b["low"], b["high"])
        ratio = lambda k: ((good - k).cast("double") * (n - k)) / ((k + 1).cast("double") * (total - good - n + k + 1))
        start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
        mass = F.aggregate(steps, start, lambda s, k: F.struct((s["p"] * ratio(k)).alias("p"), (s["sum"] + s["p"]).alias("sum")))["sum"]

        def find(goal: Column) -> Column:
            begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"), b["high"].alias("x"))
            more = lambda s, k: F.struct((s["p"] * ratio(k)).alias("p"), (s["sum"] + s["p"]).alias("sum"), F.when((s["sum"] < goal) & (s["sum"] + s["p"] >= goal), k).otherwise(s["x"]).alias("x"))
            return F.aggregate(steps, begin, more)["x"]

        return _let(mass * u, find)

    return _let(good / F.greatest(total, F.lit(1)), lambda share: _let(bounds(share), walk))


def _dealt(seats: Column, part: Column, n: Column, shards: int, seed: int) -> Column:
    """How many of a part's n rows take seats of each shard."""
    start = F.struct(F.aggregate(seats, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), n.alias("n"), F.array().cast("array<bigint>").alias("counts"))

    def step(s: Column, k: Column) -> Column:
        good = F.element_at(seats, k + 1)
        x = hypergeometric(uniform(seed, part, k), s["total"], good, s["n"])
        return _let(x, lambda x: F.struct((s["total"] - good).alias("total"), (s["n"] - x).alias("n"), F.array_append(s["counts"], x).alias("counts")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, step)["counts"]


def _matrix(parts: Column, seats: Column, shards: int, seed: int) -> Column:
    """Counts for each of an array of (part, n), the seats being filled one part after another."""
    start = F.struct(seats.alias("seats"), F.array().cast("array<struct<part:bigint,counts:array<bigint>>>").alias("rows"))

    def step(s: Column, p: Column) -> Column:
        counts = _dealt(s["seats"], p["part"], p["n"], shards, seed)
        return _let(counts, lambda c: F.struct(F.zip_with(s["seats"], c, lambda a, b: a - b).alias("seats"), F.array_append(s["rows"], F.struct(p["part"].alias("part"), c.alias("counts"))).alias("rows")))

    return F.aggregate(parts, start, step)["rows"]


def communication_matrix(counts: DataFrame, shards: int, seed: int, parts: int) -> DataFrame:
    """(part, counts): rows of each part for each shard, from (part, n) with part under `parts`."""
    levels = [counts.select("part", "n")]
    while GROUP ** len(levels) < parts:
        levels.append(levels[-1].groupBy(F.floor(F.col("part") / GROUP).alias("part")).agg(F.sum("n").alias("n")))
    total = F.col("total")
    seats = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor(total / shards) + F.when(s < total % shards, 1).otherwise(0))
    above = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).select(F.lit(0).cast("long").alias("grp"), seats.alias("seats"))
    for level in reversed(range(len(levels))):
        children = levels[level].withColumn("grp", F.floor(F.col("part") / GROUP)).groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("part", "n"))).alias("parts"))
        drawn = children.join(above, "grp").select(F.explode(_matrix(F.col("parts"), F.col("seats"), shards, seed + level)).alias("row"))
        above = drawn.select(F.col("row.part").alias("grp"), F.col("row.counts").alias("seats"))
    return above.select(F.col("grp").alias("part"), F.col("seats").alias("counts"))


def _free(name: str, taken: set[str]) -> str:
    """name with as many `own_` before it as make it new."""
    while name.lower() in taken:
        name = f"own_{name}"
    taken.add(name.lower())
    return name


def shard(df: DataFrame, shards: int = 8, seed: int = 17, part_bytes: int = 16 * MB) -> DataFrame:
    """df with shard (0 to shards - 1) and slot (gapless from 0 in each shard), a uniform shuffle by seed."""
    taken = {c.lower() for c in df.columns} | {"shard", "slot"}
    df = df.toDF(*(_free(c, taken) if c.lower() in ("shard", "slot") else c for c in df.columns))
    own = df.columns
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), size_of(df) // part_bytes + 1)
    values = [F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]
    key = F.xxhash64(*values, *(F.col(f"`{c}`").isNull() for c in own), F.lit(seed))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("row"), key.alias("key")).withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(parts)))
    matrix = communication_matrix(rows.groupBy("part").agg(F.count("*").alias("n")), shards, seed, parts)
    ends = F.aggregate("counts", F.array().cast("array<bigint>"), lambda a, x: F.array_append(a, x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0))))
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.xxhash64("key", F.lit(2)), "key"))
    rows = rows.withColumn("place", place).join(matrix.select("part", ends.alias("ends")), "part")
    rows = rows.withColumn("shard", (F.array_position(F.transform("ends", lambda e: e >= F.col("place")), True) - 1).cast("int"))
    # Permute again: a shard's rows fall into random slices, each ordered at random by a task of its own.
    rows = rows.select("row", "key", "shard", F.pmod(F.xxhash64("key", F.lit(3)), F.lit(parts)).alias("slice"))
    sizes = rows.groupBy("shard", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("shard", "slice", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("shard", "slice").orderBy(F.xxhash64("key", F.lit(4)), "key"))
    rows = rows.withColumn("place", place).join(starts, ["shard", "slice"])
    return rows.select("row.*", "shard", (F.col("start") + F.col("place") - 1).alias("slot"))


def op4_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return shard(rows).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
