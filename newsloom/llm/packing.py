"""Operator 5: packing token sequences by minimum bin slack.

A document's ids are cut at multiples of the capacity; whole pieces are sequences of their own and
the rests are packed. Only the rests' length histogram (at most `capacity - 1` counts, whatever the
corpus) is planned on the driver: take the longest rest, then let a bitset subset-sum program over
the remaining lengths find the multiset that fills the window closest to capacity, backtrack its
counts, and repeat that pattern as often as the histogram allows. Each step uses up a length, so the
plan has few patterns, each with a number of repetitions.

Pieces take their places by rank among those of their length. Ranks come from counts per (length,
bucket), so a length that a third of all documents share is spread over all tasks.

Tokens are counted once: pieces go to the checkpoint folder before the plan is made.

Cases: null and empty texts are documents of the closing id alone. A null doc_id passes through.
Repeated rows are separate documents. Texts that spell a special token go through the tokenizer
itself. An empty table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.exchange import loose, settled

_encoders: dict[str, tuple] = {}


def encoder(path: str):
    """A function from a text to the ids of the tokenizer file at path, without added special tokens.

    The file's merges are run by tiktoken, which gives the same ids several times faster; texts with
    a special token's string are left to the tokenizer.
    """
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        model = json.load(open(path, encoding="utf-8"))
        specials = [x["content"] for x in model.get("added_tokens", [])]
        # The byte-level alphabet of such files: printable bytes stand for themselves, others follow 255.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        slow = Tokenizer.from_file(path)

        def encode(text: str) -> np.ndarray:
            if any(s in text for s in specials):
                return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
            return fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

        _encoders[path] = (encode,)
    return _encoders[path][0]


def pieces(docs: DataFrame, path: str, capacity: int, close: int, with_ids: bool, text: str, doc_id: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, x in enumerate(batch["text"].to_pylist()):
                own = np.append(encode(x or ""), np.uint32(close)).astype("<u4")
                for a in range(0, len(own), capacity):
                    part = own[a : a + capacity]
                    row.append(i)
                    start.append(a)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    total.append(len(own))
                    if with_ids:
                        ids.append(part.astype(np.int64))
            out = {"doc_id": loose(batch["doc_id"].take(pa.array(row, pa.int64())))} | {k: pa.array(v, pa.int64()) for k, v in (("start", start), ("length", length), ("ids_crc32", crc), ("doc_tokens", total))}
            if with_ids:
                out["ids"] = pa.array(ids, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(out)

    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<bigint>" * with_ids)


def fill(left: Counter, room: int) -> dict[int, int]:
    """The multiset of remaining lengths whose sum is closest to room from below, as counts by length."""
    reach, mask = 1, (1 << (room + 1)) - 1
    trail: list[tuple[int, int, int]] = []  # length, copies taken at once, sums reachable before
    for size in sorted((x for x, n in left.items() if n and x <= room), reverse=True):
        n, step = min(left[size], room // size), 1
        while n:
            step = min(step, n)
            trail.append((size, step, reach))
            reach |= (reach << size * step) & mask
            n, step = n - step, step * 2
        if reach >> room & 1:
            break
    goal, counts = reach.bit_length() - 1, Counter()
    for size, step, before in reversed(trail):
        if not before >> goal & 1:
            counts[size] += step
            goal -= size * step
    return dict(counts)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Patterns (counts by length) and how many sequences each makes."""
    left, out = Counter({k: v for k, v in histogram.items() if v}), []
    while left:
        most = max(left)
        pattern = Counter({most: 1})
        left[most] -= 1
        pattern.update(fill(left, capacity - most))
        left[most] += 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        out.append((dict(pattern), times))
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, close: int = 1, with_ids: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Where every id of every document lies: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, with_ids, the ids themselves, from which sequences can be written."""
    spark = docs.sparkSession
    cut = settled(pieces(docs, path, capacity, close, with_ids, text, doc_id))
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * 4
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)))
    counts = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    whole = histogram.pop(capacity, 0)
    slots: list[tuple[int, int, int, int, int]] = [(capacity, 0, 1, 0, 0)]  # length, first rank, copies, first sequence, offset
    used: Counter = Counter()
    sequence = whole
    for pattern, times in plan(histogram, capacity):
        offset = 0
        for size, n in sorted(pattern.items(), reverse=True):
            slots.append((size, used[size], n, sequence, offset))
            used[size] += n * times
            offset += size * n
        sequence += times
    table = spark.createDataFrame(slots, "length long, first long, copies long, sequence long, at long")
    table = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "copies", "sequence", "at"))).alias("slots"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32"))
    ranked = cut.withColumn("place", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("place") - 1)
    # The plan has at most a few slots for each of capacity - 1 lengths, so it is broadcast.
    placed = ranked.join(F.broadcast(table), "length")
    slot = F.element_at(F.filter("slots", lambda s: s["first"] <= F.col("rank")), -1)
    placed = placed.withColumn("slot", slot).withColumn("turn", F.col("rank") - F.col("slot.first"))
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.sequence") + F.floor(F.col("turn") / F.col("slot.copies"))).alias("sequence_id"),
        (F.col("slot.at") + F.col("turn") % F.col("slot.copies") * F.col("length")).alias("offset"),
        *(["ids"] if with_ids else []),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, path or tokenizer_path())
