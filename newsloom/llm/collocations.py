"""Operator 11: phrase collocation mining by sorted runs of packed word ids.

1. Texts are cut into words where they are read. A chunk (some megabytes of one language) keeps its words in order, as places in the
   list of its distinct words, in a table of the shared folder.
2. A chunk sends each word once, with its count, to the bucket of the word's hash. The bucket adds up the counts by language and
   answers with ids of the words of at least `min_count` occurrences; no phrase with a rarer word can reach that count. Ids
   are dense: each bucket's begin where those before it end.
3. Pairs of neighbouring words are counted by a hash of 32 bits: a chunk sends each hash once, with its count, to the bucket of the
   hash, and gets back one bit, whether the sum reaches min_count. Hashes may share a sum, so this rules out only pairs that are rare indeed.
4. Each place of a chunk makes one window: the ids of the word and of up to `longest - 1` words behind it, up to the end of the
   piece, a rare word or a rare pair, packed into a binary key of fixed width, zeros behind. A chunk's equal windows become one with
   a count. Keys go to ranges, whose borders come from a sample of keys, and a range sorts them by radix.
5. In sorted order, all windows that begin with the same phrase are one run, so the runs of each prefix length give
   the counts of all phrases of that length. Runs that touch a range's border are added up with those of its neighbours, so a phrase that a third
   of all places begin is spread over many ranges.
6. Counts of the parts of each cut are joined, scores are whole-number divisions of decimals of 38 digits, which are exact, and
   phrases inside a longer one of (nearly) the same count go. It is enough to look at those longer by one word: what holds
   for a longer one holds for each phrase between.

Nothing but the sample of at most `SAMPLE` keys, which only decides about the balance of ranges, and numbers reach the driver.

Cases: null and empty texts have no words; a null language is `und`. Documents are not named, so repeated rows count each time. Words may
hold any other characters, control characters included; bytes that are no UTF-8 count as U+FFFD. Very long texts are chunks of their own. Ties in score and
count go by the phrase's bytes. Empty tables, and tables without frequent words, give an empty result. Other columns
take no part. Products must stay below 10**38: 1000 * a * n and l * r do up to 10**17 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (as pa.compute)
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.distinct import distinct, hashes, spread
from newsloom.llm.exchange import MB, removed, size_of, workspace
from newsloom.llm.tokens import LOWER, U64, mix, slices, text_buffers

SAMPLE = 1 << 17
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = SEPARATOR.copy()
BLANK[[0x20, 0x09]] = True


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and which of them begin a piece."""
    inside = ~BLANK[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    full = offsets[1:] > offsets[:-1]
    before[offsets[:-1][full]] = False
    after[offsets[1:][full] - 1] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    cuts = np.concatenate([[0], np.cumsum(SEPARATOR[raw])])
    new = np.ones(len(start), bool)
    new[1:] = cuts[start[1:]] > cuts[end[:-1]]
    first = np.searchsorted(start, offsets[:-1])
    new[first[first < len(start)]] = True
    return start, end, new


class Keys:
    """Fixed-width keys of up to `longest` ids below `ids`, as big-endian 64-bit limbs or as bytes; their order is that of the ids."""

    def __init__(self, ids: int, longest: int) -> None:
        self.bits, self.longest = max(1, ids.bit_length()), longest
        self.limbs = -(-self.bits * longest // 64)
        self.width = -(-self.bits * longest // 8)

    def packed(self, fields: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((self.limbs, len(fields[0])), U64)
        for j, x in enumerate(fields):
            limb, at = divmod(j * self.bits, 64)
            over = at + self.bits - 64
            x = x.astype(U64)
            if over <= 0:
                out[limb] |= x << U64(-over)
            else:
                out[limb] |= x >> U64(over)
                out[limb + 1] |= x << U64(64 - over)
        return out

    def field(self, keys: np.ndarray, j: int) -> np.ndarray:
        limb, at = divmod(j * self.bits, 64)
        over, mask = at + self.bits - 64, U64((1 << self.bits) - 1)
        x = keys[limb] >> U64(-over) if over <= 0 else keys[limb] << U64(over) | keys[limb + 1] >> U64(64 - over)
        return x & mask

    def prefix(self, keys: np.ndarray, m: int) -> np.ndarray:
        """Keys with only their first m fields."""
        whole = ((1 << m * self.bits) - 1) << (64 * self.limbs - m * self.bits)
        mask = [(whole >> 64 * (self.limbs - 1 - k)) & ((1 << 64) - 1) for k in range(self.limbs)]
        return keys & np.array(mask, U64)[:, None]

    def to_bytes(self, keys: np.ndarray) -> bytes:
        return keys.astype(">u8").T.copy().view(np.uint8).reshape(-1, 8 * self.limbs)[:, : self.width].tobytes()

    def texts(self, keys: np.ndarray) -> np.ndarray:
        """Keys as strings of bytes, which compare like their ids."""
        return np.frombuffer(self.to_bytes(keys), f"S{self.width}")

    def from_bytes(self, value: bytes) -> np.ndarray:
        rows = np.frombuffer(value, np.uint8).reshape(-1, self.width)
        out = np.zeros((len(rows), 8 * self.limbs), np.uint8)
        out[:, : self.width] = rows
        return out.view(">u8").astype(U64).T.copy()

    def to_planes(self, keys: np.ndarray) -> bytes:
        """Keys by places of their bytes: sorted ones share their first bytes, so these compress to almost nothing."""
        return np.frombuffer(self.to_bytes(keys), np.uint8).reshape(-1, self.width).T.tobytes()

    def from_planes(self, value: bytes) -> np.ndarray:
        return self.from_bytes(np.frombuffer(value, np.uint8).reshape(self.width, -1).T.tobytes())

    def order(self, keys: np.ndarray) -> np.ndarray:
        """Radix sort: stable passes over 16 bits each, from the last that holds a field; digits that all keys share are left out."""
        out = np.arange(keys.shape[1])
        for d in range(-(-self.bits * self.longest // 16) - 1, -1, -1):
            digit = (keys[d // 4] >> U64(48 - d % 4 * 16)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                out = out[np.argsort(digit[out], kind="stable")]
        return out

    def counted(self, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct keys with their counts added up."""
        order = self.order(keys)
        keys, n = keys[:, order], n[order]
        new = np.flatnonzero(changes(keys))
        return keys[:, new], np.add.reduceat(n, new) if len(new) else n


def changes(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys differ from the one before."""
    new = np.ones(keys.shape[1], bool)
    new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
    return new


def linked(ids: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Places where a frequent word has a frequent word behind it in its piece."""
    out = np.zeros(len(ids), bool)
    out[:-1] = (ids[:-1] > 0) & (ids[1:] > 0) & ~new[1:]
    return out


def windows(ids: np.ndarray, link: np.ndarray, longest: int) -> list[np.ndarray]:
    """Fields of the window at each linked place: ids of the words as far as links go, and 0 from there on."""
    at = np.flatnonzero(link)
    fields, on = [ids[at]], np.ones(len(at), bool)
    for j in range(1, longest):
        on = on & link[np.minimum(at + j - 1, len(ids) - 1)]
        fields.append(np.where(on, ids[np.minimum(at + j, len(ids) - 1)], 0))
    return fields


def pair_hashes(ids: np.ndarray, link: np.ndarray) -> np.ndarray:
    """32-bit hashes of the pairs at linked places."""
    at = np.flatnonzero(link)
    return (mix(ids[at].astype(U64) << U64(32) | ids[at + 1].astype(U64)) >> U64(32)).astype(np.uint32)


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers by places of their bytes, which compresses better than one number after another."""
    return np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def numbers(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _chunks(docs: DataFrame, chunk_bytes: int, buckets: int) -> DataFrame:
    """Chunks of words: `codes` has all words of a chunk in order (twice the place in its list of distinct words, and one more where a
    piece begins), `words` what it asks a bucket of words: the words of its list that belong there, their counts and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            lang = batch["lang"].dictionary_encode()
            codes = lang.indices.to_numpy()
            for c, name in enumerate(lang.dictionary.to_pylist()):
                raw, offsets = text_buffers(batch["text"].take(pa.array(np.flatnonzero(codes == c))))
                for i, j in slices(offsets, chunk_bytes):
                    part = LOWER[raw[offsets[i] : offsets[j]]]
                    start, end, new = words_of(part, offsets[i : j + 1] - offsets[i])
                    if not len(start):
                        continue
                    first, inverse = distinct(part, start, end)
                    # Frequent words first: small numbers compress.
                    n = np.bincount(inverse, minlength=len(first))
                    order = np.argsort(-n, kind="stable")
                    place = np.empty(len(order), np.int64)
                    place[order] = np.arange(len(order))
                    rows = [("codes", number, name, -1, len(start), planes(place[inverse] << 1 | new), b"", b"", b"")]
                    h = hashes(part, start[first], end[first])
                    bucket = ((h >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)
                    order = np.argsort(bucket, kind="stable")
                    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
                    for k in np.flatnonzero(np.diff(edges)).tolist():
                        own = order[edges[k] : edges[k + 1]]
                        size = (end - start)[first[own]]
                        rows.append(("words", number, name, k, 0, part[spread(start[first[own]], size)].tobytes(), planes(size), planes(n[own]), planes(place[own])))
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, t) for (k, t), v in zip(_CHUNK.items(), zip(*rows, strict=True), strict=True)})
                    number += 1

    return docs.mapInArrow(run, CHUNK)


_CHUNK = {"kind": pa.string(), "chunk": pa.int64(), "lang": pa.string(), "bucket": pa.int32(), "n": pa.int64(), "data": pa.binary(), "sizes": pa.binary(), "counts": pa.binary(), "places": pa.binary()}
CHUNK = "kind string, chunk long, lang string, bucket int, n long, data binary, sizes binary, counts binary, places binary"
ANSWER = "kind string, chunk long, bucket int, places binary, ids binary, lang string, word string, f long, id long"
_ANSWER = {"kind": pa.string(), "chunk": pa.int64(), "bucket": pa.int32(), "places": pa.binary(), "ids": pa.binary(), "lang": pa.string(), "word": pa.string(), "f": pa.int64(), "id": pa.int64()}


def _answers(table: pa.Table, min_count: int) -> pa.Table:
    """A bucket's frequent words of each language, numbered from 0, and for each chunk the places and numbers of those that it has."""
    rows, number, bucket = [], 0, table["bucket"][0].as_py()
    for lang in dict.fromkeys(table["lang"].to_pylist()):
        own = table.filter(pa.compute.equal(table["lang"], lang))
        size = [numbers(x).astype(np.int64) for x in own["sizes"].to_pylist()]
        per, size = np.array([len(x) for x in size]), np.concatenate(size)
        raw = np.frombuffer(b"".join(own["data"].to_pylist()), np.uint8)
        end = np.cumsum(size)
        first, inverse = distinct(raw, end - size, end)
        f = np.bincount(inverse, np.concatenate([numbers(x) for x in own["counts"].to_pylist()]).astype(np.float64)).astype(np.int64)
        ids = np.full(len(first), -1)
        often = np.flatnonzero(f >= min_count)
        ids[often] = number + np.arange(len(often))
        number += len(often)
        rows += [("word", None, bucket, None, None, lang, raw[end[i] - size[i] : end[i]].tobytes().decode(), n, k) for i, n, k in zip(first[often].tolist(), f[often].tolist(), ids[often].tolist(), strict=True)]
        got, edges = ids[inverse], np.cumsum(np.append(0, per))
        for chunk, places, a, b in zip(own["chunk"].to_pylist(), own["places"].to_pylist(), edges[:-1], edges[1:], strict=True):
            hit = got[a:b] >= 0
            rows.append(("answer", chunk, bucket, planes(numbers(places)[hit]), planes(got[a:b][hit]), None, None, None, None))
    return pa.table({k: pa.array(v, t) for (k, t), v in zip(_ANSWER.items(), zip(*rows, strict=True), strict=True)})


def phrase_counts(codes: DataFrame, answers: DataFrame, bases: dict[int, int], total: int, places: int, min_count: int, longest: int, range_bytes: int, home: str) -> DataFrame:
    """ids (array<int>) and f of all phrases of 2 to `longest` frequent words with at least min_count occurrences."""
    spark, keys = codes.sparkSession, Keys(total, longest)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges, buckets = max(tasks, places * (keys.width + 4) // range_bytes + 1), max(tasks // 2, places * 4 // range_bytes + 1)
    count = codes.count()
    every = max(1, count // 64)
    per = SAMPLE // max(1, min(count, 128))
    kinds = {"kind": pa.string(), "chunk": pa.int64(), "bucket": pa.int32(), "keys": pa.binary(), "n": pa.binary()}

    def encode(key, table: pa.Table, answer: pa.Table) -> pa.Table:
        """A chunk's ids, its pairs with counts by bucket, and for every so many chunks some windows as a sample."""
        if not table.num_rows or not answer.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        code = numbers(table["data"][0].as_py()).astype(np.int64)
        new, code, chunk = (code & 1) > 0, code >> 1, table["own"][0].as_py()
        ids = np.zeros(code.max() + 1, np.int64)
        for bucket, at, own in zip(*(answer[k].to_pylist() for k in ("bucket", "places", "ids")), strict=True):
            ids[numbers(at)] = numbers(own).astype(np.int64) + bases.get(bucket, 0) + 1
        ids = ids[code]
        link = linked(ids, new)
        h, at, n = np.unique(pair_hashes(ids, link), return_inverse=True, return_counts=True)
        rows = [("ids", chunk, -1, planes(ids << 1 | new), b"")]
        edges = np.searchsorted((h.astype(np.int64) * buckets) >> 32, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(edges)).tolist():
            a, b = edges[k], edges[k + 1]
            rows.append(("pairs", chunk, k, planes(np.diff(h[a:b], prepend=np.uint32(0))), planes(n[a:b])))
        if chunk % every == 0:
            link[np.flatnonzero(link)] = n[at] > 1  # pairs seen once here are rarely frequent
            found = windows(ids, link, longest)
            some = np.arange(0, len(found[0]), len(found[0]) // per + 1)
            rows.append(("sample", chunk, -1, keys.to_bytes(keys.packed([x[some] for x in found])), b""))
        return pa.table({k: pa.array(v, t) for (k, t), v in zip(kinds.items(), zip(*rows, strict=True), strict=True)})

    if total >= 1 << 31:
        raise ValueError("more than 2**31 frequent words")
    asked = codes.select(F.col("chunk").alias("own"), "data")
    asked.groupBy("own").cogroup(answers.groupBy("chunk")).applyInArrow(encode, "kind string, chunk long, bucket int, keys binary, n binary").write.partitionBy("kind").parquet(f"{home}/encoded")
    encoded = spark.read.schema("chunk long, bucket int, keys binary, n binary, kind string").parquet(f"{home}/encoded")

    def frequent(table: pa.Table) -> pa.Table:
        """For each chunk's pairs of a bucket one bit: whether all chunks' counts together reach min_count."""
        own = [np.cumsum(numbers(x), dtype=np.uint32) for x in table["keys"].to_pylist()]
        _, at = np.unique(np.concatenate(own), return_inverse=True)
        n = np.concatenate([numbers(x) for x in table["n"].to_pylist()])
        often = (np.bincount(at, n.astype(np.float64)) >= min_count)[at]
        edges = np.cumsum([0, *map(len, own)])
        bits = [np.packbits(often[a:b]).tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    bits = encoded.filter("kind = 'pairs'").select("chunk", "bucket", "keys", "n").groupBy("bucket").applyInArrow(frequent, "chunk long, bucket int, bits binary")
    bits = bits.withColumnRenamed("chunk", "of")
    seen = keys.from_bytes(b"".join(r["keys"] for r in encoded.filter("kind = 'sample'").select("keys").limit(512).collect()))
    seen = seen[:, keys.order(seen)]
    borders = seen[:, np.unique(np.linspace(0, seen.shape[1] - 1, ranges + 1).astype(int)[1:-1])] if seen.shape[1] else seen
    borders = keys.to_bytes(borders[:, changes(borders)])

    def deal(key, table: pa.Table, answer: pa.Table) -> pa.Table:
        """A chunk's distinct windows with counts, by range."""
        schema = {"range": pa.int32(), "keys": pa.binary(), "n": pa.binary()}
        if not table.num_rows or not answer.num_rows:
            return pa.table({k: pa.array([], t) for k, t in schema.items()})
        ids = numbers(table["keys"][0].as_py()).astype(np.int64)
        new, ids = (ids & 1) > 0, ids >> 1
        link = linked(ids, new)
        h, at = np.unique(pair_hashes(ids, link), return_inverse=True)
        sizes = np.bincount((h.astype(np.int64) * buckets) >> 32, minlength=buckets)
        given = {k: v for k, v in zip(answer["bucket"].to_pylist(), answer["bits"].to_pylist(), strict=True)}
        often = np.concatenate([np.unpackbits(np.frombuffer(given[k], np.uint8), count=sizes[k]) for k in np.flatnonzero(sizes).tolist()]) > 0
        link[np.flatnonzero(link)] = often[at]
        own = keys.packed(windows(ids, link, longest))
        own, n = keys.counted(own, np.ones(own.shape[1], np.uint32))
        edges, text = np.frombuffer(borders, f"S{keys.width}"), keys.texts(own)
        at = np.concatenate([[0], np.searchsorted(text, edges, "left"), [len(text)]])
        full = np.flatnonzero(np.diff(at))
        cut = [(int(at[r]), int(at[r + 1])) for r in full]
        return pa.table({"range": pa.array(full, pa.int32()), "keys": pa.array([keys.to_planes(own[:, a:b]) for a, b in cut], pa.binary()), "n": pa.array([planes(n[a:b]) for a, b in cut], pa.binary())})

    def runs(table: pa.Table) -> pa.Table:
        """Counts of the phrases that begin a range's windows: frequent ones, and those at its borders."""
        own = np.concatenate([keys.from_planes(x) for x in table["keys"].to_pylist()], 1)
        n = np.concatenate([numbers(x) for x in table["n"].to_pylist()]).astype(np.int64)
        own, n = keys.counted(own, n)
        found, f = [], []
        for m in range(2, longest + 1):
            part = keys.prefix(own, m)
            start = np.flatnonzero(changes(part))
            sums = np.add.reduceat(n, start)
            part = part[:, start]
            keep = sums >= min_count
            keep[[0, -1]] = True
            keep &= keys.field(part, m - 1) > 0
            f.append(sums[keep])
            found += [[int(v) for v in row] for row in np.stack([keys.field(part[:, keep], j) for j in range(m)], 1)]
        return pa.table({"ids": pa.array(found, pa.list_(pa.int32())), "f": pa.array(np.concatenate(f), pa.int64())})

    ids = encoded.filter("kind = 'ids'").select("chunk", "keys")
    dealt = ids.groupBy("chunk").cogroup(bits.groupBy("of")).applyInArrow(deal, "range int, keys binary, n binary")
    found = dealt.groupBy("range").applyInArrow(runs, "ids array<int>, f long")
    return found.groupBy("ids").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count)


def collocations(docs: DataFrame, min_count: int = 100, longest: int = 5, top: int = 2000, absorb: int = 100, chunk_bytes: int = 8 * MB, range_bytes: int = 32 * MB, text: str = "text", lang: str = "lang") -> DataFrame:
    """The `top` phrases of each language by score: lang, rank (from 1), phrase, a, l, r, n, score.

    A phrase goes if a longer one that holds it has at least `absorb` hundredths of its count (at most 100). chunk_bytes
    and range_bytes bound the text of a chunk, but for a longer single text, and about the keys of a range.
    """
    spark, home = docs.sparkSession, workspace(docs.sparkSession, "collocations")
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.make_valid_utf8(f"`{text}`").alias("text"))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size_of(source.select("text")) // range_bytes + 1)
    _chunks(source, chunk_bytes, buckets).write.partitionBy("kind").parquet(f"{home}/chunks")
    chunks = spark.read.schema(CHUNK).parquet(f"{home}/chunks")
    codes = chunks.filter("kind = 'codes'").select("chunk", "lang", "n", "data")
    asked = chunks.filter("kind = 'words'").drop("kind", "n")
    asked.groupBy("bucket").applyInArrow(lambda table: _answers(table, min_count), ANSWER).write.partitionBy("kind").parquet(f"{home}/answers")
    answers = spark.read.schema(ANSWER).parquet(f"{home}/answers")
    words = answers.filter("kind = 'word'").select("bucket", "lang", "word", "f", "id")
    # A number for each bucket, which holds some megabytes of text: where its words' ids begin.
    sizes = {r["bucket"]: r["n"] for r in words.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    bases = dict(zip(sorted(sizes), np.cumsum([0, *(sizes[b] for b in sorted(sizes))]).tolist(), strict=False))
    total = sum(sizes.values())
    begin = spark.createDataFrame(list(bases.items()), "bucket int, base long")
    words.join(begin, "bucket").select("lang", "word", "f", (F.col("id") + F.col("base") + 1).alias("id")).write.parquet(f"{home}/words")
    words = spark.read.parquet(f"{home}/words")
    sizes = codes.groupBy("lang").agg(F.sum("n").alias("n"))
    places = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    given = answers.filter("kind = 'answer'").select("chunk", "bucket", "places", "ids")
    phrase_counts(codes, given, bases, total, places, min_count, longest, range_bytes, home).write.parquet(f"{home}/phrases")
    found = spark.read.parquet(f"{home}/phrases")

    # Phrases inside a longer one of the same count go.
    m = F.size("ids")
    longer = found.filter(m > 2).select("f", F.explode(F.array(F.slice("ids", F.lit(1), m - 1), F.slice("ids", F.lit(2), m - 1))).alias("ids"))
    longer = longer.groupBy("ids").agg(F.max("f").alias("longer"))
    kept = found.join(longer, "ids", "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * absorb)).select("ids", F.col("f").alias("a"))

    known = found.unionByName(words.select(F.array(F.col("id").cast("int")).alias("ids"), "f"))
    cuts = kept.select("ids", "a", F.explode(F.sequence(F.lit(1), m - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"), F.slice("ids", F.col("k") + 1, m - F.col("k")).alias("right"))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("f").alias("r")), "right")
    heads = words.select(F.col("id").cast("int").alias("head"), "lang").join(sizes, "lang")
    cuts = cuts.withColumn("head", F.col("ids")[0]).join(heads, "head")
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast(cast(cast(1000 as decimal(4, 0)) * {wide('a')} as decimal(20, 0)) * {wide('n')} as decimal(38, 0)) div cast({wide('l')} * {wide('r')} as decimal(38, 0))")
    least = cuts.withColumn("score", score).groupBy("ids", "a", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    least = least.select("ids", "a", "lang", "n", "cut.l", "cut.r", "cut.score")

    spelt = least.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select(F.col("id").cast("int").alias("id"), "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    least = least.join(spelt, "ids")
    # The best of each part of a language first, so that no task ranks all phrases of one.
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*best)
    least = least.withColumn("place", F.row_number().over(part)).filter(F.col("place") <= top).drop("place")
    least = least.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= top)
    out = least.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    result = workspace(spark, "collocations-result")
    out.write.parquet(result)
    removed(spark, home)
    return spark.read.parquet(result)


def op11_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang"))


SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL)
), places AS (
  SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM places, range(1, 6) t(m)
  WHERE i + m - 1 <= len(w)
  GROUP BY ALL
), sizes AS (
  SELECT lang, sum(f) AS n FROM grams WHERE m = 1 GROUP BY lang
), frequent AS (
  SELECT * FROM grams WHERE f >= 100
), candidates AS (
  SELECT *, string_split(phrase, ' ') AS w FROM frequent WHERE m >= 2
), inner_phrases AS (
  SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, max(f) AS f
  FROM candidates, range(2, 5) t(s), range(1, 5) u(i)
  WHERE s < m AND i + s - 1 <= m
  GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidates c LEFT JOIN inner_phrases p ON p.lang = c.lang AND p.phrase = c.phrase WHERE p.f IS NULL OR 100 * p.f < 100 * c.f
), cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, s.n, (1000::HUGEINT * c.f * s.n) // (l.f::HUGEINT * r.f) AS score
  FROM kept c CROSS JOIN range(1, 5) t(k)
  JOIN frequent l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:k], ' ')
  JOIN frequent r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[k + 1:], ' ')
  JOIN sizes s ON s.lang = c.lang
  WHERE k < c.m
), least AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS INTEGER) AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM least
)
SELECT * FROM ranked WHERE rank <= 2000
"""
