"""Operator 6: benchmark decontamination by winnowing.

Of each `width - k + 1` consecutive k-grams of words only those with the least hash are fingerprints.
A shared span of `width` words holds exactly one such run, so both sides keep the same k-gram of it:
every span that is long enough is found. Fingerprints of documents are joined with those of benchmark
items, and around each hit the windows of full width are compared, which extends the hit to the whole
shared span. Items of fewer words than `width` have one window, all their words, which has no
fingerprint of its own and is looked up by its length.

A benchmark of at most `broadcast_bytes` (ids and texts, measured) is indexed and broadcast, and documents stream
past it without a shuffle. A larger one is never sent whole: chunks of documents and of the benchmark send each
hash once to the bucket of that hash (see `exchange`), first fingerprints, then the windows around their hits and
the windows of short lengths that occur, and buckets answer with the items. Work grows with the sum of both
sides, not with their product.

Windows are compared by 64-bit hashes of mixed word hashes.

Cases: null or empty texts have no words and hit nothing, null or empty items match nothing. A
null doc_id passes through; a null item_id is reported as "null". Repeated documents are separate
rows; repeated item ids are reported once. Empty tables give empty or clean results. Other columns
of documents, of any name, travel in the struct column `rest`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exchange import MB, dealt, framed, loose, pack, settled, size_of, split
from newsloom.llm.substring_dedup import member
from newsloom.llm.tokens import LETTER_DIGIT, LOWER, U64, Words, marked, runs, sliding, slices, text_buffers

ASKED = "chunk int, bucket int, n int, keys binary"
HELD = "bucket int, n int, keys binary, items array<string>"
ANSWER = "chunk int, n int, keys binary, items array<string>"


def fingerprints(words: Words, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the k-grams that winnowing keeps."""
    n, w = len(words.h), width - k + 1
    if n < width:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    g = words.grams(k)[: n - k + 1] | U64(1)
    least = sliding(g, w, np.minimum)
    least = np.where(words.room()[: len(least)] >= width, least, U64(0))
    pad = np.zeros(w - 1, U64)
    at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), w, np.maximum) == g)
    return at, g[at]


class Windows:
    """Distinct hashes of windows, sorted, and the items of each."""

    def __init__(self, h: np.ndarray, item: np.ndarray) -> None:
        pairs = np.unique(np.stack([h, item.astype(U64)], 1), axis=0) if len(h) else np.zeros((0, 2), U64)
        self.h, first = np.unique(pairs[:, 0], return_index=True)
        self.first, self.item = np.append(first, len(pairs)), pairs[:, 1].astype(np.int64)

    def items(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For hashes that are all in here: items, and which of h each belongs to."""
        i = np.searchsorted(self.h, h)
        n = self.first[i + 1] - self.first[i]
        which = np.repeat(np.arange(len(h)), n)
        return self.item[self.first[i][which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)], which


def item_windows(ids: list[str], column: pa.Array, width: int, k: int) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Fingerprints of items, and by length n the hashes of their windows of n words with the item of each."""
    raw, offsets = text_buffers(column)
    words = Words(LOWER[raw], offsets, LETTER_DIGIT)
    owner, full = words.doc(), np.flatnonzero(words.room() >= width)
    windows = {width: (words.grams(width)[full], owner[full])} if len(full) else {}
    size = np.diff(words.first)
    for n in range(1, width):
        if len(d := np.flatnonzero(size == n)):
            windows[n] = words.grams(n)[words.first[d]], d
    return np.unique(fingerprints(words, width, k)[1]), windows


class Index:
    """Windows of the benchmark by length, with the ids of items; marks: its fingerprints, where they are at hand."""

    def __init__(self, ids: list[str], windows: dict[int, tuple[np.ndarray, np.ndarray]], width: int, k: int, marks: np.ndarray | None = None) -> None:
        self.ids, self.width, self.k, self.marks = ids, width, k, marks
        self.windows = {n: Windows(*x) for n, x in windows.items()}

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Starts and ends of occurring windows in the words, and (word, item) of each occurrence."""
        starts, ends, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        for n, windows in self.windows.items():
            if n == self.width and self.marks is not None:
                at = near(words, self.marks, self.width, self.k)
            else:
                at = np.flatnonzero(words.room() >= n)
            h = words.grams(n)[at]
            ok = member(windows.h, h)
            starts.append(at[ok])
            ends.append(at[ok] + n)
            item, which = windows.items(h[ok])
            found.append((at[ok][which], item))
        return np.concatenate(starts), np.concatenate(ends), found


def near(words: Words, marks: np.ndarray, width: int, k: int) -> np.ndarray:
    """Words where a window of full width starts that holds a fingerprint among marks."""
    at, h = fingerprints(words, width, k)
    at = at[member(marks, h)]
    return np.flatnonzero(marked(np.maximum(0, at + k - width), at + 1, len(words.h)) & (words.room() >= width)) if len(at) else at


def _parts(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, Words]]:
    raw, offsets = text_buffers(column)
    for i, j in slices(offsets):
        yield i, j, Words(LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], LETTER_DIGIT)


def _described(rows: pa.Table | pa.RecordBatch, index: Index, with_text: bool) -> dict:
    """The result's columns for some documents."""
    n_words, n_hit, hits, items = [], [], [], []
    for i, j, words in _parts(rows["text"]):
        starts, ends, found = index.hits(words)
        mask = marked(starts, ends, len(words.h))
        total = np.concatenate([[0], np.cumsum(mask)])
        count = total[words.first[1:]] - total[words.first[:-1]]
        n_words += np.diff(words.first).tolist()
        n_hit += count.tolist()
        seen: dict[int, set[str]] = {}
        for word, item in found:
            pairs = np.unique(np.stack([np.searchsorted(words.first, word, "right") - 1, item], 1), axis=0)
            for d, x in pairs.tolist():
                seen.setdefault(d, set()).add(index.ids[x])
        for d in range(j - i):
            x, y = runs(mask[words.first[d] : words.first[d + 1]]) if count[d] else ((), ())
            hits.append([{"start": int(a), "end": int(b)} for a, b in zip(x, y, strict=True)])
            items.append(sorted(seen.get(d, ())))
    out = {"doc_id": rows["doc_id"], "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "n_items": pa.array([len(x) for x in items], pa.int64())}
    out |= {"hits": pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(items, pa.list_(pa.string()))}
    return out | ({"text": rows["text"], "rest": loose(rows["rest"])} if with_text else {})


def _sent(chunk: int, asked: dict[int, np.ndarray], buckets: int) -> pa.Table:
    """Each hash of a chunk once, by length and bucket."""
    rows = []
    for n, h in asked.items():
        h = np.unique(h)
        borders = split(h, buckets)
        rows += [{"chunk": chunk, "bucket": int(b), "n": n, "keys": pack(h[borders[b] : borders[b + 1]])} for b in np.flatnonzero(np.diff(borders))]
    return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary())]))


def _joined(docs: DataFrame, benchmark: DataFrame, size: int, width: int, k: int, with_text: bool, schema: str) -> DataFrame:
    """Documents and a benchmark of any size, joined on fingerprints and then on windows by shuffles."""
    docs, _, buckets = dealt(docs)
    buckets = max(buckets, size // (16 * MB) + 1)

    def hold(table: pa.Table) -> pa.Table:
        ids = table["item"].to_pylist()
        marks, windows = item_windows(ids, table["text"], width, k)
        rows = []
        for n, (h, item) in {0: (marks, None), **windows}.items():
            if item is not None:
                h, item = np.unique(np.stack([h, item.astype(U64)], 1), axis=0).T
            borders = split(h, buckets)
            for b in np.flatnonzero(np.diff(borders)):
                own = slice(borders[b], borders[b + 1])
                rows.append({"bucket": int(b), "n": n, "keys": pack(h[own]), "items": [] if item is None else [ids[x] for x in item[own].tolist()]})
        return pa.Table.from_pylist(rows, schema=pa.schema([("bucket", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("items", pa.list_(pa.string()))]))

    spread = benchmark.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(size // (8 * MB) + 1)).cast("int"))
    held = settled(spread.groupBy("part").applyInArrow(hold, HELD))
    lengths = [r["n"] for r in held.filter(f"n > 0 AND n < {width}").select("n").distinct().collect()]  # fewer than width numbers

    def ask_marks(table: pa.Table) -> pa.Table:
        return _sent(table["chunk"][0].as_py(), {0: np.concatenate([fingerprints(words, width, k)[1] for _, _, words in _parts(table["text"])])}, buckets)

    def answer(asked: pa.Table, own: pa.Table) -> pa.Table:
        """Of each chunk's hashes those that the benchmark holds, once for each item."""
        rows = []
        for n in set(asked["n"].to_pylist()):
            mine = own.filter(pa.compute.equal(own["n"], n))
            h = np.concatenate([np.frombuffer(x, U64) for x in mine["keys"].to_pylist()] or [np.zeros(0, U64)])
            order = np.argsort(h, kind="stable")
            item = np.array([x for xs in mine["items"].to_pylist() for x in xs], object)[order] if n else None
            h = h[order]
            for row in asked.filter(pa.compute.equal(asked["n"], n)).select(["chunk", "keys"]).to_pylist():
                keys = np.frombuffer(row["keys"], U64)
                a, z = np.searchsorted(h, keys, "left"), np.searchsorted(h, keys, "right")
                if not (z > a).any():
                    continue
                if n:
                    at = np.concatenate([np.arange(x, y) for x, y in zip(a[z > a], z[z > a], strict=True)])
                    rows.append({"chunk": row["chunk"], "n": n, "keys": pack(h[at]), "items": item[at].tolist()})
                else:
                    rows.append({"chunk": row["chunk"], "n": n, "keys": pack(keys[z > a]), "items": []})
        return pa.Table.from_pylist(rows, schema=pa.schema([("chunk", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("items", pa.list_(pa.string()))]))

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        marks = np.unique(np.concatenate([np.frombuffer(x, U64) for x in answers["keys"].to_pylist()] or [np.zeros(0, U64)]))
        asked = {n: [np.zeros(0, U64)] for n in (width, *lengths)}
        for _, _, words in _parts(table["text"]) if table.num_rows else ():
            asked[width].append(words.grams(width)[near(words, marks, width, k)])
            for n in lengths:
                asked[n].append(words.grams(n)[words.room() >= n])
        return _sent(table["chunk"][0].as_py() if table.num_rows else 0, {n: np.concatenate(h) for n, h in asked.items()}, buckets)

    def describe(table: pa.Table, answers: pa.Table) -> pa.Table:
        ids = sorted({x for xs in answers["items"].to_pylist() for x in xs})
        number = {x: i for i, x in enumerate(ids)}
        windows: dict[int, list] = {}
        for row in answers.to_pylist():
            windows.setdefault(row["n"], []).append((np.frombuffer(row["keys"], U64), np.array([number[x] for x in row["items"]], np.int64)))
        whole = {n: (np.concatenate([h for h, _ in x]), np.concatenate([i for _, i in x])) for n, x in windows.items()}
        return pa.table(_described(table, Index(ids, whole, width, k), with_text))

    chunked, by_bucket = docs.groupBy("chunk"), held.groupBy("bucket")
    marks = chunked.applyInArrow(ask_marks, ASKED).groupBy("bucket").cogroup(by_bucket).applyInArrow(lambda a, b: answer(a, b.filter(pa.compute.equal(b["n"], 0))), ANSWER)
    asked = chunked.cogroup(marks.groupBy("chunk")).applyInArrow(ask_windows, ASKED)
    found = asked.groupBy("bucket").cogroup(by_bucket).applyInArrow(answer, ANSWER)
    return chunked.cogroup(found.groupBy("chunk")).applyInArrow(describe, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5, broadcast_bytes: int = 8 * MB, with_text: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Mark the words of documents that lie in any occurrence of a window of a benchmark item.

    Returns doc_id, n_words, n_hit, n_items, hits (maximal runs of hit words), items (their ids as
    sorted strings) and, unless with_text is false, text and rest. broadcast_bytes bounds what is sent to all tasks.
    """
    if not 1 <= k <= width:
        raise ValueError("k must be 1 to width")
    spark = docs.sparkSession
    docs = framed(docs, text, doc_id)
    own, rest = docs.schema["doc_id"].dataType.simpleString(), docs.schema["rest"].dataType.simpleString()
    schema = f"doc_id {own}, n_words bigint, n_hit bigint, n_items bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>" + (f", text string, rest {rest}" if with_text else "")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    size = size_of(items)
    # A row costs a few words beyond its bytes, so many short items are not taken for a small benchmark.
    if size + 64 * items.count() > broadcast_bytes:
        return _joined(docs, items, size, width, k, with_text, schema)
    small = items.toArrow()
    ids = small["item"].to_pylist()
    marks, windows = item_windows(ids, small["text"], width, k)
    sent = spark.sparkContext.broadcast(Index(ids, windows, width, k, marks))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(_described(batch, sent.value, with_text))

    return docs.mapInArrow(describe, schema)


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """The digest of the contract, from the operator's hits and items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), with_text=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), b AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), bw AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS x
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS x
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)
), hits AS (
  SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.x = bw.x
), words AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS j FROM hits
), per AS (
  SELECT doc_id, count(*) AS n_hit FROM words GROUP BY 1
), items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS list FROM hits GROUP BY 1
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN items USING (doc_id)
"""
