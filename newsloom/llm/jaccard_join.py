"""Operator 10: n-gram Jaccard join by MinHash banding.

Documents are sets of `n` consecutive words. Documents with the same set are one class and go on as
one row with a count. Band and row counts of the MinHash signature follow from the threshold and the
recall wanted there. Bands are shuffled on their hashes; what shares one is a candidate, and
candidates are verified on their full n-gram sets, together in a block:

* a block is a connected part of the candidates (found over (hash, least member) stars, never over
  pairs), so each set travels once;
* a part of more than `limit` classes, or more than `grams` n-grams, is verified band by band instead, and a band
  hash beyond these in tiles of two slices each; a pair counts in its first common band only. So a task holds at most
  twice that of a block, but for a text that is longer alone.

Within a block, common n-grams are counted by inverted lists or, in larger blocks, matrix products.
A task returns counts and one link to a root per class, never pairs.

Cases: null and empty texts have no words and equal each other. Texts of fewer than n words have one
n-gram, all their words. Null ids stay null and are never the id of a class that has another.
Repeated rows are documents of one class. Other columns are left out; join them by doc_id. An empty
table gives an empty result. Ids are whole numbers, or text of one; others raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import components
from newsloom.llm.exchange import dealt, settled
from newsloom.llm.tokens import U64, Words, mix, slices, text_buffers


#: Rows of a block's product whose pairs are looked at together.
SLAB = 256


def banding(threshold: float, recall: float, hashes: int = 192) -> tuple[int, int]:
    """Bands and rows a band: the most rows whose bands for that recall at the threshold fit in so many hashes."""
    best = (hashes, 1)
    for rows in range(1, hashes + 1):
        chance = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log1p(-chance)) if chance < 1 else 1
        if bands * rows > hashes:
            break
        best = (bands, rows)
    return best


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of each document, sorted, and the document each belongs to."""
    words = Words(raw, offsets)
    room, own = words.room(), words.doc()
    full = np.flatnonzero(room >= n)
    h, doc = [words.grams(n)[full]], [own[full]]
    size = np.diff(words.first)
    for few in range(1, n):
        if len(d := np.flatnonzero(size == few)):
            h.append(words.grams(few)[words.first[d]])
            doc.append(d)
    h, doc = np.concatenate(h), np.concatenate(doc)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], doc[keep]


def sketches(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, row (hash of the row), node (hash of its n-gram set), grams (their number) and its band hashes."""
    rng = np.random.default_rng(5)
    factor = rng.integers(1, 2**63, (bands * rows, 1), dtype=np.uint64) * U64(2) + U64(1)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))[:, None]
    place = (rng.integers(1, 2**63, (1, rows), dtype=np.uint64) * U64(2) + U64(1)).astype(U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            node, keys, size = [], [], []
            for i, j in slices(offsets):
                h, doc = shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                first = np.searchsorted(doc, np.arange(j - i + 1))
                size.append(np.diff(first))
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h ^ U64(0x5851F42D4C957F2D)))])
                node.append(mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(U64)))
                for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    if a == b:
                        keys.append(None)
                        continue
                    least = (factor * h[a : min(b, a + 4096)]).min(1)
                    for c in range(a + 4096, b, 4096):
                        least = np.minimum(least, (factor * h[c : min(b, c + 4096)]).min(1))
                    keys.append(mix((mix(least).reshape(bands, rows) * place).sum(1, dtype=np.uint64)[:, None] + salt)[:, 0].view(np.int64))
            node = np.concatenate(node) if node else np.zeros(0, U64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "row": batch["row"], "node": pa.array(node.view(np.int64)), "grams": pa.array(np.concatenate(size) if size else np.zeros(0, np.int64)), "keys": pa.array(keys, pa.list_(pa.int64()))})

    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row")).mapInArrow(run, "doc_id long, row long, node long, grams long, keys array<bigint>")


def _common(block: np.ndarray, owner: np.ndarray, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, common n-grams) of rows i < j of one block that share any; owner and h: n-grams by row."""
    rows = len(block)
    size = np.bincount(np.unique(block, return_inverse=True)[1])[np.unique(block, return_inverse=True)[1]] if rows else block
    small = size[owner] <= 16
    order = np.lexsort((owner[small], h[small], block[owner[small]]))
    o, x = owner[small][order], h[small][order]
    b = block[o]
    pairs = []
    for k in range(1, 16):
        same = np.flatnonzero((x[k:] == x[:-k]) & (b[k:] == b[:-k])) if len(x) > k else np.zeros(0, np.int64)
        if not len(same):
            break
        pairs.append(o[same] * rows + o[same + k])
    if pairs:
        code, count = np.unique(np.concatenate(pairs), return_counts=True)
        yield code // rows, code % rows, count
    for one in np.unique(block[size > 16]):
        mine = np.flatnonzero(block == one)
        at = np.isin(owner, mine)
        _, column, often = np.unique(h[at], return_inverse=True, return_counts=True)
        row = np.searchsorted(mine, owner[at])
        shared = often[column] > 1
        rank = np.cumsum(often > 1) - 1
        row, column, wide = row[shared], rank[column[shared]], int((often > 1).sum())
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        total = np.zeros((len(mine), len(mine)), np.float32)
        step = 2048
        for c in range(0, wide, step):
            a, z = np.searchsorted(column, [c, c + step])
            m = np.zeros((len(mine), min(step, wide - c)), np.float32)
            m[row[a:z], column[a:z] - c] = 1
            total += m @ m.T
        # Pairs come in slabs of rows, so that a block whose rows all share something makes no list of all its pairs.
        for a in range(0, len(mine), SLAB):
            slab = np.triu(total[a : a + SLAB], a + 1)
            i, j = np.nonzero(slab)
            yield mine[a + i], mine[j], slab[i, j].astype(np.int64)


def _roots(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least of the n rows that each is linked to over any way along the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def jaccard_join(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, limit: int = 2048, grams: int = 4_000_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row a document: doc_id, class_id (least doc_id of all that are linked to it over any way),
    n_links (other documents of similarity >= threshold), copies (documents of the same n-gram set), row (the hash
    xxhash64 of id and text, which tells rows of one id apart)."""
    bands, rows = banding(threshold, recall)
    docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    _, groups, _ = dealt(docs)
    sketch = settled(sketches(docs, n, bands, rows))
    nodes = sketch.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("rep"), F.count("*").alias("copies"), F.max("grams").alias("grams"), F.first("keys", True).alias("keys"))
    nodes = nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("row"), "copies", "grams", "keys")
    every = nodes.select("node", "grams", F.posexplode("keys").alias("band", "key"))
    hashes = every.groupBy("key").agg(F.count("*").alias("n"), F.sum("grams").alias("sum"), F.min("node").alias("least")).filter("n > 1")
    tiles = F.greatest(F.ceil(F.col("n") / limit), F.ceil(F.col("sum") / grams)).cast("int").alias("tiles")
    shared = settled(every.join(hashes, "key").select("node", "band", "key", tiles, "least"))
    parts = components(shared.select(F.col("node").alias("u"), F.col("least").alias("v")))
    parts = parts.join(nodes.select("node", "grams"), "node")
    sizes = parts.groupBy("root").agg(((F.count("*") > limit) | (F.sum("grams") > grams)).alias("wide"))
    parts = settled(parts.join(sizes, "root").select("node", "root", "wide"))
    wide = parts.filter("wide")
    none = F.lit(None).cast("int")
    blocks = parts.filter("not wide").select("node", F.col("root").alias("block"), none.alias("band"), none.alias("tile"), F.lit(False).alias("cross"))
    many = bool(wide.limit(1).count())
    if many:
        tile = F.pmod(F.xxhash64("node", F.lit(9)), F.col("tiles")).cast("int")
        by_band = shared.join(wide.select("node"), "node", "left_semi").select("node", "band", "key", tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
        pair = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
        blocks = blocks.unionByName(by_band.select("node", pair.alias("block"), "band", "tile", (F.col("tile") != F.col("other")).alias("cross")))
    held = nodes.join(blocks, "node").select("node", "rep", "row", "copies", F.when(F.col("band").isNotNull(), F.col("keys")).alias("keys"), "block", "band", "tile", "cross")
    held = held.join(docs.select(F.xxhash64("doc_id", "text").alias("row"), "text"), "row").drop("row")
    if many:
        # Slices of wide parts travel once a tile, so the tasks follow what is sent, not what came in.
        groups = max(groups, int(blocks.join(nodes.select("node", "grams"), "node").agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]) // grams + 1)
    held = held.withColumn("grp", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))

    def verify(table: pa.Table) -> pa.Table:
        block, node = table["block"].to_numpy(), table["node"].to_numpy()
        once = np.unique(np.stack([block, node], 1), axis=0, return_index=True)[1] if len(node) else np.zeros(0, np.int64)
        table = table.take(pa.array(once))
        block, node, copies = table["block"].to_numpy(), table["node"].to_numpy(), table["copies"].to_numpy()
        rep = table["rep"].fill_null(np.iinfo(np.int64).max).to_numpy()
        band, tile, cross = table["band"].fill_null(-1).to_numpy(), table["tile"].fill_null(0).to_numpy(), table["cross"].to_numpy()
        raw, offsets = text_buffers(table["text"])
        parts = [(h, d + i) for i, j in slices(offsets) for h, d in [shingles(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)]]
        h, owner = np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])
        size = np.bincount(owner, minlength=len(node))
        links = np.zeros(len(node), np.int64)
        own = np.array([x or [0] * bands for x in table["keys"].to_pylist()], np.int64) if (band >= 0).any() else None
        us, vs = [], []
        for i, j, common in _common(block, owner, h):
            ok = common >= threshold * (size[i] + size[j] - common) - 1e-9
            ok &= ~cross[i] | (tile[i] != tile[j])
            i, j = i[ok], j[ok]
            # Of the pairs only a link to a root stays for each row.
            label = _roots(i, j, len(node))
            us.append(np.flatnonzero(label != np.arange(len(node))))
            vs.append(label[us[-1]])
            if own is not None and len(i) and (band[i] >= 0).any():
                first = np.concatenate([(own[i[a : a + 65536]] == own[j[a : a + 65536]]).argmax(1) for a in range(0, len(i), 65536)])
                counted = (band[i] < 0) | (first == band[i])
                i, j = i[counted], j[counted]
            links += np.bincount(i, copies[j], len(node)).astype(np.int64) + np.bincount(j, copies[i], len(node)).astype(np.int64)
        label = _roots(*(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs)), len(node))
        first = np.full(len(node), np.iinfo(np.int64).max)
        np.minimum.at(first, label, rep)
        first = first[label]
        return pa.table({"node": node, "links": links, "root": node[label], "first": pa.array(first, mask=first == np.iinfo(np.int64).max), "alone": band < 0})

    found = held.groupBy("grp").applyInArrow(verify, "node long, links long, root long, first long, alone boolean")
    if many:
        found = settled(found)
        rest = found.filter("not alone")
        joined = components(rest.select(F.col("node").alias("u"), F.col("root").alias("v")))
        firsts = rest.join(joined.withColumnRenamed("root", "top"), "node", "left").select("node", "links", "first", F.coalesce("top", "node").alias("top"))
        whole = firsts.groupBy("top").agg(F.min("first").alias("first"))
        counts = firsts.groupBy("node", "top").agg(F.sum("links").alias("links")).join(whole, "top").select("node", "links", "first")
        found = found.filter("alone").select("node", "links", "first").unionByName(counts)
    table = nodes.select("node", "rep", "copies").join(found.select("node", "links", "first"), "node", "left")
    table = table.select("node", "copies", F.coalesce("first", "rep").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    return sketch.select("doc_id", "row", "node").join(table, "node").select("doc_id", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), "copies", "row")


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("row")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY 1
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
  UNION ALL
  SELECT a.doc_id, b.doc_id FROM w a JOIN w b ON len(a.ws) = 0 AND len(b.ws) = 0 AND a.doc_id <> b.doc_id
), copies AS (
  SELECT doc_id, count(*) OVER (PARTITION BY (SELECT md5(string_agg(g, chr(10) ORDER BY g)) FROM grams WHERE grams.doc_id = w.doc_id)) AS copies FROM w
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, (SELECT min(b) FROM reach WHERE a = w.doc_id) AS class_id, (SELECT count(*) FROM links WHERE a = w.doc_id) AS n_links, copies FROM w JOIN copies USING (doc_id)
"""
