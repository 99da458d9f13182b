"""Operator 1: substring dedup over words by fixed-block anchors.

A repeat of `width` words holds at least six aligned blocks of `block` words of the document that
serves as reference, whatever the offset. Reference blocks are indexed at fixed, non-overlapping
places; every rolling window of that length is a probe. Of each six consecutive blocks only the one
with the least hash is indexed, and probes keep the same rule in each phase, so both sides name the
same block of a shared passage while two thirds of the traffic goes. Around the hits, and only there,
windows of the full width are compared, which extends a hit to the maximal exact repeat (the union
of its repeated windows).

Both comparisons use `exchange`: a chunk sends each hash once, so copies and hot passages cost a
bucket one value a chunk and no pair of documents is ever made.

With `keep_first` the first occurrence of every repeated window (least doc_id, then least place) stays whole, and
with it each word that it covers; by itself the operator removes all occurrences. Ids must be whole numbers then,
or text of one; a null id comes after all others, and of rows with one id any may count as the first.

Cases: null or empty text: no words, nothing removed. Null doc_id: a document like any other.
Repeated rows are separate documents, so their windows count as repeated. Documents shorter than
`width` words lose nothing. An empty table gives an empty result. Other columns of the input, of any
name, travel in the struct column `rest`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exchange import answered, dealt, framed, gathered, ids_of, loose, pack, packed_rows, split
from newsloom.llm.tokens import U64, Words, marked, slices, text_buffers

ANSWER = "chunk int, keys binary"
REQUEST = "chunk int, bucket int, keys binary"
TWO, ONE = U64(2), U64(1)
RADIX = U64(3)


def _anchors(words: Words, block: int, group: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words where a kept block starts, the blocks' hashes, and which of them are reference blocks."""
    n, span = len(words.h), block * group
    if n < span:
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, bool)
    g, room = words.grams(block), words.room()
    x = n - span + 1
    least = g[:x]
    for k in range(1, group):
        least = np.minimum(least, g[block * k : block * k + x])
    inside = room[:x] >= span
    kept = np.zeros(n, bool)
    for k in range(group):
        kept[block * k : block * k + x] |= inside & (g[block * k : block * k + x] == least)
    at = np.flatnonzero(kept)
    place = at - words.first[:-1][np.searchsorted(words.first, at, "right") - 1]
    return at, g[at] & ~RADIX, place % block == 0


def member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which of x are in the sorted keys; a bit table spares most of the searches."""
    if not len(keys) or not len(x):
        return np.zeros(len(x), bool)
    bits = min(26, max(12, int(len(keys) * 8).bit_length()))
    table, shift = np.zeros(1 << bits, bool), U64(64 - bits)
    table[keys >> shift] = True
    out = table[x >> shift]
    maybe = np.flatnonzero(out)
    found = np.searchsorted(keys, x[maybe])
    found[found == len(keys)] = 0
    out[maybe] = keys[found] == x[maybe]
    return out


def _requests(chunk: int, keys: np.ndarray, flags: np.ndarray, buckets: int) -> pa.Table:
    """Each hash once, with its flags: bit 0 as given, bit 1 set if it stands in the chunk more than once."""
    order = np.argsort(keys, kind="stable")
    keys, flags = keys[order], flags[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    often = np.diff(np.append(new, len(keys))) > 1
    value = keys[new] | (np.maximum.reduceat(flags, new) if len(new) else flags).astype(U64) | (often.astype(U64) << ONE)
    borders = split(value, buckets)
    full = np.flatnonzero(np.diff(borders))
    return pa.table(
        {
            "chunk": pa.array(np.full(len(full), chunk, np.int32)),
            "bucket": pa.array(full.astype(np.int32)),
            "keys": pa.array([pack(value[borders[b] : borders[b + 1]]) for b in full], pa.binary()),
        }
    )


def _repeated(table: pa.Table) -> pa.Table:
    """A bucket's answer: of each chunk's hashes, those flagged somewhere that stand at two places at least."""
    parts = [np.frombuffer(x, U64) for x in table["keys"].to_pylist()]
    value = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.argsort(value & ~RADIX, kind="stable")
    value, row = value[order], row[order]
    h = value & ~RADIX
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    places = np.add.reduceat(ONE + ((value >> ONE) & ONE), new)
    flagged = np.maximum.reduceat(value & ONE, new)
    hit = np.repeat((places >= TWO) & (flagged == ONE), np.diff(np.append(new, len(h))))
    h, row = h[hit], row[hit]
    order = np.argsort(row, kind="stable")
    h, borders = h[order], np.searchsorted(row[order], np.arange(len(parts) + 1))
    full = np.flatnonzero(np.diff(borders))
    return pa.table({"chunk": table["chunk"].take(pa.array(full)).combine_chunks(), "keys": pa.array([pack(h[borders[r] : borders[r + 1]]) for r in full], pa.binary())})


def _first_of(keys: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key, in order, the index of its first place by document, and whether it stands at others too."""
    order = np.lexsort((place, doc, keys))
    new = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1]])) if len(order) else order
    return order[new], np.diff(np.append(new, len(order))) > 1


def _keys(answers: pa.Table) -> np.ndarray:
    found = [np.frombuffer(x, U64) for x in answers["keys"].to_pylist()]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, U64)


def _firsts(table: pa.Table) -> pa.Table:
    """As `_repeated`, where each hash comes with its first place in a chunk: bit 0 of an answer is set for the chunk
    that holds the first place of all."""
    value, doc, place = gathered(table, "keys"), gathered(table, "doc", np.int64), gathered(table, "place", np.int64)
    row = np.repeat(np.arange(table.num_rows), [len(x) // 8 for x in table["keys"].to_pylist()])
    chunk, h = table["chunk"].to_numpy()[row], value & ~RADIX
    order = np.lexsort((chunk, place, doc, h))
    h, often, row = h[order], ((value >> ONE) & ONE)[order], row[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.flatnonzero(new)
    hit = np.repeat(np.add.reduceat(ONE + often, start) >= TWO, np.diff(np.append(start, len(h))))
    answer, row = (h | new.astype(U64))[hit], row[hit]
    order = np.argsort(row, kind="stable")
    borders = np.searchsorted(row[order], np.arange(table.num_rows + 1))
    full = np.flatnonzero(np.diff(borders))
    return pa.table({"chunk": table["chunk"].take(pa.array(full)).combine_chunks(), "keys": pa.array([pack(answer[order][borders[r] : borders[r + 1]]) for r in full], pa.binary())})


def _parts(docs: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, Words]]:
    raw, offsets = text_buffers(docs["text"])
    for i, j in slices(offsets):
        part = raw[offsets[i] : offsets[j]]
        yield i, j, part, offsets[i : j + 1] - offsets[i], Words(part, offsets[i : j + 1] - offsets[i])


def substring_dedup(docs: DataFrame, width: int = 35, block: int = 5, keep_first: bool = False, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Remove every word covered by a window of `width` words that starts anywhere else too, or, with keep_first,
    somewhere before, unless the first occurrence of a window covers it.

    Returns doc_id, n_words, n_removed, kept_text (kept words joined by one space), removed
    (array of the maximal removed runs as struct start, end, in words), text as it came, and rest.
    """
    group = (width - block + 1) // block
    if group < 1:
        raise ValueError("width must be at least 2 * block - 1")
    docs = framed(docs, text, doc_id)
    whole = docs.schema
    docs, _, buckets = dealt(docs)
    id_type = whole["doc_id"].dataType.simpleString()

    def ask_blocks(table: pa.Table) -> pa.Table:
        keys, flags = [np.zeros(0, U64)], [np.zeros(0, np.uint8)]
        for *_, words in _parts(table):
            _, h, index = _anchors(words, block, group)
            keys.append(h)
            flags.append(index.astype(np.uint8))
        return _requests(table["chunk"][0].as_py(), np.concatenate(keys), np.concatenate(flags), buckets)

    def windows(table: pa.Table, hits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Hashes of the windows around hits, with the document and place of each."""
        for i, _, _, _, words in _parts(table):
            at, h, _ = _anchors(words, block, group)
            at = at[member(hits, h)]
            if len(at):
                near = np.flatnonzero(marked(np.maximum(0, at + block - width), at + 1, len(words.h)) & (words.room() >= width))
                doc = np.searchsorted(words.first, near, "right") - 1
                yield words.grams(width)[near] & ~RADIX, i + doc, near - words.first[doc]

    def ask_windows(table: pa.Table, answers: pa.Table) -> pa.Table:
        hits = _keys(answers)
        found = list(windows(table, hits)) if table.num_rows and len(hits) else []
        keys = np.concatenate([h for h, _, _ in found] or [np.zeros(0, U64)])
        chunk = table["chunk"][0].as_py() if table.num_rows else 0
        if not keep_first:
            return _requests(chunk, keys, np.ones(len(keys), np.uint8), buckets)
        place = np.concatenate([p for _, _, p in found] or [np.zeros(0, np.int64)])
        doc = ids_of(table)[np.concatenate([d for _, d, _ in found])] if found else place
        new, often = _first_of(keys, doc, place)
        return packed_rows(chunk, keys[new], buckets, keys=keys[new] | (often.astype(U64) << ONE), doc=doc[new], place=place[new])

    def kept_places(table: pa.Table, hits: np.ndarray) -> np.ndarray:
        """Of the chunk's windows whose first occurrence lies here, document and place of that, as sorted numbers."""
        own = hits[(hits & ONE) == ONE] & ~RADIX
        h, doc, place = [np.zeros(0, U64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, _, _, _, words in _parts(table) if len(own) else ():
            at = np.flatnonzero(member(own, words.grams(width) & ~RADIX) & (words.room() >= width))
            d = np.searchsorted(words.first, at, "right") - 1
            h.append(words.grams(width)[at] & ~RADIX)
            doc.append(i + d)
            place.append(at - words.first[d])
        h, doc, place = np.concatenate(h), np.concatenate(doc), np.concatenate(place)
        new, _ = _first_of(h, ids_of(table)[doc] if len(doc) else doc, place)
        return np.sort(doc[new] << 32 | place[new])

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        hits = _keys(answers)
        stay = kept_places(table, hits) if keep_first else None
        hits = np.unique(hits & ~RADIX)
        n_words, n_removed, kept, spans = [], [], [], []
        for i, j, raw, offsets, words in _parts(table):
            per = np.diff(words.first)
            if len(hits):
                start = np.flatnonzero(member(hits, words.grams(width) & ~RADIX) & (words.room() >= width))
                gone = marked(start, start + width, len(words.h))
                if keep_first and len(start):
                    doc = np.searchsorted(words.first, start, "right") - 1
                    own = start[np.isin((i + doc) << 32 | (start - words.first[doc]), stay)]
                    gone &= ~marked(own, own + width, len(words.h))
            else:
                gone = np.zeros(len(words.h), bool)
            lost = np.add.reduceat(np.append(gone, False).astype(np.int64), words.first[:-1]) if len(per) else per
            lost = np.where(per > 0, lost, 0)
            n_words += per.tolist()
            n_removed += lost.tolist()
            for d in range(j - i):
                own = raw[offsets[d] : offsets[d + 1]].tobytes().split()
                if lost[d]:
                    mask = gone[words.first[d] : words.first[d + 1]]
                    own = [own[k] for k in np.flatnonzero(~mask)]
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).reshape(-1, 2)
                    spans.append([{"start": a, "end": b} for a, b in edges.tolist()])
                else:
                    spans.append([])
                kept.append(b" ".join(own))
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(n_words, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
                "removed": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "text": table["text"],
                "rest": loose(table["rest"]),
            }
        )

    chunked = docs.groupBy("chunk")
    found = answered(chunked.applyInArrow(ask_blocks, REQUEST), _repeated, ANSWER)
    asked = chunked.cogroup(found.groupBy("chunk")).applyInArrow(ask_windows, f"{REQUEST}, doc binary, place binary" if keep_first else REQUEST)
    found = answered(asked, _firsts if keep_first else _repeated, ANSWER)
    out = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_text string, removed array<struct<start:bigint,end:bigint>>, text string, rest {whole['rest'].dataType.simpleString()}"
    return chunked.cogroup(found.groupBy("chunk")).applyInArrow(remove, out)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of the contract, from the operator's kept texts."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), flat AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), windows AS (
  SELECT doc_id, i, md5(array_to_string(list_slice(ws, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), repeated AS (
  SELECT doc_id, i FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(*) > 1)
), covered AS (
  SELECT f.doc_id, f.j, f.word, max(r.i IS NOT NULL) OVER (PARTITION BY f.doc_id ORDER BY f.j ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM flat f LEFT JOIN repeated r ON r.doc_id = f.doc_id AND r.i = f.j
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
