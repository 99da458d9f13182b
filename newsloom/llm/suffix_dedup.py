"""Operator 3: byte-level substring dedup by prefix-free parsing.

A `k`-byte rolling hash is a trigger where it is the least of some `width - k + 1` consecutive ones. Every string of
`width` bytes holds one that depends on the string alone, its own least (leftmost on ties): the trigger of the
string. Triggers cut a text into phrases that overlap by the trigger only, and a string is a part of phrases before
its trigger and a part of the parse from its trigger on. So strings are ordered by two short arrays in place of
one of all suffixes of the corpus:

* Dictionary: the distinct stretches of phrases that end at a trigger, as far back as a string of it can begin,
  sorted from the trigger backwards, with the common lengths of neighbours.
* Parse: the distinct stretches of phrases that begin with a trigger, as far as a string of it can end, sorted
  forwards, with the common lengths of neighbours. A string's depth is `width` bytes, some three phrases, so the
  parse's suffix array is cut there and sorted on its bytes; doubling ranks would take an exchange a step.
* Corpus order: strings that begin `o` bytes before their trigger are ordered by (rank in the dictionary at depth o,
  rank in the parse at depth width - o), where ranks of one depth come from the common lengths. Equal pairs are equal
  bytes, and take the least document of their run.

Two filters keep the arrays small, so that highly repetitive text costs no more than its distinct phrases: triggers
that stand in one document only are dropped, and of each distinct context of a trigger (all that its strings reach)
one copy is kept, with the least document that holds it. Contexts that a smaller document holds go whole, whatever
the number of their copies; they are told apart by the context's hash of 62 bits within the half hash and the
bucket of its trigger. All else is decided on bytes. Work is three exchanges (see `exchange`): triggers, contexts'
hashes, and contexts.

Cases: null or empty text: no bytes, nothing removed. A null doc_id ranks after all others; ids are whole numbers, or
text of one, and others raise an error. Rows with the same doc_id are the same age: neither takes from the other.
Texts shorter than `width` stay. An empty table gives an empty result. Other columns, of any name, travel in the
struct column `rest`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exchange import answered, by_bucket, dealt, framed, gathered, ids_of, loose, pack, packed_rows
from newsloom.llm.substring_dedup import ANSWER, RADIX, REQUEST, _repeated, member
from newsloom.llm.tokens import U64, BYTE_POWERS, marked, mix, prefix_hash, runs, sliding, slices, text_buffers

GONE, MANY = U64(1), U64(2)
LOW = U64(0xFFFFFFFF)
LAST, LAST32 = np.iinfo(np.int64).max, np.iinfo(np.int32).max


class Sorted:
    """Rows of bytes in order, and how far each agrees with the one before."""

    def __init__(self, rows: np.ndarray) -> None:
        n, width = rows.shape
        wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
        wide[:, :width] = rows
        self.order = np.lexsort(wide.view(">u8").T[::-1]) if width else np.arange(n)
        rows = rows[self.order]
        self.common = np.zeros(n, np.int64)
        for a in range(1, n, 1 << 16):
            z = min(n, a + (1 << 16))
            apart = rows[a:z] != rows[a - 1 : z - 1]
            self.common[a:z] = np.where(apart.any(1), apart.argmax(1), width) if width else 0

    def ranks(self, depth: int) -> np.ndarray:
        """A number for each row, in order, equal for rows whose first `depth` bytes are equal."""
        new = self.common < depth
        if len(new):
            new[0] = True
        out = np.empty(len(new), np.int64)
        out[self.order] = np.cumsum(new)
        return out


class Triggers:
    """Triggers of some documents: place, hash, document, and the strings [lo, hi] that start at them."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, width: int, k: int) -> None:
        n, t = len(raw), width - k + 1
        self.at = np.zeros(0, np.int64)
        if n < width:
            return
        prefix = prefix_hash(raw)
        _, down = BYTE_POWERS.get(n + 1)
        g = (prefix[k:] - prefix[:-k]) * down[: n - k + 1]
        g = (g ^ (g >> U64(29))) * U64(0xBF58476D1CE4E5B9) | U64(1)
        least = sliding(g, t, np.minimum)
        ends = offsets[1:]
        least[marked(np.maximum(np.maximum(ends - width + 1, offsets[:-1]), 0).clip(max=len(least)), ends.clip(max=len(least)), len(least))] = 0
        pad = np.zeros(t - 1, U64)
        at = np.flatnonzero(sliding(np.concatenate([pad, least, pad]), t, np.maximum) == g)
        self.at = at
        if not len(at):
            return
        g = g[at]
        self.doc = np.searchsorted(offsets, at, "right") - 1
        start, end = offsets[self.doc], offsets[self.doc + 1]
        lo, hi = np.maximum(at - t + 1, start), np.minimum(at, end - width)
        for s in range(1, len(at)):
            near = at[s:] - at[:-s] < t
            if not near.any():
                break
            i = np.flatnonzero(near & (g[:-s] <= g[s:]))
            lo[i + s] = np.maximum(lo[i + s], at[i] + 1)
            i = np.flatnonzero(near & (g[s:] < g[:-s]))
            hi[i] = np.minimum(hi[i], at[i + s] - t)
        self.lo, self.hi = lo, hi
        self.h = mix(g) & ~RADIX
        self.left, self.right = np.minimum(t - 1, at - start), np.minimum(t - 1, end - at - k)
        _, down = BYTE_POWERS.get(n + 1)
        a = at - self.left
        phrase = (prefix[at + k + self.right] - prefix[a]) * down[a]
        self.phrase = mix(phrase + (self.left * 256 + self.right).astype(U64) * U64(0x9E3779B97F4A7C15)) & ~RADIX


def _distinct(columns: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the columns (the last is the first key), and where new values of all but the first column begin."""
    order = np.lexsort(columns)
    changed = np.ones(len(order), bool)
    if len(order):
        changed[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns[1:]])
    return order, np.flatnonzero(changed)


def spread(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for a bucket and the low half of a hash, which tell a hash within all but a few."""
    return ((bucket.astype(np.uint64) << U64(32)) | (low & LOW & ~RADIX)) * U64(0x9E3779B97F4A7C15)


def halves(keys: np.ndarray) -> np.ndarray:
    """The low halves of hashes, flags included: their bucket tells most of the rest."""
    return (keys & LOW).astype(np.uint32)


def _short_repeated(table: pa.Table) -> pa.Table:
    """`_repeated` over the low halves of a bucket's hashes. What they hit by mistake is told apart later."""
    wide = lambda t, a, b: t.set_column(t.schema.get_field_index("keys"), "keys", pa.array([pack(np.frombuffer(x, a).astype(b)) for x in t["keys"].to_pylist()], pa.binary()))
    found = wide(_repeated(wide(table, np.uint32, np.uint64)), np.uint64, np.uint32)
    return found.add_column(1, "bucket", pa.array(np.full(found.num_rows, table["bucket"][0].as_py(), np.int32)))


def packed_ids(ids: np.ndarray) -> np.ndarray:
    """Ids in four bytes where all fit, the last of all kept apart."""
    own = ids[ids != LAST]
    if len(own) and (own.min() < -LAST32 or own.max() >= LAST32):
        return ids
    return np.where(ids == LAST, LAST32, ids).astype(np.int32)


def gathered_ids(table: pa.Table) -> np.ndarray:
    """The ids of packed rows, whose phrases take eight bytes each."""
    out = [np.zeros(0, np.int64)]
    for doc, phrase in zip(table["doc"].to_pylist(), table["phrase"].to_pylist(), strict=True):
        ids = np.frombuffer(doc, np.int32 if 2 * len(doc) == len(phrase) else np.int64).astype(np.int64)
        out.append(np.where(ids == LAST32, LAST, ids) if 2 * len(doc) == len(phrase) else ids)
    return np.concatenate(out)


def _first_seen(table: pa.Table) -> pa.Table:
    """A bucket of the dictionary: for each chunk's phrases, whether a smaller document of another chunk
    has them (GONE), or else whether their trigger begins other phrases too (MANY)."""
    h, phrase, doc = gathered(table, "keys", np.uint32), gathered(table, "phrase"), gathered_ids(table)
    row = np.repeat(np.arange(table.num_rows), [len(x) // 8 for x in table["phrase"].to_pylist()])
    order, new = _distinct((doc, phrase, h))
    h, phrase, doc, row = h[order], phrase[order], doc[order], row[order]
    size = np.diff(np.append(new, len(h)))
    first = np.repeat(doc[new], size)
    triggers = np.concatenate([[True], h[new][1:] != h[new][:-1]])
    kinds = np.diff(np.append(np.flatnonzero(triggers), len(new)))
    many = np.repeat(np.repeat(kinds, kinds) > 1, size)
    code = np.where(doc > first, GONE, np.where(many, MANY, U64(0)))
    order = np.argsort(row, kind="stable")
    value, borders = (phrase | code)[order], np.searchsorted(row[order], np.arange(table.num_rows + 1))
    return pa.table({"chunk": table["chunk"], "keys": pa.array([pack(value[borders[r] : borders[r + 1]]) for r in range(table.num_rows)], pa.binary())})


def substring_dedup_bytes(docs: DataFrame, width: int = 50, k: int = 16, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Remove every byte covered by a string of `width` bytes that also starts in a document of smaller id.

    Returns doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), spans (removed runs as
    struct start, end, in bytes), and rest.
    """
    if not 1 <= k < width or width - k > 62:
        raise ValueError("k must leave 1 to 62 places in a string")
    docs = framed(docs, text, doc_id)
    whole = docs.schema
    docs, _, buckets = dealt(docs)
    t = width - k + 1
    reach = 2 * (t - 1) + k

    def each(table: pa.Table):
        raw, offsets = text_buffers(table["text"])
        ids = ids_of(table)
        for i, j in slices(offsets, 1 << 17):
            part, own = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            yield i, j, part, own, ids[i:j], Triggers(part, own, width, k)

    def ask_triggers(table: pa.Table) -> pa.Table:
        h, doc = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for *_, ids, found in each(table):
            if len(found.at):
                h.append(found.h)
                doc.append(ids[found.doc])
        h, doc = np.concatenate(h), np.concatenate(doc)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        last = np.append(new[1:], len(h)) - 1 if len(h) else new
        value = h[new] | GONE | np.where(doc[last] != doc[new], MANY, U64(0))
        return packed_rows(table["chunk"][0].as_py(), value, buckets, keys=halves(value))

    def ask_phrases(table: pa.Table, answers: pa.Table) -> pa.Table:
        at = np.repeat(answers["bucket"].to_numpy(), [len(x) // 4 for x in answers["keys"].to_pylist()])
        hits = np.sort(spread(at, gathered(answers, "keys", np.uint32).astype(np.uint64)))
        h, phrase, doc = [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        if table.num_rows and len(hits):
            for *_, ids, found in each(table):
                if len(found.at):
                    i = np.flatnonzero(member(hits, spread(by_bucket(found.h, buckets)[0], found.h)))
                    h.append(found.h[i])
                    phrase.append(found.phrase[i])
                    doc.append(ids[found.doc[i]])
        h, phrase, doc = np.concatenate(h), np.concatenate(phrase), np.concatenate(doc)
        order, new = _distinct((doc, phrase, h))
        i = order[new]
        return packed_rows(table["chunk"][0].as_py() if table.num_rows else 0, h[i], buckets, keys=halves(h[i]), phrase=phrase[i], doc=packed_ids(doc[i]))

    def coded(table: pa.Table, codes: np.ndarray):
        """Of each run of documents, the triggers whose phrases have a code, with it and the least document here."""
        codes = np.sort(codes)
        plain = codes & ~RADIX
        parts, seen = [], [(np.zeros(0, U64), np.zeros(0, np.int64))]
        for part in each(table):
            found = part[-1]
            i = np.flatnonzero(member(plain, found.phrase)) if len(found.at) and len(plain) else np.zeros(0, np.int64)
            code = codes[np.searchsorted(plain, found.phrase[i])] & RADIX if len(i) else np.zeros(0, U64)
            parts.append((part, i, code))
            if len(i):
                seen.append((found.phrase[i], part[-2][found.doc[i]]))
        phrase, doc = np.concatenate([x for x, _ in seen]), np.concatenate([x for _, x in seen])
        order, new = _distinct((doc, phrase))
        phrase, first = phrase[order][new], doc[order][new]
        for part, i, code in parts:
            found = part[-1]
            doc = part[-2][found.doc[i]] if len(i) else np.zeros(0, np.int64)
            least = first[np.searchsorted(phrase, found.phrase[i])] if len(i) else doc
            yield part, i, code, doc, least

    def ask_suffixes(table: pa.Table, answers: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if table.num_rows:
            for (_, _, raw, _, _, found), i, code, doc, least in coded(table, gathered(answers, "keys")):
                i, doc = i[own := np.flatnonzero((code == MANY) & (doc == least))], doc[own]
                i, doc = i[own := np.unique(found.phrase[i], return_index=True)[1]], doc[own]
                if not len(i):
                    continue
                place = np.arange(reach) - (t - 1) + found.at[i][:, None]
                inside = (np.arange(reach) >= t - 1 - found.left[i][:, None]) & (np.arange(reach) < t - 1 + k + found.right[i][:, None])
                body = np.where(inside, raw[np.where(inside, place, 0)], 0).astype(np.uint8)
                span = np.stack([found.lo[i] - found.at[i] + t - 1, found.hi[i] - found.at[i] + t - 1], 1).clip(-1, t).astype(np.int8)
                rows.append((found.h[i], found.phrase[i], doc, body, span))
        if not rows:
            rows = [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros((0, reach), np.uint8), np.zeros((0, 2), np.int8))]
        h, phrase, doc, body, span = (np.concatenate(x) for x in zip(*rows, strict=True))
        order, new = _distinct((doc, phrase, h))
        i = order[new]
        return packed_rows(table["chunk"][0].as_py() if table.num_rows else 0, h[i], buckets, phrase=phrase[i], doc=packed_ids(doc[i]), body=body[i], span=span[i])

    def sorted_suffixes(table: pa.Table) -> pa.Table:
        """Which strings of each context stand in a context of a smaller document, as bits by place."""
        phrase, doc = gathered(table, "phrase"), gathered_ids(table)
        body, span = gathered(table, "body", np.uint8).reshape(-1, reach), gathered(table, "span", np.int8).reshape(-1, 2)
        bits = np.zeros(len(phrase), U64)
        # Contexts by age, so that the first of equal ones is the oldest.
        age = np.argsort(doc, kind="stable")
        dictionary = Sorted(body[age, : t - 1][:, ::-1])
        parse = Sorted(body[age, t - 1 :])
        for before in range(t):
            place = t - 1 - before
            own = np.flatnonzero((span[age, 0] <= place) & (place <= span[age, 1]))
            if len(own) < 2:
                continue
            order = dictionary.ranks(before)[own] * (len(age) + 1) + parse.ranks(width - before)[own]
            _, first, at = np.unique(order, return_index=True, return_inverse=True)
            own = age[own]
            gone = own[doc[own] > doc[own[first]][at]]
            bits[gone] |= U64(1) << U64(place)
        ends = np.cumsum([len(x) // 8 for x in table["phrase"].to_pylist()])
        cut = lambda x: pa.array([pack(p) for p in np.split(x, ends[:-1])], pa.binary())
        return pa.table({"chunk": table["chunk"], "keys": cut(phrase), "bits": cut(bits)})

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        whole_codes = answers.filter(pa.compute.is_null(answers["bits"]))
        part_codes = answers.filter(pa.compute.is_valid(answers["bits"]))
        keys, bits = gathered(part_codes, "keys"), gathered(part_codes, "bits")
        order = np.argsort(keys)
        keys, bits = keys[order], bits[order]
        n_bytes, n_removed, kept, spans = [], [], [], []
        for (_, _, raw, offsets, _, found), i, code, doc, least in coded(table, gathered(whole_codes, "keys")):
            gone = np.zeros(len(raw), bool)
            if len(i):
                all_of = (code == GONE) | (doc > least)
                lo, hi = found.lo[i], found.hi[i]
                a = all_of & (lo <= hi)
                starts, ends = [lo[a]], [hi[a] + width]
                some = np.flatnonzero(~all_of & (code == MANY))
                if len(some) and len(keys):
                    some = some[member(keys, found.phrase[i][some])]
                    mask = bits[np.searchsorted(keys, found.phrase[i][some])]
                    base = found.at[i][some] - (t - 1)
                    for o in range(t):
                        x = base[(mask >> U64(o)) & U64(1) == 1] + o
                        starts.append(x)
                        ends.append(x + width)
                gone = marked(np.concatenate(starts), np.concatenate(ends), len(raw))
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                n_bytes.append(b - a)
                mask = gone[a:b]
                if mask.any():
                    x, y = runs(mask)
                    n_removed.append(int(mask.sum()))
                    spans.append([{"start": s, "end": e} for s, e in zip(x.tolist(), y.tolist(), strict=True)])
                    kept.append(raw[a:b][~mask].tobytes())
                else:
                    n_removed.append(0)
                    spans.append([])
                    kept.append(raw[a:b].tobytes())
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_bytes": pa.array(n_bytes, pa.int64()),
                "n_removed": pa.array(n_removed, pa.int64()),
                "n_spans": pa.array([len(x) for x in spans], pa.int64()),
                "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                "rest": loose(table["rest"]),
            }
        )

    chunked = docs.groupBy("chunk")
    hits = answered(chunked.applyInArrow(ask_triggers, REQUEST), _short_repeated, "chunk int, bucket int, keys binary")
    asked = chunked.cogroup(hits.groupBy("chunk")).applyInArrow(ask_phrases, f"{REQUEST}, phrase binary, doc binary")
    # Dealt by chunk once, for the two steps that read them.
    codes = answered(asked, _first_seen, ANSWER).repartition("chunk")
    asked = chunked.cogroup(codes.groupBy("chunk")).applyInArrow(ask_suffixes, "chunk int, bucket int, phrase binary, doc binary, body binary, span binary")
    bits = answered(asked, sorted_suffixes, f"{ANSWER}, bits binary").repartition("chunk")
    answers = codes.withColumn("bits", F.lit(None).cast("binary")).unionByName(bits)
    out = f"doc_id {whole['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary, spans array<struct<start:bigint,end:bigint>>, rest {whole['rest'].dataType.simpleString()}"
    return chunked.cogroup(answers.groupBy("chunk")).applyInArrow(remove, out)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The digest of the contract, from the operator's kept bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), parts AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, 698) AS x, least(300, length(x) // 2 - p) AS n FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2, 300)) AS p FROM d)
), windows AS (
  SELECT doc_id, p + i AS i, md5(substr(x, 2 * i - 1, 100)) AS h FROM (SELECT doc_id, p, x, unnest(range(1, least(n, length(x) // 2 - 49) + 1)) AS i FROM parts WHERE length(x) >= 100)
), first AS (
  SELECT h, min(doc_id) AS doc_id FROM windows GROUP BY h
), later AS (
  SELECT w.doc_id, w.i FROM windows w JOIN first f USING (h) WHERE f.doc_id < w.doc_id
), bytes AS (
  SELECT doc_id, p + i AS i, substr(x, 2 * i - 1, 2) AS b FROM (SELECT doc_id, p, x, unnest(range(1, n + 1)) AS i FROM parts)
), covered AS (
  SELECT b.doc_id, b.i, b.b, max(l.i IS NOT NULL) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM bytes b LEFT JOIN later l ON l.doc_id = b.doc_id AND l.i = b.i
), edges AS (
  SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS begins FROM covered
), per AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, string_agg(b, '' ORDER BY i) FILTER (NOT gone) AS kept FROM edges GROUP BY 1
)
SELECT d.doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id)
"""
