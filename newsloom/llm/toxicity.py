"""Operator 8: toxicity by nearest labelled examples under exact TF-IDF cosine, with a block-max inverted index.

Terms are whole words, lower-cased. All terms of a bounded sample of labelled rows are indexed, and norms
run over all of them; a term's weight is (1 + ln tf) * idf * factor, where the factor grows with the
evidence that the term marks label 1 (see `factors`) and is 1 for others. Document frequencies are counted
over all documents. A term that no example has adds nothing to a product and is counted in the norm of a
text as a term of one document.

The index: examples are put in an order that keeps like ones together and cut into blocks of `BLOCK`. Terms that
few examples have are lists of examples, and what they add to a product is summed exactly. Of a common term the
index holds each block's largest weight: that sum's largest value in a block and the maxima of a text's common terms
bound its product with every example of the block. Blocks are opened from the highest bound downwards and the common
terms of their examples added, until the next bound is under the k-th best score; what may be among the best is
scored in 64 bits, so the neighbours are those of a full scan. Examples with the same terms and counts are one row of
the index. The k nearest examples vote by similarity, exact copies most, against the share of label 1 in the sample.

Every example has a class of its own to speak for, so the evidence (id, similarity and label of all k voters,
nearest first) is returned with the score.

The sample has at most `bound` rows and `bound_bytes` of text, in the order of a hash of the id: that bounds the
index, which is built on the driver and broadcast. What it leaves out are ids beyond the bound, more than a few
different texts of one id, and texts that don't fit into what is left of the bytes (`labelled_sample`).

Cases: null and empty texts, and texts without a term of any example, get the prior. Without labels all
get 0.5. A null doc_id counts as the empty text for held_out. Ids are whole numbers, or text of one; other ids of
labelled rows raise an error. Equal similarities rank by smaller doc_id. An empty table gives an empty result.
Other columns, of any name, travel in the struct column `rest`.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exchange import MB, framed, loose
from newsloom.llm.labelled import labelled_sample, remainder
from newsloom.llm.tokens import LETTER_DIGIT, LOWER, U64, Words, mix, slices, text_buffers

#: Examples in a block of the index, and dimensions in which examples are ordered.
BLOCK, SKETCH = 16, 64
#: Terms that at least one in so many examples has are common: a matrix serves them faster than lists do.
OFTEN = 16
CHANCE = 2.0


def term_counts(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs i to j of documents: (i, j, document from i, term, count), sorted by document and term."""
    raw, offsets = text_buffers(column)
    for i, j in slices(offsets):
        words = Words(LOWER[raw[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], LETTER_DIGIT)
        term, at = np.unique(words.h, return_inverse=True)
        key = np.sort(words.doc() * max(1, len(term)) + at)
        new = np.flatnonzero(np.diff(key, prepend=-1))
        doc, at = np.divmod(key[new], max(1, len(term)))
        yield i, j, doc, term[at], np.diff(np.append(new, len(key)))


def places(vocabulary: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Place of each term in the sorted vocabulary, -1 for others."""
    if not len(vocabulary):
        return np.full(len(terms), -1)
    at = np.minimum(np.searchsorted(vocabulary, terms), len(vocabulary) - 1)
    return np.where(vocabulary[at] == terms, at, -1)


def factors(a: np.ndarray, n: np.ndarray, base: float) -> np.ndarray:
    """Weight of terms in n examples, a of them of label 1: sqrt(1 + evidence), in nats of a binomial
    likelihood ratio beyond the `CHANCE` that a rare term has without meaning anything, where label 1 is more common
    than its share `base`; 1 elsewhere."""
    if not 0 < base < 1:
        return np.ones(len(n))
    share = a / np.maximum(n, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = n * (share * np.log(share / base) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - base)), 0))
    return np.where(share > base, np.sqrt(1 + np.maximum(apart - CHANCE, 0)), 1.0)


def alike(x: np.ndarray, size: int) -> np.ndarray:
    """An order of the rows that keeps like ones together: halves along the main direction, down to so many rows."""
    out, stack = [], [np.arange(len(x))]
    while stack:
        rows = stack.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        z = x[rows] - x[rows].mean(0)
        direction = z[np.abs(z).sum(1).argmax()]
        for _ in range(6):
            direction = z.T @ (z @ direction)
            direction = direction / max(np.linalg.norm(direction), 1e-12)
        order = rows[np.argsort(z @ direction, kind="stable")]
        # Halves of whole blocks, so that all blocks but the last are full.
        middle = max(1, (len(rows) // size + 1) // 2) * size
        stack += [order[middle:], order[:middle]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


class Index:
    """Labelled examples by term: all terms of all examples.

    first, place, count: terms of each distinct example, by place in the vocabulary; of: the distinct example
    of each example. What `nearest` needs beyond that is made where it is first used, not sent.
    """

    def __init__(self, ids: np.ndarray, labels: np.ndarray, of: np.ndarray, first: np.ndarray, place: np.ndarray, count: np.ndarray, vocabulary: np.ndarray) -> None:
        order = np.lexsort((ids, of))
        self.ids, self.labels, self.rows = ids[order], labels[order], np.searchsorted(of[order], np.arange(len(first)))
        self.first, self.place, self.count, self.vocabulary = first, place, count, vocabulary
        self.prior = float(labels.mean()) if len(labels) else 0.5
        self.weight, self.dense = np.ones(len(vocabulary)), None

    def weigh(self, frequency: np.ndarray, number: int) -> None:
        """Term weights from document frequencies and from the labels of distinct examples."""
        size = np.diff(self.first)
        # A distinct example has the label that most of its copies have.
        share = np.add.reduceat(self.labels, self.rows[:-1]) / np.diff(self.rows) if len(size) else np.zeros(0)
        toxic = share >= 0.5
        n = np.bincount(self.place, minlength=len(self.vocabulary)).astype(float)
        a = np.bincount(self.place[np.repeat(toxic, size)], minlength=len(self.vocabulary)).astype(float)
        idf = np.log((1 + number) / (1 + frequency)) + 1
        self.weight = idf * factors(a, n, float(toxic.mean()) if len(toxic) else 0.0)

    def open(self, common: int | None = None) -> None:
        """Unit weights by example: a matrix with block maxima for the commonest terms (those in one of `OFTEN` examples, at
        least 512 and at most 2,048 of them, as far as there are), lists of examples for others."""
        n, terms = len(self.first) - 1, len(self.vocabulary)
        w = self.raw(self.place, self.count)
        example = np.repeat(np.arange(n), np.diff(self.first))
        self.unit = w / np.sqrt(np.bincount(example, w * w, n))[example]
        # Like examples share a block: their order follows a projection of their vectors to a few dimensions.
        sign = mix(self.vocabulary)
        sketch = np.zeros((n, SKETCH))
        np.add.at(sketch, (example, (sign % U64(SKETCH)).astype(np.int64)[self.place]), self.unit * np.where(sign >> U64(63), 1.0, -1.0)[self.place])
        self.order = alike(sketch, BLOCK)
        size = np.diff(self.first)[self.order]
        take = np.repeat(self.first[:-1][self.order] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        # Numbered by frequency here, so that the commonest terms are the first numbers.
        self.rank = np.empty(terms, np.int32)
        times = np.bincount(self.place, minlength=terms)
        self.rank[np.argsort(-times, kind="stable")] = np.arange(terms)
        term, unit, row = self.rank[self.place[take]], self.unit[take], np.repeat(np.arange(n, dtype=np.int32), size)
        if common is None:
            common = min(max(512, int((times * OFTEN >= n).sum())), 2048)
        self.blocks, common = -(-n // BLOCK), min(common, terms)
        often = term < common
        # Common terms by example, with the largest weight of each block rounded up, so that a bound in 32 bits stays one.
        self.at = np.concatenate([[0], np.cumsum(np.bincount(row[often], minlength=n))])
        self.term, self.unit = term[often], unit[often]
        self.dense = np.zeros((self.blocks * BLOCK, common), np.float32)
        self.dense[row[often], self.term] = self.unit
        self.top = self.dense.reshape(self.blocks, BLOCK, common).max(1) * np.float32(1 + 1e-6)
        # Other terms have lists of examples.
        rest = np.flatnonzero(~often)
        rest = rest[np.argsort(term[rest], kind="stable")]
        self.holder, self.part = row[rest], unit[rest]
        self.postings = np.concatenate([[0], np.cumsum(np.bincount(term[rest], minlength=terms))])

    def raw(self, place: np.ndarray, count: np.ndarray) -> np.ndarray:
        return (1 + np.log(count)) * self.weight[place]

    def exact(self, near: np.ndarray, often: np.ndarray) -> np.ndarray:
        """Products of examples (by place in the index's order) with a query's weights of common terms, in 64 bits."""
        lo, size = self.at[near], self.at[near + 1] - self.at[near]
        take = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(np.repeat(np.arange(len(near)), size), often[self.term[take]] * self.unit[take], len(near))

    def others(self, term: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Products of every example with a query over the terms that aren't common, in 64 bits."""
        lo, size, out = self.postings[term], self.postings[term + 1] - self.postings[term], np.zeros(len(self.dense))
        for i, j in slices(np.concatenate([[0], np.cumsum(size)])):
            own = size[i:j]
            take = np.repeat(lo[i:j] - np.cumsum(own) + own, own) + np.arange(own.sum())
            out += np.bincount(self.holder[take], self.part[take] * np.repeat(w[i:j], own), len(out))
        return out

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], norms: list[float], k: int, batch: int = 128) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (places, weights): examples and similarities of the k nearest with any common term,
        nearest first."""
        if self.dense is None:
            self.open()
        self.opened, out = 0, [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        if not queries or not self.blocks:
            return out
        queries = [(self.rank[place], w / norm) for (place, w), norm in zip(queries, norms, strict=True)]
        for a in range(0, len(queries), 16 * batch):
            some = queries[a : a + 16 * batch]
            often = np.zeros((len(some), self.dense.shape[1]), np.float32)
            for i, (term, w) in enumerate(some):
                own = term < often.shape[1]
                often[i, term[own]] = w[own]
            # Queries of like bounds are answered together, as they open the same blocks.
            bound = often @ self.top.T
            order = np.argsort(bound.argmax(1), kind="stable")
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                for i, (near, sim) in zip(part.tolist(), self._search([some[i] for i in part], often[part], bound[part], k), strict=True):
                    best = self.order[near]
                    number = np.minimum(self.rows[best + 1] - self.rows[best], k)
                    rows = np.concatenate([np.arange(self.rows[x], self.rows[x] + n) for x, n in zip(best.tolist(), number.tolist(), strict=True)] or [np.zeros(0, np.int64)])
                    sims = np.repeat(sim, number)
                    first = np.lexsort((self.ids[rows], -sims))[:k]
                    out[a + i] = rows[first], sims[first]
        return out

    def _search(self, queries: list[tuple[np.ndarray, np.ndarray]], often: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query (numbers of terms, unit weights; often: those of common terms; bound: of their products by
        block) places and products of all examples that reach its k-th best product.

        What the other terms add is exact and known first, so a block's bound is its largest such sum and the bound
        of its common terms. Each query opens its blocks from high bounds downwards, in rounds, while they reach its
        k-th best product so far; queries that open the same block do so together."""
        number, each = len(queries), np.arange(len(queries))[:, None]
        rest = np.zeros((number, len(self.dense)))
        for i, (term, w) in enumerate(queries):
            own = term >= often.shape[1]
            rest[i] = self.others(term[own], w[own])
        bound = bound + rest.reshape(number, self.blocks, BLOCK).max(2).astype(np.float32)
        about = np.full((number, self.blocks, BLOCK), -1, np.float32)
        # What is computed in 32 bits is off by less than the margin; products of nothing stay exactly 0.
        edge, margin, best = np.zeros(number, np.float32), 1e-4, np.full((number, k), -1, np.float32)
        order = np.argsort(-bound, axis=1)
        a, step = 0, max(2, -(-2 * k // BLOCK))
        while a < self.blocks:
            # The third round is the last.
            mine = order[:, a : a + step if a < 8 * step else self.blocks]
            value = bound[each, mine]
            who, at = np.nonzero((value > 0) & (value >= (edge - margin)[:, None]))
            self.opened += len(who)
            block = mine[who, at]
            by = np.argsort(block, kind="stable")
            who, block = who[by], block[by]
            border = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
            for lo, hi in pairwise(border):
                asks, b = who[lo:hi], int(block[lo])
                about[asks, b] = often[asks] @ self.dense[b * BLOCK : (b + 1) * BLOCK].T + rest[asks, b * BLOCK : (b + 1) * BLOCK]
            best = np.concatenate([best, about[each, mine].reshape(number, -1)], 1)
            best = np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k :]
            edge = np.maximum(best[:, 0], 0)
            a, step = a + mine.shape[1], step * 8
        about = about.reshape(number, -1)
        for i in range(number):
            near = np.flatnonzero((about[i] > 0) & (about[i] >= edge[i] - margin))
            weight = np.zeros(often.shape[1])
            term, w = queries[i]
            own = term < len(weight)
            weight[term[own]] = w[own]
            sim = np.minimum(np.round(self.exact(near, weight) + rest[i, near], 9), 1.0)
            if len(sim) > k:
                keep = sim >= np.partition(sim, len(sim) - k)[len(sim) - k]
                near, sim = near[keep], sim[keep]
            yield near, sim

    def score(self, rows: np.ndarray, sim: np.ndarray) -> float:
        """Votes by squared similarity over distance, so that an exact copy outweighs far neighbours; half a
        vote of the prior keeps far neighbours from certainty."""
        w = sim * sim / (1.05 - sim)
        return float(((w * self.labels[rows]).sum() + 0.5 * self.prior) / (w.sum() + 0.5))


def build(rows: pa.Table) -> Index:
    """The index of rows (doc_id, label, terms, counts)."""
    ids, labels = rows["doc_id"].to_numpy().astype(np.int64), rows["label"].to_numpy().astype(np.int64)
    seen: dict[bytes, int] = {}
    of, terms, counts = np.zeros(len(ids), np.int64), [], []
    for i, (t, c) in enumerate(zip(rows["terms"], rows["counts"], strict=True)):
        t, c = t.as_buffer(), c.as_buffer()
        of[i] = seen.setdefault(blake2b(bytes(t) + bytes(c), digest_size=16).digest(), len(terms) if len(t) else -1)
        if of[i] == len(terms):
            terms.append(np.frombuffer(t, U64))
            counts.append(np.frombuffer(c, np.int32))
    first = np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int64)
    every = np.concatenate(terms or [np.zeros(0, U64)])
    vocabulary = np.unique(every)
    return Index(ids, labels, of, first, np.searchsorted(vocabulary, every).astype(np.int32), np.concatenate(counts or [np.zeros(0, np.int32)]), vocabulary)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, held: int = 0, bound: int = 8_000, bound_bytes: int = 64 * MB, k: int = 15, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted, evidence (the k nearest examples), text and rest."""
    docs = framed(docs, text, doc_id)
    sample = labelled_sample(docs, labels, label, remainder("doc_id", modulus) != held, bound, bound_bytes)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = [], []
            for i, j, doc, h, n in term_counts(batch["text"]):
                border = np.searchsorted(doc, np.arange(j - i + 1))
                terms += [h[a:b].tobytes() for a, b in zip(border[:-1], border[1:], strict=True)]
                counts += [n[a:b].astype(np.int32).tobytes() for a, b in zip(border[:-1], border[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.int64()), "label": batch["label"], "terms": pa.array(terms, pa.binary()), "counts": pa.array(counts, pa.binary())})

    rows = sample.mapInArrow(learn, "doc_id long, label int, terms binary, counts binary").toArrow().sort_by("doc_id")
    index = build(rows)
    del rows
    vocabulary = docs.sparkSession.sparkContext.broadcast(index.vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = vocabulary.value, 0
        total = np.zeros(len(known), np.int64)
        for batch in batches:
            number += batch.num_rows
            for _, _, _, h, _ in term_counts(batch["text"]):
                at = places(known, h)
                total += np.bincount(at[at >= 0], minlength=len(known))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"term": pa.array(np.append(-1, some)), "n": pa.array(np.append(number, total[some]))})

    counted = docs.select("text").mapInArrow(frequencies, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, times = counted["term"].to_numpy(), counted["n"].to_numpy()
    frequency = np.zeros(len(index.vocabulary), np.int64)
    frequency[term[term >= 0]] = times[term >= 0]
    number = int(times[term < 0].sum())
    index.weigh(frequency, number)
    # The index holds the terms of at most `bound` examples of `bound_bytes` in all: the broadcast is bounded.
    sent = docs.sparkSession.sparkContext.broadcast(index)
    # In a norm, terms that no example has count as those of one document.
    alone = float(np.log((1 + number) / 2) + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = sent.value, {}
        for batch in batches:
            scores, evidence = [], []
            for i, j, doc, h, n in term_counts(batch["text"]):
                at = places(index.vocabulary, h)
                w = (1 + np.log(n)) * np.where(at >= 0, index.weight[at] if len(index.weight) else 0.0, alone)
                norm = np.sqrt(np.bincount(doc, w * w, j - i))
                border = np.searchsorted(doc, np.arange(j - i + 1))
                if len(known) > 50_000:
                    known.clear()
                keys, new, queries, norms = [], [], [], []
                for d, (a, b) in enumerate(zip(border[:-1].tolist(), border[1:].tolist(), strict=True)):
                    own = at[a:b] >= 0
                    key = blake2b(h[a:b].tobytes() + n[a:b].tobytes(), digest_size=16).digest()
                    keys.append(key)
                    if key in known:
                        continue
                    known[key] = index.prior, []
                    if own.any():
                        new.append(key)
                        queries.append((at[a:b][own], w[a:b][own]))
                        norms.append(float(norm[d]))
                for key, (near, sim) in zip(new, index.nearest(queries, norms, k), strict=True):
                    known[key] = index.score(near, sim), [{"doc_id": int(index.ids[x]), "similarity": float(s), "label": int(index.labels[x])} for x, s in zip(near, sim, strict=True)]
                for key in keys:
                    scores.append(known[key][0])
                    evidence.append(known[key][1])
            kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(scores, pa.float64()), "evidence": pa.array(evidence, kind), "text": batch["text"], "rest": loose(batch["rest"])})

    kinds = docs.schema
    out = f"doc_id {kinds['doc_id'].dataType.simpleString()}, score double, evidence array<struct<doc_id:bigint,similarity:double,label:int>>, text string, rest {kinds['rest'].dataType.simpleString()}"
    scored = docs.mapInArrow(score, out)
    return scored.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "text", "rest")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = toxicity_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")
