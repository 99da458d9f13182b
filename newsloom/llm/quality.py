"""Operator 2: quality classifier over random-indexing word vectors.

Random indexing: each word has a sparse ternary index vector, drawn from its 64-bit hash; a word's vector is the
sum of the index vectors of its neighbours over all documents. Word shapes (case, digits and marks, with runs
collapsed) are words of a second stream.

The table that documents are pooled with is bounded. A shuffle by word counts all words and shapes; the table holds
those seen at least so often that at most `table` of them remain (the count follows from a histogram, so
about equal counts stand or fall together), each with a vector of its own. Rarer words are not left out: as
neighbours they have index vectors of their own, and they share one vector, the sum of all of theirs, as do rarer
shapes. Tasks sum the table's vectors over their documents, and a shuffle by place adds the sums up.

A document is pooled to the mean vector of its words and of their shapes, and the mean product of
neighbours' vectors, by component and in all. A two-layer network in numpy is trained on a bounded
sample of labelled rows (`bound`); a tenth of it fits the temperature that calibrates probabilities.

Cases: null and empty texts pool to zero and get the score the network gives there. Without labels of
both kinds every score is the share of label 1, or 0.5. A null doc_id counts as the empty text for
held_out. Repeated rows get equal scores; copies under one id are one example, and an id with many different texts
gives a few of them (`labelled_sample`). An empty table gives an empty result. Other columns, of any name, travel
in the struct column `rest`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.exchange import MB, framed, loose, settled, size_of
from newsloom.llm.labelled import labelled_sample, remainder
from newsloom.llm.tokens import U64, Words, mix, prefix_hash, range_hash, slices, text_buffers

DIM, SPARSE = 32, 4
#: Most words that a task counts before it sends them on.
HELD = 1 << 18
COUNTED = "part int, words binary, counts binary"
SUMMED = "part int, width int, places binary, vectors binary"

_kind = np.arange(256, dtype=np.uint8)
_kind[[*range(0x61, 0x7B), *range(0x80, 0x100)]] = 0x61
_kind[0x41:0x5B] = 0x41
_kind[0x30:0x3A] = 0x30


def index_vectors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the ternary index vector of each word."""
    h = mix(words[:, None] + np.arange(1, SPARSE + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))
    return (h % U64(DIM)).astype(np.int64), np.where(h >> U64(63), 1, -1)


def streams(raw: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """Words, and the keys of each word (even) and of its shape (odd)."""
    words = Words(raw, offsets)
    kind = _kind[raw]
    new = np.zeros(len(raw) + 1, np.int64)
    changed = np.ones(len(raw), bool)
    changed[1:] = kind[1:] != kind[:-1]
    changed[words.start] = True
    np.cumsum(changed, out=new[1:])
    shape = range_hash(prefix_hash(kind[changed]), new[words.start], new[words.end])
    return words, words.h & ~U64(1), shape | U64(1)


def added(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, in order, with the sum of its values (numbers or vectors)."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(values, new, axis=0) if len(new) else values


def _cut(keys: np.ndarray, part: np.ndarray, parts: int, **columns: np.ndarray) -> dict:
    """Packed columns of a row for each part that has any key."""
    order = np.argsort(part, kind="stable")
    border = np.searchsorted(part[order], np.arange(parts + 1))
    full = np.flatnonzero(np.diff(border))
    return {"part": pa.array(full.astype(np.int32))} | {k: pa.array([x[order[border[p] : border[p + 1]]].tobytes() for p in full], pa.binary()) for k, x in columns.items()}


def _counted(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    words, counts = [np.zeros(0, U64)], [np.zeros(0, np.int64)]

    def sent() -> pa.RecordBatch:
        w, n = added(np.concatenate(words), np.concatenate(counts))
        return pa.RecordBatch.from_pydict(_cut(w, (mix(w) % U64(parts)).astype(np.int64), parts, words=w, counts=n))

    for batch in batches:
        raw, offsets = text_buffers(batch["text"])
        for i, j in slices(offsets, 1 << 21):
            _, *both = streams(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for key in both:
                w, n = np.unique(key, return_counts=True)
                words.append(w)
                counts.append(n)
            if sum(map(len, words)) > HELD:
                w, n = added(np.concatenate(words), np.concatenate(counts))
                words[:], counts[:] = [w], [n]
                if len(w) > HELD // 2:
                    yield sent()
                    words[:], counts[:] = [w[:0]], [n[:0]]
    yield sent()


def neighbour_sums(raw: np.ndarray, offsets: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the table that some documents' words and shapes have, and the sums of their neighbours' index vectors."""
    words, *both = streams(raw, offsets)
    pair = np.flatnonzero(words.room() >= 2)
    out = []
    for key in both:
        distinct, at = np.unique(key, return_inverse=True)
        place, sign = index_vectors(distinct)
        total = np.zeros(len(distinct) * DIM)
        left, right = at[pair], at[pair + 1]
        for k in range(SPARSE):
            total += np.bincount(left * DIM + place[right, k], sign[right, k], len(total))
            total += np.bincount(right * DIM + place[left, k], sign[left, k], len(total))
        out.append((places(known, distinct), total.reshape(-1, DIM).astype(np.int64)))
    return added(*(np.concatenate(x) for x in zip(*out, strict=True)))


def places(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key among the sorted known ones; rare words and rare shapes have the two after them."""
    rare = len(known) + (keys & U64(1)).astype(np.int64)
    if not len(known):
        return rare
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, rare)


def _sums(place: np.ndarray, vectors: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of summed vectors, in 16 bits where they fit."""
    kind = np.int16 if not len(vectors) or np.abs(vectors).max() < 2**15 else np.int64
    out = _cut(place, place % parts, parts, places=place.astype(np.int32), vectors=vectors.astype(kind))
    out["width"] = pa.array([np.dtype(kind).itemsize] * len(out["part"]), pa.int32())
    return pa.RecordBatch.from_pydict({k: out[k] for k in ("part", "width", "places", "vectors")})


def _summed(batches: Iterator[pa.RecordBatch], known: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros((len(known) + 2, DIM), np.int64)
    for batch in batches:
        raw, offsets = text_buffers(batch["text"])
        for i, j in slices(offsets, 1 << 21):
            place, vectors = neighbour_sums(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], known)
            total[place] += vectors
    some = np.flatnonzero(total.any(1))
    # Words of great sums apart, so that the others still fit in 16 bits.
    wide = np.abs(total[some]).max(1) >= 2**15
    yield _sums(some[~wide], total[some[~wide]], parts)
    yield _sums(some[wide], total[some[wide]], parts)


def _vectors_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    place = [np.frombuffer(x, np.int32).astype(np.int64) for x in rows["places"].to_pylist()]
    body = [np.frombuffer(x, np.int16 if w == 2 else np.int64).reshape(-1, DIM).astype(np.int64) for x, w in zip(rows["vectors"].to_pylist(), rows["width"].to_pylist(), strict=True)]
    return added(np.concatenate([np.zeros(0, np.int64), *place]), np.concatenate([np.zeros((0, DIM), np.int64), *body]))


def _counts_of(rows: pa.Table | pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return added(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in rows["words"].to_pylist())]), np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in rows["counts"].to_pylist())]))


def _octave(counts: np.ndarray) -> np.ndarray:
    """A step of the histogram for each count: eight to a doubling."""
    return np.floor(np.log2(counts) * 8).astype(np.int64)


class Table:
    """Words in order and their unit vectors, with the vectors of rare words and of rare shapes at the end."""

    def __init__(self, words: np.ndarray, vectors: np.ndarray, rare: np.ndarray) -> None:
        self.words = words
        whole = np.concatenate([vectors, rare]).astype(np.float64)
        length = np.linalg.norm(whole, axis=1, keepdims=True)
        unit, seen = whole / np.maximum(length, 1e-9), length[:, 0] > 0
        shape = np.concatenate([(words & U64(1)).astype(bool), [False, True]])
        for part in (~shape, shape):
            if (part & seen).any():
                unit[part & seen] -= unit[part & seen].mean(0)
        self.vectors = (unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def word_vectors(docs: DataFrame, table: int = 100_000) -> Table:
    """The table of at most so many words and shapes, from all documents."""
    spark = docs.sparkSession
    texts = docs.select("text")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(tasks, size_of(texts) // (64 * MB) + 1)

    def count(rows: pa.Table) -> pa.Table:
        words, n = _counts_of(rows)
        return pa.table({"part": rows["part"][:1], "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary())})

    # All words' counts, kept in the shared folder: they grow with the vocabulary and are read twice.
    counts = settled(texts.mapInArrow(lambda b: _counted(b, parts), COUNTED).groupBy("part").applyInArrow(count, COUNTED))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step, n = np.unique(_octave(_counts_of(batch)[1]), return_counts=True)
            yield pa.RecordBatch.from_pydict({"step": step, "n": n})

    # Some hundreds of steps at most, whatever the corpus.
    histogram = counts.mapInArrow(steps, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).orderBy(F.col("step").desc()).collect()
    least, room = 1 << 62, table
    for step, n in histogram:
        if n > room:
            break
        least, room = step, room - n

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = _counts_of(batch)
            yield pa.RecordBatch.from_pydict({"words": pa.array([words[_octave(n) >= least].tobytes()], pa.binary())})

    # At most `table` words of eight bytes.
    rows = counts.mapInArrow(chosen, "words binary").toArrow()["words"].to_pylist()
    known = np.sort(np.concatenate([np.zeros(0, U64), *(np.frombuffer(x, U64) for x in rows)]))
    sent = spark.sparkContext.broadcast(known)

    def add(rows: pa.Table) -> pa.Table:
        place, vectors = _vectors_of(rows)
        return pa.Table.from_batches([_sums(place, vectors, 1)]).set_column(0, "part", rows["part"][:1])

    sums = texts.mapInArrow(lambda b: _summed(b, sent.value, tasks), SUMMED).groupBy("part").applyInArrow(add, SUMMED).toArrow()
    total = np.zeros((len(known) + 2, DIM), np.int64)
    place, vectors = _vectors_of(sums)
    total[place] = vectors
    return Table(known, total[:-2], total[-2:])


def pooled(raw: np.ndarray, offsets: np.ndarray, table: Table) -> np.ndarray:
    """A document's features: means of word and shape vectors and of products of neighbours."""
    words, *both = streams(raw, offsets)
    n = len(offsets) - 1
    count = np.diff(words.first)[:, None]
    room = words.room()
    out = []

    def mean(x: np.ndarray, number: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((n, x.shape[1]), np.float32)
        total = np.add.reduceat(np.concatenate([x, np.zeros((1, x.shape[1]), x.dtype)]), words.first[:-1], axis=0)
        return np.where(count > 0, total / np.maximum(number, 1), 0)

    for key in both:
        v = table.vectors[places(table.words, key)]
        out.append(mean(v, count))
        pair = np.zeros_like(v)
        pair[:-1] = v[:-1] * v[1:]
        pair[room < 2] = 0
        product = mean(pair, count - 1)
        out += [product, product.sum(1, keepdims=True)]
    return np.concatenate(out, 1)


class Network:
    """Two layers (rectified, then logistic) trained by Adam on standardised features, with a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 40, seed: int = 3) -> None:
        self.share = float(y.mean()) if len(y) else 0.5
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        order = rng.permutation(len(y))
        held = order[: len(y) // 10]
        held = held if len(np.unique(y[held])) == 2 else order
        fit = order[len(y) // 10 :] if len(np.unique(y[order[len(y) // 10 :]])) == 2 else order
        d = z.shape[1]
        self.w = [rng.normal(0, np.sqrt(2 / d), (d, hidden)), np.zeros(hidden), rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(p) for p in self.w], [np.zeros_like(p) for p in self.w], 0
        for _ in range(max(epochs, min(400, 40000 // len(fit)))):
            rng.shuffle(fit)
            for a in range(0, len(fit), 256):
                i = fit[a : a + 256]
                h = np.maximum(z[i] @ self.w[0] + self.w[1], 0)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w[2] + self.w[3], -30, 30)))
                g = (p - y[i]) / len(i)
                back = np.outer(g, self.w[2]) * (h > 0)
                t += 1
                for k, grad in enumerate((z[i].T @ back + 1e-4 * self.w[0], back.sum(0), h.T @ g + 1e-4 * self.w[2], g.sum(keepdims=True))):
                    m[k] += 0.1 * (grad - m[k])
                    v[k] += 0.001 * (grad * grad - v[k])
                    self.w[k] -= 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        raw, truth = self.logits(z[held]), y[held]
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
        loss = [np.logaddexp(0, np.where(truth == 1, -raw, raw) / c).mean() + 0.002 * abs(np.log(c)) for c in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-np.clip(self.logits((x - self.mean) / self.scale) / self.temperature, -700, 700)))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, held: int = 1, bound: int = 20_000, table: int = 100_000, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score (probability of label 1), predicted, text and rest of every document."""
    spark = docs.sparkSession
    docs = framed(docs, text, doc_id)
    # At most `table` words of 264 bytes, and labelled rows of about a kilobyte each, pass through the driver.
    sent = spark.sparkContext.broadcast(word_vectors(docs, table))
    sample = labelled_sample(docs, labels, label, remainder("doc_id", modulus) != held, bound)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            rows = [x.astype(np.float64).tobytes() for i, j in slices(offsets) for x in pooled(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sent.value)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"].cast(pa.string()), "label": batch["label"], "x": pa.array(rows, pa.binary())})

    rows = sorted(sample.mapInArrow(features, "doc_id string, label int, x binary").collect())
    x = np.stack([np.frombuffer(r["x"]) for r in rows]) if rows else np.zeros((0, 1))
    network = Network(x, np.array([r["label"] for r in rows], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffers(batch["text"])
            found = [network.score(pooled(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], sent.value).astype(np.float64)) for i, j in slices(offsets)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], "score": pa.array(np.concatenate(found) if found else np.zeros(0)), "text": batch["text"], "rest": loose(batch["rest"])})

    kinds = docs.schema
    scored = docs.mapInArrow(score, f"doc_id {kinds['doc_id'].dataType.simpleString()}, score double, text string, rest {kinds['rest'].dataType.simpleString()}")
    return scored.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "text", "rest")


def op2_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.select("doc_id", "held_out", "score", "predicted")
