"""Embedding of texts of any length by a model that takes short ones, and of what surrounds keywords in them.

Texts are cut into overlapping parts, parts are dealt to tasks by key and number, so that a long text is the work
of many, and parts' vectors are averaged by an aggregate that combines before its shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.automaton import automaton
from newsloom.operators.vectors import DEFINITIONS

#: Parts in a call of a model.
BATCH = 64


class Refused(Exception):
    """Raised by a model for texts that it doesn't take, as they are too long."""


Model = Callable[[list[str]], list[list[float]]]


def _columns(rows: DataFrame, *names: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names)


def text_parts(rows: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """(key, part, text): texts cut into parts of size characters, of which the last is shorter, each beginning with the last `overlap`
    ones of the part before. Null and empty texts have no part."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, t in zip(frame["_key"], frame["_text"], strict=True):
                starts = range(0, max(len(t) - overlap, 1), size - overlap)
                # A long text's parts leave in frames of bounded size.
                for a in range(0, len(starts), 4096):
                    own = starts[a : a + 4096]
                    yield pd.DataFrame({"_key": [k] * len(own), "part": range(a, a + len(own)), "text": [t[s : s + size] for s in own]})

    kept = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("length(_text) > 0")
    return kept.mapInPandas(cut, f"{_columns(kept, '_key')}, part long, text string").withColumnRenamed("_key", key)


def encoded(texts: list[str], model: Model, prefix: str = "", whole: bool = True, tries: int = 3) -> list[list[tuple[int, list[float]]]]:
    """For each text the vectors that stand for it, with the characters each is of: one, or those of its halves where the model refuses it.

    With whole, both halves of a refused text are tried, down to single characters, which are left out if they are refused too.
    Without it the first half alone is, and a text that is refused so many times has no vector.
    """
    try:
        return [[(len(t), v)] if any(v) else [] for t, v in zip(texts, model([prefix + t for t in texts]), strict=True)]
    except Refused:
        pass
    if len(texts) > 1:
        return [x for t in texts for x in encoded([t], model, prefix, whole, tries)]
    half = len(texts[0]) // 2
    if not half or not whole and tries <= 1:
        return [[]]
    halves = [texts[0][:half], texts[0][half:]] if whole else [texts[0][:half]]
    return [[v for t in halves for v in encoded([t], model, prefix, whole, tries - 1)[0]]]


def embedded(
    rows: DataFrame, key: str, text: str, model: Model, dim: int, size: int = 2000, overlap: int = 200, prefix: str = "", by_length: bool = False, whole: bool = True, unit: bool = True, output: str = "vector"
) -> DataFrame:
    """(key, vector) of each key's text.

    A text of at most `size` characters is one part. The prefix, a model's name for the task, goes before each part. A vector is the mean of
    its parts' ones (by their characters with by_length), of the first dim components and of unit length unless that is off. A part
    that the model refuses is halved (`encoded`). Texts of one key are pooled; a text without a vector (null, empty, refused or zero
    throughout) has zeros. Other errors of the model end the task, so that Spark tries it again.
    """
    parts = text_parts(rows, key, text, size, overlap).withColumnRenamed(key, "_key")
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = parts.repartition(tasks, "_key", "part")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for a in range(0, len(frame), BATCH):
                own = frame.iloc[a : a + BATCH]
                found = encoded(own["text"].tolist(), model, prefix, whole)
                for x in found:
                    for _, v in x:
                        if len(v) < dim:
                            raise ValueError(f"a vector of {len(v)} components where {dim} are asked for")
                yield pd.DataFrame({"_key": [k for k, x in zip(own["_key"], found, strict=True) for _ in x], "_n": [float(n) for x in found for n, _ in x], "_v": [list(v[:dim]) for x in found for _, v in x]})

    vectors = dealt.mapInPandas(run, f"{_columns(dealt, '_key')}, _n double, _v array<double>")
    weight = F.col("_n") if by_length else F.lit(1.0)
    pooled = vectors.groupBy("_key").agg(Summarizer.mean(array_to_vector("_v"), weight).alias("_mean"))
    if unit:
        pooled = Normalizer(inputCol="_mean", outputCol="_unit").transform(pooled).select("_key", F.col("_unit").alias("_mean"))
    keys = rows.select(F.col(key).alias("_own")).distinct()
    joined = keys.join(pooled.select("_key", vector_to_array("_mean").alias("_mean")), F.col("_own").eqNullSafe(F.col("_key")), "left")
    return joined.select(F.col("_own").alias(key), F.coalesce("_mean", F.array_repeat(F.lit(0.0), dim)).alias(output))


def short_vectors(text: Column, model: Model, dim: int, prefix: str = "") -> Column:
    """Vectors (array<double>) of texts that fit the model, not of unit length; of a text that it refuses the mean of its halves' vectors,
    zeros where there is none."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        out, own = [], texts.fillna("").tolist()
        for a in range(0, len(own), BATCH):
            for found in encoded(own[a : a + BATCH], model, prefix):
                out.append(np.mean([v[:dim] for _, v in found], axis=0).tolist() if found else [0.0] * dim)
        return pd.Series(out, dtype=object)

    return vectors(text)


def surroundings(rows: DataFrame, key: str, text: str, words: list[str], window: int = 100) -> DataFrame:
    """(key, word, start, context) for every place where a word stands in the text, case ignored: with `window` characters on both sides.

    Places count from 0, words that overlap have places of their own. Each text is read once, however many words there are.
    Null texts and empty words have no place.
    """
    words = list(dict.fromkeys(w.lower() for w in words if w))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = automaton(words) if words else None
        for frame in frames:
            for k, t in zip(frame["_key"], frame["_text"], strict=True):
                if known is None:
                    continue
                # Character by character, as some capitals have longer small forms and would shift what follows.
                low = t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t)
                out = []
                for end, i in known.iter(low):
                    start = end + 1 - len(words[i])
                    out.append((k, words[i], start, t[max(0, start - window) : end + 1 + window]))
                    if len(out) == 4096:
                        yield pd.DataFrame(out, columns=["_key", "word", "start", "context"])
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=["_key", "word", "start", "context"])

    kept = rows.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text IS NOT NULL")
    return kept.mapInPandas(run, f"{_columns(kept, '_key')}, word string, start long, context string").withColumnRenamed("_key", key)


def best_definition(vector: Column, definitions: DataFrame) -> Column:
    """struct(name, score): the definition (name, vector) of highest cosine, rounded to six digits; of equal ones the last name. Null for
    a vector of zeros. Definitions are at most `DEFINITIONS`, and travel with the function."""
    known = definitions.select("name", F.col("vector").cast("array<double>")).orderBy("name").limit(DEFINITIONS + 1).collect()
    if len(known) > DEFINITIONS:
        raise ValueError(f"more than {DEFINITIONS} definitions; search them with knn")
    names, m = [r["name"] for r in known], np.array([r["vector"] for r in known], float)
    m = m.reshape(len(known), -1 if known else 1)
    m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("name string, score double")
    def best(vectors: pd.Series) -> pd.DataFrame:
        if not names or not len(vectors):
            return pd.DataFrame({"name": pd.Series([None] * len(vectors), dtype=object), "score": pd.Series([None] * len(vectors), dtype=object)})
        x = np.array(vectors.tolist(), float)
        size = np.linalg.norm(x, axis=1)
        scores = np.round(x @ m.T / np.maximum(size, 1e-300)[:, None], 6)
        at = len(names) - 1 - scores[:, ::-1].argmax(1)
        fine = (size > 0).tolist()
        score = scores[np.arange(len(x)), at].tolist()
        return pd.DataFrame({"name": pd.Series([names[i] if ok else None for i, ok in zip(at, fine, strict=True)], dtype=object), "score": pd.Series([v if ok else None for v, ok in zip(score, fine, strict=True)], dtype=object)})

    return best(vector)


def meanings(rows: DataFrame, key: str, text: str, words: list[str], definitions: DataFrame, model: Model, dim: int, window: int = 100, prefix: str = "") -> DataFrame:
    """(key, word, start, name, score): for every place of a word, the definition that its surroundings are closest to."""
    hits = surroundings(rows, key, text, words, window)
    # Many places come from a text of many hits, so they are dealt anew before the model sees them.
    hits = hits.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key, "start", "word")
    best = hits.select(key, "word", "start", best_definition(short_vectors(F.col("context"), model, dim, prefix), definitions).alias("best"))
    return best.select(key, "word", "start", "best.name", "best.score")


def best_meaning(found: DataFrame, key: str) -> DataFrame:
    """(key, name, score, hits) of a text: the definition of its closest place, of equal ones the last name, and its number of places."""
    return found.groupBy(key).agg(F.max_by("name", F.struct("score", "name")).alias("name"), F.max("score").alias("score"), F.count("*").alias("hits"))
