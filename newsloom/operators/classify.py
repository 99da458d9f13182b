"""Hierarchical text classifiers on Spark ML: relevance, then priority and working group of what is relevant."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IDF, CountVectorizer, HashingTF, IndexToString, NGram, Normalizer, RegexTokenizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_ROWS = 10


class Tfidf:
    """Words and pairs of words, at most so many terms, sublinear counts times IDF, unit length."""

    def __init__(self, terms: int = 3000, least: float = 2, most: float = 0.9) -> None:
        self.words = Pipeline(stages=[RegexTokenizer(inputCol="text", outputCol="_one", pattern=r"(?U)\b\w\w+\b", gaps=False), NGram(inputCol="_one", outputCol="_two"), SQLTransformer(statement="SELECT *, concat(_one, _two) AS _both FROM __THIS__")])
        self.count = CountVectorizer(inputCol="_both", outputCol="_tf", vocabSize=terms, minDF=least, maxDF=most)
        self.idf = IDF(inputCol="_log", outputCol="_idf")
        self.unit = Normalizer(inputCol="_idf", outputCol="features")

    def fit(self, rows: DataFrame) -> Callable[[DataFrame], DataFrame]:
        words = self.words.fit(rows)
        # Counts and IDF pass over the words several times, so they are made once and kept until the fit is done.
        kept = words.transform(rows).select("_both").persist()
        try:
            return self._fitted(words, kept)
        finally:
            kept.unpersist()

    def _fitted(self, words: PipelineModel, kept: DataFrame) -> Callable[[DataFrame], DataFrame]:
        counts = self.count.fit(kept)
        log = lambda df: df.withColumn("_log", array_to_vector(F.transform(vector_to_array("_tf"), lambda x: F.when(x > 0, 1 + F.log(x)).otherwise(0.0))))
        idf = self.idf.fit(log(counts.transform(kept)))
        return lambda df: self.unit.transform(idf.transform(log(counts.transform(words.transform(df))))).drop("_one", "_two", "_both", "_tf", "_log", "_idf")


def with_features(rows: DataFrame, columns: list[Column], features: str = "features") -> DataFrame:
    """rows whose vector ends in further numbers; a null counts as 0."""
    names = [f"_f{i}" for i in range(len(columns))]
    wide = rows.withColumns({n: F.coalesce(c.cast("double"), F.lit(0.0)) for n, c in zip(names, columns, strict=True)})
    return VectorAssembler(inputCols=[features, *names], outputCol="_all").transform(wide).drop(features, *names).withColumnRenamed("_all", features)


def vectors(rows: DataFrame, column: str) -> DataFrame:
    return rows.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))


def balanced(label: Column, rows: DataFrame) -> DataFrame:
    """rows with `weight`, so that both classes weigh the same."""
    n = rows.agg(F.count("*").alias("n"), F.count_if(label == 1).alias("p")).first()
    return rows.withColumn("weight", F.when(label == 1, n["n"] / max(1, 2 * n["p"])).otherwise(n["n"] / max(1, 2 * (n["n"] - n["p"]))))


class Hierarchy:
    """Logistic regression for relevance and, on relevant rows, a forest for each further label with enough rows."""

    def __init__(self, further: list[str], trees: int = 50, seed: int = 42) -> None:
        self.further, self.trees, self.seed = further, trees, seed
        self.relevance: Transformer | None = None
        self.models: dict[str, PipelineModel] = {}

    def fit(self, rows: DataFrame) -> Hierarchy:
        """rows: features, relevant (0 or 1) and the further labels."""
        # Every stage passes over the features again, so they are made once and kept until the fit is done.
        kept = balanced(F.col("relevant"), rows.select("features", "relevant", *self.further)).persist()
        try:
            self._fit(kept)
        finally:
            kept.unpersist()
        return self

    def _fit(self, rows: DataFrame) -> None:
        self.relevance = LogisticRegression(featuresCol="features", labelCol="relevant", weightCol="weight", maxIter=50, regParam=0.01, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_y").fit(rows)
        inner = rows.filter("relevant = 1")
        # One pass counts the rows of every further label.
        counts = inner.agg(*(F.count(F.col(name)).alias(name) for name in self.further)).first() if self.further else {}
        for name in self.further:
            if counts[name] <= LEAST_ROWS:
                continue
            own = inner.filter(F.col(name).isNotNull())
            index = StringIndexer(inputCol=name, outputCol=f"_{name}_i", stringOrderType="alphabetAsc", handleInvalid="keep").fit(own)
            forest = RandomForestClassifier(featuresCol="features", labelCol=f"_{name}_i", numTrees=self.trees, maxDepth=8, seed=self.seed, probabilityCol=f"_{name}_p", rawPredictionCol=f"_{name}_r", predictionCol=f"_{name}_y").fit(index.transform(own))
            self.models[name] = PipelineModel([forest, IndexToString(inputCol=f"_{name}_y", outputCol=f"{name}_guess", labels=[*index.labels, ""])])

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with confidence, relevant_guess (confidence over a half) and, only where relevant, the further guesses."""
        out = self.relevance.transform(rows).withColumn("confidence", vector_to_array("_p")[1]).drop("_p", "_raw", "_y").withColumn("relevant_guess", F.col("confidence") > 0.5)
        for name, model in self.models.items():
            out = model.transform(out).drop(f"_{name}_p", f"_{name}_r", f"_{name}_y").withColumn(f"{name}_guess", F.when(F.col("relevant_guess"), F.col(f"{name}_guess")))
        return out


def multilabel(rows: DataFrame, labels: str, classes: list[str], trees: int = 20, seed: int = 42) -> dict[str, Transformer]:
    """One forest for each class of an array column that has both kinds of rows."""
    models = {}
    for c in classes:
        own = rows.withColumn("_l", F.array_contains(labels, c).cast("double"))
        if own.select("_l").distinct().count() == 2:
            models[c] = RandomForestClassifier(featuresCol="features", labelCol="_l", numTrees=trees, maxDepth=6, seed=seed).fit(own)
    return models


def multilabel_guess(rows: DataFrame, models: dict[str, Transformer], fallback: str | None = "QAG") -> DataFrame:
    """rows with guess: classes over a half, else the fallback, or without one the likeliest class."""
    probs = []
    for c, m in models.items():
        rows = m.transform(rows).withColumn(f"_{c}", vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")
        probs.append(F.struct(F.col(f"_{c}").alias("p"), F.lit(c).alias("c")))
    every = F.array(*probs)
    over = F.transform(F.filter(every, lambda x: x["p"] > 0.5), lambda x: x["c"])
    best = F.lit(fallback) if fallback else F.array_max(every)["c"]
    return rows.withColumn("guess", F.when(F.size(over) > 0, over).otherwise(F.array(best))).drop(*(f"_{c}" for c in models))


def should_process(relevant: Column, confidence: Column, threshold: float) -> Column:
    """False only for what is surely not relevant; unknown passes."""
    return F.coalesce(relevant | (confidence >= 1 - threshold), F.lit(True))


def hashed_embedding(rows: DataFrame, text: str, size: int = 64, output: str = "vector") -> DataFrame:
    """rows with a unit vector of word counts by hash: the default embedder where no model is given."""
    words = rows.withColumn("_words", F.split(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\W+"))
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit").transform(counts)
    return unit.withColumn(output, vector_to_array("_unit")).drop("_words", "_tf", "_unit")


def with_model(rows: DataFrame, column: str, call: Callable[[list[str]], list[str]], output: str = "answer") -> DataFrame:
    """rows with the answer of a model to a text column; call gets one batch of texts at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(**{output: call(frame[column].fillna("").tolist())})

    return rows.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes) + f", `{output}` string")
