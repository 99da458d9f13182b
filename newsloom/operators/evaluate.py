"""Figures of classifiers, splits, samples and triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import priority_rank


def _share(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a, b), F.lit(0.0)), 6)


def relevance_figures(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Accuracy, precision, recall, F1 and the confusion counts; 0 where a divisor is 0."""
    t, g = F.col(truth), F.col(guess)
    counts = rows.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    p, r = F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return counts.select("tp", "fp", "fn", "tn", _share(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), _share(2 * p * r, p + r).alias("f1"))


def class_figures(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    """Precision, recall, F1 and support of every class that is true or guessed anywhere."""
    each = rows.select(F.explode(F.array_distinct(F.array(truth, guess))).alias("class"), F.col(truth).alias("t"), F.col(guess).alias("g"))
    counts = each.groupBy("class").agg(F.count_if((F.col("t") == F.col("class")) & (F.col("g") == F.col("class"))).alias("tp"), F.count_if(F.col("g") == F.col("class")).alias("guessed"), F.count_if(F.col("t") == F.col("class")).alias("support"))
    return counts.select("class", _share(F.col("tp"), F.col("guessed")).alias("precision"), _share(F.col("tp"), F.col("support")).alias("recall"), _share(2 * F.col("tp"), F.col("guessed") + F.col("support")).alias("f1"), "support")


def macro_figures(rows: DataFrame, truth: str = "truth", guess: str = "guess") -> DataFrame:
    by_class = class_figures(rows, truth, guess).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return rows.agg(F.round(F.avg((F.col(truth) == F.col(guess)).cast("double")), 6).alias("accuracy")).crossJoin(by_class)


def within_one(rows: DataFrame, truth: str = "truth", guess: str = "guess", unknown_as_one: bool = False) -> DataFrame:
    """Share of guesses at most one priority away. An unknown priority is skipped, or counts as rank 1."""
    known = ["high", "medium", "low", "none"]
    rank = lambda c: F.when(c.isin(*known), priority_rank(c)).otherwise(F.lit(1) if unknown_as_one else F.lit(None).cast("int"))
    near = (F.abs(rank(F.col(truth)) - rank(F.col(guess))) <= 1).cast("double")
    return rows.agg(F.round(F.avg(near), 6).alias("within_one"))


def multilabel_figures(rows: DataFrame, truth: str, guess: str, classes: list[str]) -> DataFrame:
    """Subset accuracy, Hamming loss and the share with any common label, for arrays of labels."""
    t, g = F.col(truth), F.col(guess)
    wrong = F.aggregate(F.array(*map(F.lit, classes)), F.lit(0), lambda s, c: s + (F.array_contains(t, c) != F.array_contains(g, c)).cast("int"))
    same = (F.array_sort(F.array_distinct(t)) == F.array_sort(F.array_distinct(g))).cast("double")
    return rows.agg(F.round(F.avg(same), 6).alias("subset_accuracy"), F.round(F.avg(wrong / len(classes)), 6).alias("hamming_loss"), F.round(F.avg(F.arrays_overlap(t, g).cast("double")), 6).alias("any_overlap"))


def _placed(rows: DataFrame, key: str, stratum: str, seed: int) -> DataFrame:
    """rows with `_place`, their rank in the stratum by a seeded hash of the key, and `_n`, the stratum's rows.

    The hash's leading bits cut each stratum into runs that are ranked apart; a run's first rank comes
    from the counts before it, and no task holds a stratum.
    """
    bits = (int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4).bit_length()
    order = F.xxhash64(F.col(key), F.lit(seed))
    rows = rows.withColumn("_order", order).withColumn("_run", F.shiftright("_order", 64 - bits))
    counts = rows.groupBy(stratum, "_run").agg(F.count("*").alias("_own"))
    own = Window.partitionBy(stratum)
    before = F.sum("_own").over(own.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    runs = counts.select(F.col(stratum).alias("_stratum"), F.col("_run").alias("_at"), F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_own").over(own).alias("_n"))
    within = F.row_number().over(Window.partitionBy(stratum, "_run").orderBy("_order", key))
    placed = rows.withColumn("_within", within).join(runs, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_run") == F.col("_at")))
    return placed.withColumn("_place", F.col("_within") + F.col("_before")).drop("_order", "_run", "_within", "_stratum", "_at", "_before")


def stratified_split(rows: DataFrame, key: str, stratum: str, train: float = 0.7, val: float = 0.15, seed: int = 42) -> DataFrame:
    """rows with `split`: of each stratum, in an order by seed, the first floor(train * n) and so on."""
    split = F.when(F.col("_place") <= F.floor(F.col("_n") * train), "train").when(F.col("_place") <= F.floor(F.col("_n") * F.lit(train + val)), "val").otherwise("test")
    return _placed(rows, key, stratum, seed).withColumn("split", split).drop("_place", "_n")


def triage(old: DataFrame, new: DataFrame, key: str = "key", size: str = "size", grown: float = 1.2, least: int = 500) -> DataFrame:
    """(key, action): relabel what grew by a fifth to at least 500 characters, keep the rest, and label new ones."""
    both = new.select(key, F.col(size).alias("now")).join(old.select(key, F.col(size).alias("before")), key, "left")
    action = F.when(F.col("before").isNull(), "new").when((F.col("now") > F.col("before") * grown) & (F.col("now") >= least), "relabel").otherwise("keep")
    return both.select(key, action.alias("action"))


def long_and_some_short(rows: DataFrame, key: str, text: str, least: int = 500, short_share: float = 0.1, seed: int = 42) -> DataFrame:
    """All rows of at least so many characters and the whole part of a share of the shorter, by rank in a seeded order."""
    if not short_share:
        return rows.join(rows.filter(F.length(text) < least).select(key), key, "left_anti")
    placed = _placed(rows.withColumn("_short", F.coalesce(F.length(text) < least, F.lit(True))), key, "_short", seed)
    return placed.filter(~F.col("_short") | (F.col("_place") <= F.floor(F.col("_n") * F.lit(short_share)))).drop("_short", "_place", "_n")


def balanced_sample(rows: DataFrame, label: str, each: int, *order: Column) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(label).orderBy(*order))).filter(F.col("_place") <= each).drop("_place")


def agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """How often two verdicts agree and in which way they don't."""
    x, y = F.col(a), F.col(b)
    return rows.agg(F.count("*").alias("n"), F.count_if(x == y).alias("agree"), F.count_if(x & ~y).alias("only_first"), F.count_if(~x & y).alias("only_second"), F.count_if(x.isNull() | y.isNull()).alias("missing"))


def bake_off(rows: DataFrame, models: list[str]) -> DataFrame:
    """How often each model is right and how long it takes: (model, relevant, ak, priority, seconds, relevant_rows).

    rows: relevant, ak, priority and, for each model, <model>_relevant, _ak, _priority and _seconds. Groups and
    priorities count on relevant rows only; seconds is the mean of a row.
    """
    same = lambda m, c: F.col(c).eqNullSafe(F.col(f"{m}_{c}"))
    one = lambda m: F.struct(F.lit(m).alias("model"), same(m, "relevant").alias("r"), (F.col("relevant") & same(m, "ak")).alias("a"), (F.col("relevant") & same(m, "priority")).alias("p"), F.col(f"{m}_seconds").alias("s"), F.col("relevant").alias("t"))
    each = rows.select(F.explode(F.array(*map(one, models))).alias("x")).select("x.*")
    return each.groupBy("model").agg(F.count_if("r").alias("relevant"), F.count_if("a").alias("ak"), F.count_if("p").alias("priority"), F.round(F.avg("s"), 6).alias("seconds"), F.count_if("t").alias("relevant_rows"))
