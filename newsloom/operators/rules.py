"""Rules against items: keyword and regular-expression rules, scores and targets.

Rules are a table that people keep by hand; it is read once and checked. The keywords of all rules and of the score are looked for
together, in one pass over each text (`keyword_groups`), so thousands of rules cost a text no more than a few do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.automaton import keyword_groups
from newsloom.functions.text import SCORE_WORDS, regex_match, score_priority
from newsloom.functions.urls import valid_pattern


def usable(rules: list[dict]) -> list[dict]:
    """Enabled rules in order, without regular expressions that don't compile (they would never match)."""
    kept = [r for r in rules if r.get("enabled", True) and r["rule_type"] in ("keyword", "regex") and (r["rule_type"] == "keyword" or valid_pattern(r["pattern"]))]
    return sorted(kept, key=lambda r: (r.get("order", 0), r["id"]))


def apply_rules(items: DataFrame, rules: list[dict]) -> DataFrame:
    """items with rule_ids that matched, priority_score and priority.

    score: 50 with the boosts of matching rules and the keywords' weights, within 0 and 100; the last
    matching rule with a target priority decides, else the score. A keyword rule matches if any of its comma-separated parts, trimmed
    and lower-cased, lies in the lower-cased text; an empty part lies in every text.
    """
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    kept = usable(rules)
    weights = [(k, w) for w, words in SCORE_WORDS.items() for k in words]
    # One group of words a rule, none for a regular expression, and then one for each word of the score.
    groups = [[k.strip(" ").lower() for k in r["pattern"].split(",")] if r["rule_type"] == "keyword" else [] for r in kept] + [[k] for k, _ in weights]
    items = items.withColumn("_text", text).withColumn("_hits", keyword_groups(F.lower("_text"), groups))
    regex = [F.when(regex_match(r["pattern"], F.col("_text")), F.lit(i)) for i, r in enumerate(kept) if r["rule_type"] == "regex"]
    items = items.withColumn("_hits", F.array_sort(F.concat("_hits", F.array_compact(F.array(*regex))))) if regex else items
    worth = F.array(*(F.lit(r["priority_boost"]) for r in kept), *(F.lit(w) for _, w in weights))
    total = lambda keep: F.aggregate(F.filter("_hits", keep), F.lit(0), lambda a, i: a + F.get(worth, i))
    own = F.filter("_hits", lambda i: i < len(kept))
    ids, targets = (F.array(*(F.lit(x) for x in v)) if kept else F.array() for v in ([int(r["id"]) for r in kept], [r.get("target_priority") or "" for r in kept]))
    found = F.transform(own, lambda i: F.get(ids.cast("array<bigint>"), i))
    target = F.get(F.filter(F.reverse(own), lambda i: F.get(targets.cast("array<string>"), i) != ""), F.lit(0))
    score = F.greatest(F.lit(0), F.least(F.lit(100), total(lambda i: i < len(kept)) + F.least(F.lit(100), F.lit(50) + total(lambda i: i >= len(kept)))))
    out = items.withColumn("rule_ids", found).withColumn("priority_score", score).withColumn("_target", F.get(targets.cast("array<string>"), target))
    return out.withColumn("priority", F.coalesce("_target", score_priority(F.col("priority_score")))).drop("_target", "_hits", "_text")


def matches(items: DataFrame, rules: list[dict]) -> DataFrame:
    """(item_id, rule_id) of every match."""
    return apply_rules(items, rules).select(F.col("id").alias("item_id"), F.explode("rule_ids").alias("rule_id"))
