"""Text rules as column expressions: cleaning, hashing, similarity, scoring and assembly."""

from __future__ import annotations

import html as entities
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from newsloom.functions.automaton import keyword_hits

# Keyword weights and lists of the priority score.
SCORE_WORDS = {
    40: ["kürzung", "streichung", "haushaltssperre", "finanzierungslücke", "kahlschlag", "förderentzug", "nothaushalt", "haushaltskrise", "schließung", "abbau", "existenzbedrohend", "insolvenz", "personalreduzierung", "stellenabbau", "einschnitte"],
    20: ["gesetzesänderung", "novelle", "anhörung", "regierungsentwurf", "bundesratsentscheidung", "gesetzgebung", "reform"],
    10: ["pflegenotstand", "kitaplätze", "migrationsberatung", "fachkräftemangel", "sozialfinanzierung", "eingliederungshilfe", "kinderbetreuung"],
}
# Keyword lists of the hand-made features.
WELFARE_WORDS = ["liga", "wohlfahrt", "awo", "caritas", "diakonie", "drk", "paritätisch", "wohlfahrtsverband", "spitzenverband", "freie wohlfahrtspflege"]
LEISURE_WORDS = ["fußball", "bundesliga", "champions", "sport", "tennis", "olympia", "mannschaft", "trainer", "spieler", "tor", "sieg", "niederlage", "kino", "film", "konzert", "festival", "unterhaltung"]
# Words of keyword pairs, and contexts that exclude.
WORDS_IN_CONTEXT = {
    "tagespflege": {"AK3": ["senioren", "pflege", "ältere", "alten"], "AK5": ["kita", "kinder", "eltern", "frühkindlich"]},
    "fachkräftemangel": {"AK3": ["pflege", "krankenhaus", "gesundheit", "klinik"], "AK5": ["kita", "erzieher", "betreuung"]},
}
RULED_OUT = {"wohngruppe": {"AK4": ["geflüchtet", "asyl", "abschieb", "migration"]}}


@F.pandas_udf(StringType())
def unescape(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Character references decoded, as HTML defines them; Spark has no such function."""
    for s in texts:
        yield s.map(lambda x: None if x is None else entities.unescape(x))


def squeeze(text: Column) -> Column:
    """Tags and control characters out, runs of (Unicode) white space to one space, trimmed."""
    bare = F.regexp_replace(text, "<[^>]+>", "")
    bare = F.regexp_replace(bare, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    return F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), "^ +| +$", "")


def normalize_content(text: Column) -> Column:
    """Tags go before character references are decoded, so an escaped tag survives as text."""
    return unescape(squeeze(text))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


# What stands around articles that were followed from a feed, and where a sentence ends.
SUMMARY_MARK = r"(?i)^RSS-Zusammenfassung:\s*"
ARTICLE_MARK = r"(?i)\n\n--- Vollständiger Artikel von [^\n]+ ---\n\n"
SENTENCE_END = r"[.!?]\s+(?=[A-ZÄÖÜ])|[.!?]$"


def strip_boilerplate(text: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(text, SUMMARY_MARK, ""), ARTICLE_MARK, "")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def title_words(title: Column) -> Column:
    """Distinct words of more than two characters."""
    return F.array_distinct(F.filter(F.split(F.lower(title), r"\s+"), lambda w: F.length(w) > 2))


def titles_similar(a: Column, b: Column, threshold: float = 0.7) -> Column:
    """Shared words over the smaller title's words reach the threshold; never for a title without words."""
    x, y = title_words(a), title_words(b)
    small = F.least(F.size(x), F.size(y))
    return (small > 0) & (F.size(F.array_intersect(x, y)) >= threshold * small)


def keyword_match(pattern: Column | str, text: Column) -> Column:
    """Any comma-separated part of the pattern, trimmed and lower-cased, lies in the lower-cased text.

    A trailing comma gives the empty part, which lies in every text.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.exists(F.split(F.lower(pattern), ","), lambda k: F.contains(F.lower(text), F.trim(k)))


def regex_match(pattern: Column | str, text: Column) -> Column:
    """The pattern is found in the lower-cased text, case ignored. Invalid patterns are dropped when rules are loaded."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.rlike(F.lower(text), F.concat(F.lit("(?iU)"), pattern))


def keyword_score(text: Column) -> Column:
    """50 and the weight of each keyword that lies in the lower-cased text, at most 100; keywords are looked for in one pass."""
    weights = [(k, w) for w, words in SCORE_WORDS.items() for k in words]
    worth = F.array(*(F.lit(w) for _, w in weights))
    return F.least(F.lit(100), F.aggregate(F.coalesce(keyword_hits(F.lower(text), [k for k, _ in weights]), F.array().cast("array<int>")), F.lit(50), lambda a, i: a + F.get(worth, i)))


def keyword_priority(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "medium").when(score >= 40, "low").otherwise("none")


def score_priority(score: Column) -> Column:
    return F.when(score >= 90, "high").when(score >= 70, "medium").when(score > 50, "low").otherwise("none")


def confidence_bucket(confidence: Column) -> Column:
    """struct priority, score, skip (of the slow model) for a relevance confidence."""
    made = lambda p, s, skip: F.struct(F.lit(p).alias("priority"), F.lit(s).alias("score"), F.lit(skip).alias("skip"))
    return F.when(confidence >= 0.5, made("medium", 70, False)).when(confidence >= 0.25, made("low", 55, False)).otherwise(made("none", 20, True))


def retry_priority(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unknown").when(confidence >= 0.5, "high").when(confidence >= 0.25, "edge_case").otherwise("low")


def model_outcome(priority: Column, relevant: Column, score: Column, shifted: bool = False) -> Column:
    """struct priority, score after the slow model: its priority with a floor for the score, none with a ceiling of 20.

    shifted: the other map, where critical means high, high medium, medium low and low none.
    """
    if shifted:
        priority = F.when(priority == "critical", "high").when(priority == "high", "medium").when(priority == "medium", "low").otherwise("none")
    priority = F.when(F.coalesce(relevant, F.lit(True)), F.when(priority.isin("high", "medium", "low"), priority).otherwise("none")).otherwise("none")
    floor = F.when(priority == "high", F.greatest(score, F.lit(90))).when(priority == "medium", F.greatest(score, F.lit(70))).when(priority == "low", F.greatest(score, F.lit(40)))
    value = floor.otherwise(F.least(F.when(score == 0, 100).otherwise(F.coalesce(score, F.lit(100))), F.lit(20)))
    return F.struct(priority.alias("priority"), value.alias("score"))


def group_fallback(model_groups: Column, own: Column, suggested: Column) -> Column:
    """The model's working groups, else the item's own, else the classifier's suggestion."""
    return F.when(F.size(F.coalesce(model_groups, F.array().cast("array<string>"))) > 0, model_groups).when(own.isNotNull(), F.array(own)).when(suggested.isNotNull(), F.array(suggested)).otherwise(F.array().cast("array<string>"))


def toggled_priority(priority: Column) -> Column:
    """struct priority, score when ingest takes the classifier's priority."""
    made = lambda p, s: F.struct(F.lit(p).alias("priority"), F.lit(s).alias("score"))
    return F.when(priority == "high", made("high", 90)).when(priority == "medium", made("medium", 70)).when(priority == "low", made("low", 50)).otherwise(made("medium", 60))


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 3).when(priority == "medium", 2).when(priority == "low", 1).otherwise(0)


def priority_order(priority: Column) -> Column:
    """1 for high to 4 for none, 5 for anything else."""
    return F.when(priority == "high", 1).when(priority == "medium", 2).when(priority == "low", 3).when(priority == "none", 4).otherwise(5)


def count_sentences(text: Column) -> Column:
    parts = F.split(F.coalesce(text, F.lit("")), SENTENCE_END, -1)
    return F.size(F.filter(parts, lambda s: F.trim(s) != ""))


def label_valid(relevant: Column, summary: Column, analysis: Column) -> Column:
    return ~F.coalesce(relevant, F.lit(False)) | ((count_sentences(summary) >= 3) & (count_sentences(analysis) >= 7))


def normalize_title(title: Column) -> Column:
    bare = F.regexp_replace(F.lower(title), r"(?U)[^\w\s]", "")
    return F.substring(F.trim(F.regexp_replace(bare, r"(?U)\s+", " ")), 1, 100)


def short_title(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def hand_features(text: Column) -> list[Column]:
    """Keyword hits of both lists, length, mentions of the state, and two flags."""
    low = F.lower(text)
    hits = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    return [
        hits(WELFARE_WORDS).alias("liga_hits"), hits(LEISURE_WORDS).alias("irrelevant_hits"), F.length(text).alias("length"),
        F.regexp_count(low, F.lit("hessen")).alias("hessen"), F.contains(low, F.lit("liga")).cast("int").alias("has_liga"), F.contains(low, F.lit("wohlfahrt")).cast("int").alias("has_wohlfahrt"),
    ]


def multi_hot(values: Column, classes: list[str]) -> Column:
    return F.transform(F.array(*map(F.lit, classes)), lambda c: F.array_contains(values, c).cast("int"))


def from_multi_hot(flags: Column, classes: list[str]) -> Column:
    return F.filter(F.transform(F.arrays_zip(F.array(*map(F.lit, classes)).alias("c"), flags.alias("f")), lambda z: F.when(z["f"] == 1, z["c"])), lambda c: c.isNotNull())


def chunks(text: Column, size: int = 10000, overlap: int = 500) -> Column:
    """Pieces of `size` characters, each beginning `size - overlap` after the last; an empty text has none."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.when(F.length(text) > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def assembled(title: Column, content: Column, source: Column | None = None) -> Column:
    """title, content and, if asked for, the source in its bracket."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(content, F.lit("")))
    return text if source is None else F.concat(text, F.lit(" [Quelle: "), F.coalesce(source, F.lit("")), F.lit("]"))


def merged_article(summary: Column, domain: Column, article: Column) -> Column:
    return F.concat(F.lit("RSS-Zusammenfassung: "), summary, F.lit("\n\n--- Vollständiger Artikel von "), domain, F.lit(" ---\n\n"), article)


def relevance_score(relevant: Column, priority: Column) -> Column:
    inner = F.when(priority == "critical", 1.0).when(priority == "high", 0.85).when(F.coalesce(priority, F.lit("medium")) == "medium", 0.7).otherwise(0.55)
    return F.when(relevant, inner).otherwise(0.0)


def contextual_group(text: Column, keyword: str) -> Column:
    """The first working group whose context words stand beside the keyword; null without one."""
    low = F.lower(text)
    found = F.lit(None).cast("string")
    for group, words in reversed(list(WORDS_IN_CONTEXT[keyword].items())):
        near = F.lit(False)
        for w in words:
            near = near | F.contains(low, F.lit(w))
        found = F.when(near, group).otherwise(found)
    return F.when(F.contains(low, F.lit(keyword)), found)


def ruled_out(text: Column, keyword: str, group: str) -> Column:
    """Whether words beside the keyword keep it from counting for the group."""
    low = F.lower(text)
    found = F.lit(False)
    for w in RULED_OUT.get(keyword, {}).get(group, []):
        found = found | F.contains(low, F.lit(w))
    return F.contains(low, F.lit(keyword)) & found


def format_bytes(size: Column) -> Column:
    out = F.format_string("%.1f PB", F.bround(size / F.lit(1024.0**5), 1))
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out = F.when(size < 1024.0 ** (k + 1), F.format_string(f"%.1f {unit}", F.bround(size / F.lit(1024.0**k), 1))).otherwise(out)
    return out
