"""The topic taxonomy and the map from free tags to it, as small tables that are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The topics that count, in their spelling.
TOPICS = [
    "Sozialpolitik", "Haushalt und Finanzen", "Steuerpolitik", "Sozialleistungen", "Bürokratieabbau", "Vergaberecht", "Ehrenamt", "Wohlfahrtsverbände", "Tarifpolitik",
    "Migration und Flucht", "Asylpolitik", "Integration", "Abschiebung",
    "Pflege", "Pflegefinanzierung", "Pflegepersonal", "Gesundheitsversorgung", "Krankenhausreform", "Psychische Gesundheit", "Sucht und Prävention", "Senioren und Alter", "Demenz", "Hospiz und Palliativ",
    "Behinderung und Inklusion", "Barrierefreiheit", "Eingliederungshilfe",
    "Kita und Kinderbetreuung", "Kinder- und Jugendhilfe", "Kinderschutz", "Familienpolitik", "Kinderarmut",
    "Digitalisierung", "Wohnen und Wohnungsnot", "Armut und Existenzsicherung", "Obdachlosigkeit", "Schuldnerberatung",
    "Fachkräftemangel", "Arbeitsmarkt", "Bildung und Ausbildung", "Gleichstellung", "Gewalt und Gewaltschutz", "Demokratie und Extremismus", "Menschenrechte", "Humanitäre Hilfe", "Klimaschutz und Soziales", "Recht und Gesetzgebung",
]
OTHER = "Sonstiges"


def taxonomy(spark: SparkSession, topics: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(t.lower(), t) for t in topics or TOPICS], "key string, canonical string")


def validated(rows: DataFrame, column: str, topics: list[str] | None = None) -> DataFrame:
    """rows with topic in the taxonomy's spelling, or Sonstiges and what was said as suggestion."""
    said = F.nullif(F.trim(F.col(column)), F.lit(""))
    out = rows.withColumn("_said", said).withColumn("_key", F.lower("_said")).join(F.broadcast(taxonomy(rows.sparkSession, topics).withColumnRenamed("key", "_key")), "_key", "left")
    suggestion = F.when(F.col("canonical").isNull() & (F.col("_key") != OTHER.lower()), F.col("_said"))
    return out.withColumn("topic", F.coalesce("canonical", F.lit(OTHER))).withColumn("suggestion", suggestion).drop("_said", "_key", "canonical")


def mapped(tags: Column, table: dict[str, str]) -> Column:
    """The topic of the first tag that the table (lower-case tags to topics) knows, else null."""
    pairs = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.try_element_at(F.array_compact(F.transform(tags, lambda t: F.try_element_at(pairs, F.lower(F.trim(t))))), F.lit(1))


def map_tags(rows: DataFrame, tags: str, table: DataFrame, key: str = "id") -> DataFrame:
    """(key, topic) of rows whose array of tags holds any that the table (tag, topic, place) knows: the topic of the
    first such tag. The map is a landed table, not code: its tags count trimmed and in lower case, and of equal tags
    the last place counts."""
    known = table.groupBy(F.lower(F.trim("tag")).alias("_tag")).agg(F.max_by("topic", "place").alias("_topic"))
    said = rows.select(key, F.posexplode(tags).alias("_at", "_said")).withColumn("_tag", F.lower(F.trim("_said")))
    return said.join(known, "_tag").groupBy(key).agg(F.min_by("_topic", "_at").alias("topic"))


# Organisations of source names that carry a platform; other names lose the platform's suffix.
ORGANISATIONS = {
    "FAZ Aktuell": "FAZ (Frankfurter Allgemeine)", "FAZ Gesellschaft": "FAZ (Frankfurter Allgemeine)", "FAZ Rhein-Main": "FAZ (Frankfurter Allgemeine)", "FAZ (X.com)": "FAZ (Frankfurter Allgemeine)",
    "FR Politik": "Frankfurter Rundschau", "hessenschau (X.com)": "Hessenschau", "HLS Suchtfragen (X.com)": "HLS (Suchtfragen)", "Pro Asyl": "PRO ASYL", "Boris Rhein MP (Mastodon)": "Boris Rhein", "Boris Rhein MP Instagram": "Boris Rhein",
    "Astrid Wallmann (Landtagspräsidentin) (X.com)": "Astrid Wallmann", "Ines Claus (CDU Fraktionsvorsitzende) (X.com)": "Ines Claus (CDU)", "Ines Claus CDU Instagram": "Ines Claus (CDU)",
    "Tobias Eckert (SPD Fraktionsvorsitzender) (X.com)": "Tobias Eckert (SPD)", "Tobias Eckert SPD Instagram": "Tobias Eckert (SPD)", "Robert Lambrou (AfD Fraktionsvorsitzender) (X.com)": "Robert Lambrou (AfD)", "Robert Lambrou AfD Instagram": "Robert Lambrou (AfD)",
    "Mathias Wagner Gruene Instagram": "Mathias Wagner (Grüne)", "Bijan Kaffenberger SPD Instagram": "Bijan Kaffenberger (SPD)", "SPD Landtagsfraktion Hessen (X.com)": "SPD Fraktion Hessen",
}


# What names of channels end in, by platform.
PLATFORM_SUFFIXES = [r"\s*\(X\.com\)$", r"\s*\(Mastodon\)$", r"\s*\(Bluesky\)$", r"\s+Instagram$", r"\s+Telegram$"]


def organisation(name: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for pair in ORGANISATIONS.items() for x in pair))
    bare = name
    for pattern in PLATFORM_SUFFIXES:
        bare = F.regexp_replace(bare, "(?i)" + pattern, "")
    return F.coalesce(F.try_element_at(pairs, name), F.trim(bare))


# Of the names above, those whose channel keeps a name of its own.
CHANNELS = {"FAZ Aktuell": "Aktuell", "FAZ Gesellschaft": "Gesellschaft", "FAZ Rhein-Main": "Rhein-Main", "FR Politik": "Politik"}


def channel_of(name: Column) -> Column:
    """The channel's own name within its organisation, where a source's name tells one, else null."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in CHANNELS.items() for x in pair)), name)
