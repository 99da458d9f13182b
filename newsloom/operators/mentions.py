"""Mentions of known persons in items, by handle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HANDLE = r"(?U)@(\w+)"


def handles(items: DataFrame, content: str = "content") -> DataFrame:
    """(id, handle, n) of every handle that an item mentions."""
    found = items.select("id", F.explode(F.regexp_extract_all(F.col(content), F.lit(HANDLE), F.lit(1))).alias("handle"))
    return found.groupBy("id", "handle").agg(F.count("*").alias("n"))


def known_handles(persons: DataFrame) -> DataFrame:
    """(handle, person) of all texts that name a person (id, category, twitter_handle, mastodon_handle, instagram_handle): a handle of
    the two networks as it is, and whatever lies inside a mastodon handle, case ignored there.

    All parts of a mastodon handle are rows, as many as half the square of its length, so that mentions join by equality; the least id
    stands for persons of one handle.
    """
    exact = persons.select(F.explode(F.array("twitter_handle", "instagram_handle")).alias("handle"), F.col("id").alias("person")).filter("handle IS NOT NULL")
    low = persons.select(F.lower("mastodon_handle").alias("whole"), F.col("id").alias("person")).filter("length(whole) > 0")
    starts = low.select("whole", "person", F.explode(F.sequence(F.lit(1), F.length("whole"))).alias("i"))
    parts = starts.select("person", F.explode(F.transform(F.sequence(F.lit(1), F.length("whole") - F.col("i") + 1), lambda n: F.substring(F.col("whole"), F.col("i"), n))).alias("handle"))
    one = lambda df: df.groupBy("handle").agg(F.min("person").alias("person"))
    return one(exact).withColumn("folded", F.lit(False)).unionByName(one(parts).withColumn("folded", F.lit(True)))


def mentions(items: DataFrame, persons: DataFrame, direct: str = "liga", member: str = "liga_mitglied") -> DataFrame:
    """For each item (id, content, author_handle) the persons that it mentions and its sender.

    n_handles, person_ids (distinct, in order), mentions_direct and mentions_member (a person of that category), mentions_any, sender_id and
    sender_category (the least id of that twitter handle), and is_direct_question: a question mark in an item that mentions anyone.
    Mentions are few in an item, so their list is. A null content mentions nobody.
    """
    own, known = handles(items), known_handles(persons)
    exact = own.join(known.filter("NOT folded"), "handle").select("id", "handle", "person")
    inside = own.withColumn("low", F.lower("handle")).join(known.filter("folded").withColumnRenamed("handle", "low"), "low").select("id", "handle", "person")
    # A handle names one person: the least id of all that it fits.
    named = exact.unionByName(inside).groupBy("id", "handle").agg(F.min("person").alias("person")).join(persons.select(F.col("id").alias("person"), "category"), "person")
    per = named.groupBy("id").agg(F.sort_array(F.collect_set("person")).alias("person_ids"), F.bool_or(F.col("category") == direct).alias("mentions_direct"), F.bool_or(F.col("category") == member).alias("mentions_member"))
    counts = own.groupBy("id").agg(F.sum("n").alias("n_handles"))
    senders = persons.filter("twitter_handle IS NOT NULL").groupBy(F.col("twitter_handle").alias("author_handle")).agg(F.min_by(F.struct(F.col("id").alias("sender_id"), F.col("category").alias("sender_category")), "id").alias("sender"))
    out = items.join(counts, "id", "left").join(per, "id", "left").join(senders, "author_handle", "left")
    some = F.size("person_ids") > 0
    no = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "id", F.coalesce("n_handles", F.lit(0)).alias("n_handles"), F.coalesce("person_ids", F.array().cast("array<bigint>")).alias("person_ids"), no(F.col("mentions_direct")).alias("mentions_direct"), no(F.col("mentions_member")).alias("mentions_member"),
        no(some).alias("mentions_any"), "sender.sender_id", "sender.sender_category", no(F.contains("content", F.lit("?")) & some).alias("is_direct_question"),
    )
