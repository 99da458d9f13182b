"""Counts and groupings: dashboards, per-source figures, analytics, retention and topics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.operators.listing import latest
from newsloom.schemas import PRIORITIES

DEFAULT_RETENTION = {"high": 365, "medium": 180, "low": 90, "none": 30}


def merged_settings(value: Column, default: dict[str, int]) -> Column:
    """map of whole-number settings: those of a stored JSON object over the defaults, by key. Text that is no JSON counts as none stored."""
    known = F.create_map(*(F.lit(x) for pair in default.items() for x in pair))
    stored = F.when(F.try_parse_json(value).isNotNull(), F.transform_values(F.from_json(value, "map<string,string>"), lambda _, v: v.try_cast("int")))
    own = F.coalesce(stored, F.create_map().cast("map<string,int>"))
    return F.map_concat(F.map_filter(known, lambda k, _: ~F.map_contains_key(own, k)), own)


def flag_setting(value: Column) -> Column:
    """Whether a setting's text says yes."""
    return F.coalesce(F.lower(value).isin("true", "1", "yes"), F.lit(False))


def unread() -> Column:
    return F.coalesce(F.sum(F.when(~F.col("is_read"), 1).otherwise(0)), F.lit(0))


def dashboard(items: DataFrame, as_of: datetime) -> DataFrame:
    """All counts in one pass."""
    today, week = F.date_trunc("day", F.lit(as_of)), F.date_trunc("week", F.lit(as_of))
    shown = F.col("priority") != "none"
    when = lambda c: F.count_if(c)
    return items.agg(
        F.count("*").alias("total"), when(shown).alias("relevant"), when(shown & ~F.col("is_read")).alias("unread"), when(F.col("is_starred")).alias("starred"),
        when(F.col("priority") == "high").alias("high"), when(F.col("priority") == "medium").alias("medium"), when((F.col("priority") == "high") & ~F.col("is_read")).alias("high_unread"),
        when(F.col("fetched_at") >= today).alias("today"), when(F.col("fetched_at") >= week).alias("this_week"), when(F.col("is_archived")).alias("archived"),
    )


def by_source(items: DataFrame, channels: DataFrame, sources: DataFrame, as_of: datetime, days: int | None = None, priority: str | None = None) -> DataFrame:
    """Every source with its items under the filter, zero where there are none, and its channels.

    Items are filtered and counted by channel before any join, so only counts are joined.
    """
    kept = items
    if days is not None:
        kept = kept.filter(F.col("fetched_at") >= F.lit(as_of) - F.expr(f"INTERVAL '{days}' DAY"))
    if priority:
        kept = kept.filter(F.col("priority") == priority)
    per = kept.groupBy("channel_id").agg(F.count("*").alias("items"), unread().alias("unread"))
    owned = channels.select(F.col("id").alias("channel_id"), "source_id").join(per, "channel_id", "left")
    counts = owned.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("channels"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sources.select("id", "name").join(counts, "id", "left").select("id", "name", zero("items"), zero("unread"), zero("channels"))


def by_channel(items: DataFrame, channels: DataFrame, sources: DataFrame) -> DataFrame:
    per = items.groupBy("channel_id").agg(F.count("*").alias("items"), unread().alias("unread"))
    named = channels.select(F.col("id").alias("channel_id"), "source_id", F.col("name").alias("channel_name"), "connector_type").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    return named.join(per, "channel_id", "left").select("channel_id", "channel_name", "source_name", "connector_type", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("unread", F.lit(0)).alias("unread"))


def by_connector(items: DataFrame, channels: DataFrame) -> DataFrame:
    per = items.groupBy("channel_id").agg(F.count("*").alias("items"), unread().alias("unread"))
    return channels.select(F.col("id").alias("channel_id"), "connector_type").join(per, "channel_id", "left").groupBy("connector_type").agg(F.count_distinct("channel_id").alias("channels"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.coalesce(F.sum("unread"), F.lit(0)).alias("unread"))


def zero_filled(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Count of each of the values, zero for those that don't occur, in their order."""
    spark = rows.sparkSession
    every = spark.sql("SELECT pos, col AS " + column + " FROM (SELECT posexplode(array(" + ", ".join(f"'{v}'" for v in values) + ")))")
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return every.join(counts, column, "left").select(column, "pos", F.coalesce("n", F.lit(0)).alias("n"))


def topic_counts(items: DataFrame, since: Column) -> DataFrame:
    kept = items.filter((F.col("fetched_at") >= since) & F.col("similar_to_id").isNull() & (F.col("priority") != "none") & F.col("topic").isNotNull() & (F.col("topic") != "Sonstiges"))
    return kept.groupBy("topic").agg(F.count("*").alias("n"))


def donut(items: DataFrame, channels: DataFrame, sources: DataFrame, resolve_alerts: bool = True) -> DataFrame:
    """Items by source name; those of alert sources by channel name (or Unbekannt), marked; same names add up."""
    named = items.groupBy("channel_id").agg(F.count("*").alias("n")).join(channels.select(F.col("id").alias("channel_id"), "source_id", F.col("name").alias("channel_name")), "channel_id").join(sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name")), "source_id")
    alert = F.col("source_name").ilike("%google alert%") if resolve_alerts else F.lit(False)
    name = F.when(alert, F.coalesce("channel_name", F.lit("Unbekannt"))).otherwise(F.col("source_name"))
    return named.groupBy(name.alias("name")).agg(F.sum("n").alias("n"), F.bool_or(alert).alias("from_alerts"))


def top_and_rest(counts: DataFrame, keep: int = 10, rest: str = "Andere") -> DataFrame:
    """The largest `keep` names and the sum of all others under one name."""
    top = counts.orderBy(F.col("n").desc(), F.col("name")).limit(keep).select("name", "n")
    others = counts.join(top.select("name"), "name", "left_anti").agg(F.sum("n").alias("n")).filter("n IS NOT NULL").select(F.lit(rest).alias("name"), "n")
    return top.unionByName(others)


def retry_queue(items: DataFrame) -> DataFrame:
    return items.filter("needs_llm_processing").groupBy(F.coalesce("retry_priority", F.lit("unknown")).alias("retry_priority")).agg(F.count("*").alias("n"))


def analytics_summary(logs: DataFrame) -> DataFrame:
    return logs.groupBy("step_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence_score") < 0.5).alias("low_confidence"), F.count_if("priority_changed").alias("changed"),
        F.count_if(~F.col("success")).alias("errors"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"),
    )


def model_performance(logs: DataFrame) -> DataFrame:
    return logs.filter(F.col("model_name").isNotNull()).groupBy("model_name", "model_provider").agg(
        F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("avg_ms"), F.round(F.avg("confidence_score"), 6).alias("avg_confidence"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed")
    )


def duration_quantile(logs: DataFrame, q: float) -> DataFrame:
    return logs.filter(F.col("model_name").isNotNull()).groupBy("model_name").agg(F.round(F.percentile("duration_ms", q), 6).alias("ms"))


def disagreements(items: DataFrame, logs: DataFrame) -> DataFrame:
    """Items whose latest classifier and model results differ in priority or group; null never differs."""
    pick = lambda step, p: latest(logs.filter(F.col("step_type") == step), "item_id", "created_at", "id").select("item_id", F.col("priority_output").alias(f"{p}_priority"), F.col("ak_primary").alias(f"{p}_group"))
    both = pick("classifier", "classifier").join(pick("llm_analysis", "model"), "item_id")
    differs = (F.col("classifier_priority") != F.col("model_priority")) | (F.col("classifier_group") != F.col("model_group"))
    return both.filter(differs).join(items.select(F.col("id").alias("item_id"), "title"), "item_id")


def system_stats(items: DataFrame, as_of: datetime) -> DataFrame:
    recent = F.col("fetched_at") >= F.lit(as_of) - F.expr("INTERVAL '2' DAY")
    return items.agg(
        F.count_if("needs_llm_processing").alias("queued"), F.count_if(F.col("needs_llm_processing") & (F.col("retry_priority") == "high")).alias("queued_high"),
        F.count_if(recent & F.col("confidence").isNull()).alias("unclassified"), F.count_if(recent & F.col("similar_to_id").isNotNull()).alias("duplicates"), F.count_if(recent & F.col("summary").isNull()).alias("unprocessed"),
    )


def database_stats(items: DataFrame, channels: DataFrame) -> DataFrame:
    per = items.groupBy("channel_id", "priority").agg(F.count("*").alias("n"), F.count("summary").alias("with_summary"))
    return per.join(channels.select(F.col("id").alias("channel_id"), "connector_type"), "channel_id").groupBy("connector_type", F.coalesce("priority", F.lit("none")).alias("priority")).agg(F.sum("n").alias("n"), F.sum("with_summary").alias("with_summary"))


def expired(items: DataFrame, as_of: datetime, retention: dict[str, int] | None = None, keep_starred: bool = True) -> DataFrame:
    """Items fetched strictly before their priority's days; starred ones stay if asked for."""
    days = F.create_map(*(F.lit(x) for pair in (retention or DEFAULT_RETENTION).items() for x in pair))
    old = F.unix_timestamp("fetched_at") < F.unix_timestamp(F.lit(as_of)) - F.try_element_at(days, F.col("priority")) * 86400
    out = items.filter(old)
    return out.filter(~F.col("is_starred")) if keep_starred else out


def retention_preview(items: DataFrame, as_of: datetime) -> DataFrame:
    return expired(items, as_of).groupBy("priority").agg(F.count("*").alias("n"), F.min("fetched_at").alias("oldest"))


def per_day(items: DataFrame) -> DataFrame:
    return items.groupBy(F.to_date("fetched_at").alias("day")).agg(F.count("*").alias("n"))


def topic_groups(items: DataFrame, least: int) -> DataFrame:
    """Topics of at least so many primary items, with their size and their items' ids."""
    kept = items.filter(F.col("similar_to_id").isNull() & F.col("topic").isNotNull() & (F.col("topic") != "Sonstiges"))
    return kept.groupBy("topic").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("id")).alias("ids")).filter(F.col("n") >= least)


def ungrouped(items: DataFrame, groups: DataFrame) -> DataFrame:
    return items.filter(F.col("similar_to_id").isNull()).join(groups.select("topic"), "topic", "left_anti")


def logger_top(lines: DataFrame, keep: int = 10) -> DataFrame:
    return lines.groupBy(F.split_part("logger", F.lit("."), F.lit(1)).alias("prefix")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "prefix").limit(keep)


def length_stats(texts: DataFrame, column: str = "text") -> DataFrame:
    n = F.length(column)
    return texts.agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


def tag_histogram(rows: DataFrame, known: DataFrame, keep: int = 20) -> DataFrame:
    """The most frequent tags that the map doesn't know."""
    tags = rows.select(F.explode("tags").alias("tag")).select(F.lower(F.trim("tag")).alias("tag"))
    return tags.join(known, "tag", "left_anti").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "tag").limit(keep)


def changes(rows: DataFrame, old: str, new: str, keep: int | None = None) -> DataFrame:
    """Counts of "old -> new" of rows where they differ."""
    out = rows.filter(~F.col(old).eqNullSafe(F.col(new))).groupBy(F.concat_ws(" -> ", F.coalesce(F.col(old), F.lit("None")), F.coalesce(F.col(new), F.lit("None"))).alias("change")).agg(F.count("*").alias("n"))
    return out if keep is None else out.orderBy(F.col("n").desc(), "change").limit(keep)


def channels_by_type(channels: DataFrame) -> DataFrame:
    return channels.groupBy("connector_type").agg(F.count("*").alias("channels"), F.count_if("enabled").alias("enabled"), F.sort_array(F.collect_list("id")).alias("ids"))


def mean_ms(logs: DataFrame) -> DataFrame:
    return logs.agg(F.round(F.coalesce(F.try_divide(F.sum("duration_ms"), F.count("duration_ms")), F.lit(0.0)), 6).alias("mean_ms"), F.count("duration_ms").alias("timed"))


def cloud_size(counts: DataFrame) -> DataFrame:
    """Font sizes from 0.75 to 3, linear in the count; 1.5 where all counts are equal."""
    bounds = counts.agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    size = F.when(F.col("hi") == F.col("lo"), 1.5).otherwise(0.75 + (F.col("n") - F.col("lo")) / F.greatest(F.col("hi") - F.col("lo"), F.lit(1)) * 2.25)
    return counts.crossJoin(F.broadcast(bounds)).withColumn("size", F.round(size, 6)).drop("lo", "hi")


def briefing_groups(items: DataFrame) -> DataFrame:
    return zero_filled(items, "priority", PRIORITIES)


def ranked(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def fastest_proxies(proxies: DataFrame, keep: int, most_failures: int) -> DataFrame:
    """The keep proxies of least latency among those that haven't failed too often."""
    return proxies.filter(F.col("failures") < most_failures).orderBy("latency", "id").limit(keep)
