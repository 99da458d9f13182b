"""Selections of items, sources and channels: filters, joins, order and pages."""

from __future__ import annotations

import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.text import priority_order, priority_rank


def search(text: str, *columns: str) -> Column:
    """Any column holds the text, case ignored; % and _ in it stay wildcards."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(f"%{text}%")
    return found


def in_group(*groups: str) -> Column:
    """One of the groups among an item's, as its first, or as the model's."""
    wanted = F.array(*map(F.lit, groups))
    return F.coalesce(F.arrays_overlap("assigned_aks", wanted), F.lit(False)) | F.coalesce(F.col("assigned_ak").isin(*groups), F.lit(False)) | F.coalesce(F.get_json_object("metadata", "$.llm_analysis.assigned_ak").isin(*groups), F.lit(False))


def list_items(
    items: DataFrame, channels: DataFrame, as_of: datetime | None = None, source_id: int | None = None, channel_id: int | None = None, priority: str | None = None, relevant_only: bool = True,
    is_read: bool | None = None, is_starred: bool | None = None, is_archived: bool | None = False, days: int | None = None, since: datetime | None = None, until: datetime | None = None,
    text: str | None = None, connector_type: str | None = None, group: str | None = None, group_duplicates: bool = False,
) -> DataFrame:
    """Items under all filters given. Without a priority, relevant_only leaves out none and null."""
    out = items
    if channel_id is not None:
        out = out.filter(F.col("channel_id") == channel_id)
    elif source_id is not None:
        out = out.join(channels.filter(F.col("source_id") == source_id).select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    if priority:
        out = out.filter(F.col("priority").isin(*[p.strip() for p in priority.split(",")]))
    elif relevant_only:
        out = out.filter(F.col("priority") != "none")
    for name, wanted in (("is_read", is_read), ("is_starred", is_starred), ("is_archived", is_archived)):
        if wanted is not None:
            out = out.filter(F.col(name) == wanted)
    if days is not None:
        out = out.filter(F.col("fetched_at") >= F.lit(as_of) - F.expr(f"INTERVAL '{days}' DAY"))
    if since is not None:
        out = out.filter(F.col("published_at") >= F.lit(since))
    if until is not None:
        out = out.filter(F.col("published_at") <= F.lit(until))
    if text:
        out = out.filter(search(text, "title", "content"))
    if connector_type:
        out = out.join(channels.filter(F.col("connector_type") == connector_type).select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    if group:
        out = out.filter(in_group(*group.split(",")))
    return out.filter(F.col("similar_to_id").isNull()) if group_duplicates else out


def sorted_items(items: DataFrame, by: str = "date", descending: bool = True) -> list[Column]:
    """Order columns with id as the last; nulls first when descending and last when ascending."""
    if by == "priority":
        # Descending priority is ascending place: high comes first.
        place = priority_order(F.col("priority"))
        return [place.asc() if descending else place.desc(), F.col("published_at").desc_nulls_first(), F.col("id").desc()]
    key = F.col("source_name" if by == "source" else "published_at")
    return [key.desc_nulls_first() if descending else key.asc_nulls_last(), F.col("id").desc() if descending else F.col("id").asc()]


def page(items: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page of the order, with each row's place; only the page's rows and those before it are sorted whole."""
    return items.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(items: DataFrame, size: int) -> DataFrame:
    return items.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size))


def with_names(items: DataFrame, channels: DataFrame, sources: DataFrame) -> DataFrame:
    """items with channel_name, connector_type, source_id and source_name, null where there is none."""
    c = channels.select(F.col("id").alias("channel_id"), F.col("name").alias("channel_name"), "connector_type", "source_id")
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    return items.join(c, "channel_id", "left").join(s, "source_id", "left")


def with_duplicates(items: DataFrame) -> DataFrame:
    """Items that are no duplicate, with the ids of their duplicates in order."""
    children = items.filter(F.col("similar_to_id").isNotNull()).groupBy(F.col("similar_to_id").alias("id")).agg(F.sort_array(F.collect_list(F.col("id"))).alias("duplicates"))
    return items.filter(F.col("similar_to_id").isNull()).join(children, "id", "left").withColumn("duplicates", F.coalesce("duplicates", F.array().cast("array<bigint>")))


def list_sources(sources: DataFrame, channels: DataFrame, enabled: bool | None = None, is_stakeholder: bool | None = None, has_errors: bool | None = None) -> DataFrame:
    out = sources
    if enabled is not None:
        out = out.filter(F.col("enabled") == enabled)
    if is_stakeholder is not None:
        out = out.filter(F.col("is_stakeholder") == is_stakeholder)
    if has_errors is not None:
        bad = channels.filter(F.col("last_error").isNotNull()).select(F.col("source_id").alias("id"))
        out = out.join(bad, "id", "left_semi" if has_errors else "left_anti")
    return out


def due_channels(channels: DataFrame, sources: DataFrame, as_of: datetime) -> DataFrame:
    on = sources.filter("enabled").select(F.col("id").alias("source_id"))
    due = F.col("last_fetch_at").isNull() | (F.unix_timestamp("last_fetch_at") + F.col("fetch_interval_minutes") * 60 < F.unix_timestamp(F.lit(as_of)))
    return channels.filter(F.col("enabled") & due).join(on, "source_id", "left_semi")


def unclassified(items: DataFrame) -> DataFrame:
    return items.filter(F.col("confidence").isNull())


def unchecked_duplicates(items: DataFrame, as_of: datetime, days: int) -> DataFrame:
    out = items.filter(F.col("similar_to_id").isNull() & ~F.coalesce("duplicate_checked", F.lit(False)))
    return out.filter(F.col("fetched_at") >= F.lit(as_of) - F.expr(f"INTERVAL '{days}' DAY")) if days else out


def unindexed(items: DataFrame) -> DataFrame:
    return items.filter(~F.coalesce("indexed", F.lit(False)))


def backlog(items: DataFrame, worker: bool = True) -> DataFrame:
    """Classified items that wait for the slow model, with their rank.

    The worker keeps a null retry priority and ranks high, edge_case, low, else; the scheduler drops
    null and ranks high, unknown, edge_case, low.
    """
    retry = F.col("retry_priority")
    waiting = F.col("needs_llm_processing") & F.col("confidence").isNotNull()
    if worker:
        rank = F.when(retry == "high", 1).when(retry == "edge_case", 2).when(retry == "low", 3).otherwise(4)
        return items.filter(waiting & (retry.isNull() | (retry != "low"))).withColumn("rank", rank)
    rank = F.when(retry == "high", 1).when(retry == "unknown", 2).when(retry == "edge_case", 3).otherwise(4)
    return items.filter(F.col("needs_llm_processing") & (retry != "low")).withColumn("rank", rank)


def to_reprocess(items: DataFrame, channels: DataFrame, source_id: int | None = None, connector_type: str | None = None, exclude_low: bool = False, without_analysis: bool = False) -> DataFrame:
    out = items
    if source_id is not None or connector_type is not None:
        wanted = channels
        if source_id is not None:
            wanted = wanted.filter(F.col("source_id") == source_id)
        if connector_type is not None:
            wanted = wanted.filter(F.col("connector_type") == connector_type)
        out = out.join(wanted.select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    if exclude_low:
        out = out.filter(~F.col("priority").isin("low", "none"))
    return out.filter(F.col("summary").isNull()) if without_analysis else out


def unprocessed(items: DataFrame) -> DataFrame:
    return items.filter(F.col("summary").isNull() | (F.col("summary") == ""))


def confidence_band(logs: DataFrame, items: DataFrame, low: float, high: float, step: str | None = None) -> DataFrame:
    out = logs.filter(F.col("confidence_score").between(low, high))
    if step:
        out = out.filter(F.col("step_type") == step)
    return out.join(items.select(F.col("id").alias("item_id"), "title", "priority"), "item_id")


def briefing(items: DataFrame, since: datetime, least: str = "low", include_read: bool = False) -> DataFrame:
    out = items.filter((F.col("fetched_at") >= F.lit(since)) & (priority_rank(F.col("priority")) >= priority_rank(F.lit(least))))
    return out if include_read else out.filter(~F.col("is_read"))


def message_of_the_day(messages: DataFrame, as_of: datetime) -> DataFrame:
    live = messages.filter(F.col("active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(as_of))))
    return live.orderBy(F.col("updated_at").desc(), F.col("id").desc()).limit(1)


def log_lines(lines: DataFrame, level: str | None = None, logger: str | None = None, text: str | None = None) -> DataFrame:
    out = lines
    if level:
        out = out.filter(F.col("level") == level)
    if logger:
        out = out.filter(F.contains("logger", F.lit(logger)))
    return out.filter(F.contains(F.lower("message"), F.lit(text.lower()))) if text else out


def health(scheduler: Column, database: Column) -> Column:
    return F.when(~database, "unhealthy").when(~scheduler, "degraded").otherwise("healthy")


def worker_alerts(workers: DataFrame) -> DataFrame:
    """name, severity of workers that stopped: error after errors, else warning."""
    severity = F.when(F.col("stopped_due_to_errors"), "error").when(~F.col("running"), "warning")
    return workers.select("name", severity.alias("severity")).filter("severity IS NOT NULL")


def redacted(config: Column, words: list[str]) -> Column:
    """A string map with the values of keys that hold any of the words hidden; empty values stay."""
    pattern = "|".join(words)
    return F.transform_values(config, lambda k, v: F.when(F.rlike(F.lower(k), F.lit(pattern)) & (v != ""), "<REDACTED>").otherwise(v))


def config_problems(sources: DataFrame, channels: DataFrame, rules: DataFrame, version: str, kinds: list[str], current: str = "1.0") -> DataFrame:
    """(path, severity, message) of what is wrong with a configuration before it is imported.

    sources: place and name; channels: source, place, connector_type and config (a map); rules: place, name, rule_type
    and pattern. Names that come again (case ignored), values left redacted and broken patterns are errors; unknown
    connectors and another version are warnings.
    """

    def again(rows: DataFrame, what: str) -> DataFrame:
        first = rows.groupBy(F.lower("name").alias("_name")).agg(F.min("place").alias("_first"))
        later = rows.withColumn("_name", F.lower("name")).join(first, "_name").filter(F.col("place") > F.col("_first"))
        return later.select(F.format_string(f"{what}s[%d].name", "place").alias("path"), F.lit("error").alias("severity"), F.format_string(f"Duplicate {what} name: '%s'", "name").alias("message"))

    at = F.format_string("sources[%d].channels[%d]", "source", "place")
    unknown = channels.filter(~F.col("connector_type").isin(*kinds)).select(F.concat(at, F.lit(".connector_type")).alias("path"), F.lit("warning").alias("severity"), F.format_string("Unknown connector type: '%s'", "connector_type").alias("message"))
    left = channels.select(at.alias("at"), F.explode(F.map_keys(F.map_filter("config", lambda _, v: v == "<REDACTED>"))).alias("key"))
    left = left.select(F.concat("at", F.lit(".config."), "key").alias("path"), F.lit("error").alias("severity"), F.format_string("Redacted value not replaced: '%s'", "key").alias("message"))
    broken = rules.filter(F.col("rule_type") == "regex").withColumn("_why", regex_error("pattern")).filter("_why IS NOT NULL")
    broken = broken.select(F.format_string("rules[%d].pattern", "place").alias("path"), F.lit("error").alias("severity"), F.concat(F.lit("Invalid regex pattern: "), "_why").alias("message"))
    other = sources.sparkSession.range(1).filter(F.lit(version != current)).select(F.lit("version").alias("path"), F.lit("warning").alias("severity"), F.lit(f"Config version '{version}' differs from current '{current}'").alias("message"))
    return again(sources, "source").unionByName(again(rules, "rule")).unionByName(unknown).unionByName(left).unionByName(broken).unionByName(other)


def regex_error(pattern: Column | str) -> Column:
    """Why a pattern doesn't compile, else null."""

    def why(pattern: str | None) -> str | None:
        try:
            re.compile(pattern or "")
        except re.error as e:
            return str(e)
        return None

    @F.pandas_udf(T.StringType())
    def each(patterns: pd.Series) -> pd.Series:
        return patterns.map(why)

    return each(pattern)


# Words of keys whose values are never exported.
SENSITIVE = ["api_key", "api_secret", "password", "secret", "token", "access_token", "refresh_token", "cookie", "cookies", "auth", "authorization", "credentials", "private_key"]


def latest(rows: DataFrame, key: str | list[str], *newest: str) -> DataFrame:
    """The last row of each key by the given columns, of which the last must be unique; a null is older than any value.
    An aggregate that combines before the shuffle, so a hot key is one row a task."""
    keys = [key] if isinstance(key, str) else key
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.max_by(whole, F.struct(*newest)).alias("_row")).select("_row.*")
