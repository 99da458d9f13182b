"""Changes as functions from one snapshot to the next, with the events they cause."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.urls import identifier
from newsloom.operators.listing import latest
from newsloom.shared import settled


def with_ids(new: DataFrame, old: DataFrame, order: str, key: str = "id") -> DataFrame:
    """new rows with ids that follow the largest id of old, in the given order.

    Rows are numbered within ranges of the order and the ranges' sizes added up, so no task sees all. Ranges are
    named once and kept, as Spark may cut them anew each time that they are computed.
    """
    top = old.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    parts = settled(new.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    # One row a range, and one row: both bounded by the number of partitions.
    return parts.withColumn("_place", place).join(F.broadcast(before), "_part").crossJoin(F.broadcast(top)).withColumn(key, F.col("_top") + F.col("_before") + F.col("_place")).drop("_part", "_place", "_before", "_top")


def events(rows: DataFrame, kind: str, at: datetime, item: str = "id", data: Column | None = None) -> DataFrame:
    return rows.select(F.col(item).alias("item_id"), F.lit(kind).alias("event_type"), F.lit(at).alias("timestamp"), (data if data is not None else F.lit(None).cast("string")).alias("data"))


def log_entries(rows: DataFrame, step: str, order: int, at: datetime) -> DataFrame:
    """Processing-log rows; a priority changed if both are known and differ."""
    changed = F.coalesce(F.col("priority_input") != F.col("priority_output"), F.lit(False))
    return rows.withColumns({"step_type": F.lit(step), "step_order": F.lit(order), "priority_changed": changed, "created_at": F.lit(at)})


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new rows replace old ones of the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def add_absent(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.unionByName(new.join(old.select(key), key, "left_anti"))


def without_nulls(metadata: Column) -> Column:
    return F.map_filter(metadata, lambda _, v: v.isNotNull())


def without(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def patched(rows: DataFrame, patch: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """rows with non-null fields of patch put in; reviewed is set where priority or the set of groups changed."""
    p = patch.select(key, *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_patched"))
    both = rows.join(p, key, "left")
    ordered = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    moved = F.lit(False)
    if "priority" in fields:
        moved = moved | (F.col("_priority").isNotNull() & ~F.col("_priority").eqNullSafe(F.col("priority")))
    if "assigned_aks" in fields:
        moved = moved | (F.col("_assigned_aks").isNotNull() & (ordered(F.col("_assigned_aks")) != ordered(F.col("assigned_aks"))))
    out = both.withColumn("is_manually_reviewed", F.coalesce("is_manually_reviewed", F.lit(False)) | moved) if "is_manually_reviewed" in rows.columns else both
    return out.withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).drop("_patched", *(f"_{f}" for f in fields))


def marked(rows: DataFrame, field: str, value: Column, where: Column) -> DataFrame:
    return rows.withColumn(field, F.when(where, value).otherwise(F.col(field)))


def flagged_for_model(items: DataFrame) -> DataFrame:
    """items where those without a summary wait for the model; those with one keep their flag."""
    return marked(items, "needs_llm_processing", F.lit(True), F.col("summary").isNull())


def without_key(metadata: Column, key: str) -> Column:
    """A JSON object as text without a key; other values keep their types, and what is no object stays as it is."""
    parts = F.from_json(metadata, "map<string,variant>")
    return F.when(F.map_contains_key(parts, key), F.to_json(F.map_filter(parts, lambda k, _: k != key))).otherwise(metadata)


def reanalysed(items: DataFrame, answers: DataFrame) -> DataFrame:
    """items with a model's answers (id, summary, priority, assigned_aks) written in; items without one stay.

    A blank summary and an empty list of groups leave what was there. The model's scale is one step above the
    items': critical is high, high is medium, medium is low, all else is none. What was answered waits no more.
    """
    said = answers.select("id", F.lit(True).alias("_said"), F.nullif("summary", F.lit("")).alias("_summary"), F.col("priority").alias("_priority"), F.when(F.size("assigned_aks") > 0, F.col("assigned_aks")).alias("_groups"))
    step = F.when(F.col("_priority") == "critical", "high").when(F.col("_priority") == "high", "medium").when(F.col("_priority") == "medium", "low").otherwise("none")
    both = items.join(said, "id", "left")
    new = {
        "summary": F.coalesce("_summary", "summary"), "priority": F.when(F.col("_said"), step).otherwise(F.col("priority")),
        "assigned_ak": F.coalesce(F.try_element_at("_groups", F.lit(1)), "assigned_ak"), "needs_llm_processing": F.col("needs_llm_processing") & F.col("_said").isNull(),
    }
    if "assigned_aks" in items.columns:
        new["assigned_aks"] = F.coalesce("_groups", "assigned_aks")
    return both.withColumns(new).drop("_said", "_summary", "_priority", "_groups")


def archive_group(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Ids of the given items, their primaries, the primaries' other duplicates and their own: one hop, no further."""
    chosen = items.join(ids.select("id"), "id", "left_semi").select("id", "similar_to_id")
    primary = chosen.filter("similar_to_id IS NOT NULL").select(F.col("similar_to_id").alias("id"))
    links = items.filter("similar_to_id IS NOT NULL").select("id", "similar_to_id")
    siblings = links.join(primary.select(F.col("id").alias("similar_to_id")), "similar_to_id", "left_semi").select("id")
    children = links.join(chosen.select(F.col("id").alias("similar_to_id")), "similar_to_id", "left_semi").select("id")
    return chosen.select("id").unionByName(primary).unionByName(siblings).unionByName(children).distinct().join(items.select("id"), "id", "left_semi")


def deleted_items(items: DataFrame, before: datetime | None = None, source_channels: DataFrame | None = None, priority: str | None = None) -> DataFrame:
    """Items that a delete removes: starred ones never go. A delete of "low" items removes priority none."""
    out = items.filter(~F.col("is_starred"))
    if before is not None:
        out = out.filter(F.col("fetched_at") < F.lit(before))
    if source_channels is not None:
        out = out.join(source_channels.select(F.col("id").alias("channel_id")), "channel_id", "left_semi")
    return out if priority is None else out.filter(F.col("priority") == ("none" if priority == "low" else priority))


def cascade(items: DataFrame, logs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """items and their logs after the deletion of gone: children lose their link, logs go."""
    kept = without(items, gone)
    dead = gone.select(F.col("id").alias("similar_to_id"), F.lit(True).alias("_dead"))
    kept = kept.join(dead, "similar_to_id", "left").withColumn("similar_to_id", F.when(F.col("_dead").isNull(), F.col("similar_to_id"))).drop("_dead")
    return kept, logs.join(gone.select(F.col("id").alias("item_id")), "item_id", "left_anti")


def imported(old: DataFrame, new: DataFrame, natural: list[str], replace: bool) -> DataFrame:
    """Configuration rows after an import: all new ones, or the old with the new ones of unknown natural key."""
    return new if replace else old.unionByName(new.join(old.select(*natural), natural, "left_anti"))


def restructured(legacy: DataFrame, organisation: Column) -> tuple[DataFrame, DataFrame]:
    """sources and channels from rows that were both: one source per organisation, every row a channel."""
    named = legacy.withColumn("organisation", organisation)
    sources = named.groupBy("organisation").agg(F.bool_or("is_stakeholder").alias("is_stakeholder"), F.bool_or("enabled").alias("enabled"), F.min("created_at").alias("created_at"), F.min("id").alias("id"))
    channels = named.join(sources.select("organisation", F.col("id").alias("source_id")), "organisation").select("id", "source_id", "name", "connector_type", "enabled")
    return sources, channels


def add_channels(channels: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, conflicts) of new channels by source, connector and identifier."""
    own = new.withColumn("source_identifier", identifier(F.col("connector_type"), F.col("config")))
    key = ["source_id", "connector_type", "source_identifier"]
    known = channels.select(*key)
    return own.join(known, key, "left_anti"), own.join(known, key, "left_semi")


def reordered(rules: DataFrame, places: DataFrame) -> DataFrame:
    return rules.join(places.select("id", F.col("order").alias("_order")), "id", "left").withColumn("order", F.coalesce("_order", "order")).drop("_order")


def new_message(messages: DataFrame, new: DataFrame) -> DataFrame:
    return messages.withColumn("active", F.lit(False)).unionByName(new)


def newest(rows: DataFrame, key: str, at: str, last: str) -> DataFrame:
    return latest(rows, key, at, last)


def training_records(items: DataFrame, least: float = 0.0, size: int = 2000) -> DataFrame:
    """Items with a summary as labelled records; relevant above a score of 0.5."""
    kept = items.filter(F.col("summary").isNotNull() & (F.col("relevance_score") >= least))
    return kept.select(
        F.struct("title", F.substring("content", 1, size).alias("content"), F.col("source_name").alias("source"), F.date_format("published_at", "yyyy-MM-dd").alias("date")).alias("input"),
        F.struct((F.col("relevance_score") > 0.5).alias("relevant"), "priority", F.col("assigned_ak").alias("ak"), F.coalesce("assigned_aks", F.when(F.col("assigned_ak").isNotNull(), F.array("assigned_ak")).otherwise(F.array().cast("array<string>"))).alias("aks")).alias("labels"),
        F.struct(F.lit("production").alias("source_type"), F.col("id").alias("item_id")).alias("provenance"),
    )


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def briefing_text(items: DataFrame) -> DataFrame:
    """One text a priority, lines by score, for the items that a briefing selects (see `listing.briefing`), at most some hundreds."""
    line = F.format_string("- %s (%d)", F.col("title"), F.col("priority_score"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("priority_score")).alias("s"), "id", line.alias("line"))))
    return items.groupBy("priority").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n"))
