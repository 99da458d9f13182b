"""Counting queries: dashboards, analytics, retention, topics."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.operators import stats as S
from newsloom.operators.listing import latest
from newsloom.plans.model import AS_OF, Catalog

catalog = Catalog()
add = catalog.add
_SOURCE = """SELECT s.id, s.name, CAST(coalesce(sum(p.items), 0) AS BIGINT) AS items, CAST(coalesce(sum(p.unread), 0) AS BIGINT) AS unread, count(c.id) AS channels
FROM sources s LEFT JOIN channels c ON c.source_id = s.id LEFT JOIN (SELECT channel_id, count(*) AS items, sum(CASE WHEN NOT is_read THEN 1 ELSE 0 END) AS unread FROM items WHERE {w} GROUP BY 1) p ON p.channel_id = c.id GROUP BY s.id, s.name"""


@add("stats_by_source", "A03 J04 J05", _SOURCE.format(w="true"))
def _(m):
    return S.by_source(m.items, m.channels, m.sources, AS_OF)


@add("stats_by_source_filtered", "A03 J04", _SOURCE.format(w="priority = 'high' AND fetched_at >= TIMESTAMP '1998-08-02 15:30:00' - INTERVAL 500 DAY"))
def _(m):
    return S.by_source(m.items, m.channels, m.sources, AS_OF, 500, "high")


@add("stats_by_channel", "A05 J06", """SELECT c.id AS channel_id, c.name AS channel_name, s.name AS source_name, c.connector_type, count(i.id) AS items, CAST(sum(CASE WHEN NOT i.is_read THEN 1 ELSE 0 END) AS BIGINT) AS unread
FROM channels c JOIN sources s ON c.source_id = s.id LEFT JOIN items i ON i.channel_id = c.id GROUP BY ALL""")
def _(m):
    return S.by_channel(m.items, m.channels, m.sources)


@add("stats_by_connector", "A06 J06", "SELECT c.connector_type, count(DISTINCT c.id) AS channels, count(i.id) AS items, CAST(sum(CASE WHEN NOT i.is_read THEN 1 ELSE 0 END) AS BIGINT) AS unread FROM channels c LEFT JOIN items i ON i.channel_id = c.id GROUP BY 1")
def _(m):
    return S.by_connector(m.items, m.channels)


@add("dashboard_counts", "A01 X37", """SELECT count(*) AS total, count(*) FILTER (priority <> 'none') AS relevant, count(*) FILTER (priority <> 'none' AND NOT is_read) AS unread, count(*) FILTER (is_starred) AS starred,
count(*) FILTER (priority = 'high') AS high, count(*) FILTER (priority = 'medium') AS medium, count(*) FILTER (priority = 'high' AND NOT is_read) AS high_unread,
count(*) FILTER (fetched_at >= date_trunc('day', TIMESTAMP '1998-07-30 15:30:00')) AS today, count(*) FILTER (fetched_at >= date_trunc('week', TIMESTAMP '1998-07-30 15:30:00')) AS this_week, count(*) FILTER (is_archived) AS archived FROM items""")
def _(m):
    return S.dashboard(m.items, datetime(1998, 7, 30, 15, 30))


@add("priority_zero_filled", "A07 A25 A28", "SELECT p.priority, CAST(p.pos AS INTEGER) AS pos, count(i.id) AS n FROM (VALUES ('high', 0), ('medium', 1), ('low', 2), ('none', 3), ('critical', 4)) p(priority, pos) LEFT JOIN items i ON i.priority = p.priority GROUP BY ALL")
def _(m):
    return S.zero_filled(m.items, "priority", ["high", "medium", "low", "none", "critical"])


@add("topic_counts", "A02", "SELECT topic, count(*) AS n FROM items WHERE fetched_at >= TIMESTAMP '1997-06-01' AND similar_to_id IS NULL AND priority <> 'none' AND topic <> 'Sonstiges' GROUP BY 1")
def _(m):
    return S.topic_counts(m.items, F.lit(datetime(1997, 6, 1)))


@add("topic_cloud", "T07 A02", """WITH c AS (SELECT topic AS name, count(*) AS n FROM items WHERE topic IS NOT NULL GROUP BY 1), b AS (SELECT min(n) AS lo, max(n) AS hi FROM c)
SELECT name, n, round(CASE WHEN lo = hi THEN 1.5 ELSE 0.75 + CAST(n - lo AS DOUBLE) / (hi - lo) * 2.25 END, 6) AS size FROM c, b""")
def _(m):
    return S.cloud_size(m.items.filter("topic IS NOT NULL").groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("n")))


_DONUT = """WITH d AS (SELECT CASE WHEN s.name ILIKE '%google alert%' THEN coalesce(c.name, 'Unbekannt') ELSE s.name END AS name, s.name ILIKE '%google alert%' AS a, count(*) AS n
FROM items i JOIN channels c ON i.channel_id = c.id JOIN sources s ON c.source_id = s.id GROUP BY ALL), e AS (SELECT name, CAST(sum(n) AS BIGINT) AS n, bool_or(a) AS from_alerts FROM d GROUP BY 1) """


@add("source_donut", "A04 J03", _DONUT + "SELECT name, n, from_alerts FROM e")
def _(m):
    return S.donut(m.items, m.channels, m.sources)


@add("donut_top_and_rest", "T04", "WITH c AS (SELECT source AS name, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, name) AS place FROM c) SELECT CASE WHEN place <= 10 THEN name ELSE 'Andere' END AS name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1", model=False)
def _(m):
    return S.top_and_rest(m.table("documents").groupBy(F.col("source").alias("name")).agg(F.count("*").alias("n")))


@add("retry_queue", "A08", "SELECT coalesce(retry_priority, 'unknown') AS retry_priority, count(*) AS n FROM items WHERE needs_llm_processing GROUP BY 1")
def _(m):
    return S.retry_queue(m.items)


_LOGS = "(SELECT *, coalesce(priority_input <> priority_output, false) AS priority_changed FROM logs)"


def _changed(m):
    return m.logs.withColumn("priority_changed", F.coalesce(F.col("priority_input") != F.col("priority_output"), F.lit(False)))


@add("analytics_summary", "A09 F07", f"SELECT step_type, count(*) AS n, count(*) FILTER (confidence_score < 0.5) AS low_confidence, count(*) FILTER (priority_changed) AS changed, count(*) FILTER (NOT success) AS errors, round(avg(duration_ms), 6) AS avg_ms FROM {_LOGS} GROUP BY 1")
def _(m):
    return S.analytics_summary(_changed(m))


@add("model_performance", "A10", "SELECT model_name, model_provider, count(*) AS n, round(avg(duration_ms), 6) AS avg_ms, round(avg(confidence_score), 6) AS avg_confidence, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed FROM logs WHERE model_name IS NOT NULL GROUP BY ALL")
def _(m):
    return S.model_performance(m.logs)


@add("duration_p95", "A11", "SELECT model_name, round(quantile_cont(duration_ms, 0.95), 6) AS ms FROM logs WHERE model_name IS NOT NULL GROUP BY 1")
def _(m):
    return S.duration_quantile(m.logs, 0.95)


@add("mean_processing_time", "A28", "SELECT round(avg(duration_ms), 6) AS mean_ms, count(duration_ms) AS timed FROM logs")
def _(m):
    return S.mean_ms(m.logs)


_LATEST = "SELECT DISTINCT ON (item_id) item_id, priority_output, ak_primary FROM logs WHERE step_type = '{s}' ORDER BY item_id, created_at DESC, id DESC"


@add("latest_per_key", "W01", "SELECT DISTINCT ON (item_id) item_id, id, step_type FROM logs ORDER BY item_id, created_at DESC, id DESC")
def _(m):
    return latest(m.logs, "item_id", "created_at", "id").select("item_id", "id", "step_type")


@add("disagreements", "J07 W01", f"WITH a AS ({_LATEST.format(s='classifier')}), b AS ({_LATEST.format(s='llm_analysis')}) SELECT a.item_id, a.priority_output AS classifier_priority, b.priority_output AS model_priority, a.ak_primary AS classifier_group, b.ak_primary AS model_group, i.title FROM a JOIN b USING (item_id) JOIN items i ON i.id = a.item_id WHERE a.priority_output <> b.priority_output OR a.ak_primary <> b.ak_primary")
def _(m):
    return S.disagreements(m.items, m.logs)


@add("system_stats", "A12", """SELECT count(*) FILTER (needs_llm_processing) AS queued, count(*) FILTER (needs_llm_processing AND retry_priority = 'high') AS queued_high, count(*) FILTER (r AND confidence IS NULL) AS unclassified, count(*) FILTER (r AND similar_to_id IS NOT NULL) AS duplicates, count(*) FILTER (r AND summary IS NULL) AS unprocessed
FROM (SELECT *, fetched_at >= TIMESTAMP '1998-07-20' - INTERVAL 2 DAY AS r FROM items)""")
def _(m):
    return S.system_stats(m.items, datetime(1998, 7, 20))


@add("database_stats", "A13 A15", "SELECT connector_type, coalesce(priority, 'none') AS priority, count(*) AS n, count(summary) AS with_summary FROM items i JOIN channels c ON i.channel_id = c.id GROUP BY ALL")
def _(m):
    return S.database_stats(m.items, m.channels)


_OLD = "fetched_at < TIMESTAMP '1998-08-02 15:30:00' - INTERVAL 1 DAY * (CASE priority WHEN 'high' THEN 365 WHEN 'medium' THEN 180 WHEN 'low' THEN 90 WHEN 'none' THEN 30 END) AND NOT is_starred"


@add("retention_preview", "A14 K21", f"SELECT priority, count(*) AS n, min(fetched_at) AS oldest FROM items WHERE {_OLD} GROUP BY 1")
def _(m):
    return S.retention_preview(m.items, AS_OF)


@add("retention_apply", "K21 K15 R09 J10", f"SELECT id, priority FROM items WHERE NOT coalesce({_OLD}, false)")
def _(m):
    return m.items.join(S.expired(m.items, AS_OF).select("id"), "id", "left_anti").select("id", "priority")


@add("event_retention", "K22 R09", "SELECT count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-07-10' - INTERVAL 180 DAY", model=False)
def _(m):
    return m.table("events").filter(F.col("ts") >= F.lit(datetime(2024, 7, 10)) - F.expr("INTERVAL '180' DAY")).agg(F.count("*").alias("n"))


@add("items_per_day", "A16", "SELECT CAST(fetched_at AS DATE) AS day, count(*) AS n FROM items GROUP BY 1")
def _(m):
    return S.per_day(m.items)


@add("topic_groups", "A17", "SELECT topic, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum FROM items WHERE similar_to_id IS NULL AND topic <> 'Sonstiges' GROUP BY 1 HAVING count(*) >= 3")
def _(m):
    g = S.topic_groups(m.items, 3)
    return g.select("topic", "n", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))


@add("topic_ungrouped", "A17", "SELECT id FROM items WHERE similar_to_id IS NULL AND (topic IS NULL OR topic NOT IN (SELECT topic FROM items WHERE similar_to_id IS NULL AND topic <> 'Sonstiges' GROUP BY 1 HAVING count(*) >= 3))")
def _(m):
    return S.ungrouped(m.items, S.topic_groups(m.items, 3)).select("id")


@add("log_levels", "A18", "SELECT split_part(c_name, '#', 1) AS prefix, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, prefix LIMIT 10", model=False)
def _(m):
    return S.logger_top(m.table("customer").select(F.replace("c_name", F.lit("#"), F.lit(".")).alias("logger")))


@add("dataset_stats", "A19 A20", "SELECT lang, count(*) AS n, CAST(min(length(text)) AS INTEGER) AS shortest, CAST(max(length(text)) AS INTEGER) AS longest, round(avg(length(text)), 6) AS mean FROM documents GROUP BY 1", model=False)
def _(m):
    n = F.length("text")
    return m.table("documents").groupBy("lang").agg(F.count("*").alias("n"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean"))


@add("tag_histogram", "A21", "SELECT tag, count(*) AS n FROM (SELECT lower(trim(unnest(string_split(text, ' ')))) AS tag FROM documents) WHERE tag NOT IN ('the', 'of') GROUP BY 1 ORDER BY n DESC, tag LIMIT 20", model=False)
def _(m):
    known = m.spark.createDataFrame([("the",), ("of",)], "tag string")
    return S.tag_histogram(m.table("documents").select(F.split("text", " ").alias("tags")), known)


@add("change_counts", "A22", "SELECT coalesce(priority_input, 'None') || ' -> ' || coalesce(priority_output, 'None') AS change, count(*) AS n FROM logs WHERE priority_input IS DISTINCT FROM priority_output GROUP BY 1 ORDER BY n DESC, change LIMIT 10")
def _(m):
    return S.changes(m.logs, "priority_input", "priority_output", 10)


@add("channels_by_type", "A24", "SELECT connector_type, count(*) AS channels, count(*) FILTER (enabled) AS enabled, string_agg(CAST(id AS STRING), ',' ORDER BY id) AS ids FROM channels GROUP BY 1")
def _(m):
    return S.channels_by_type(m.channels).withColumn("ids", F.array_join("ids", ","))


@add("non_blank_lines", "A29", "SELECT doc_id, CAST(len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')) AS INTEGER) AS lines FROM documents", model=False)
def _(m):
    return m.table("documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).alias("lines"))


@add("fastest_proxies", "T06", "SELECT p_partkey AS id FROM part WHERE p_size < 30 ORDER BY p_retailprice, p_partkey LIMIT 20", model=False)
def _(m):
    proxies = m.table("part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("latency"), F.col("p_size").alias("failures"))
    return S.fastest_proxies(proxies, 20, 30).select("id")
