"""Queries over items, sources and channels."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions.text import priority_order, priority_rank
from newsloom.functions.urls import display_name, identifier
from newsloom.operators import listing as L
from newsloom.plans.model import AS_OF, Catalog
from newsloom.sources import feeds  # noqa: F401  (registers the connectors)
from newsloom.sources.registry import kinds

catalog = Catalog()
add = catalog.add
_CH = "SELECT id FROM channels"


@add("items_list_default", "F01 T02 J01", "SELECT id, priority, title FROM items WHERE priority <> 'none' AND NOT is_archived AND fetched_at >= TIMESTAMP '1998-08-02 15:30:00' - INTERVAL 400 DAY")
def _(m):
    return L.list_items(m.items, m.channels, as_of=AS_OF, days=400).select("id", "priority", "title")


@add("items_list_filtered", "F01 F02", f"SELECT id, title FROM items WHERE channel_id IN ({_CH} WHERE source_id BETWEEN 0 AND 24 AND connector_type = 'rss') AND priority IN ('high', 'medium') AND NOT is_read AND NOT is_archived AND similar_to_id IS NULL AND published_at >= TIMESTAMP '1996-01-01' AND published_at <= TIMESTAMP '1997-12-31'")
def _(m):
    return L.list_items(m.items, m.channels, priority="high,medium", is_read=False, connector_type="rss", since=datetime(1996, 1, 1), until=datetime(1997, 12, 31), group_duplicates=True).select("id", "title")


@add("items_by_source", "F01 J01", f"SELECT id, priority FROM items WHERE channel_id IN ({_CH} WHERE source_id = (SELECT min(source_id) FROM channels WHERE id <= 10)) AND priority <> 'none' AND NOT is_archived")
def _(m):
    first = m.channels.filter("id <= 10").agg(F.min("source_id")).first()[0]
    return L.list_items(m.items, m.channels, source_id=first).select("id", "priority")


@add("items_search", "F02 F25", "SELECT doc_id, lang FROM documents WHERE text ILIKE '%tion the_%' OR source ILIKE '%tion the_%'", model=False)
def _(m):
    return m.table("documents").filter(L.search("tion the_", "text", "source")).select("doc_id", "lang")


@add("items_page_by_priority", "T01 T02 F25", """WITH kept AS (SELECT id, priority, published_at FROM items WHERE priority <> 'none' AND NOT is_archived)
SELECT id, priority FROM kept ORDER BY CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'none' THEN 4 ELSE 5 END, published_at DESC, id DESC LIMIT 50 OFFSET 100""")
def _(m):
    return L.page(L.list_items(m.items, m.channels), L.sorted_items(m.items, "priority"), 3, 50).select("id", "priority")


@add("items_page_by_date", "T01 T02", "SELECT id, published_at FROM items WHERE priority <> 'none' AND NOT is_archived ORDER BY published_at ASC, id ASC LIMIT 20 OFFSET 40")
def _(m):
    return L.page(L.list_items(m.items, m.channels), L.sorted_items(m.items, "date", False), 3, 20).select("id", "published_at")


@add("items_page_by_source", "S17 T01 T03 J02 J03", """SELECT i.id, s.name AS source_name, c.name AS channel_name FROM items i LEFT JOIN channels c ON i.channel_id = c.id + 2 LEFT JOIN sources s ON c.source_id = s.id
ORDER BY s.name DESC NULLS FIRST, i.id DESC LIMIT 100""")
def _(m):
    named = L.with_names(m.items, m.channels.withColumn("id", F.col("id") + 2), m.sources)
    return L.page(named, L.sorted_items(named, "source"), 1, 100).select("id", "source_name", "channel_name")


@add("items_page_count", "T02", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM items WHERE priority <> 'none' AND NOT is_archived")
def _(m):
    return L.page_count(L.list_items(m.items, m.channels), 50)


@add("items_in_group", "F04 F05 F06 U04", "SELECT id FROM items WHERE assigned_ak IN ('AK2', 'AK3') OR model_ak IN ('AK2', 'AK3')")
def _(m):
    items = m.items.withColumn("assigned_aks", F.when(F.col("assigned_ak").isNotNull(), F.array("assigned_ak"))).withColumn("metadata", F.to_json(F.struct(F.struct(F.col("model_ak").alias("assigned_ak")).alias("llm_analysis"))))
    return items.filter(L.in_group("AK2", "AK3")).select("id")


@add("items_nested_duplicates", "F26 J09 A17", "SELECT p.id, count(d.id) AS n, coalesce(string_agg(CAST(d.id AS STRING), ',' ORDER BY d.id), '') AS duplicates FROM items p LEFT JOIN items d ON d.similar_to_id = p.id WHERE p.similar_to_id IS NULL GROUP BY p.id")
def _(m):
    return L.with_duplicates(m.items).select("id", F.size("duplicates").cast("long").alias("n"), F.array_join("duplicates", ",").alias("duplicates"))


@add("json_path_group", "F03 A02 A08", "SELECT CAST(json_extract_string(props, '$.k') AS STRING) AS k, count(*) AS n FROM events GROUP BY 1", model=False)
def _(m):
    return m.table("events").groupBy(F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@add("sources_with_errors", "F08 F09 J08 F30", "SELECT id, name FROM sources s WHERE EXISTS (SELECT 1 FROM channels c WHERE c.source_id = s.id AND c.last_error IS NOT NULL)")
def _(m):
    return L.list_sources(m.sources, m.channels, has_errors=True).select("id", "name")


@add("sources_without_errors", "F08 J08", "SELECT id, name FROM sources s WHERE enabled AND NOT EXISTS (SELECT 1 FROM channels c WHERE c.source_id = s.id AND c.last_error IS NOT NULL)")
def _(m):
    return L.list_sources(m.sources, m.channels, enabled=True, has_errors=False).select("id", "name")


@add("sources_stakeholders", "F08", "SELECT id FROM sources WHERE is_stakeholder")
def _(m):
    return L.list_sources(m.sources, m.channels, is_stakeholder=True).select("id")


@add("channels_due", "F10 R01", "SELECT c.id FROM channels c JOIN sources s ON c.source_id = s.id WHERE c.enabled AND s.enabled AND (last_fetch_at IS NULL OR last_fetch_at + INTERVAL 1 MINUTE * fetch_interval_minutes < TIMESTAMP '1998-08-02 15:30:00')")
def _(m):
    return L.due_channels(m.channels, m.sources, AS_OF).select("id")


@add("channels_stale", "F25 F30", "SELECT id FROM channels WHERE last_fetch_at < TIMESTAMP '1998-08-02 14:30:00' OR last_error IS NOT NULL")
def _(m):
    return m.channels.filter((F.col("last_fetch_at") < F.lit(datetime(1998, 8, 2, 14, 30))) | F.col("last_error").isNotNull()).select("id")


@add("items_unclassified", "F11 R05", "SELECT id FROM items WHERE confidence IS NULL ORDER BY fetched_at DESC, id DESC LIMIT 50")
def _(m):
    return L.unclassified(m.items).orderBy(F.col("fetched_at").desc(), F.col("id").desc()).limit(50).select("id")


@add("items_unchecked", "F12", "SELECT count(*) AS n FROM items WHERE similar_to_id IS NULL AND NOT duplicate_checked AND fetched_at >= TIMESTAMP '1998-08-02 15:30:00' - INTERVAL 700 DAY")
def _(m):
    return L.unchecked_duplicates(m.items, AS_OF, 700).agg(F.count("*").alias("n"))


@add("items_unindexed", "F13", "SELECT id FROM items WHERE NOT indexed")
def _(m):
    return L.unindexed(m.items).select("id")


@add("backlog_worker", "F14 R06", """SELECT id FROM items WHERE needs_llm_processing AND confidence IS NOT NULL AND (retry_priority IS NULL OR retry_priority <> 'low')
ORDER BY CASE retry_priority WHEN 'high' THEN 1 WHEN 'edge_case' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, fetched_at DESC, id DESC LIMIT 50""")
def _(m):
    return L.backlog(m.items).orderBy("rank", F.col("fetched_at").desc(), F.col("id").desc()).limit(50).select("id")


@add("backlog_scheduler", "F15", "SELECT id, CASE retry_priority WHEN 'high' THEN 1 WHEN 'unknown' THEN 2 WHEN 'edge_case' THEN 3 ELSE 4 END AS rank FROM items WHERE needs_llm_processing AND retry_priority <> 'low'")
def _(m):
    return L.backlog(m.items, worker=False).select("id", "rank")


@add("items_to_reprocess", "F16 F18 K23", f"SELECT id FROM items WHERE channel_id IN ({_CH} WHERE connector_type = 'html') AND priority NOT IN ('low', 'none') AND summary IS NULL")
def _(m):
    return L.to_reprocess(m.items, m.channels, connector_type="html", exclude_low=True, without_analysis=True).select("id")


@add("items_unprocessed", "F18 K16", "SELECT id FROM items WHERE summary IS NULL OR summary = ''")
def _(m):
    return L.unprocessed(m.items).select("id")


@add("items_to_classify", "F17", "SELECT id FROM items WHERE confidence IS NULL ORDER BY needs_llm_processing DESC, fetched_at DESC, id DESC LIMIT 100")
def _(m):
    return L.unclassified(m.items).orderBy(F.col("needs_llm_processing").desc(), F.col("fetched_at").desc(), F.col("id").desc()).limit(100).select("id")


@add("low_confidence_band", "F19 F07", "SELECT l.id, l.item_id, i.title, l.confidence_score FROM logs l JOIN items i ON l.item_id = i.id WHERE confidence_score BETWEEN 0.2 AND 0.45 AND step_type = 'classifier' ORDER BY confidence_score, l.id LIMIT 100 OFFSET 20")
def _(m):
    return L.confidence_band(m.logs, m.items, 0.2, 0.45, "classifier").orderBy("confidence_score", "id").offset(20).limit(100).select("id", "item_id", "title", "confidence_score")


@add("recent_errors", "F20", "SELECT id, step_type FROM logs WHERE NOT success ORDER BY created_at DESC, id DESC LIMIT 20")
def _(m):
    return m.logs.filter(~F.col("success")).orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(20).select("id", "step_type")


@add("briefing_items", "F21 X16", "SELECT id, priority_score FROM items WHERE fetched_at >= TIMESTAMP '1997-01-01' AND NOT is_read AND priority IN ('high', 'medium') ORDER BY priority_score DESC, fetched_at DESC, id DESC LIMIT 200")
def _(m):
    return L.briefing(m.items, datetime(1997, 1, 1), "medium").orderBy(F.col("priority_score").desc(), F.col("fetched_at").desc(), F.col("id").desc()).limit(200).select("id", "priority_score")


@add("message_of_the_day", "F22 K26", "SELECT id FROM items WHERE is_starred AND (similar_to_id IS NULL OR fetched_at > TIMESTAMP '1998-01-01') ORDER BY fetched_at DESC, id DESC LIMIT 1")
def _(m):
    messages = m.items.select("id", F.col("is_starred").alias("active"), F.when(F.col("similar_to_id").isNotNull(), F.col("fetched_at")).alias("expires_at"), F.col("fetched_at").alias("updated_at"))
    return L.message_of_the_day(messages, datetime(1998, 1, 1)).select("id")


@add("log_lines", "F23", "SELECT event_id FROM events WHERE event_type = 'error' AND contains(event_type, 'err') AND contains(lower(props), '\"k\": 1') ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 50", model=False)
def _(m):
    lines = m.table("events").select("event_id", "ts", F.col("event_type").alias("level"), F.col("event_type").alias("logger"), F.col("props").alias("message"))
    return L.log_lines(lines, "error", "err", '"K": 1').orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(50).limit(50).select("event_id")


@add("health_states", "F31 F32", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'unhealthy' WHEN n_nationkey % 2 = 0 THEN 'degraded' ELSE 'healthy' END AS state, CASE WHEN n_regionkey = 1 THEN 'error' WHEN n_regionkey = 2 THEN 'warning' END AS alert FROM nation WHERE n_regionkey IN (1, 2)", model=False)
def _(m):
    n = m.table("nation")
    alerts = L.worker_alerts(n.select(F.col("n_nationkey").alias("name"), (F.col("n_regionkey") == 1).alias("stopped_due_to_errors"), (~F.col("n_regionkey").isin(1, 2)).alias("running")))
    states = n.select(F.col("n_nationkey").alias("id"), L.health(F.col("n_nationkey") % 2 != 0, F.col("n_nationkey") % 3 != 0).alias("state"))
    return states.join(alerts.select(F.col("name").alias("id"), F.col("severity").alias("alert")), "id")


@add("config_redacted", "F27 F28", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE '<REDACTED>' END AS api_token FROM supplier", model=False)
def _(m):
    config = F.create_map(F.lit("name"), F.col("s_name"), F.lit("Api_Token"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("geheim"))
    out = m.table("supplier").select(F.col("s_suppkey").alias("id"), L.redacted(config, L.SENSITIVE).alias("c"))
    return out.select("id", F.col("c")["name"].alias("name"), F.col("c")["Api_Token"].alias("api_token"))


@add("config_export", "F28", "SELECT s.name, count(c.id) AS channels, coalesce(string_agg(CAST(c.id AS STRING), ',' ORDER BY c.id), '') AS ids FROM sources s LEFT JOIN channels c ON c.source_id = s.id GROUP BY s.id, s.name")
def _(m):
    c = m.channels.groupBy("source_id").agg(F.count("*").alias("channels"), F.sort_array(F.collect_list("id")).alias("ids"))
    return m.sources.join(c, F.col("source_id") == F.col("id"), "left").select("name", F.coalesce("channels", F.lit(0)).alias("channels"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("ids"))


@add("config_problems", "F29", """WITH s AS (SELECT CAST(n_nationkey AS INTEGER) AS place, CASE WHEN n_nationkey % 4 = 0 THEN 'Nord' WHEN n_nationkey % 4 = 1 THEN 'NORD' ELSE n_name END AS name FROM nation), c AS (SELECT CAST(s_nationkey AS INTEGER) AS source, CAST(s_suppkey AS INTEGER) AS place, CASE WHEN s_suppkey % 3 = 0 THEN 'fax' || CAST(s_suppkey % 5 AS STRING) ELSE 'rss' END AS kind, s_suppkey % 4 = 1 AS hidden FROM supplier), r AS (SELECT CAST(p_partkey AS INTEGER) AS place, p_name AS name, p_partkey % 6 AS k FROM part)
SELECT 'sources[' || CAST(place AS STRING) || '].name' AS path, 'error' AS severity, 'Duplicate source name: ' || chr(39) || name || chr(39) AS message FROM s QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY place) > 1
UNION ALL (SELECT 'rules[' || CAST(place AS STRING) || '].name', 'error', 'Duplicate rule name: ' || chr(39) || name || chr(39) FROM r QUALIFY row_number() OVER (PARTITION BY lower(name) ORDER BY place) > 1)
UNION ALL SELECT 'sources[' || CAST(source AS STRING) || '].channels[' || CAST(place AS STRING) || '].connector_type', 'warning', 'Unknown connector type: ' || chr(39) || kind || chr(39) FROM c WHERE kind <> 'rss'
UNION ALL SELECT 'sources[' || CAST(source AS STRING) || '].channels[' || CAST(place AS STRING) || '].config.token', 'error', 'Redacted value not replaced: ' || chr(39) || 'token' || chr(39) FROM c WHERE hidden
UNION ALL SELECT 'rules[' || CAST(place AS STRING) || '].pattern', 'error', 'Invalid regex pattern: missing ), unterminated subpattern at position 0' FROM r WHERE k = 0
UNION ALL SELECT 'version', 'warning', 'Config version ' || chr(39) || '0.9' || chr(39) || ' differs from current ' || chr(39) || '1.0' || chr(39)""", model=False)
def _(m):
    k, p = F.col("n_nationkey"), F.col("p_partkey")
    sources = m.table("nation").select(k.cast("int").alias("place"), F.when(k % 4 == 0, "Nord").when(k % 4 == 1, "NORD").otherwise(F.col("n_name")).alias("name"))
    n = F.col("s_suppkey")
    kind = F.when(n % 3 == 0, F.concat(F.lit("fax"), (n % 5).cast("string"))).otherwise("rss")
    config = F.create_map(F.lit("url"), F.lit("https://e.org"), F.lit("token"), F.when(n % 4 == 1, "<REDACTED>").otherwise("t"))
    channels = m.table("supplier").select(F.col("s_nationkey").cast("int").alias("source"), n.cast("int").alias("place"), kind.alias("connector_type"), config.alias("config"))
    rules = m.table("part").select(p.cast("int").alias("place"), F.col("p_name").alias("name"), F.when(p % 6 < 3, "regex").otherwise("keyword").alias("rule_type"), F.when(p % 3 == 0, "(offen").otherwise(r"\bganz\w*").alias("pattern"))
    return L.config_problems(sources, channels, rules, "0.9", kinds())


@add("config_duplicate_names", "F29", "SELECT lower(c_mktsegment) AS name, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1", model=False)
def _(m):
    return m.table("customer").groupBy(F.lower("c_mktsegment").alias("name")).agg(F.count("*").alias("n")).filter("n > 1")


@add("channel_names", "X32 X33 K24", "SELECT id, coalesce(name, CASE connector_type WHEN 'rss' THEN 'RSS Feed' WHEN 'html' THEN 'Website' WHEN 'mastodon' THEN 'Mastodon' WHEN 'telegram' THEN 'Telegram' ELSE 'LinkedIn' END) AS shown, CASE connector_type WHEN 'rss' THEN 'https://e.org/feed' || CAST(id AS STRING) WHEN 'html' THEN 'https://e.org/feed' || CAST(id AS STRING) WHEN 'mastodon' THEN 'user' || CAST(id AS STRING) WHEN 'telegram' THEN 'chan' || CAST(id AS STRING) ELSE 'firma' || CAST(id AS STRING) END AS identifier FROM channels")
def _(m):
    n = F.col("id").cast("string")
    config = F.create_map(F.lit("url"), F.concat(F.lit("https://E.org/Feed"), n), F.lit("handle"), F.concat(F.lit("User"), n), F.lit("channel"), F.concat(F.lit("Chan"), n), F.lit("profile_url"), F.concat(F.lit("https://linkedin.com/company/Firma"), n, F.lit("/about")))
    return m.channels.select("id", display_name(F.col("name"), F.col("connector_type")).alias("shown"), identifier(F.col("connector_type"), config).alias("identifier"))


@add("priority_ranks", "X16 T01 F30", "SELECT priority, CASE priority WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS rank, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'none' THEN 4 ELSE 5 END AS place, count(*) AS n FROM items WHERE NOT is_read GROUP BY ALL")
def _(m):
    p = F.col("priority")
    return m.items.filter("NOT is_read").groupBy("priority", priority_rank(p).alias("rank"), priority_order(p).alias("place")).agg(F.count("*").alias("n"))


@add("item_history", "W06 T01", "SELECT item_id, id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY created_at DESC, id DESC) AS place FROM logs) WHERE place <= 5")
def _(m):
    from newsloom.operators.stats import ranked

    return ranked(m.logs, "item_id", F.col("created_at").desc(), F.col("id").desc()).filter("rank <= 5").select("item_id", "id", "created_at")


@add("length_and_confidence_filter", "F24 K04", "SELECT id, substr(content, 1, 5000) AS content FROM items WHERE length(content) >= 22 AND confidence >= 0.3")
def _(m):
    return m.items.filter((F.length("content") >= 22) & (F.col("confidence") >= 0.3)).select("id", F.substring("content", 1, 5000).alias("content"))
