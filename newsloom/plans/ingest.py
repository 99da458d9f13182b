"""Queries of connectors, ingest, streams and classifiers."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions.text import SCORE_WORDS, content_hash, hand_features
from newsloom.operators import classify as C
from newsloom.operators.embed import Refused, best_meaning, embedded, meanings
from newsloom.operators.evaluate import relevance_figures, stratified_split
from newsloom.operators.listing import backlog
from newsloom.plans.model import AS_OF, Catalog
from newsloom.shared import settled, workspace
from newsloom.sources import feeds
from newsloom.sources.channels import LandedChannels
from newsloom.sources.pdf import landed_pdfs
from newsloom.sources.registry import LandedItems, checked, get, kinds, opened, validate
from newsloom.streaming import ingest as I
from newsloom.streaming.state import first_rows, model_queue, state_session

catalog = Catalog()
add = catalog.add


def _n():
    return F.col("n_nationkey").cast("string")


def _nation(m):
    return m.table("nation")


@add("feed_rss", "S03 S04 X49", """SELECT 'g' || n AS external_id, CASE WHEN k % 2 = 0 THEN 'Titel ' || n ELSE 'Untitled' END AS title, 'Text ' || n AS content, CASE WHEN k % 2 = 0 THEN 'https://e.org/a/' || n ELSE 'https://feeds.org/b/' || n END AS url, TIMESTAMP '2024-01-05 10:00:00' AS published_at, CASE WHEN k % 2 = 0 THEN 'e.org' ELSE 'feeds.org' END AS host, 'x,y' AS tags FROM (SELECT n_nationkey AS k, CAST(n_nationkey AS STRING) AS n FROM nation)""", model=False)
def _(m):
    link = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("https://www.google.com/url?rct=j&amp;url=https%3A%2F%2Fe.org%2Fa%2F"), _n(), F.lit("&amp;ct=ga"))).otherwise(F.concat(F.lit("/b/"), _n()))
    title = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Titel "), _n())).otherwise("")
    xml = F.concat(F.lit("<rss><channel><title>F</title><item><guid>g"), _n(), F.lit("</guid><title>"), title, F.lit("</title><link>"), link, F.lit("</link><description>Text "), _n(), F.lit("</description><pubDate>Fri, 5 Jan 2024 10:00:00 +0000</pubDate><category>x</category><category>y</category></item></channel></rss>"))
    out = get("rss")(_nation(m).select(F.lit("https://feeds.org/rss.xml").alias("url"), xml.alias("xml")), {})
    return out.select("external_id", "title", "content", "url", "published_at", F.col("metadata")["source_domain"].alias("host"), F.col("metadata")["tags"].alias("tags"))


@add("feed_atom", "S03", """SELECT 'tag:' || n AS external_id, 'Titel ' || n AS title, CASE WHEN k % 3 = 0 THEN 'Ganz ' || n ELSE 'Kurz ' || n END AS content, CASE k % 3 WHEN 0 THEN 'https://e.org/a/' || n WHEN 1 THEN 'https://e.org/media/' || n ELSE 'https://feeds.org/b/' || n END AS url, CASE WHEN k % 2 = 0 THEN TIMESTAMP '2024-01-05 10:00:00' ELSE TIMESTAMP '2024-02-06 11:00:00' END AS published_at, 'r' || n AS author, 'x,' || n AS tags FROM (SELECT n_nationkey AS k, CAST(n_nationkey AS STRING) AS n FROM nation)""", model=False)
def _(m):
    k = F.col("n_nationkey")
    links = F.when(k % 3 == 0, F.concat(F.lit('<link rel="self" href="https://e.org/s"/><link rel="alternate" href="https://e.org/a/'), _n(), F.lit('"/>'))).when(k % 3 == 1, F.concat(F.lit('<link rel="enclosure" href="https://e.org/media/'), _n(), F.lit('"/><link rel="self" href="https://e.org/s"/>'))).otherwise(F.concat(F.lit('<link href="/b/'), _n(), F.lit('"/>')))
    full = F.when(k % 3 == 0, F.concat(F.lit("<content>Ganz "), _n(), F.lit("</content>"))).otherwise("")
    date = F.when(k % 2 == 0, "<published>2024-01-05T10:00:00Z</published>").otherwise("<updated>2024-02-06T11:00:00Z</updated>")
    xml = F.concat(F.lit("<feed><title>F</title><entry><id>tag:"), _n(), F.lit("</id><title>Titel "), _n(), F.lit("</title>"), links, F.lit("<summary>Kurz "), _n(), F.lit("</summary>"), full, date, F.lit("<author><name>r"), _n(), F.lit('</name></author><category term="x"/><category term="'), _n(), F.lit('"/></entry></feed>'))
    out = get("rss")(_nation(m).select(F.lit("https://feeds.org/atom.xml").alias("url"), xml.alias("xml")), {})
    return out.select("external_id", "title", "content", "url", "published_at", "author", F.col("metadata")["tags"].alias("tags"))


@add("feed_pdf", "S06", "SELECT substr(md5('b' || CAST(n_nationkey AS STRING)), 1, 16) AS external_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Bericht' ELSE 'Seite eins' END AS title, TIMESTAMP '2023-04-05 06:07:08' AS published_at FROM nation", model=False)
def _(m):
    rows = _nation(m).select(F.lit("https://e.org/x.pdf").alias("url"), F.concat(F.lit("b"), _n()).cast("binary").alias("bytes"), F.array(F.lit("Seite eins\nmehr"), F.lit("zwei")).alias("pages"), F.when(F.col("n_nationkey") % 2 == 0, "Bericht").alias("title"), F.lit("D:20230405060708+01'00'").alias("created"))
    return get("pdf")(rows, {}).select("external_id", "title", "published_at")


def _pdf(lines: list[str], title: str | None) -> bytes:
    """A small PDF of one page a line, deflated."""
    import zlib

    parts = [b"1 0 obj <</Type /Catalog>> endobj"]
    for i, line in enumerate(lines):
        data = zlib.compress(f"BT /F1 12 Tf ({line}) Tj 0 -14 Td (mehr) Tj ET".encode("latin-1"))
        parts += [f"{10 + 2 * i} 0 obj <</Type /Page /Contents {11 + 2 * i} 0 R>> endobj".encode(), f"{11 + 2 * i} 0 obj <</Length {len(data)} /Filter /FlateDecode>> stream\n".encode() + data + b"\nendstream endobj"]
    named = f"/Title ({title}) " if title else ""
    return b"%PDF-1.4\n" + b"\n".join([*parts, f"99 0 obj <<{named}/CreationDate (D:20230405060708+01'00')>> endobj".encode("latin-1")]) + b"\n%%EOF"


@add("feed_pdf_files", "S06", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Bericht ' || n_name ELSE n_name END AS title, n_name || chr(10) || 'mehr' || chr(10) || 'Seite ' || CAST(n_nationkey AS STRING) || chr(10) || 'mehr' AS content, TIMESTAMP '2023-04-05 06:07:08' AS published_at FROM nation", model=False)
def _(m):
    folder = workspace(m.spark, "pdf")
    fs, path = opened(folder)
    fs.create_dir(path)
    for r in _nation(m).select("n_nationkey", "n_name").collect():  # the 25 files that the query is about
        with fs.open_output_stream(f"{path}/{r[0]}.pdf") as out:
            out.write(_pdf([r[1], f"Seite {r[0]}"], f"Bericht {r[1]}" if r[0] % 2 == 0 else None))
    return get("pdf")(landed_pdfs(m.spark, folder), {}).select("title", "content", "published_at")


@add("feed_mastodon", "S07 S08 X48", "SELECT CAST(n_nationkey AS STRING) AS external_id, CASE WHEN n_nationkey % 2 = 0 THEN 'Geteilt' ELSE 'Eigen' END AS title, CAST(n_nationkey AS STRING) AS favourites FROM nation WHERE n_nationkey % 5 <> 0", model=False)
def _(m):
    k = F.col("n_nationkey")
    own = F.struct(_n().alias("id"), F.lit("<p>Eigen</p>").alias("content"), F.lit("u").alias("url"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.when(k % 5 == 0, "9").alias("in_reply_to_id"), k.alias("favourites_count"), F.when(k % 2 == 0, F.struct(F.lit("r").alias("id"), F.lit("<p>Geteilt</p>").alias("content"), k.alias("favourites_count"))).alias("reblog"))
    out = get("mastodon")(_nation(m).select(F.to_json(own).alias("json")), {})
    return out.select("external_id", "title", F.col("metadata")["favourites"].alias("favourites"))


@add("feed_mastodon_rss", "S08", "SELECT 'g' || CAST(n_nationkey AS STRING) AS external_id, 'Text ' || n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'https://e.org/' || CAST(n_nationkey AS STRING) END AS linked FROM nation", model=False)
def _(m):
    link = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit('&lt;a href="https://e.org/'), _n(), F.lit('"&gt;'))).otherwise("")
    text = F.concat(F.lit('&lt;a href="https://Mastodon.social/@a"&gt;&lt;a href="https://own.example/x"&gt;'), link, F.lit("&lt;p&gt;Text "), F.col("n_name"), F.lit("&lt;/p&gt;"))
    xml = F.concat(F.lit("<rss><channel><item><guid>g"), _n(), F.lit("</guid><link>https://own.example/1</link><description>"), text, F.lit("</description></item></channel></rss>"))
    out = get("mastodon")(_nation(m).select(F.lit("https://own.example/@a.rss").alias("url"), xml.alias("xml")), {"rss": True, "instance": "own.example"})
    return out.select("external_id", "title", F.col("metadata")["linked"].alias("linked"))


@add("feed_mastodon_limit", "S08", "SELECT CAST(event_id AS STRING) AS external_id FROM events ORDER BY ts DESC, external_id DESC LIMIT 40", model=False)
def _(m):
    own = F.struct(F.col("event_id").cast("string").alias("id"), F.lit("<p>x</p>").alias("content"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("created_at"))
    return get("mastodon")(m.table("events").select(F.to_json(own).alias("json")), {"limit": 40}).select("external_id")


@add("feed_telegram_first_posts", "S09", "SELECT CAST(event_id AS STRING) AS external_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 20 AND event_type <> 'error'", model=False)
def _(m):
    rows = m.table("events").select(F.col("user_id").cast("string").alias("channel"), F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("text"), F.when(F.col("event_type") == "error", "x").alias("forwarded_from"), F.col("ts").alias("posted_at"), *(F.lit(False).alias(f"has_{k}") for k in ("photo", "video", "document")), F.col("event_id").alias("place"))
    return get("telegram")(rows, {"max_posts": 20}).select("external_id")


@add("feed_instagram_mirrors", "S12", """SELECT CASE WHEN n_nationkey % 4 = 0 THEN md5('u:Bild ' || n_name) ELSE 'c' || CAST(n_nationkey AS STRING) END AS external_id, 'Bild ' || n_name AS title, CASE WHEN n_nationkey % 4 = 0 THEN 'https://mirror.example/x' ELSE 'https://www.instagram.com/p/c' || CAST(n_nationkey AS STRING) || '/' END AS url FROM nation WHERE n_nationkey % 5 <> 0
UNION ALL SELECT 'c' || CAST(n_nationkey AS STRING), 'Post by @u', 'https://www.instagram.com/p/c' || CAST(n_nationkey AS STRING) || '/' FROM nation WHERE n_nationkey % 4 <> 0""", model=False)
def _(m):
    k, seen = F.col("n_nationkey"), F.lit(datetime(2024, 1, 1)).alias("seen_at")
    when = F.lit("2 hours ago").alias("when")
    a = _nation(m).select(F.when(k % 4 == 0, "https://mirror.example/x").otherwise(F.concat(F.lit("https://mirror.example/media/c"), _n())).alias("href"), F.concat(F.lit("Bild "), "n_name").alias("caption"), when, seen, (k % 5 == 0).alias("is_reel"))
    b = lambda odd: _nation(m).filter(k % 2 == odd).select(F.when(k % 4 == 0, "/other/c").otherwise(F.concat(F.lit("/p/c"), _n(), F.lit("/x"))).alias("href"), F.lit("").alias("caption"), when, seen, F.lit(False).alias("is_reel"))
    mirror = lambda rows, layout: get("instagram")(rows, {"layout": layout, "username": "u"}).select("external_id", "title", "url")
    return mirror(a, "picuki").unionByName(mirror(b(0), "picnob")).unionByName(mirror(b(1), "imginn"))


@add("feed_bluesky", "S07", "SELECT CAST(n_nationkey AS STRING) AS external_id, repeat('x', 100) || '...' AS title, 'https://e.org/' || CAST(n_nationkey AS STRING) AS url FROM nation", model=False)
def _(m):
    rows = _nation(m).select(_n().alias("uri"), F.lit("x" * 120).alias("text"), F.array(F.lit("https://bsky.app/p"), F.concat(F.lit("https://e.org/"), _n())).alias("links"), F.lit("2024-01-01 00:00:00").alias("created_at"))
    return get("bluesky")(rows, {}).select("external_id", "title", "url")


@add("feed_telegram", "S09", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS STRING) ELSE md5('k:' || CASE WHEN n_nationkey % 3 = 0 THEN '' ELSE 'Hallo' END || ':2024-01-01 00:00:00') END AS external_id, CASE WHEN n_nationkey % 3 = 0 THEN 'photo' ELSE '' END AS media FROM nation WHERE n_nationkey % 7 <> 0", model=False)
def _(m):
    k = F.col("n_nationkey")
    rows = _nation(m).select(F.lit("k").alias("channel"), F.when(k % 2 == 0, _n()).alias("id"), F.when(k % 3 != 0, "Hallo").alias("text"), F.when(k % 7 == 0, "x").alias("forwarded_from"), F.lit(datetime(2024, 1, 1)).alias("posted_at"), (k % 3 == 0).alias("has_photo"), F.lit(False).alias("has_video"), F.lit(False).alias("has_document"))
    return get("telegram")(rows, {}).select("external_id", F.col("metadata")["media_types"].alias("media"))


@add("feed_twitter", "S10", "SELECT CAST(n_nationkey AS STRING) AS external_id, 'https://twitter.com/a/' || CAST(n_nationkey AS STRING) AS url FROM nation WHERE n_nationkey % 3 = 0", model=False)
def _(m):
    k = F.col("n_nationkey") % 3
    rows = _nation(m).select(_n().alias("id"), F.when(k == 1, "RT by @x: a").when(k == 2, "R to @y: b").otherwise("Eigen").alias("title"), F.lit("c").alias("content"), F.concat(F.lit("https://nitter.net/a/"), _n()).alias("link"), F.lit(datetime(2024, 1, 1)).alias("published_at"))
    return get("twitter")(rows, {}).select("external_id", "url")


@add("feed_x", "S11 X31", "SELECT CAST(100 + n_nationkey AS STRING) AS external_id, 'https://e.org/' || CAST(n_nationkey AS STRING) AS url, 'https://e.org/login,https://e.org/' || CAST(n_nationkey AS STRING) AS links FROM nation WHERE n_nationkey % 4 = 0", model=False)
def _(m):
    k = F.col("n_nationkey") % 4
    own = F.concat(F.lit("https://e.org/"), _n())
    rows = _nation(m).select(F.when(k != 1, "Text").alias("text"), F.when(k != 2, F.concat(F.lit("https://x.com/a/status/"), (F.col("n_nationkey") + 100).cast("string"))).otherwise("https://x.com/a").alias("permalink"), F.array(F.lit("https://e.org/login"), own).alias("links"), F.array(own).alias("cards"), (k == 3).alias("is_reply"), F.lit(datetime(2024, 1, 1)).alias("posted_at"))
    return get("x_scraper")(rows, {}).select("external_id", "url", F.col("metadata")["extracted_links"].alias("links"))


@add("feed_instagram_linkedin", "S12 S13 X35", "SELECT 'c' || CAST(n_nationkey AS STRING) AS external_id, TIMESTAMP '2023-12-31 22:00:00' AS published_at FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT CASE WHEN n_nationkey % 2 = 0 THEN '1234567890123456789' ELSE 'linkedin_p_' || CAST(n_nationkey AS STRING) || '_1704067200' END, TIMESTAMP '2023-12-31 22:00:00' FROM nation", model=False)
def _(m):
    k, seen = F.col("n_nationkey"), F.lit(datetime(2024, 1, 1)).alias("seen_at")
    a = _nation(m).select(F.concat(F.when(k % 2 == 0, "/p/c").otherwise("/reel/c"), _n(), F.lit("/")).alias("href"), F.lit("Bild").alias("caption"), F.lit("2 hours ago").alias("when"), seen)
    b = _nation(m).select(F.lit("p").alias("profile"), k.alias("place"), F.when(k % 2 == 0, "urn:1234567890123456789").otherwise("ohne").alias("html"), F.lit("Text").alias("text"), F.lit("2h").alias("when"), seen)
    return get("instagram")(a, {}).select("external_id", "published_at").unionByName(get("linkedin")(b, {}).select("external_id", "published_at"))


@add("dataset_notes", "S14", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 2 = 0 THEN 'Inhalt' || chr(10) || 'Armut' || chr(10) || '2010-2020' || chr(10) || 'Erhebung.' ELSE 'Inhalt' END AS content FROM nation", model=False)
def _(m):
    items = _nation(m).select(F.col("n_nationkey").alias("id"), F.when(F.col("n_nationkey") % 2 == 0, "ILC_LI01 - Daten").otherwise("anderes").alias("title"), F.lit("Inhalt").alias("content"))
    notes = m.spark.range(1).select(F.lit("ILC_LI01").alias("id"), F.create_map(F.lit("en"), F.lit("Poverty"), F.lit("de"), F.lit("Armut")).alias("names"), F.lit("2010-2020").alias("coverage"), F.lit("Erhebung.").alias("method"))
    return feeds.with_dataset_notes(items, notes).select("id", "content")


@add("connector_registry", "S01 S02", "SELECT * FROM (VALUES ('bluesky', false), ('google_alerts', true), ('instagram', false), ('linkedin', false), ('mastodon', false), ('pdf', true), ('rss', true), ('telegram', false), ('twitter', false), ('x_scraper', false)) v(kind, valid)", model=False)
def _(m):
    return m.spark.createDataFrame([(k, validate(k, {"url": "https://e.org"})[0]) for k in kinds()], "kind string, valid boolean")


@add("channel_configs", "S02 S01", """SELECT s_suppkey AS id, kind, kind <> 'fax' AS registered, CASE WHEN kind = 'fax' THEN 'unknown connector fax' WHEN s_suppkey % 3 = 0 THEN 'missing ' || need ELSE '' END AS problem FROM (SELECT s_suppkey, kinds[1 + s_suppkey % 11] AS kind, needs[1 + s_suppkey % 11] AS need
FROM supplier, (SELECT ['bluesky', 'fax', 'google_alerts', 'instagram', 'linkedin', 'mastodon', 'pdf', 'rss', 'telegram', 'twitter', 'x_scraper'] AS kinds, ['handle', '', 'url', 'username', 'profile_url', 'handle', 'url', 'url', 'channel', 'username', 'username'] AS needs))""", model=False)
def _(m):
    """Suppliers as channels, each with a type and a configuration, checked against the registry; one type is unknown, some lack what they need."""
    names = sorted([*kinds(), "fax"])
    kind = F.element_at(F.array(*map(F.lit, names)), (1 + F.col("s_suppkey") % len(names)).cast("int"))
    config = F.create_map(*(x for k in ("url", "handle", "username", "channel", "profile_url") for x in (F.lit(k), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_name")).otherwise(""))))
    return checked(m.table("supplier").select(F.col("s_suppkey").alias("id"), kind.alias("kind"), config.alias("config"))).select("id", "kind", "registered", "problem")


@add("landed_files", "S01 S15 S16 K05", "SELECT CAST(item_id AS STRING) AS external_id, text AS content FROM benchmark", model=False)
def _(m):
    folder = workspace(m.spark, "landed")
    rows = m.table("benchmark").select(F.col("item_id").cast("string").alias("external_id"), F.col("text").alias("content"))
    rows.coalesce(2).write.json(folder)
    m.spark.range(1).select(F.lit("\n{bad\n[1]").alias("value")).write.mode("append").text(folder)
    m.spark.dataSource.register(LandedItems)
    return m.spark.read.format("landed_items").option("folder", folder).load().select("external_id", "content")


def _batch(m):
    """documents as raw items; their first eight words are the title, and two of them have each address."""
    d = m.table("documents")
    return d.select(
        F.col("doc_id").alias("seq"), F.col("source").alias("channel_id"), F.col("doc_id").cast("string").alias("external_id"), F.regexp_extract("text", r"^\s*\S+(\s+\S+){0,7}", 0).alias("title"), F.col("text").alias("content"),
        F.concat(F.lit("https://e.org/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.lit(AS_OF).alias("published_at"), (F.col("doc_id") % 10 / F.lit(10.0)).alias("confidence"),
    )


_KEPT = r"""WITH d AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS t, trim(regexp_replace(regexp_replace(regexp_extract(text, '^\s*\S+(\s+\S+){0,7}'), '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS title FROM documents), f AS (SELECT min(doc_id) AS seq, arg_min(title, doc_id) AS title FROM d GROUP BY t)"""
_SCORED = "CASE WHEN seq % 10 >= 5 THEN 'medium' WHEN seq % 10 >= 3 THEN 'low' ELSE 'none' END AS priority, CASE WHEN seq % 10 >= 5 THEN 70 WHEN seq % 10 >= 3 THEN 55 ELSE 20 END AS priority_score"
_INGEST = _KEPT + rf""", w AS (SELECT seq, list_distinct(list_filter(string_split_regex(lower(title), '\s+'), lambda x: length(x) > 2)) AS ws FROM f), x AS (SELECT seq, len(ws) AS n, unnest(ws) AS word FROM w),
p AS (SELECT a.seq AS first, b.seq AS later FROM x a JOIN x b ON a.word = b.word AND a.seq < b.seq GROUP BY 1, 2 HAVING count(*) >= 0.7 * least(min(a.n), min(b.n))), t AS (SELECT later AS seq, min(first) AS similar_to_seq FROM p GROUP BY 1)
SELECT f.seq, {_SCORED}, similar_to_seq FROM f LEFT JOIN t ON t.seq = f.seq"""


def _none(m):
    return m.spark.createDataFrame([], "channel_id string, external_id string, content_hash string, url string, seq bigint")


@add("ingest_batch", "R02 R03 D01 K01 D05", _INGEST.replace("seq %", "f.seq %"), model=False)
def _(m):
    return I.ingest(_batch(m), _none(m), AS_OF).select("seq", "priority", "priority_score", "similar_to_seq")


@add("ingest_second_batch", "R02 D01 D02", _KEPT + f""" , h AS (SELECT doc_id, t, source FROM d JOIN documents USING (doc_id) WHERE doc_id % 2 = 0), s AS (SELECT min(doc_id) AS even, arg_min(source, doc_id) AS source FROM h GROUP BY t), g AS (SELECT min(doc_id) AS seq FROM d WHERE doc_id % 2 = 1 AND t NOT IN (SELECT t FROM h) GROUP BY t), l AS (SELECT g.seq, s.even AS linked FROM g JOIN documents o ON o.doc_id = g.seq JOIN s ON s.even = g.seq - 1 AND s.source <> o.source)
SELECT g.seq, {_SCORED.replace("seq %", "g.seq %")}, linked FROM g LEFT JOIN l ON l.seq = g.seq""", model=False)
def _(m):
    """A batch of odd ids over a store of even ones: known contents go, and known addresses of other channels are linked."""
    stored = I.ingest(_batch(m).filter("seq % 2 = 0"), _none(m), AS_OF).select("channel_id", "external_id", "content_hash", "url", "seq")
    found = I.ingest(_batch(m).filter("seq % 2 = 1"), stored, AS_OF)
    return found.select("seq", "priority", "priority_score", F.when(F.col("similar_to_seq") % 2 == 0, F.col("similar_to_seq")).alias("linked"))


# Rules of the query below, by words that some of the texts have.
RULES = [
    {"id": 1, "rule_type": "keyword", "pattern": "lor, ane", "priority_boost": 15, "target_priority": None, "order": 1},
    {"id": 2, "rule_type": "regex", "pattern": "[0-9]{2}", "priority_boost": 30, "target_priority": None, "order": 2},
    {"id": 3, "rule_type": "keyword", "pattern": "http", "priority_boost": -10, "target_priority": "high", "order": 3},
    {"id": 4, "rule_type": "keyword", "pattern": "a", "priority_boost": 50, "enabled": False, "order": 4},
]
_HEAD = r"regexp_extract(body, '^\s*\S+(\s+\S+){0,7}')"
_CLEAN = r"trim(regexp_replace(regexp_replace({x}, '<[^>]+>', '', 'g'), '\s+', ' ', 'g'))"
_ORDERED = rf"""WITH raw AS (
  SELECT doc_id AS seq, source AS ch, CAST(doc_id % 611 AS VARCHAR) AS ext, coalesce(text, '') AS body, CASE WHEN doc_id % 8 < 4 THEN 0 ELSE 1 END AS batch, CASE WHEN doc_id % 6 <> 5 THEN doc_id % 10 / 10.0 END AS conf,
    CASE WHEN doc_id % 4 = 0 THEN 'https://e.org/a/' || CAST(doc_id // 8 AS VARCHAR) WHEN doc_id % 4 = 1 THEN 'https://www.e.org/a/' || CAST(doc_id // 8 AS VARCHAR) || '/?utm_source=x' ELSE 'https://e.org/b/' || CAST(doc_id AS VARCHAR) END AS url
  FROM documents WHERE doc_id IS NOT NULL
), d AS (
  SELECT *, {_CLEAN.format(x="body")} AS t, {_CLEAN.format(x=_HEAD)} AS bare FROM raw
), e0 AS (
  SELECT * FROM d WHERE batch = 0 QUALIFY row_number() OVER (PARTITION BY ch, ext ORDER BY seq) = 1
), b0 AS (
  SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY t ORDER BY seq) = 1
), stored AS (
  SELECT * FROM b0 WHERE seq % 23 <> 0
), e1 AS (
  SELECT d.* FROM d WHERE batch = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.ch = d.ch AND s.ext = d.ext) AND d.t NOT IN (SELECT t FROM stored) QUALIFY row_number() OVER (PARTITION BY ch, ext ORDER BY seq) = 1
), b1 AS (
  SELECT * FROM e1 QUALIFY row_number() OVER (PARTITION BY t ORDER BY seq) = 1
), address AS (
  SELECT b1.seq, min(CASE WHEN s.url = b1.url THEN s.seq END) AS exact, min(CASE WHEN s.url = 'https://e.org/a/' || CAST(b1.seq // 8 AS VARCHAR) AND b1.seq % 4 = 1 THEN s.seq END) AS clean
  FROM b1 JOIN stored s ON s.ch <> b1.ch GROUP BY 1
), v AS (
  SELECT doc_id AS seq, list_transform(range(1, 65), lambda i: CAST(x.embedding[i] AS DOUBLE) + (0.2 + doc_id % 9 * 0.1) * CAST(y.embedding[i] AS DOUBLE)) AS vec
  FROM documents JOIN embeddings x ON x.vec_id = doc_id % 60 JOIN embeddings y ON y.vec_id = 70 + doc_id % 29 WHERE doc_id % 7 <> 6
), near AS (
  SELECT b1.seq, i.seq AS other, round(list_cosine_similarity(q.vec, w.vec), 6) AS score
  FROM b1 JOIN address a ON a.seq = b1.seq AND a.exact IS NULL AND a.clean IS NULL JOIN v q ON q.seq = b1.seq JOIN b0 i ON true JOIN v w ON w.seq = i.seq
  QUALIFY row_number() OVER (PARTITION BY b1.seq ORDER BY score DESC, i.seq) = 1
), meaning AS (
  SELECT near.* FROM near JOIN stored s ON s.seq = near.other WHERE score >= 0.6
), fresh AS (
  SELECT * FROM b0 UNION ALL SELECT * FROM b1
), w AS (
  SELECT seq, batch, list_distinct(list_filter(string_split_regex(lower(bare), '\s+'), lambda x: length(x) > 2)) AS ws FROM fresh
), x AS (
  SELECT seq, batch, len(ws) AS n, unnest(ws) AS word FROM w
), p AS (
  SELECT a.seq AS first, b.seq AS later FROM x a JOIN x b ON a.word = b.word AND a.batch = b.batch AND a.seq < b.seq GROUP BY 1, 2 HAVING count(*) >= 0.7 * least(min(a.n), min(b.n))
), titles AS (
  SELECT later AS seq, min(first) AS first FROM p GROUP BY 1
), judged AS (
  SELECT f.seq, f.batch, f.conf, lower(CASE WHEN f.seq % 5 = 0 THEN 'rss-zusammenfassung: ' ELSE '' END || f.bare || ' ' || f.t) AS low, a.exact, a.clean, m.other, m.score, titles.first
  FROM fresh f LEFT JOIN address a ON a.seq = f.seq LEFT JOIN meaning m ON m.seq = f.seq LEFT JOIN titles ON titles.seq = f.seq
), ruled AS (
  SELECT *, contains(low, 'lor') OR contains(low, 'ane') AS r1, regexp_matches(low, '[0-9]{{2}}') AS r2, contains(low, 'http') AS r3, {{keywords}} AS words FROM judged
), marked AS (
  SELECT *, greatest(0, least(100, (CASE WHEN r1 THEN 15 ELSE 0 END) + (CASE WHEN r2 THEN 30 ELSE 0 END) - (CASE WHEN r3 THEN 10 ELSE 0 END) + words)) AS s FROM ruled
), done AS (
  SELECT seq, batch, coalesce(exact, clean, CASE WHEN score >= 0.75 THEN other END, first) AS similar_to_seq,
    CASE WHEN exact IS NOT NULL THEN 'url' WHEN clean IS NOT NULL THEN 'url_normalized' WHEN score >= 0.75 THEN 'semantic' WHEN first IS NOT NULL THEN 'title' END AS link_method,
    CASE WHEN score < 0.75 THEN other END AS candidate_seq, score AS similarity,
    CASE WHEN conf >= 0.5 THEN 'medium' WHEN conf >= 0.25 THEN 'low' WHEN conf IS NOT NULL THEN 'none' WHEN r3 THEN 'high' WHEN s >= 90 THEN 'high' WHEN s >= 70 THEN 'medium' WHEN s > 50 THEN 'low' ELSE 'none' END AS priority,
    CASE WHEN conf >= 0.5 THEN 70 WHEN conf >= 0.25 THEN 55 WHEN conf IS NOT NULL THEN 20 ELSE s END AS priority_score,
    conf IS NULL OR conf >= 0.25 OR coalesce(score < 0.75, false) AS needs_llm_processing
  FROM marked
)"""
_ORDERED = _ORDERED.replace("{keywords}", "least(100, 50" + "".join(f" + CASE WHEN contains(low, '{k}') THEN {weight} ELSE 0 END" for weight, words in SCORE_WORDS.items() for k in words) + ")")


def _ordered(m):
    """Two batches over one store, in the order of the pipeline; between them some items go from the store but not from the index."""
    d, e = m.table("documents").filter("doc_id IS NOT NULL"), m.table("embeddings")
    n = F.col("doc_id")
    path = F.floor(n / 8).cast("string")
    title = F.concat(F.when(n % 5 == 0, "RSS-Zusammenfassung: ").otherwise(""), F.regexp_extract(F.coalesce("text", F.lit("")), r"^\s*\S+(\s+\S+){0,7}", 0))
    rows = d.select(
        n.alias("seq"), F.col("source").alias("channel_id"), (n % 611).cast("string").alias("external_id"), title.alias("title"), F.coalesce("text", F.lit("")).alias("content"),
        F.when(n % 4 == 0, F.concat(F.lit("https://e.org/a/"), path)).when(n % 4 == 1, F.concat(F.lit("https://www.e.org/a/"), path, F.lit("/?utm_source=x"))).otherwise(F.concat(F.lit("https://e.org/b/"), n.cast("string"))).alias("url"),
        F.lit(AS_OF).alias("published_at"), F.when(n % 6 != 5, n % 10 / F.lit(10.0)).alias("confidence"),
    )
    x, y = e.select(F.col("vec_id").alias("xi"), F.col("embedding").alias("xe")), e.select(F.col("vec_id").alias("yi"), F.col("embedding").alias("ye"))
    mixed = F.zip_with("xe", "ye", lambda a, b: a.cast("double") + (F.lit(0.2) + F.col("seq") % 9 * F.lit(0.1)) * b.cast("double"))
    rows = rows.join(x, (F.col("seq") % 7 != 6) & (F.col("xi") == F.col("seq") % 60), "left").join(y, F.col("yi") == 70 + F.col("seq") % 29, "left").withColumn("vector", mixed).drop("xi", "xe", "yi", "ye")
    into = I.Ingest(m.spark, workspace(m.spark, "ordered"), AS_OF, rules=RULES)
    into.step(rows.filter("seq % 8 < 4"), 0)
    into.remove(settled(into.items().filter("seq % 23 = 0").select("seq")))
    into.step(rows.filter("seq % 8 >= 4"), 1)
    return into


@add("ingest_in_order", "R02 D01 D02 D03 D04 D05 K25 X04 J16", _ORDERED + " SELECT seq, batch, similar_to_seq, link_method, candidate_seq, similarity, priority, priority_score, needs_llm_processing FROM done WHERE batch = 1 OR seq % 23 <> 0", model=False)
def _(m):
    """Each stage decides some rows: copies go, addresses, cleaned addresses, meanings and titles link, rules and confidences score."""
    into = _ordered(m)
    return into.items().select("seq", "batch", "similar_to_seq", "link_method", "candidate_seq", "similarity", "priority", "priority_score", "needs_llm_processing")


@add("ingest_events", "K10 R02 D04", _ORDERED + " SELECT seq AS item_seq, 'created' AS event_type, CAST(NULL AS BIGINT) AS other_seq, priority AS method FROM done UNION ALL SELECT similar_to_seq, 'duplicate_detected', seq, link_method FROM done WHERE link_method <> 'title'", model=False)
def _(m):
    """What the two batches record: each new item, and each stored item that one was linked to."""
    into = _ordered(m)
    return into.events().select("item_seq", "event_type", "other_seq", "method")


@add("ingest_age_cutoff", "R03", "SELECT doc_id AS seq FROM documents WHERE doc_id % 12 <= 7", model=False)
def _(m):
    rows = _batch(m).withColumn("published_at", F.timestamp_seconds(F.unix_timestamp(F.lit(AS_OF)) - (F.col("seq") % 12) * 86400))
    return I.fresh(rows, AS_OF).select("seq")


@add("stream_ingest_equals_batch", "R02 R04", f"{_KEPT} SELECT seq, {_SCORED} FROM f", model=False)
def _(m):
    """Three micro-batches, in the order of ids; a null id comes last."""
    base = workspace(m.spark, "stream")
    low, high = m.table("documents").agg(F.min("doc_id"), F.max("doc_id")).first()
    third = ((high or 0) - (low or 0)) // 3 + 1
    part = F.coalesce(F.floor((F.col("seq") - (low or 0)) / third), F.lit(2))
    for k in range(3):
        _batch(m).filter(part == k).coalesce(1).write.mode("append").parquet(f"{base}/in")
    source = m.spark.readStream.schema(m.spark.read.parquet(f"{base}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
    I.stream_ingest(m.spark, source, f"{base}/store", f"{base}/checkpoint", AS_OF).awaitTermination()
    return m.spark.read.parquet(f"{base}/store/items").select("seq", "priority", "priority_score")


@add("stream_windowed_counts", "R04", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL", model=False)
def _(m):
    base = workspace(m.spark, "window")
    events = m.table("events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    events.coalesce(1).write.mode("overwrite").parquet(f"{base}/in")
    stream = m.spark.readStream.schema(events.schema).parquet(f"{base}/in")
    counts = I.windowed_counts(stream, "ts", "event_type", "1 day", "1 hour")
    name = base.rpartition("/")[2].replace("-", "_")
    counts.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return m.spark.table(name).select(F.col("window.start").alias("day"), "event_type", "n")


_SPAN, _LATE, _DAY = 36 * 3_600_000, 6 * 86_400_000, 86_400_000


def _late_events(m, base: str, *columns):
    """events as a stream of four micro-batches by week; a fifth of the rows comes one to three batches too late."""
    first = m.table("events").agg(F.min(F.col("ts").cast("timestamp"))).first()[0]
    events = m.table("events").filter("ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.floor((F.unix_millis("ts") - F.unix_millis(F.lit(first))) / (8 * _DAY))
    number = F.least(F.lit(3), week + F.when(F.col("event_id") % 5 == 0, 1 + F.col("event_id") % 3).otherwise(0))
    rows = settled(events.select(*columns, "ts", number.alias("batch")))
    for k in range(4):
        rows.filter(F.col("batch") == k).drop("batch").coalesce(1).write.mode("append").parquet(f"{base}/in")
    return state_session(m.spark).readStream.schema(rows.drop("batch").schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")


def _outcome(m, stream, base: str):
    stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return m.spark.read.schema(stream.schema).parquet(f"{base}/out")


_FIRST = f"""WITH RECURSIVE f AS (SELECT min(ts) AS first FROM events), e AS (
  SELECT event_id, user_id, event_type, epoch_ms(ts) AS ms, least(3, (epoch_ms(ts) - epoch_ms(first)) // {8 * _DAY} + CASE WHEN event_id % 5 = 0 THEN 1 + event_id % 3 ELSE 0 END) AS batch FROM events, f WHERE ts IS NOT NULL
), marks AS (
  SELECT b, coalesce((SELECT max(ms) FROM e WHERE batch < b) - {_LATE}, 0) AS mark FROM range(4) t(b)
), live AS (
  SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY batch, ms, event_id) AS n FROM e JOIN marks ON b = batch WHERE ms > mark
), r AS (
  SELECT user_id, event_type, n, event_id, [ms] AS passed, true AS ok FROM live WHERE n = 1
  UNION ALL
  SELECT l.user_id, l.event_type, l.n, l.event_id, CASE WHEN len(list_filter(r.passed, lambda x: abs(x - l.ms) <= {_SPAN})) = 0 THEN list_append(r.passed, l.ms) ELSE r.passed END, len(list_filter(r.passed, lambda x: abs(x - l.ms) <= {_SPAN})) = 0
  FROM r JOIN live l ON l.user_id IS NOT DISTINCT FROM r.user_id AND l.event_type IS NOT DISTINCT FROM r.event_type AND l.n = r.n + 1
) SELECT event_id, user_id, event_type FROM r WHERE ok"""


@add("stream_first_rows", "R04 D01", _FIRST, model=False)
def _(m):
    """The first event of each user and type within 36 hours, where rows come late on both sides of a watermark of six days."""
    base = workspace(m.spark, "first")
    stream = _late_events(m, base, "event_id", "user_id", "event_type")
    return _outcome(m, first_rows(stream, ["user_id", "event_type"], "ts", "event_id", "36 hours", "6 days"), base).select("event_id", "user_id", "event_type")


@add("stream_deduplicated", "R04", "SELECT DISTINCT user_id, event_type FROM events WHERE ts IS NOT NULL", model=False)
def _(m):
    """One row of each key, by the built-in operator; its watermark leaves no row behind."""
    base = workspace(m.spark, "deduplicated")
    stream = _late_events(m, base, "user_id", "event_type")
    return _outcome(m, I.deduplicated(stream, ["user_id", "event_type"], "ts", "400 days"), base).select("user_id", "event_type")


@add("stream_model_queue", "R06")
def _(m):
    """What the slow model of each event type takes, an hour a tick: fresh events first, and a backlog that they put off."""
    base = workspace(m.spark, "queue")
    kind = F.when(F.col("event_id") % 3 == 0, "backlog").otherwise("fresh")
    stream = _late_events(m, base, F.col("event_type").alias("lane"), F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 4 + 1).cast("int").alias("rank"))
    return _outcome(m, model_queue(stream, "ts", "1 day", "1 hour", 4, 100), base)


@add("stream_channels", "R01 S01", "SELECT event_type AS kind, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, CAST(least(2, count(DISTINCT user_id % 6)) AS BIGINT) AS most FROM events GROUP BY 1", model=False)
def _(m):
    """Channels of events, read as a stream of at most two channels of a type in a trigger: all rows once, and the most channels of a batch."""
    base = workspace(m.spark, "channels")
    rows = m.table("events").select(F.col("event_id").cast("string").alias("external_id"), "event_type", (F.col("user_id") % 6).alias("channel"), (F.col("event_id") % 2).alias("part"))
    for k in range(2):
        rows.filter(F.col("part") == k).drop("part").withColumnRenamed("event_type", "kind").repartition(1).write.mode("append").partitionBy("kind", "channel").json(f"{base}/in")
    m.spark.dataSource.register(LandedChannels)
    stream = m.spark.readStream.format("landed_channels").option("folder", f"{base}/in").option("progress", f"{base}/progress").option("cap", 2).load()
    query = stream.writeStream.foreachBatch(lambda batch, number: batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{base}/out")).option("checkpointLocation", f"{base}/checkpoint").start()
    query.processAllAvailable()  # until a trigger finds nothing left
    query.stop()
    out = m.spark.read.parquet(f"{base}/out")
    most = out.groupBy("kind", "batch").agg(F.count_distinct("channel").alias("most")).groupBy("kind").agg(F.max("most").alias("most"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("external_id").cast("long")).alias("ids")).join(most, "kind").select("kind", "n", "ids", "most")


@add("worker_passes", "R05 F11 F12 F13", "SELECT 'classify' AS pass, id FROM (SELECT id FROM items WHERE confidence IS NULL ORDER BY fetched_at DESC, id DESC LIMIT 50) UNION ALL SELECT 'index', id FROM (SELECT id FROM items WHERE NOT indexed ORDER BY fetched_at DESC, id DESC LIMIT 50) UNION ALL SELECT 'check', id FROM (SELECT id FROM items WHERE similar_to_id IS NULL AND NOT duplicate_checked AND fetched_at >= TIMESTAMP '1998-08-02 15:30:00' - INTERVAL 7 DAY ORDER BY fetched_at DESC, id DESC LIMIT 50)")
def _(m):
    passes = [rows.select(F.lit(name).alias("pass"), "id") for name, rows in I.worker_passes(m.items, AS_OF)]
    return passes[0].unionByName(passes[1]).unionByName(passes[2])


@add("model_schedule", "R06", "WITH f AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM items WHERE id % 7 = 3), q AS (SELECT id, CAST((n - 1) // 10 AS INTEGER) AS run FROM f WHERE n <= 1000), b AS (SELECT id FROM items WHERE needs_llm_processing AND confidence IS NOT NULL AND coalesce(retry_priority <> 'low', true) AND id NOT IN (SELECT id FROM q) ORDER BY CASE retry_priority WHEN 'high' THEN 1 WHEN 'edge_case' THEN 2 ELSE 4 END, fetched_at DESC, id DESC LIMIT 50) SELECT id, 'fresh' AS kind, run FROM q UNION ALL SELECT id, 'backlog', (SELECT coalesce(max(run) + 1, 0) FROM q) FROM b")
def _(m):
    return I.model_schedule(m.items.filter("id % 7 = 3").select("id", F.col("id").alias("seq")), backlog(m.items))


@add("worker_commands", "R07", "SELECT event_type AS name, arg_max(event_id % 3, ts) AS action FROM events WHERE ts >= TIMESTAMP '2024-01-29' GROUP BY 1", model=False)
def _(m):
    commands = m.table("events").select(F.col("event_type").alias("name"), (F.col("event_id") % 3).alias("action"), F.col("ts").alias("at"))
    return I.live_commands(commands, datetime(2024, 1, 31), 2 * 86400)


@add("tfidf_relevance", "V08 V10 V12 E01")
def _(m):
    rows = m.table("labels").join(m.table("documents"), "doc_id").select("doc_id", "text", F.col("quality").cast("double").alias("relevant"), F.col("lang").alias("language"))
    rows = stratified_split(rows, "doc_id", "relevant")
    terms = C.Tfidf().fit(rows.filter("split = 'train'"))
    prepare = lambda df: C.with_features(terms(df), hand_features(F.col("text")))
    model = C.Hierarchy(["language"]).fit(prepare(rows.filter("split = 'train'")))
    out = model.predict(prepare(rows.filter("split <> 'train'"))).withColumn("truth", F.col("relevant") == 1)
    return relevance_figures(out, "truth", "relevant_guess")


@add("embedding_classifier", "V07 V10")
def _(m):
    rows = C.vectors(m.table("embeddings").withColumn("relevant", (F.col("label") < 5).cast("double")).withColumn("kind", F.col("label").cast("string")), "embedding")
    model = C.Hierarchy(["kind"]).fit(rows.filter("vec_id % 5 <> 0"))
    out = model.predict(rows.filter("vec_id % 5 = 0"))
    return out.select("vec_id", F.round("confidence", 6).alias("confidence"), "relevant_guess", "kind_guess", C.should_process(F.col("relevant_guess"), F.col("confidence"), 0.7).alias("process"))


@add("multilabel_classifier", "V09 E05")
def _(m):
    rows = C.vectors(m.table("embeddings").withColumn("groups", F.array((F.col("label") % 3).cast("string"))), "embedding")
    models = C.multilabel(rows.filter("vec_id % 5 <> 0"), "groups", ["0", "1", "2"])
    return C.multilabel_guess(rows.filter("vec_id % 5 = 0"), models).select("vec_id", F.array_join("guess", ",").alias("guess"))


@add("hashed_embeddings", "V11")
def _(m):
    out = C.hashed_embedding(m.table("documents").select("doc_id", "text"), "text", 16)
    return out.select("doc_id", F.array_join(F.transform("vector", lambda x: F.round(x, 6).cast("string")), ",").alias("vector"))


_V = "[CAST(length(c) AS DOUBLE), " + ", ".join(f"CAST(length(c) - length(replace(c, '{x}', '')) AS DOUBLE)" for x in "en ") + "]"


def letters(texts: list[str]) -> list[list[float]]:
    """A stand-in for a model: length and three counts; texts of more than 200 characters are refused."""
    if any(len(t) > 200 for t in texts):
        raise Refused
    return [[float(len(t)), *(float(t.count(c)) for c in "en ")] for t in texts]


_LONG = f"""WITH p AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 250)) AS place FROM documents WHERE length(text) > 0),
q AS (SELECT doc_id, substr(text, place + 1, 300) AS c FROM p), h AS (SELECT doc_id, unnest(CASE WHEN length(c) > 200 THEN [substr(c, 1, length(c) // 2), substr(c, length(c) // 2 + 1)] ELSE [c] END) AS c FROM q),
v AS (SELECT doc_id, {_V} AS v FROM h), m AS (SELECT doc_id, avg(v[1]) AS a, avg(v[2]) AS b, avg(v[3]) AS c, avg(v[4]) AS d FROM v GROUP BY 1), u AS (SELECT *, sqrt(a * a + b * b + c * c + d * d) AS n FROM m)
SELECT doc_id, round(coalesce(a / n, 0), 6) AS a, round(coalesce(b / n, 0), 6) AS b, round(coalesce(c / n, 0), 6) AS c, round(coalesce(d / n, 0), 6) AS d FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN u USING (doc_id)"""


@add("long_text_embeddings", "V11", _LONG, model=False)
def _(m):
    out = embedded(m.table("documents"), "doc_id", "text", letters, 4, size=300, overlap=50)
    return out.select("doc_id", *(F.round(F.col("vector")[i], 6).alias(c) for i, c in enumerate("abcd")))


_TERMS = ["data", "value", "haus", "les "]
_HITS = f"""WITH w AS (SELECT unnest({_TERMS}) AS word), p AS (SELECT doc_id, text, lower(text) AS low, word FROM documents, w WHERE contains(lower(text), word)),
s AS (SELECT *, unnest(range(0, length(low))) AS start FROM p), h AS (SELECT doc_id, word, start, substr(text, CAST(greatest(start - 40, 0) + 1 AS BIGINT), CAST(start + length(word) + 40 - greatest(start - 40, 0) AS BIGINT)) AS c FROM s WHERE substr(low, start + 1, length(word)) = word),
d AS (SELECT CAST(vec_id AS VARCHAR) AS name, list_transform(range(1, 5), lambda i: abs(CAST(embedding[i] AS DOUBLE))) AS x FROM embeddings WHERE vec_id < 12),
r AS (SELECT doc_id, word, start, name, round(list_cosine_similarity({_V}, x), 6) AS score FROM h, d),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, word, start ORDER BY score DESC, name DESC) = 1)"""


def _meanings(m):
    definitions = m.table("embeddings").filter("vec_id < 12").select(F.col("vec_id").cast("string").alias("name"), F.transform(F.slice("embedding", 1, 4), lambda x: F.abs(x.cast("double"))).alias("vector"))
    return meanings(m.table("documents"), "doc_id", "text", _TERMS, definitions, letters, 4, window=40)


@add("keyword_meanings", "Z02 V11", _HITS + " SELECT word, name, count(*) AS hits, count(DISTINCT doc_id) AS texts, round(max(score), 6) AS best FROM b GROUP BY 1, 2", model=False)
def _(m):
    return _meanings(m).groupBy("word", "name").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("texts"), F.max("score").alias("best"))


@add("text_meanings", "Z02", _HITS + " SELECT doc_id, arg_max(name, struct_pack(s := score, n := name)) AS name, max(score) AS score, count(*) AS hits FROM b GROUP BY 1", model=False)
def _(m):
    return best_meaning(_meanings(m), "doc_id")


@add("model_calls", "V13 X42", "SELECT item_id, sha256(text) AS answer FROM benchmark", model=False)
def _(m):
    rows = m.table("benchmark").select("item_id", F.col("text").alias("prompt"))
    return C.with_model(rows, "prompt", lambda texts: [hashlib.sha256(t.encode()).hexdigest() for t in texts]).select("item_id", "answer")


@add("model_calls_whole", "V13 X42")
def _(m):
    rows = m.table("benchmark").select("item_id", F.col("text").alias("prompt"))
    return C.with_model(rows, "prompt", lambda texts: [t.upper() for t in texts]).select("item_id", "answer")


@add("content_hashes_differ", "X02 D01", "SELECT count(DISTINCT sha256(text)) AS n FROM documents", model=False)
def _(m):
    return m.table("documents").select(content_hash(F.col("text")).alias("h")).agg(F.count_distinct("h").alias("n"))
