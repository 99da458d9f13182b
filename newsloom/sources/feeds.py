"""Connectors as rules over landed rows: feeds as XML, posts as JSON, files as text.

Fetching is left to what lands the rows; everything after it is here. Each connector returns raw items:
external_id, title, content, url, author, published_at and metadata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.functions.text import short_title
from newsloom.functions.times import instagram_time, linkedin_time, pdf_date
from newsloom.functions.urls import NOT_ARTICLES, domain, redirect_target
from newsloom.sources.registry import connector

LINK = "array<struct<_href:string,_rel:string,_VALUE:string>>"
RSS = (
    f"channel struct<title:string,item:array<struct<guid:string,title:string,link:{LINK},description:string,pubDate:string,updated:string,author:string,category:array<string>,content:string>>>, "
    f"title string, entry array<struct<id:string,title:string,link:{LINK},summary:string,published:string,updated:string,author:struct<name:string>,category:array<struct<_term:string>>,content:string>>"
)
# Hosts of the network itself, whose links in a post lead to no article.
FEDIVERSE_HOSTS = ["mastodon.social", "mastodon.online", "mstdn.social", "social.hessen.de", "social.bund.de", "hessen.social"]


def _raw(rows: DataFrame, external_id: Column, title: Column, content: Column, url: Column, published: Column, author: Column | None = None, **metadata: Column) -> DataFrame:
    pairs = [x for k, v in metadata.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(
        external_id.alias("external_id"), title.alias("title"), content.alias("content"), url.alias("url"), (author if author is not None else F.lit(None).cast("string")).alias("author"),
        published.alias("published_at"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("metadata"),
    )


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _absolute(link: Column, base: Column) -> Column:
    root = F.regexp_extract(base, "^([A-Za-z]+://[^/]*)", 1)
    return F.when(F.rlike(link, F.lit("^[A-Za-z][A-Za-z0-9+.-]*://")), link).when(F.startswith(link, F.lit("/")), F.concat(root, link)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), link))


def _first(rows: DataFrame, n: int | None, *by: str) -> DataFrame:
    """The first n rows of each profile or channel in the page's order (column `place`), where a limit is set."""
    if not n:
        return rows
    place = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    return rows.withColumn("_nth", place).filter(F.col("_nth") <= n).drop("_nth")


def entries(landed: DataFrame) -> DataFrame:
    """One row an entry of RSS or Atom, from rows of url and xml, in one layout: feed_url, feed_title and e."""
    feed = landed.select(F.col("url").alias("feed_url"), F.from_xml("xml", RSS).alias("x"))
    href = lambda l: F.coalesce(_blank(l["_VALUE"]), _blank(l["_href"]))
    # The entry's own link, else the first of its links, whatever its kind.
    link = lambda e: F.coalesce(href(F.try_element_at(F.filter(e["link"], lambda l: F.coalesce(l["_rel"], F.lit("alternate")) == "alternate"), F.lit(1))), href(F.try_element_at(e["link"], F.lit(1))))
    one = lambda e, key, date, summary, author, tags: F.struct(key.alias("key"), e["title"].alias("title"), link(e).alias("link"), date.alias("published"), e["updated"].alias("updated"), e["content"].alias("content"), summary.alias("summary"), author.alias("author"), tags.alias("tags"))
    rss = F.transform("x.channel.item", lambda e: one(e, e["guid"], e["pubDate"], e["description"], e["author"], e["category"]))
    atom = F.transform("x.entry", lambda e: one(e, e["id"], e["published"], e["summary"], e["author"]["name"], F.transform(e["category"], lambda c: c["_term"])))
    none = F.array().cast("array<struct<key:string,title:string,link:string,published:string,updated:string,content:string,summary:string,author:string,tags:array<string>>>")
    return feed.select("feed_url", F.coalesce("x.channel.title", "x.title").alias("feed_title"), F.explode(F.concat(F.coalesce(rss, none), F.coalesce(atom, none))).alias("e"))


def _date(c: Column) -> Column:
    return F.coalesce(F.try_to_timestamp(F.regexp_replace(c, "^[A-Za-z]+, *", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))


@connector("rss", "url")
def rss(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of url and xml, RSS or Atom. Date: published, else updated; content: full, else summary; redirects unwrapped."""
    e = entries(landed)
    link = redirect_target(_absolute(F.coalesce("e.link", F.lit("")), F.col("feed_url")))
    return _raw(
        e, F.coalesce(_blank(F.col("e.key")), F.col("e.link")), F.coalesce(_blank(F.col("e.title")), F.lit("Untitled")), F.coalesce(_blank(F.col("e.content")), _blank(F.col("e.summary")), F.lit("")),
        link, F.coalesce(_date(F.col("e.published")), _date(F.col("e.updated"))), _blank(F.col("e.author")), source_domain=domain(link), feed_title=F.col("feed_title"), feed_url=F.col("feed_url"), tags=F.array_join("e.tags", ","),
    )


@connector("google_alerts", "url")
def google_alerts(landed: DataFrame, config: dict) -> DataFrame:
    return rss(landed.filter(F.contains("url", F.lit("google.com/alerts")) | F.contains("url", F.lit("google.de/alerts"))), config)


@connector("pdf", "url")
def pdf(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of url, bytes, pages (texts), title and created (as in the file)."""
    text = F.array_join("pages", "\n")
    first = F.substring(F.trim(F.element_at(F.split(text, "\n"), 1)), 1, 100)
    return _raw(landed, F.substring(F.md5("bytes"), 1, 16), F.coalesce(_blank(F.col("title")), _blank(first), F.lit("PDF Document")), text, F.col("url"), pdf_date(F.col("created")))


@connector("bluesky", "handle")
def bluesky(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of uri, text, links and created_at; the first outside link stands for the post."""
    outside = F.filter("links", lambda u: ~F.contains(u, F.lit("bsky.app")))
    return _raw(landed, F.col("uri"), short_title(F.col("text")), F.col("text"), F.coalesce(F.try_element_at(outside, F.lit(1)), F.col("uri")), F.to_timestamp("created_at"), linked=F.try_element_at(outside, F.lit(1)))


STATUS = "id string, content string, url string, created_at string, in_reply_to_id string, favourites_count bigint, reblogs_count bigint, replies_count bigint"


def _outside(text: Column, config: dict) -> Column:
    """The first address in a post that leads out of the network."""
    hosts = "|".join(x.replace(".", r"\.") for x in [*FEDIVERSE_HOSTS, *([config["instance"].lower()] if config.get("instance") else [])])
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s\"'<>]+)"), 1)
    return F.try_element_at(F.filter(found, lambda u: ~F.rlike(F.lower(u), F.lit(hosts))), F.lit(1))


@connector("mastodon", "handle")
def mastodon(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of json, one status each, or with a configuration of rss, rows of url and xml.

    A boost stands for the boosted post; replies are left out. limit: the newest so many posts of the account, as its
    interface gives. metadata.linked: the first address outside of the network, whose article stands for the post.
    """
    if config.get("rss"):
        e = entries(landed)
        text = F.trim(F.regexp_replace(F.coalesce("e.summary", F.lit("")), "<[^>]+>", ""))
        return _raw(e, F.coalesce(_blank(F.col("e.key")), F.col("e.link")), short_title(text), text, F.col("e.link"), _date(F.col("e.published")), linked=_outside(F.col("e.summary"), config))
    s = landed.select(F.from_json("json", STATUS + f", reblog struct<{', '.join(x.strip().replace(' ', ': ', 1) for x in STATUS.split(','))}>").alias("s")).filter("s.in_reply_to_id IS NULL")
    pick = lambda f: F.coalesce(F.col(f"s.reblog.{f}"), F.col(f"s.{f}"))
    text = F.trim(F.regexp_replace(pick("content"), "<[^>]+>", ""))
    out = _raw(s, F.col("s.id"), short_title(text), text, pick("url"), F.to_timestamp(pick("created_at")), favourites=pick("favourites_count"), reblogs=pick("reblogs_count"), replies=pick("replies_count"), is_reblog=F.col("s.reblog").isNotNull(), linked=_outside(pick("content"), config))
    return out.orderBy(F.col("published_at").desc_nulls_last(), F.col("external_id").desc()).limit(config["limit"]) if config.get("limit") else out


@connector("telegram", "channel")
def telegram(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of channel, id, text, forwarded_from, posted_at, has_photo, has_video, has_document and, for a limit of
    max_posts a channel (taken before any post is left out), place."""
    rows = _first(landed, config.get("max_posts"), "channel")
    rows = rows if config.get("forwards") else rows.filter("forwarded_from IS NULL")
    media = F.array_compact(F.array(*(F.when(F.col(f"has_{k}"), k) for k in ("photo", "video", "document"))))
    rows = rows.withColumn("media", media).filter((F.coalesce(_blank(F.col("text")), F.lit("")) != "") | (F.size("media") > 0))
    text = F.coalesce("text", F.lit(""))
    own = F.md5(F.concat_ws(":", "channel", F.substring(text, 1, 100), F.col("posted_at").cast("string")))
    return _raw(rows, F.coalesce(F.col("id"), own), short_title(text), text, F.concat(F.lit("https://t.me/"), "channel", F.lit("/"), F.coalesce("id", F.lit(""))), F.col("posted_at"), media_types=F.array_join("media", ","))


@connector("twitter", "username")
def twitter(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of id, title, content, link and published_at from a mirror's feed, whose host becomes the network's own."""
    rows = landed
    for flag, start in (("retweets", "RT by"), ("replies", "R to")):
        if not config.get(flag):
            rows = rows.filter(~F.startswith("title", F.lit(start)))
    return _raw(rows, F.col("id"), short_title(F.col("title")), F.col("content"), F.regexp_replace("link", "^https?://[^/]+", "https://twitter.com"), F.col("published_at"))


@connector("x_scraper", "username")
def x_posts(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of text, permalink, links, cards, is_reply and posted_at; a post needs a text and a status number."""
    rows = landed.filter(_blank(F.col("text")).isNotNull()).withColumn("status", F.regexp_extract("permalink", r"/status/(\d+)", 1)).filter("status <> ''")
    if not config.get("replies"):
        rows = rows.filter(~F.col("is_reply"))
    links = F.array_distinct(F.concat("links", "cards"))
    good = F.filter(links, lambda u: ~F.rlike(u, F.lit("(?i)" + "|".join(NOT_ARTICLES))))
    return _raw(rows, F.col("status"), short_title(F.col("text")), F.col("text"), F.coalesce(F.try_element_at(good, F.lit(1)), F.col("permalink")), F.col("posted_at"), extracted_links=F.array_join(links, ","))


@connector("instagram", "username")
def instagram(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of href, caption, when (relative) and seen_at, as a browser or one of three mirrors shows them.

    layout picuki: addresses are /media/<code>, and a post without one gets an id of its name and caption; picnob and
    imginn: /p/<code>. Mirrors tell reels by a mark (is_reel) instead of the address. Reels only if asked for.
    max_posts: the first so many of a page (place).
    """
    layout = config.get("layout")
    rows = _first(landed, config.get("max_posts"), "username") if "username" in landed.columns else landed
    if not config.get("reels"):
        rows = rows.filter(~F.coalesce("is_reel", F.lit(False))) if layout else rows.filter(~F.contains("href", F.lit("/reel/")))
    pattern = {"picuki": "/media/([^/]+)", "picnob": "/p/([^/]+)", "imginn": "/p/([^/]+)"}.get(layout, "/(?:p|reel)/([^/?]+)")
    code = _blank(F.regexp_extract("href", pattern, 1))
    if layout == "picuki":
        key = F.coalesce(code, F.md5(F.concat(F.lit(f"{config['username']}:"), F.substring(F.coalesce("caption", F.lit("")), 1, 100))))
    else:
        rows, key = rows.filter(code.isNotNull()) if layout else rows, F.coalesce(code, F.lit(""))
    title = F.coalesce(_blank(short_title(F.col("caption"))), F.lit(f"Post by @{config.get('username')}")) if layout else short_title(F.col("caption"))
    url = F.when(code.isNotNull() | (F.lit(layout) != "picuki"), F.concat(F.lit("https://www.instagram.com/p/"), F.coalesce(code, F.lit("")), F.lit("/"))).otherwise(F.col("href")) if layout else F.concat(F.lit("https://www.instagram.com/p/"), key, F.lit("/"))
    return _raw(rows, key, title, F.col("caption"), url, instagram_time(F.col("when"), F.col("seen_at")))


@connector("linkedin", "profile_url")
def linkedin(landed: DataFrame, config: dict) -> DataFrame:
    """Rows of profile, place, html, text, when (relative) and seen_at; a post without its number gets one of its own."""
    number = F.nullif(F.regexp_extract("html", r"(\d{19})", 1), F.lit(""))
    made = F.concat_ws("_", F.lit("linkedin"), "profile", F.col("place").cast("string"), F.unix_timestamp("seen_at").cast("string"))
    return _raw(landed, F.coalesce(number, made), short_title(F.col("text")), F.col("text"), F.coalesce(F.concat(F.lit("https://www.linkedin.com/feed/update/urn:li:activity:"), number), F.concat(F.lit("https://www.linkedin.com/in/"), "profile")), linkedin_time(F.col("when"), F.col("seen_at")))


def with_dataset_notes(items: DataFrame, notes: DataFrame) -> DataFrame:
    """items with what is known of the dataset their title begins with (notes: id, names, coverage, method), German before English."""
    key = F.regexp_extract("title", r"^([A-Z0-9_]+)\s*-", 1)
    known = notes.select(F.col("id").alias("_id"), "names", "coverage", "method")
    name = F.coalesce(F.try_element_at("names", F.lit("de")), F.try_element_at("names", F.lit("en")))
    excerpt = F.when(F.length("method") > 2000, F.coalesce(_blank(F.regexp_extract(F.substring("method", 1, 2000), r"(?s)^(.*[.])", 1)), F.substring("method", 1, 2000))).otherwise(F.col("method"))
    both = items.withColumn("_id", key).join(known, "_id", "left")
    return both.withColumn("content", F.when(F.col("names").isNull(), F.col("content")).otherwise(F.concat_ws("\n", "content", name, "coverage", excerpt))).drop("_id", "names", "coverage", "method")


def labelled(spark, paths: list[str], schema: str) -> DataFrame:
    """Labelled records of several JSON lines files with the file each came from; broken and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths).withColumn("file", F.col("_metadata.file_path"))
