"""Queries over texts, addresses, pages and rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions import html as H
from newsloom.functions import salvage, times, topics
from newsloom.functions import text as X
from newsloom.functions import urls as U
from newsloom.operators import rules as R
from newsloom.operators import stats as S
from newsloom.operators.mentions import mentions
from newsloom.plans.model import Catalog
from newsloom.schemas import WORKING_GROUPS

catalog = Catalog()
add = catalog.add

RULES = [
    {"id": 1, "rule_type": "keyword", "pattern": "the, of", "priority_boost": 20, "target_priority": None, "enabled": True, "order": 0},
    {"id": 2, "rule_type": "regex", "pattern": r"\btion\w*\b", "priority_boost": 15, "target_priority": "high", "enabled": True, "order": 1},
    {"id": 3, "rule_type": "keyword", "pattern": "keiten,ungen", "priority_boost": -60, "target_priority": None, "enabled": True, "order": 2},
    {"id": 4, "rule_type": "regex", "pattern": "(unclosed", "priority_boost": 50, "target_priority": "high", "enabled": True, "order": 3},
]
_TITLE = "substr(string_split(text, chr(10))[1], 1, 120)"


def _title():
    return F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 120)


@add("content_hash", "X02", "SELECT doc_id, sha256(text) AS hash FROM documents", model=False)
def _(m):
    return m.table("documents").select("doc_id", X.content_hash(F.col("text")).alias("hash"))


@add("squeezed_text", "X01", r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '<[^>]+>', '', 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), ' ') AS text FROM documents", model=False)
def _(m):
    return m.table("documents").select("doc_id", X.squeeze(F.col("text")).alias("text"))


@add("normalized_pages", "X01")
def _(m):
    return m.table("pages").select("page_id", X.normalize_content(F.col("html")).alias("text"))


@add("boilerplate_removed", "X04 X49", "SELECT doc_id, trim('kurz' || text, chr(10) || chr(13) || chr(9) || ' ') AS text FROM documents", model=False)
def _(m):
    merged = X.merged_article(F.lit("kurz"), F.lit("e.org"), F.col("text"))
    return m.table("documents").select("doc_id", X.strip_boilerplate(merged).alias("text"))


@add("keyword_score", "X08 X09", """WITH w AS (SELECT * FROM (VALUES ('kürzung', 40), ('streichung', 40), ('haushaltssperre', 40), ('finanzierungslücke', 40), ('kahlschlag', 40), ('förderentzug', 40), ('nothaushalt', 40), ('haushaltskrise', 40), ('schließung', 40), ('abbau', 40), ('existenzbedrohend', 40), ('insolvenz', 40), ('personalreduzierung', 40), ('stellenabbau', 40), ('einschnitte', 40),
('gesetzesänderung', 20), ('novelle', 20), ('anhörung', 20), ('regierungsentwurf', 20), ('bundesratsentscheidung', 20), ('gesetzgebung', 20), ('reform', 20), ('pflegenotstand', 10), ('kitaplätze', 10), ('migrationsberatung', 10), ('fachkräftemangel', 10), ('sozialfinanzierung', 10), ('eingliederungshilfe', 10), ('kinderbetreuung', 10)) v(k, w)),
t AS (SELECT doc_id, lower(text || CASE doc_id % 4 WHEN 0 THEN ' Novelle und Kürzung' WHEN 1 THEN ' REFORM' ELSE '' END) AS x FROM documents), s AS (SELECT doc_id, CAST(least(100, 50 + coalesce((SELECT sum(w) FROM w WHERE contains(x, k)), 0)) AS INTEGER) AS score FROM t)
SELECT doc_id, score, CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' WHEN score >= 40 THEN 'low' ELSE 'none' END AS by_keyword, CASE WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' WHEN score > 50 THEN 'low' ELSE 'none' END AS by_score FROM s""", model=False)
def _(m):
    d = F.col("doc_id") % 4
    text = F.concat("text", F.when(d == 0, " Novelle und Kürzung").when(d == 1, " REFORM").otherwise(""))
    s = m.table("documents").select("doc_id", X.keyword_score(text).alias("score"))
    return s.select("doc_id", "score", X.keyword_priority(F.col("score")).alias("by_keyword"), X.score_priority(F.col("score")).alias("by_score"))


@add("rule_match", "X06 X07 X12 J16 W05 K25", r"""WITH h AS (SELECT doc_id, contains(x, 'the') OR contains(x, 'of') AS a, regexp_matches(x, '(^|[^\p{L}\p{M}\p{N}_])tion') AS b, contains(x, 'keiten') OR contains(x, 'ungen') AS c, contains(x, 'reform') AS k FROM (SELECT doc_id, lower(text) AS x FROM documents)),
s AS (SELECT *, CAST(greatest(0, least(100, 50 + CASE WHEN a THEN 20 ELSE 0 END + CASE WHEN b THEN 15 ELSE 0 END - CASE WHEN c THEN 60 ELSE 0 END + CASE WHEN k THEN 20 ELSE 0 END)) AS INTEGER) AS score FROM h)
SELECT doc_id AS id, concat_ws(',', CASE WHEN a THEN '1' END, CASE WHEN b THEN '2' END, CASE WHEN c THEN '3' END) AS rules, score, CASE WHEN b THEN 'high' WHEN score >= 90 THEN 'high' WHEN score >= 70 THEN 'medium' WHEN score > 50 THEN 'low' ELSE 'none' END AS priority FROM s""", model=False)
def _(m):
    items = m.table("documents").select(F.col("doc_id").alias("id"), F.lit(None).cast("string").alias("title"), F.col("text").alias("content"))
    found = R.apply_rules(items, RULES)
    return found.select("id", F.array_join("rule_ids", ",").alias("rules"), F.col("priority_score").alias("score"), "priority")


@add("confidence_bucket", "X10 X11 X46", """SELECT id, CASE WHEN c >= 0.5 THEN 'medium' WHEN c >= 0.25 THEN 'low' ELSE 'none' END AS priority, CASE WHEN c >= 0.5 THEN 70 WHEN c >= 0.25 THEN 55 ELSE 20 END AS score, NOT coalesce(c >= 0.25, false) AS skip,
CASE WHEN c IS NULL THEN 'unknown' WHEN c >= 0.5 THEN 'high' WHEN c >= 0.25 THEN 'edge_case' ELSE 'low' END AS retry, CASE p WHEN 'high' THEN 90 WHEN 'medium' THEN 70 WHEN 'low' THEN 50 ELSE 60 END AS toggled FROM (SELECT id, confidence AS c, priority AS p FROM items)""")
def _(m):
    b = X.confidence_bucket(F.col("confidence"))
    return m.items.select("id", b["priority"].alias("priority"), b["score"].alias("score"), b["skip"].alias("skip"), X.retry_priority(F.col("confidence")).alias("retry"), X.toggled_priority(F.col("priority"))["score"].alias("toggled"))


_OUT = "CASE WHEN {p} = 'high' THEN greatest(s, 90) WHEN {p} = 'medium' THEN greatest(s, 70) WHEN {p} = 'low' THEN greatest(s, 40) ELSE least(CASE WHEN s = 0 THEN 100 ELSE coalesce(s, 100) END, 20) END"
_P1 = "CASE WHEN relevant AND priority IN ('high', 'medium', 'low') THEN priority ELSE 'none' END"
_P2 = "CASE WHEN NOT relevant THEN 'none' WHEN priority = 'high' THEN 'medium' WHEN priority = 'medium' THEN 'low' ELSE 'none' END"


@add("model_outcome", "X13 X14 X15 K23", f"SELECT id, p1, CAST({_OUT.format(p='p1')} AS INTEGER) AS s1, p2, CAST({_OUT.format(p='p2')} AS INTEGER) AS s2, coalesce(model_ak, assigned_ak, 'AK9') AS grp FROM (SELECT *, priority_score AS s, {_P1} AS p1, {_P2} AS p2 FROM (SELECT *, id % 8 <> 0 AS relevant FROM items))")
def _(m):
    rel, p, s = F.col("id") % 8 != 0, F.col("priority"), F.col("priority_score")
    a, b = X.model_outcome(p, rel, s), X.model_outcome(p, rel, s, True)
    groups = X.group_fallback(F.when(F.col("model_ak").isNotNull(), F.array("model_ak")), F.col("assigned_ak"), F.lit("AK9"))
    return m.items.select("id", a["priority"].alias("p1"), a["score"].alias("s1"), b["priority"].alias("p2"), b["score"].alias("s2"), groups[0].alias("grp"))


@add("topics_validated", "X17", "SELECT id, CASE WHEN lower(topic) IN ('pflege', 'integration', 'demenz') THEN topic ELSE 'Sonstiges' END AS topic, CASE WHEN topic = 'Bildung' THEN topic END AS suggestion FROM items")
def _(m):
    rows = m.items.select("id", F.concat(F.lit(" "), F.upper("topic"), F.lit(" ")).alias("said"))
    out = topics.validated(rows, "said")
    return out.select("id", "topic", F.initcap("suggestion").alias("suggestion"))


@add("topics_mapped", "X18 W05", "SELECT id, CASE WHEN retry_priority = 'low' THEN 'Pflege' WHEN topic IN ('Pflege', 'Demenz') THEN 'Gesundheit' END AS topic FROM items")
def _(m):
    tags = F.array(F.coalesce("retry_priority", F.lit("-")), F.coalesce(F.concat(F.lit(" "), F.upper("topic")), F.lit("-")))
    return m.items.select("id", topics.mapped(tags, {"low": "Pflege", "pflege": "Gesundheit", "demenz": "Gesundheit"}).alias("topic"))


@add("topics_from_tag_table", "X18", "WITH t AS (SELECT lower(p_brand) AS tag, arg_max(p_type, p_partkey) AS topic FROM part GROUP BY 1), d AS (SELECT doc_id, unnest(['Brand#' || CAST(doc_id % 60 AS STRING), ' BRAND#' || CAST(doc_id % 37 AS STRING) || ' ', source]) AS said, unnest([0, 1, 2]) AS pos FROM documents) SELECT doc_id AS id, arg_min(topic, pos) AS topic FROM d JOIN t ON t.tag = lower(trim(said)) GROUP BY 1", model=False)
def _(m):
    tags = F.array(F.concat(F.lit("Brand#"), (F.col("doc_id") % 60).cast("string")), F.concat(F.lit(" BRAND#"), (F.col("doc_id") % 37).cast("string"), F.lit(" ")), F.col("source"))
    table = m.table("part").select(F.col("p_brand").alias("tag"), F.col("p_type").alias("topic"), F.col("p_partkey").alias("place"))
    return topics.map_tags(m.table("documents").select(F.col("doc_id").alias("id"), tags.alias("tags")), "tags", table)


@add("sentence_count", "X22", r"SELECT doc_id, CAST(len(list_filter(string_split_regex(regexp_replace(text, '([.!?])\s+([A-ZÄÖÜ])', '\1' || chr(1) || '\2', 'g'), '[.!?]\x01|[.!?]$'), lambda s: trim(s) <> '')) AS INTEGER) AS sentences FROM documents", model=False)
def _(m):
    return m.table("documents").select("doc_id", X.count_sentences(F.col("text")).alias("sentences"))


@add("label_validation", "X22", "SELECT id, summary IS NULL OR summary = '' OR id % 3 <> 0 AS valid FROM (SELECT id, CASE WHEN id % 3 = 0 THEN 'Eins. Zwei. Drei.' ELSE '' END AS summary FROM items)")
def _(m):
    s = F.when(F.col("id") % 3 == 0, "Eins. Zwei. Drei.").otherwise("")
    return m.items.select("id", X.label_valid(F.col("id") % 3 == 0, s, s).alias("valid"))


@add("hand_features", "X40", "SELECT doc_id, CAST(contains(x, 'liga') AS INTEGER) + CAST(contains(x, 'wohlfahrt') AS INTEGER) + CAST(contains(x, 'awo') AS INTEGER) + CAST(contains(x, 'caritas') AS INTEGER) + CAST(contains(x, 'diakonie') AS INTEGER) + CAST(contains(x, 'drk') AS INTEGER) + CAST(contains(x, 'paritätisch') AS INTEGER) + CAST(contains(x, 'wohlfahrtsverband') AS INTEGER) + CAST(contains(x, 'spitzenverband') AS INTEGER) + CAST(contains(x, 'freie wohlfahrtspflege') AS INTEGER) AS liga_hits, CAST(length(x) AS INTEGER) AS length, CAST((length(x) - length(replace(x, 'hessen', ''))) / 6 AS INTEGER) AS hessen, CAST(contains(x, 'liga') AS INTEGER) AS has_liga FROM (SELECT doc_id, lower(text) AS x FROM documents)", model=False)
def _(m):
    return m.table("documents").select("doc_id", *X.hand_features(F.col("text"))).select("doc_id", "liga_hits", "length", "hessen", "has_liga")


@add("multi_hot", "X41", "SELECT id, " + " || ".join(f"CAST(CAST(coalesce(g = '{c}', false) AS INTEGER) AS STRING)" for c in WORKING_GROUPS) + " AS flags, coalesce(g, '') AS back FROM (SELECT id, coalesce(assigned_ak, model_ak) AS g FROM items)")
def _(m):
    g = F.coalesce("assigned_ak", "model_ak")
    values = F.when(g.isNotNull(), F.array(g)).otherwise(F.array().cast("array<string>"))
    rows = m.items.select("id", X.multi_hot(values, WORKING_GROUPS).alias("f"))
    return rows.select("id", F.array_join(F.transform("f", lambda x: x.cast("string")), "").alias("flags"), F.array_join(X.from_multi_hot(F.col("f"), WORKING_GROUPS), ",").alias("back"))


@add("text_chunks", "X44", "SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(text, CAST(i AS INTEGER) * 950 + 1, 1000) AS chunk FROM (SELECT doc_id, text, unnest(range(0, CAST(floor((length(text) - 1) / 950) AS INTEGER) + 1)) AS i FROM documents WHERE length(text) > 0)", model=False)
def _(m):
    return m.table("documents").select("doc_id", F.posexplode(X.chunks(F.col("text"), 1000, 50)).alias("pos", "chunk"))


@add("assembled_text", "X42 X48", f"SELECT doc_id, {_TITLE} || ' ' || text || ' [Quelle: ' || source || ']' AS whole, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents", model=False)
def _(m):
    return m.table("documents").select("doc_id", X.assembled(_title(), F.col("text"), F.col("source")).alias("whole"), X.short_title(F.col("text")).alias("short"))


@add("normalized_titles", "X24", r"SELECT doc_id, substr(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}\p{Pc}\s]', '', 'g'), '\s+', ' ', 'g')), 1, 100) AS title FROM documents", model=False)
def _(m):
    return m.table("documents").select("doc_id", X.normalize_title(F.col("text")).alias("title"))


@add("chat_format", "X43 K04", "SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS chat FROM conversations GROUP BY 1", model=False)
def _(m):
    c = m.table("conversations")
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("x"))))
    return c.groupBy("conv_id").agg(F.count("*").alias("turns"), F.array_join(F.transform(turns, lambda t: t["x"]), "\n").alias("chat"))


@add("synthetic_relevance", "X43", "SELECT id, CASE WHEN NOT is_read THEN 0.0 WHEN priority = 'high' THEN 0.85 WHEN coalesce(priority, 'medium') = 'medium' THEN 0.7 ELSE 0.55 END::DOUBLE AS score FROM items")
def _(m):
    return m.items.select("id", X.relevance_score(F.col("is_read"), F.col("priority")).alias("score"))


@add("labelling_prompt", "X50", "SELECT conv_id, string_agg('=== ARTIKEL ' || CAST(turn + 1 AS STRING) || ' ===' || chr(10) || 'Titel: ' || coalesce(role, 'N/A') || chr(10) || 'Inhalt: ' || coalesce(text, 'N/A') || chr(10), chr(10) ORDER BY turn) AS prompt FROM conversations GROUP BY 1", model=False)
def _(m):
    block = F.format_string("=== ARTIKEL %d ===\nTitel: %s\nInhalt: %s\n", F.col("turn") + 1, F.coalesce("role", F.lit("N/A")), F.coalesce("text", F.lit("N/A")))
    blocks = F.sort_array(F.collect_list(F.struct("turn", block.alias("b"))))
    return m.table("conversations").groupBy("conv_id").agg(F.array_join(F.transform(blocks, lambda x: x["b"]), "\n").alias("prompt"))


@add("formatted_bytes", "X38 A15", "SELECT doc_id, CASE WHEN n < 1024 THEN format('{:.1f} B', n) WHEN n < 1048576 THEN format('{:.1f} KB', n / 1024) WHEN n < 1073741824 THEN format('{:.1f} MB', n / 1048576) WHEN n < 1099511627776 THEN format('{:.1f} GB', n / 1073741824) ELSE format('{:.1f} TB', n / 1099511627776) END AS size FROM (SELECT doc_id, CAST(n_chars AS DOUBLE) * power(doc_id % 50 + 1, 4) AS n FROM documents)", model=False)
def _(m):
    n = F.col("n_chars").cast("double") * F.pow(F.col("doc_id") % 50 + 1, F.lit(4))
    return m.table("documents").select("doc_id", X.format_bytes(n).alias("size"))


@add("contextual_groups", "Z01", "SELECT doc_id, CASE WHEN NOT contains(x, 'the') THEN NULL WHEN contains(x, 'kita') OR contains(x, 'erzieher') OR contains(x, 'betreuung') THEN 'AK5' END AS grp FROM (SELECT doc_id, lower(text) AS x FROM documents) WHERE contains(x, 'the')", model=False)
def _(m):
    text = F.concat("text", F.lit(" Fachkräftemangel"))
    return m.table("documents").filter(F.contains(F.lower("text"), F.lit("the"))).select("doc_id", X.contextual_group(text, "fachkräftemangel").alias("grp"))


@add("ruled_out_groups", "Z01", "SELECT id, id % 2 = 0 AS out FROM channels")
def _(m):
    text = F.when(F.col("id") % 2 == 0, "Wohngruppe für Geflüchtete").otherwise("Wohngruppe mit Teilhabe")
    return m.channels.select("id", X.ruled_out(text, "wohngruppe", "AK4").alias("out"))


@add("mentions", "Z03", r"SELECT doc_id, handle, count(*) AS n FROM (SELECT doc_id, lower(unnest(regexp_extract_all(text, '@(\w+)', 1))) AS handle FROM documents) GROUP BY ALL", model=False)
def _(m):
    found = m.table("documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"@(\w+)"), F.lit(1))).alias("handle"))
    return found.groupBy("doc_id", F.lower("handle").alias("handle")).agg(F.count("*").alias("n"))


_PEOPLE = """p AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'liga' WHEN 1 THEN 'liga_mitglied' WHEN 2 THEN 'politik' ELSE 'presse' END AS category, CASE WHEN s_suppkey % 3 > 0 THEN 'user' || CAST(s_suppkey % 70 AS STRING) END AS twitter_handle,
CASE WHEN s_suppkey % 2 = 0 THEN '@Mast' || CAST(s_suppkey AS STRING) || '@social.org' END AS mastodon_handle, CASE WHEN s_suppkey % 5 = 0 THEN 'insta' || CAST(s_suppkey AS STRING) END AS instagram_handle FROM supplier),
i AS (SELECT doc_id AS id, text || CASE WHEN doc_id % 3 > 0 THEN ' @user' || CAST(doc_id % 90 AS STRING) ELSE '' END || CASE WHEN doc_id % 4 = 1 THEN ' @MAST' || CAST(doc_id % 50 AS STRING) || ' @insta' || CAST(doc_id % 60 AS STRING) ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' wann?' ELSE '' END AS content, 'user' || CAST(doc_id % 100 AS STRING) AS author_handle FROM documents)"""


@add("mentions_of_persons", "Z03", "WITH " + _PEOPLE + r""", h AS (SELECT id, unnest(regexp_extract_all(content, '@([\p{L}\p{M}\p{N}_]+)', 1)) AS handle FROM i), n AS (SELECT h.id, h.handle, min(p.id) AS person FROM (SELECT DISTINCT * FROM h) h JOIN p ON p.twitter_handle = h.handle OR p.instagram_handle = h.handle OR contains(lower(p.mastodon_handle), lower(h.handle)) GROUP BY ALL),
g AS (SELECT n.id, array_to_string(list_sort(list(DISTINCT person)), ',') AS persons, bool_or(category = 'liga') AS mentions_direct, bool_or(category = 'liga_mitglied') AS mentions_member FROM n JOIN p ON p.id = person GROUP BY 1)
SELECT i.id, (SELECT count(*) FROM h WHERE h.id = i.id) AS n_handles, coalesce(persons, '') AS persons, coalesce(mentions_direct, false) AS mentions_direct, coalesce(mentions_member, false) AS mentions_member, persons IS NOT NULL AS mentions_any, s.sender_id, s.sender_category, coalesce(contains(content, '?'), false) AND persons IS NOT NULL AS is_direct_question
FROM i LEFT JOIN g ON g.id = i.id LEFT JOIN (SELECT twitter_handle, min(id) AS sender_id, arg_min(category, id) AS sender_category FROM p GROUP BY 1) s ON s.twitter_handle = i.author_handle""", model=False)
def _(m):
    """Suppliers as persons with handles of three networks, mentioned at the end of documents."""
    of = lambda name: m.spark.sql(f"WITH {_PEOPLE.replace('supplier)', '{s})').replace('documents)', '{d})')} SELECT * FROM {name}", s=m.table("supplier"), d=m.table("documents"))
    out = mentions(of("i"), of("p"))
    return out.withColumn("persons", F.array_join("person_ids", ",")).select("id", "n_handles", "persons", "mentions_direct", "mentions_member", "mentions_any", "sender_id", "sender_category", "is_direct_question")


_URL = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), 'www\.', '', 'g')"


@add("url_domain", "X30 S05", f"SELECT page_id, {_URL} AS host FROM pages", model=False)
def _(m):
    return m.table("pages").select("page_id", U.domain(F.col("url")).alias("host"))


@add("url_normalized", "X03", r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([a-z]+)://', 1)) AS s, regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?]*)', 1)), '^www\.', '') AS h, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS p,
list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref', 'source', 'xtor', 'wtmc', 'rct', 'sa', 'ct', 'cd', 'ved', 'usg')) AS k FROM p)
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM q""", model=False)
def _(m):
    return m.table("pages").select("page_id", U.normalize_url(F.col("url")).alias("url"))


@add("url_normalized_exact", "X03 X26", r"""WITH p AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), q AS (SELECT page_id, lower(regexp_extract(u, '^([a-z]+)://', 1)) AS s, regexp_replace(lower(regexp_extract(u, '^[a-z]+://([^/?]*)', 1)), '^www\.', '') AS h, regexp_replace(regexp_extract(u, '^[a-z]+://[^/?]*([^?]*)', 1), '/+$', '') AS p,
list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda x: x <> '' AND lower(string_split(x, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'fbclid', 'gclid', 'ref', 'source', 'xtor', 'wtmc', 'rct', 'sa', 'ct', 'cd', 'ved', 'usg')) AS k FROM p)
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(k) > 0 THEN '?' || array_to_string(k, '&') ELSE '' END AS url FROM q""", model=False)
def _(m):
    return m.table("pages").select("page_id", U.normalize_url_exact("url").alias("url"))


@add("url_cleaned", "X26 X30", "SELECT page_id, 'https://e.org/a?k=' || CAST(page_id AS STRING) AS inner_url, 'https://e.org/a?k=' || CAST(page_id AS STRING) || '#t' AS cleaned FROM pages", model=False)
def _(m):
    n = F.col("page_id").cast("string")
    link = F.concat(F.lit("https://www.google.com/url?rct=j&url=https%3A%2F%2Fe.org%2Fa%3Fk%3D"), n, F.lit("&ct=ga"))
    tracked = F.concat(F.lit("https://e.org/a?utm_source=x&k="), n, F.lit("&blank=#t"))
    return m.table("pages").select("page_id", U.redirect_target(link).alias("inner_url"), U.clean_url(tracked).alias("cleaned"))


@add("urls_in_text", "X25 X31", "SELECT page_id, CAST(1 AS BIGINT) AS n, 'https://faz.net/a' || CAST(page_id AS STRING) AS first, false AS own, true AS redirect, true AS external FROM pages", model=False)
def _(m):
    n = F.col("page_id").cast("string")
    text = F.concat(F.lit("Siehe https:// faz.net/a"), n, F.lit(". , https://x.com/a/status/1 , https://e.org/b.jpg , https://e.org/login"))
    found = U.extract_urls(text)
    ext = U.is_external_article
    return m.table("pages").select("page_id", F.size(found).cast("long").alias("n"), found[0].alias("first"), ext(F.lit("https://x.com/a")).alias("own"), ext(F.lit("https://t.co/a")).alias("redirect"), ext(F.concat(F.lit("https://e.org/"), n)).alias("external"))


@add("handles", "X34 X47", "SELECT id, 'kanal' || CAST(id AS STRING) AS channel, 'nutzer' AS handle_user, 'i' || CAST(id AS STRING) || '.social' AS instance, '10.0.0.' || CAST(id AS STRING) AS ip FROM channels")
def _(m):
    n = F.col("id").cast("string")
    h = U.fediverse_handle(F.concat(F.lit("@nutzer@i"), n, F.lit(".social")))
    return m.channels.select("id", U.telegram_channel(F.concat(F.lit("https://t.me/@kanal"), n, F.lit("/12"))).alias("channel"), h["user"].alias("handle_user"), h["instance"].alias("instance"), U.client_ip(F.concat(F.lit(" 10.0.0."), n, F.lit(" , 1.1.1.1")), F.lit("p")).alias("ip"))


@add("relative_times", "X35", """SELECT id, TIMESTAMP '2024-01-31' - INTERVAL 1 SECOND * (CASE k WHEN 0 THEN n * 60 WHEN 1 THEN n * 3600 WHEN 2 THEN n * 86400 WHEN 3 THEN n * 604800 WHEN 4 THEN n * 60 ELSE n * 31536000 END) AS linkedin,
CASE WHEN k = 1 THEN TIMESTAMP '2024-01-31' - INTERVAL 1 HOUR * n END AS instagram FROM (SELECT id, id % 6 AS k, id % 13 + 1 AS n FROM channels)""")
def _(m):
    k, n = F.col("id") % 6, (F.col("id") % 13 + 1).cast("string")
    now = F.lit(datetime(2024, 1, 31))
    short = F.concat(n, F.when(k == 0, "m").when(k == 1, "h").when(k == 2, "d").when(k == 3, "w").when(k == 4, "mo").otherwise("y"))
    long = F.when(k == 1, F.concat(n, F.lit(" hours ago"))).otherwise("just now")
    return m.channels.select("id", times.linkedin_time(short, now).alias("linkedin"), times.instagram_time(long, now).alias("instagram"))


@add("active_hours", "X39 X37", "SELECT id, hour(fetched_at) BETWEEN 7 AND 15 AND isodow(fetched_at) < 6 AS day_shift, hour(fetched_at) >= 22 OR hour(fetched_at) < 6 AS night, CAST(date_trunc('week', fetched_at) AS TIMESTAMP) AS week, CASE WHEN isodow(fetched_at) = 1 THEN 3 ELSE 1 END AS days FROM items")
def _(m):
    t = F.col("fetched_at")
    return m.items.select("id", times.within_active_hours(t, 7, 16, True).alias("day_shift"), times.within_active_hours(t, 22, 6, False).alias("night"), times.week_start(t).alias("week"), times.topic_days(t).alias("days"))


@add("html_title", "X28", r"SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages", model=False)
def _(m):
    return m.table("pages").select("page_id", H.page_title(F.col("html")).alias("title"))


@add("html_article_flag", "X27 X30", "SELECT page_id, contains(html, '<article') AS article, CAST(2 * CAST(contains(html, '<article') AS INTEGER) AS INTEGER) AS points, false AS spa FROM pages", model=False)
def _(m):
    h = F.col("html")
    return m.table("pages").select("page_id", H.is_news_article(h, F.col("url")).alias("article"), H.article_points(h).alias("points"), H.looks_like_spa(h).alias("spa"))


@add("html_main_content", "X29")
def _(m):
    return m.table("pages").select("page_id", H.main_content_of("html").alias("content"))


@add("html_scraped", "S05")
def _(m):
    entries = m.table("pages").select("page_id", "url", F.explode(H.scrape("article", "h1", "p")("html")).alias("e"))
    return entries.select("page_id", H.scraped_id(F.col("e.title")).alias("external_id"), "e.title", "e.content", F.coalesce("e.link", "url").alias("link"))


@add("model_answers", "X19 X20 K11", """SELECT id, CASE WHEN id % 4 = 3 THEN 'ab' ELSE 's' || CAST(id AS STRING) END AS summary, id % 4 <> 3 AS relevant, CASE WHEN id % 4 = 3 THEN '' ELSE 'AK1' END AS groups, CASE WHEN id % 4 = 3 THEN 'low' ELSE 'high' END AS priority FROM items""")
def _(m):
    body = F.concat(F.lit('{"summary": "s'), F.col("id").cast("string"), F.lit('", "relevant": true, "priority": "high", "assigned_ak": "AK1"}'))
    k = F.col("id") % 4
    said = F.when(k == 0, body).when(k == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Hier: "), body, F.lit(" fertig"))).otherwise(F.lit('{"summary": "ab'))
    rows = m.items.select("id", salvage.analysis(said).alias("a"))
    return rows.select("id", "a.summary", "a.relevant", F.array_join("a.assigned_aks", ",").alias("groups"), "a.priority")


@add("json_lines", "X21 X23", "SELECT id, CAST(2 AS INTEGER) AS n, '{\"t\": \"a ' || chr(92) || '\"b' || chr(92) || '\"\"}' AS fixed FROM channels")
def _(m):
    text = F.lit('```json\n{"title": "a"}\nText {"title": "b"} mehr\n# nein\n{"x": 1}\n```')
    return m.channels.select("id", F.size(salvage.json_lines(F.concat(text, F.lit("")))).alias("n"), salvage.fix_quotes(F.lit('{"t": "a „b“"}')).alias("fixed"))


@add("source_names", "X36 K18", "SELECT id, name AS organisation FROM sources")
def _(m):
    k = F.col("id") % 4
    name = F.concat("name", F.when(k == 0, " (X.com)").when(k == 1, " Instagram").when(k == 2, " (mastodon)").otherwise(""))
    return m.sources.select("id", topics.organisation(name).alias("organisation"))


@add("source_channel_names", "X36", """SELECT id, CASE id % 5 WHEN 0 THEN 'FAZ (Frankfurter Allgemeine)' WHEN 1 THEN 'Frankfurter Rundschau' WHEN 2 THEN 'PRO ASYL' ELSE name END AS organisation, CASE id % 5 WHEN 0 THEN 'Rhein-Main' WHEN 1 THEN 'Politik' END AS channel FROM sources""")
def _(m):
    k = F.col("id") % 5
    name = F.when(k == 0, "FAZ Rhein-Main").when(k == 1, "FR Politik").when(k == 2, "Pro Asyl").when(k == 3, F.concat("name", F.lit(" (Bluesky)"))).otherwise(F.concat("name", F.lit(" telegram")))
    return m.sources.select("id", topics.organisation(name).alias("organisation"), topics.channel_of(name).alias("channel"))


@add("settings_merged", "X45", "SELECT 'high' AS k, 365 AS v UNION ALL SELECT 'low', 10 UNION ALL SELECT 'medium', 180 UNION ALL SELECT 'none', 30", model=False)
def _(m):
    default = F.create_map(*(F.lit(x) for p in S.DEFAULT_RETENTION.items() for x in p))
    own = F.create_map(F.lit("low"), F.lit(10))
    return m.spark.range(1).select(F.explode(F.map_concat(F.map_filter(default, lambda k, _: ~F.map_contains_key(own, k)), own)).alias("k", "v"))


@add("settings_by_nation", "X45", r"""WITH s AS (SELECT n_nationkey AS nation, '{"low": ' || CAST(10 + n_nationkey AS VARCHAR) || CASE WHEN n_nationkey % 3 = 0 THEN ', "high": "700"' ELSE '' END || CASE WHEN n_nationkey % 4 = 1 THEN ', "extra": 5' ELSE '' END || CASE WHEN n_nationkey % 7 = 2 THEN '' ELSE '}' END AS value,
CASE n_nationkey % 5 WHEN 0 THEN 'TRUE' WHEN 1 THEN '1' WHEN 2 THEN 'off' WHEN 3 THEN 'yes' ELSE 'false' END AS flag FROM nation), d AS (SELECT * FROM (VALUES ('high', 365), ('medium', 180), ('low', 90), ('none', 30)) v(k, v)), t AS (SELECT nation, lower(flag) IN ('true', '1', 'yes') AS enabled, CASE WHEN json_valid(value) THEN value ELSE '{}' END AS value FROM s),
o AS (SELECT nation, unnest(json_keys(value)) AS k, value FROM t), own AS (SELECT nation, k, CAST(json_extract_string(value, '$.' || k) AS INTEGER) AS v FROM o)
SELECT t.nation, enabled, k, v FROM (SELECT nation, k, v FROM own UNION ALL SELECT nation, k, v FROM t, d WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.nation = t.nation AND own.k = d.k)) x JOIN t USING (nation)""", model=False)
def _(m):
    """Each nation's stored settings, as JSON text and flags, over the defaults; broken JSON counts as none."""
    n = F.col("n_nationkey")
    part = lambda when, text: F.when(when, text).otherwise("")
    value = F.concat(F.lit('{"low": '), (n + 10).cast("string"), part(n % 3 == 0, ', "high": "700"'), part(n % 4 == 1, ', "extra": 5'), part(n % 7 != 2, "}"))
    flag = F.when(n % 5 == 0, "TRUE").when(n % 5 == 1, "1").when(n % 5 == 2, "off").when(n % 5 == 3, "yes").otherwise("false")
    rows = m.table("nation").select(n.alias("nation"), S.flag_setting(flag).alias("enabled"), S.merged_settings(value, S.DEFAULT_RETENTION).alias("settings"))
    return rows.select("nation", "enabled", F.explode("settings").alias("k", "v"))


@add("quick_json", "F03 X20", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS STRING) AS k, false AS yes FROM events", model=False)
def _(m):
    return m.table("events").select("event_id", salvage.quick_field(F.col("props"), "$.k").alias("k"), salvage.yes_or_no(F.col("props")).alias("yes"))
