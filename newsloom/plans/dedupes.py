"""Queries of duplicates, vectors, evaluation and changes."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from newsloom.functions.text import content_hash, normalize_title
from newsloom.operators.neighbours import search
from newsloom.operators import dedupe as D
from newsloom.operators import evaluate as E
from newsloom.operators import listing as L
from newsloom.operators import mutate as M
from newsloom.operators import vectors as V
from newsloom.plans.model import AS_OF, Catalog

catalog = Catalog()
add = catalog.add
_FIRST = "string_split(text, chr(10))[1]"


def _docs(m):
    """documents as a batch: seq, channel, external id, title, content and hash."""
    d = m.table("documents")
    return d.select(F.col("doc_id").alias("seq"), F.col("source").alias("channel_id"), (F.col("doc_id") % 600).cast("string").alias("external_id"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.col("text").alias("content"), content_hash(F.col("text")).alias("content_hash"))


_BATCH = f"SELECT doc_id AS seq, source AS channel_id, CAST(doc_id % 600 AS STRING) AS external_id, {_FIRST} AS title, text AS content, sha256(text) AS content_hash FROM documents"


@add("dedupe_exact", "D01 R04 K01", f"""WITH d AS ({_BATCH}), h AS (SELECT * FROM d WHERE seq % 10 = 0), a AS (SELECT * FROM d WHERE seq % 10 <> 0 AND (channel_id, external_id) NOT IN (SELECT (channel_id, external_id) FROM h) AND content_hash NOT IN (SELECT content_hash FROM h)),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY channel_id, external_id ORDER BY seq) = 1) SELECT seq FROM b QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY seq) = 1""", model=False)
def _(m):
    d = _docs(m)
    return D.drop_known(d.filter("seq % 10 <> 0"), d.filter("seq % 10 = 0")).select("seq")


@add("dedupe_url", "D02 J15", "SELECT a.id AS seq, min(b.id) AS similar_to_id FROM items a JOIN items b ON a.url = b.url AND a.channel_id <> b.channel_id WHERE a.id % 7 = 0 AND b.id % 7 <> 0 GROUP BY 1")
def _(m):
    return D.link_by_url(m.items.filter("id % 7 = 0").withColumn("seq", F.col("id")), m.items.filter("id % 7 <> 0"))


@add("dedupe_url_normalized", "D03 X03", "WITH s AS (SELECT id, channel_id, 'https://example.org/' || CAST(id % 300 AS STRING) AS url FROM items WHERE id % 7 <> 0), b AS (SELECT id, channel_id, 'https://example.org/' || CAST(id % 300 AS STRING) AS url FROM items WHERE id % 7 = 0) SELECT b.id AS seq, min(s.id) AS similar_to_id FROM b JOIN s ON b.url = s.url AND b.channel_id <> s.channel_id GROUP BY 1")
def _(m):
    path = (F.col("id") % 300).cast("string")
    batch = m.items.filter("id % 7 = 0").select(F.col("id").alias("seq"), "channel_id", F.concat(F.lit("https://WWW.example.org/"), path, F.lit("/?utm_source=feed#top")).alias("url"))
    return D.link_by_url(batch, m.items.filter("id % 7 <> 0").withColumn("url", F.concat(F.lit("https://example.org/"), path)), normalized=True)


_PAIRS = f"""WITH w AS (SELECT doc_id, {{part}} AS part, list_distinct(list_filter(string_split_regex(lower({_FIRST}), '\\s+'), lambda x: length(x) > 2)) AS ws FROM documents), v AS (SELECT *, len(ws) AS n FROM w WHERE len(ws) > 0),
x AS (SELECT doc_id, part, n, unnest(ws) AS t FROM v), p AS (SELECT a.doc_id AS first, b.doc_id AS later, min(a.n) AS n1, min(b.n) AS n2, count(*) AS k FROM x a JOIN x b ON a.t = b.t AND a.part = b.part AND a.doc_id < b.doc_id GROUP BY ALL)"""


@add("title_overlap_pairs", "X05 J13 U04", _PAIRS.format(part="source") + " SELECT first, later FROM p WHERE k >= 0.7 * least(n1, n2)", model=False)
def _(m):
    return D.title_pairs(_docs(m), within="channel_id")


@add("dedupe_title_batch", "D05 J13", _PAIRS.format(part="source") + " SELECT later AS seq, min(first) AS first FROM p WHERE k >= 0.7 * least(n1, n2) GROUP BY 1", model=False)
def _(m):
    return D.link_by_title(_docs(m), within="channel_id")


@add("dedupe_first_title", "D08 W02", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim({_FIRST})) ORDER BY doc_id) = 1", model=False)
def _(m):
    return D.first_wins(_docs(m), F.lower(F.trim("title")), "seq").select(F.col("seq").alias("doc_id"))


@add("dedupe_longest", "D08 W03", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(trim({_FIRST})) ORDER BY length(text) DESC, doc_id) = 1", model=False)
def _(m):
    return D.longest_wins(_docs(m), F.lower(F.trim("title")), "content", "seq").select(F.col("seq").alias("doc_id"))


_TITLE = rf"substr(trim(regexp_replace(regexp_replace(lower({_FIRST}), '[^\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}\s]', '', 'g'), '\s+', ' ', 'g')), 1, 100)"


@add("dedupe_longest_title", "D08 W03", f"SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY {_TITLE} ORDER BY length(text) DESC, doc_id) = 1", model=False)
def _(m):
    return D.longest_wins(_docs(m), normalize_title(F.col("title")), "content", "seq").select(F.col("seq").alias("doc_id"))


_PREFIX = """SELECT a.id, b.id AS other, round(1 - levenshtein(a.title, b.title)::DOUBLE / greatest(length(a.title), length(b.title)), 6) AS similarity FROM items a JOIN items b ON substr(lower(a.title), 1, 20) = substr(lower(b.title), 1, 20) AND b.id < a.id AND abs(epoch(a.published_at) - epoch(b.published_at)) <= 604800 WHERE round(1 - levenshtein(a.title, b.title)::DOUBLE / greatest(length(a.title), length(b.title)), 6) > 0.85"""


@add("title_prefix_pairs", "D09 Z04", _PREFIX)
@add("title_prefix_pairs_all", "D09 Z04", _PREFIX)
def _(m):
    return D.title_prefix_pairs(m.items)


_SIM = "round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)"
_KNN = f"SELECT q.vec_id AS query_id, v.vec_id, {_SIM} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {_SIM} DESC, v.vec_id) AS INTEGER) AS rank FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE {{w}}"


def _knn(m, k, where="vec_id % 25 = 0"):
    v = m.table("embeddings")
    return V.knn(v, v.filter(where), k)


@add("knn_topk", "V01 T05 J14", _KNN.format(w="q.vec_id % 25 = 0") + " QUALIFY rank <= 10", model=False)
def _(m):
    return _knn(m, 10)


@add("find_duplicates", "V03 D04", "WITH k AS (" + _KNN.format(w="q.vec_id % 25 = 0") + ") SELECT query_id, vec_id, score, CASE WHEN score >= 0.75 THEN 'duplicate' WHEN score >= 0.6 THEN 'candidate' ELSE 'none' END AS kind FROM k WHERE rank <= 5", model=False)
def _(m):
    return _knn(m, 5).select("query_id", "vec_id", "score", D.semantic_class(F.col("score")).alias("kind"))


@add("similar_elsewhere", "V02", "WITH k AS (" + _KNN.format(w="q.vec_id % 25 = 0") + "), o AS (SELECT k.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place FROM k WHERE rank <= 15 AND vec_id % 4 <> query_id % 4) SELECT query_id, place, vec_id, score FROM o WHERE place <= 5", model=False)
def _(m):
    items = m.table("embeddings").select("vec_id", (F.col("vec_id") % 4).alias("source"))
    return V.similar_elsewhere(_knn(m, 15), items, 5)


@add("knn_vote", "A26", "WITH k AS (" + _KNN.format(w="q.vec_id % 25 = 0") + "), v AS (SELECT query_id, e.label, sum(score) AS w, min(rank) AS met FROM k JOIN embeddings e USING (vec_id) WHERE rank <= 7 GROUP BY ALL), t AS (SELECT *, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS share, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, met) AS place FROM v) SELECT query_id, label, share FROM t WHERE place = 1", model=False)
def _(m):
    return V.weighted_vote(_knn(m, 7), m.table("embeddings"), "label")


_JUDGES = "j AS (SELECT vec_id, label < 5 AS relevant, CASE label % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority, 'AK' || CAST(label % 4 + 1 AS STRING) AS ak FROM embeddings)"


def _judges(m):
    n = F.col("label")
    return m.table("embeddings").select("vec_id", (n < 5).alias("relevant"), F.when(n % 3 == 0, "high").when(n % 3 == 1, "medium").otherwise("low").alias("priority"), F.concat(F.lit("AK"), (n % 4 + 1).cast("string")).alias("ak"))


def _vote_sql(name: str, source: str) -> str:
    return f"(SELECT query_id, {name}, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS {name}_share, row_number() OVER (PARTITION BY query_id ORDER BY round(w, 9) DESC, met) AS p FROM (SELECT query_id, {name}, sum(score) AS w, min(rank) AS met FROM {source} GROUP BY ALL))"


@add("knn_hierarchy", "V04", "WITH " + _JUDGES + ", k AS (" + _KNN.format(w="q.vec_id % 25 = 0") + "), x AS (SELECT k.*, relevant, priority, ak FROM k JOIN j USING (vec_id)), r AS (SELECT * FROM " + _vote_sql("relevant", "(SELECT * FROM x WHERE rank <= 7)") + " WHERE p = 1), n AS (SELECT x.query_id, score, priority, ak, rank FROM x JOIN r ON r.query_id = x.query_id AND r.relevant WHERE x.rank <= 15 AND x.relevant QUALIFY row_number() OVER (PARTITION BY x.query_id ORDER BY rank) <= 5), pv AS (SELECT * FROM " + _vote_sql("priority", "n") + " WHERE p = 1), av AS (SELECT * FROM " + _vote_sql("ak", "n") + " WHERE p = 1) SELECT query_id, relevant, relevant_share, CASE WHEN relevant THEN coalesce(priority, 'medium') END AS priority, CASE WHEN relevant THEN coalesce(priority_share, 0.5) END AS priority_share, CASE WHEN relevant THEN coalesce(ak, 'QAG') END AS ak, CASE WHEN relevant THEN coalesce(ak_share, 0.5) END AS ak_share FROM r LEFT JOIN pv USING (query_id) LEFT JOIN av USING (query_id)", model=False)
def _(m):
    return V.hierarchical_vote(_knn(m, 15), _judges(m)).select("query_id", "relevant", "relevant_share", "priority", "priority_share", "ak", "ak_share")


@add("similar_relevant", "V05", "WITH " + _JUDGES + ", k AS (" + _KNN.format(w="q.vec_id % 25 = 0") + ") SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS place, vec_id, score FROM k JOIN j USING (vec_id) WHERE rank <= 15 AND relevant QUALIFY place <= 5", model=False)
def _(m):
    return V.similar_relevant(_knn(m, 15), _judges(m), 5, F.col("relevant"))


@add("mislabel_candidates", "V06", "WITH k AS (" + _KNN.format(w="true") + "), v AS (SELECT query_id, e.label, count(*) AS n FROM k JOIN embeddings e USING (vec_id) WHERE rank <= 7 GROUP BY ALL), t AS (SELECT *, round(n / sum(n) OVER (PARTITION BY query_id), 6) AS share, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) AS place FROM v) SELECT query_id, o.label AS own, t.label AS suggested, share FROM t JOIN embeddings o ON o.vec_id = query_id WHERE place = 1 AND t.label <> o.label AND share >= 0.5", model=False)
def _(m):
    v = m.table("embeddings")
    return V.mislabelled(search(v, v, 7).matches(), v, "label", 0.5)


_RECHECK = "WITH u AS (SELECT a.id, min(b.id) AS similar_to_id FROM items a JOIN items b ON a.url = b.url AND b.id < a.id AND a.channel_id <> b.channel_id WHERE a.similar_to_id IS NULL GROUP BY 1), k AS (" + _KNN.format(w="true") + "), s AS (SELECT query_id AS id, arg_min(vec_id, rank) AS similar_to_id FROM k WHERE rank <= 5 AND score >= 0.75 AND vec_id < query_id GROUP BY 1) SELECT id, similar_to_id, 'url' AS method FROM u UNION ALL SELECT s.id, s.similar_to_id, 'semantic' FROM s JOIN items i ON i.id = s.id WHERE i.similar_to_id IS NULL AND s.id NOT IN (SELECT id FROM u)"


@add("dedupe_recheck", "D06 D07", _RECHECK)
@add("dedupe_recheck_all", "D06 D07", _RECHECK)
def _(m):
    v = m.table("embeddings")
    return D.recheck(m.items.filter("similar_to_id IS NULL"), m.items, search(v, v, 5, least=D.CONFIRMED).matches()).select("id", "similar_to_id", "method")


_MIXED = "v AS (SELECT o.id, list_transform(range(1, 65), lambda i: CAST(x.embedding[i] AS DOUBLE) + (0.2 + o.id % 9 * 0.1) * CAST(y.embedding[i] AS DOUBLE)) AS vec FROM (SELECT id FROM items WHERE id % 16 = 3) o JOIN embeddings x ON x.vec_id = o.id % 60 JOIN embeddings y ON y.vec_id = 70 + o.id % 29)"


@add("dedupe_recheck_written", "D06", "WITH " + _MIXED + """, t AS (SELECT * FROM items WHERE id % 23 <> 0), b AS (SELECT * FROM t WHERE id % 8 = 3 AND NOT duplicate_checked), u AS (SELECT a.id, min(c.id) AS other FROM b a JOIN t c ON a.url = c.url AND c.id < a.id AND a.channel_id <> c.channel_id WHERE a.id % 3 = 0 GROUP BY 1),
k AS (SELECT q.id, w.id AS other, round(list_cosine_similarity(q.vec, w.vec), 6) AS score FROM v q JOIN b ON b.id = q.id JOIN v w ON w.id <> q.id QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY score DESC, w.id) <= 5),
s AS (SELECT id, arg_min(other, (-score, other)) AS other, max(score) AS score FROM k WHERE score >= 0.75 AND other < id AND id NOT IN (SELECT id FROM u) GROUP BY 1)
SELECT b.id, coalesce(u.other, t.id) AS similar_to_id, CASE WHEN u.other IS NOT NULL THEN 'url' WHEN t.id IS NOT NULL THEN 'semantic' END AS duplicate_method, CASE WHEN t.id IS NOT NULL THEN s.score END AS duplicate_score, true AS duplicate_checked
FROM b LEFT JOIN u ON u.id = b.id LEFT JOIN s ON s.id = b.id LEFT JOIN t ON t.id = s.other""")
def _(m):
    """A backlog by address and by meaning, with links to items that have gone cleared; a third of it has an address."""
    e, n = m.table("embeddings"), F.col("id")
    x, y = e.select(F.col("vec_id").alias("xi"), F.col("embedding").alias("xe")), e.select(F.col("vec_id").alias("yi"), F.col("embedding").alias("ye"))
    mixed = F.zip_with("xe", "ye", lambda a, b: a.cast("double") + (F.lit(0.2) + n % 9 * F.lit(0.1)) * b.cast("double"))
    v = m.items.filter("id % 16 = 3").select("id").join(x, F.col("xi") == n % 60).join(y, F.col("yi") == 70 + n % 29).select(n.alias("vec_id"), mixed.alias("embedding"))
    items = m.items.filter("id % 23 <> 0")
    backlog = items.filter("id % 8 = 3 AND NOT duplicate_checked").withColumn("url", F.when(n % 3 == 0, F.col("url")))
    near = search(v, v.join(backlog.select(n.alias("vec_id")), "vec_id", "left_semi"), 5, least=D.CONFIRMED).matches()
    return D.rechecked(backlog, items, near).select("id", "similar_to_id", "duplicate_method", "duplicate_score", "duplicate_checked")


_CANDIDATES = "c AS (SELECT id, id + 1 + id % 5 AS candidate_id, id % 100 / 100.0 AS similarity_score FROM items WHERE id % 4 = 2), j AS (SELECT c.*, c.id % 3 = 0 AS yes, i.similar_to_id FROM c JOIN items i ON i.id = c.id WHERE candidate_id IN (SELECT id FROM items) AND c.id % 7 <> 0)"


def _confirmed(m):
    n = F.col("id")
    candidates = m.items.filter("id % 4 = 2").select("id", (n + 1 + n % 5).alias("candidate_id"), (n % 100 / F.lit(100.0)).alias("similarity_score"))
    verdicts = m.items.filter("id % 7 <> 0").select("id", (n % 3 == 0).alias("is_duplicate"), F.concat(F.lit("weil "), n.cast("string")).alias("reasoning"))
    return D.confirmations(m.items, candidates, verdicts)


@add("candidates_judged", "D07", "WITH " + _CANDIDATES + " SELECT id, CASE WHEN yes THEN candidate_id ELSE similar_to_id END AS similar_to_id, yes AS confirmed, candidate_id FROM j")
def _(m):
    return _confirmed(m)[0]


@add("confirmation_events", "D07 K10", "WITH " + _CANDIDATES + " SELECT id AS item_id, CASE WHEN yes THEN 'duplicate_detected' ELSE 'duplicate_rejected' END AS event_type, candidate_id, CAST(similarity_score AS DOUBLE) AS similarity_score, yes AS llm_confirmed, 'weil ' || CAST(id AS VARCHAR) AS reasoning FROM j")
def _(m):
    return _confirmed(m)[1]


@add("confirmed_candidates", "D07", "SELECT id, CASE WHEN id % 3 = 0 THEN id + 1 ELSE similar_to_id END AS similar_to_id FROM items")
def _(m):
    verdicts = m.items.select("id", (F.col("id") + 1).alias("candidate_id"), (F.col("id") % 3 == 0).alias("is_duplicate"))
    return D.promote(m.items, verdicts).select("id", "similar_to_id")


@add("mean_pooling", "A27", "SELECT label, i AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS x FROM embeddings, range(1, 65) r(i) GROUP BY ALL", model=False)
def _(m):
    pooled = V.mean_pooled(m.table("embeddings"), "label", "embedding")
    return pooled.select(F.col("key").alias("label"), F.posexplode("vector").alias("p", "x")).select("label", (F.col("p") + 1).cast("long").alias("pos"), F.round("x", 6).alias("x"))


@add("nearest_definition", "Z02", "WITH d AS (SELECT vec_id AS name, embedding FROM embeddings WHERE vec_id IN (1, 2, 3)), s AS (SELECT v.vec_id, d.name, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score FROM embeddings v, d) SELECT vec_id, name, score FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, name DESC) = 1", model=False)
def _(m):
    e = m.table("embeddings")
    out = V.nearest_definition(e, e.filter("vec_id IN (1, 2, 3)").select(F.col("vec_id").alias("name"), F.col("embedding").alias("vector")), "vec_id", "embedding")
    return out.select(F.col("key").alias("vec_id"), "name", "score")


@add("vector_sync", "J12 U02 R08 J11", "SELECT 'orphaned' AS kind, vec_id AS id FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'missing', doc_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)", model=False)
def _(m):
    v, i = m.table("embeddings").select(F.col("vec_id").alias("id")), m.table("labels").select(F.col("doc_id").alias("id"))
    return v.join(i, "id", "left_anti").select(F.lit("orphaned").alias("kind"), "id").unionByName(i.join(v, "id", "left_anti").select(F.lit("missing").alias("kind"), "id"))


@add("sync_check", "R08", "SELECT CASE WHEN abs(d - i) > 50 THEN 'error' WHEN d > i THEN 'warning' ELSE 'ok' END AS state FROM (SELECT (SELECT count(*) FROM labels) AS d, (SELECT count(*) FROM embeddings) AS i)", model=False)
def _(m):
    d, i = m.table("labels").agg(F.count("*").alias("d")), m.table("embeddings").agg(F.count("*").alias("i"))
    gap = F.col("d") - F.col("i")
    return d.crossJoin(i).select(F.when(F.abs(gap) > 50, "error").when(gap > 0, "warning").otherwise("ok").alias("state"))


_JUDGED = "SELECT l.doc_id, quality = 1 AS truth, n_chars > 900 AS guess FROM labels l JOIN documents d USING (doc_id)"


def _judged(m):
    return m.table("labels").join(m.table("documents"), "doc_id").select("doc_id", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 900).alias("guess"))


@add("eval_relevance", "E01 E04 V12 V10", f"""WITH c AS (SELECT count(*) FILTER (truth AND guess) AS tp, count(*) FILTER (NOT truth AND guess) AS fp, count(*) FILTER (truth AND NOT guess) AS fn, count(*) FILTER (NOT truth AND NOT guess) AS tn FROM ({_JUDGED}))
SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)), 6) AS f1 FROM c""", model=False)
def _(m):
    return E.relevance_figures(_judged(m))


_CLASS = """WITH l AS (SELECT priority_input AS t, priority_output AS g FROM logs WHERE priority_input IS NOT NULL AND priority_output IS NOT NULL), k AS (SELECT t AS class FROM l UNION SELECT g FROM l),
f AS (SELECT class, count(*) FILTER (t = class AND g = class) AS tp, count(*) FILTER (g = class) AS n, count(*) FILTER (t = class) AS support FROM k, l GROUP BY 1)"""


def _guessed(m):
    return m.logs.filter("priority_input IS NOT NULL AND priority_output IS NOT NULL").select(F.col("priority_input").alias("truth"), F.col("priority_output").alias("guess"))


@add("eval_classes", "E02 E03", _CLASS + " SELECT class, round(coalesce(tp / nullif(n, 0), 0), 6) AS precision, round(coalesce(tp / nullif(support, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(n + support, 0), 0), 6) AS f1, support FROM f")
def _(m):
    return E.class_figures(_guessed(m))


@add("eval_macro_f1", "E02 E03", _CLASS + " SELECT (SELECT round(avg(CAST(t = g AS INTEGER)), 6) FROM l) AS accuracy, (SELECT round(avg(round(coalesce(2 * tp / nullif(n + support, 0), 0), 6)), 6) FROM f) AS macro_f1")
def _(m):
    return E.macro_figures(_guessed(m))


_R = "CASE {c} WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'none' THEN 0 {e} END"


@add("eval_within_one", "E02 E06", "SELECT (SELECT round(avg(CAST(abs(a - b) <= 1 AS INTEGER)), 6) FROM (SELECT " + _R.format(c="priority_input", e="") + " AS a, " + _R.format(c="priority_output", e="") + " AS b FROM logs) WHERE a IS NOT NULL AND b IS NOT NULL) AS within_one, (SELECT round(avg(CAST(abs(a - b) <= 1 AS INTEGER)), 6) FROM (SELECT " + _R.format(c="priority_input", e="ELSE 1") + " AS a, " + _R.format(c="priority_output", e="ELSE 1") + " AS b FROM logs)) AS with_unknown")
def _(m):
    rows = m.logs.select(F.col("priority_input").alias("truth"), F.col("priority_output").alias("guess"))
    return E.within_one(rows).crossJoin(E.within_one(rows, unknown_as_one=True).withColumnRenamed("within_one", "with_unknown"))


@add("eval_multilabel", "E05", "SELECT round(avg(CAST(a = b AS INTEGER)), 6) AS subset_accuracy, round(avg(CASE WHEN a = b THEN 0.0 ELSE 2.0 END / 6), 6) AS hamming_loss, round(avg(CAST(a = b AS INTEGER)), 6) AS any_overlap FROM (SELECT 'AK' || CAST(id % 5 + 1 AS STRING) AS a, 'AK' || CAST(id % 3 + 1 AS STRING) AS b FROM items)")
def _(m):
    g = lambda k: F.array(F.concat(F.lit("AK"), (F.col("id") % k + 1).cast("string")))
    return E.multilabel_figures(m.items.select(g(5).alias("t"), g(3).alias("g")), "t", "g", ["AK1", "AK2", "AK3", "AK4", "AK5", "QAG"])


@add("agreement", "A23 E06 E07 E12", f"SELECT count(*) AS n, count(*) FILTER (truth = guess) AS agree, count(*) FILTER (truth AND NOT guess) AS only_first, count(*) FILTER (NOT truth AND guess) AS only_second, CAST(0 AS BIGINT) AS missing FROM ({_JUDGED})", model=False)
def _(m):
    return E.agreement(_judged(m), "truth", "guess")


@add("stratified_split_sizes", "E08", "SELECT quality, split, n FROM (SELECT quality, count(*) AS c FROM labels GROUP BY 1), LATERAL (SELECT 'train' AS split, CAST(floor(c * 0.7) AS BIGINT) AS n UNION ALL SELECT 'val', CAST(floor(c * 0.85) - floor(c * 0.7) AS BIGINT) UNION ALL SELECT 'test', CAST(c - floor(c * 0.85) AS BIGINT))", model=False)
def _(m):
    return E.stratified_split(m.table("labels"), "doc_id", "quality").groupBy("quality", "split").agg(F.count("*").alias("n"))


@add("sample_long_and_short", "E09", "SELECT count(*) FILTER (length(text) >= 500) AS long, CAST(floor(0.1 * count(*) FILTER (length(text) < 500)) AS BIGINT) AS short FROM documents", model=False)
def _(m):
    out = E.long_and_some_short(m.table("documents"), "doc_id", "text")
    return out.agg(F.count_if(F.length("text") >= 500).alias("long"), F.count_if(F.length("text") < 500).alias("short"))


@add("model_bake_off", "E13", """WITH r AS (SELECT *, relevance_score > 0.4 AS rel FROM items), p AS (SELECT 'fast' AS model, rel, (id % 3 <> 0) = rel AS a, coalesce(model_ak, 'QAG') IS NOT DISTINCT FROM assigned_ak AS b, CASE WHEN is_read THEN 'high' ELSE 'none' END IS NOT DISTINCT FROM priority AS c, CAST(id % 10 AS DOUBLE) / 1000 AS s FROM r
UNION ALL SELECT 'slow', rel, is_starred = rel, ('AK' || CAST(id % 5 + 1 AS STRING)) IS NOT DISTINCT FROM assigned_ak, 'high' IS NOT DISTINCT FROM priority, CAST(id % 7 AS DOUBLE) FROM r) SELECT model, count(*) FILTER (a) AS relevant, count(*) FILTER (rel AND b) AS ak, count(*) FILTER (rel AND c) AS priority, round(avg(s), 6) AS seconds, count(*) FILTER (rel) AS relevant_rows FROM p GROUP BY 1""")
def _(m):
    k = F.col("id")
    rows = m.items.select(
        (F.col("relevance_score") > 0.4).alias("relevant"), F.col("assigned_ak").alias("ak"), "priority",
        (k % 3 != 0).alias("fast_relevant"), F.coalesce("model_ak", F.lit("QAG")).alias("fast_ak"), F.when(F.col("is_read"), "high").otherwise("none").alias("fast_priority"), ((k % 10).cast("double") / 1000).alias("fast_seconds"),
        F.col("is_starred").alias("slow_relevant"), F.concat(F.lit("AK"), (k % 5 + 1).cast("string")).alias("slow_ak"), F.lit("high").alias("slow_priority"), (k % 7).cast("double").alias("slow_seconds"),
    )
    return E.bake_off(rows, ["fast", "slow"])


@add("relabel_triage", "E10", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'new' WHEN n_chars > (n_chars * (CASE WHEN doc_id % 2 = 0 THEN 0.5 ELSE 0.9 END)) * 1.2 AND n_chars >= 500 THEN 'relabel' ELSE 'keep' END AS action FROM documents", model=False)
def _(m):
    new = m.table("documents").select("doc_id", F.col("n_chars").alias("size"))
    old = new.filter("doc_id % 3 <> 0").withColumn("size", F.col("size") * F.when(F.col("doc_id") % 2 == 0, F.expr("0.5")).otherwise(F.expr("0.9")))
    return E.triage(old, new, "doc_id")


@add("balanced_sample", "E11", "SELECT doc_id, toxic FROM labels QUALIFY row_number() OVER (PARTITION BY toxic ORDER BY doc_id) <= 10", model=False)
def _(m):
    return E.balanced_sample(m.table("labels"), "toxic", 10, F.col("doc_id")).select("doc_id", "toxic")


@add("archive_group_expand", "K14 U01", "WITH c AS (SELECT id, similar_to_id FROM items WHERE id % 100 = 0), p AS (SELECT similar_to_id AS id FROM c WHERE similar_to_id IS NOT NULL), a AS (SELECT id FROM c UNION SELECT id FROM p UNION SELECT id FROM items WHERE similar_to_id IN (SELECT id FROM p) UNION SELECT id FROM items WHERE similar_to_id IN (SELECT id FROM c)) SELECT id FROM a WHERE id IN (SELECT id FROM items)")
def _(m):
    return M.archive_group(m.items, m.items.filter("id % 100 = 0"))


@add("items_patched", "K12 K24", "SELECT id, CASE WHEN id % 5 = 0 THEN 'high' ELSE priority END AS priority, is_manually_reviewed OR (id % 5 = 0 AND priority IS DISTINCT FROM 'high') AS is_manually_reviewed FROM items")
def _(m):
    patch = m.items.filter("id % 5 = 0").select("id", F.lit("high").alias("priority"))
    return M.patched(m.items, patch, ["priority"]).select("id", "priority", "is_manually_reviewed")


@add("items_flagged_for_model", "K16", "SELECT id, needs_llm_processing OR summary IS NULL AS flag FROM items")
def _(m):
    return M.flagged_for_model(m.items).select("id", F.col("needs_llm_processing").alias("flag"))


@add("metadata_key_removed", "K20", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{\"a\":' || CAST(event_id AS STRING) || ',\"b\":\"x' || event_type || '\"}' ELSE '{\"a\":1}' END AS metadata FROM events", model=False)
def _(m):
    n = F.col("event_id").cast("string")
    body = F.concat(F.lit('{"a":'), n, F.lit(',"duplicate_checked":true,"b":"x'), F.col("event_type"), F.lit('"}'))
    metadata = F.when(F.col("event_id") % 3 == 0, body).otherwise('{"a":1}')
    return m.table("events").select("event_id", M.without_key(metadata, "duplicate_checked").alias("metadata"))


@add("items_reanalysed", "K23", """SELECT id, CASE WHEN id % 3 <> 0 THEN summary WHEN id % 2 = 0 THEN 'Neu ' || CAST(id AS STRING) ELSE summary END AS summary, CASE WHEN id % 3 <> 0 THEN priority ELSE CASE id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END END AS priority, CASE WHEN id % 3 = 0 AND id % 4 = 0 THEN 'AK2' ELSE assigned_ak END AS assigned_ak, needs_llm_processing AND id % 3 <> 0 AS waits FROM items""")
def _(m):
    k = F.col("id") % 5
    said = F.when(k == 0, "critical").when(k == 1, "high").when(k == 2, "medium").when(k == 3, "low")
    answers = m.items.filter("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("Neu "), F.col("id").cast("string"))).otherwise("").alias("summary"), said.alias("priority"), F.when(F.col("id") % 4 == 0, F.array(F.lit("AK2"), F.lit("AK1"))).otherwise(F.array().cast("array<string>")).alias("assigned_aks"))
    return M.reanalysed(m.items, answers).select("id", "summary", "priority", "assigned_ak", F.col("needs_llm_processing").alias("waits"))


@add("items_marked_read", "K13", "SELECT id, is_read OR channel_id = 3 AS is_read, is_archived <> (id % 2 = 0) AS is_archived FROM items")
def _(m):
    read = M.marked(m.items, "is_read", F.lit(True), F.col("channel_id") == 3)
    return M.marked(read, "is_archived", ~F.col("is_archived"), F.col("id") % 2 == 0).select("id", "is_read", "is_archived")


@add("items_deleted", "K15 K08", "SELECT count(*) AS n, 'low' AS kind FROM items WHERE NOT is_starred AND priority = 'none' UNION ALL SELECT count(*), 'old' FROM items WHERE NOT is_starred AND fetched_at < TIMESTAMP '1997-01-01' UNION ALL SELECT count(*), 'source' FROM items WHERE NOT is_starred AND channel_id IN (SELECT id FROM channels WHERE connector_type = 'rss')")
def _(m):
    n = lambda df, kind: df.agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    rss = m.channels.filter("connector_type = 'rss'")
    return n(M.deleted_items(m.items, priority="low"), "low").unionByName(n(M.deleted_items(m.items, before=datetime(1997, 1, 1)), "old")).unionByName(n(M.deleted_items(m.items, source_channels=rss), "source"))


@add("delete_cascade", "K15 K24 J11", "WITH g AS (SELECT id FROM items WHERE id % 17 = 16) SELECT i.id, CASE WHEN similar_to_id IN (SELECT id FROM g) THEN NULL ELSE similar_to_id END AS similar_to_id FROM items i WHERE id NOT IN (SELECT id FROM g)")
def _(m):
    kept, _ = M.cascade(m.items, m.logs, m.items.filter("id % 17 = 16"))
    return kept.select("id", "similar_to_id")


@add("settings_upserted", "K06", "SELECT n_nationkey AS key, CASE WHEN n_nationkey < 5 THEN 'neu' ELSE n_name END AS value FROM nation UNION ALL SELECT 100, 'neu'", model=False)
def _(m):
    old = m.table("nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("value"))
    new = m.spark.range(5).select(F.col("id").cast("int").alias("key"), F.lit("neu").alias("value")).unionByName(m.spark.range(1).select(F.lit(100).alias("key"), F.lit("neu").alias("value")))
    return M.upsert(old, new, "key")


@add("vectors_added", "K07 K09 S18", "SELECT count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS ids FROM embeddings", model=False)
def _(m):
    v = m.table("embeddings").select("vec_id", "label")
    return M.add_absent(v.filter("vec_id % 3 = 0"), v, "vec_id").agg(F.count("*").alias("n"), F.sum("vec_id").alias("ids"))


@add("metadata_without_nulls", "K07", "SELECT id, CASE WHEN summary IS NULL THEN CAST(1 AS INTEGER) ELSE 2 END AS n FROM items")
def _(m):
    return m.items.select("id", F.size(M.without_nulls(F.create_map(F.lit("a"), F.col("summary"), F.lit("b"), F.col("title")))).alias("n"))


@add("new_ids", "K01", "SELECT doc_id, CAST(24 + row_number() OVER (ORDER BY doc_id) AS BIGINT) AS id FROM labels", model=False)
def _(m):
    old = m.table("nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return M.with_ids(m.table("labels").select("doc_id"), old, "doc_id").select("doc_id", "id")


@add("item_events", "K10 K12", "SELECT id AS item_id, 'archived' AS event_type, TIMESTAMP '1998-08-02 15:30:00' AS timestamp FROM items WHERE is_archived")
def _(m):
    return M.events(m.items.filter("is_archived"), "archived", AS_OF).select("item_id", "event_type", "timestamp")


@add("processing_log_entries", "K11", "SELECT id, coalesce(priority_input <> priority_output, false) AS priority_changed, 'pre_filter' AS step FROM logs")
def _(m):
    return M.log_entries(m.logs, "pre_filter", 2, AS_OF).select("id", "priority_changed", F.col("step_type").alias("step"))


@add("config_imported", "K17 K24", "SELECT name, 'alt' AS origin FROM sources WHERE id % 2 = 0 UNION ALL SELECT name, 'neu' FROM sources WHERE name NOT IN (SELECT name FROM sources WHERE id % 2 = 0)")
def _(m):
    old, new = m.sources.filter("id % 2 = 0").select("name", F.lit("alt").alias("origin")), m.sources.select("name", F.lit("neu").alias("origin"))
    return M.imported(old, new, ["name"], False)


@add("sources_restructured", "K18", "SELECT organisation, bool_or(s) AS is_stakeholder, bool_or(e) AS enabled, count(*) AS channels FROM (SELECT 'Org ' || CAST(source_id AS STRING) AS organisation, id % 4 = 0 AS s, enabled AS e FROM channels) GROUP BY 1")
def _(m):
    legacy = m.channels.select("id", F.concat(F.lit("Org "), F.col("source_id").cast("string"), F.lit(" Telegram")).alias("name"), "connector_type", (F.col("id") % 4 == 0).alias("is_stakeholder"), "enabled", F.col("last_fetch_at").alias("created_at"))
    from newsloom.functions.topics import organisation

    s, c = M.restructured(legacy, organisation(F.col("name")))
    n = c.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("channels"))
    return s.join(n, "id").select("organisation", "is_stakeholder", "enabled", "channels")


@add("channel_conflicts", "K24", "SELECT id, CASE WHEN id % 2 = 0 THEN 'conflict' ELSE 'added' END AS state FROM channels")
def _(m):
    config = F.create_map(*(x for k in ("url", "handle", "channel", "profile_url") for x in (F.lit(k), F.concat(F.lit("https://e.org/"), F.col("id").cast("string")))))
    new = m.channels.select("id", "source_id", "connector_type", config.alias("config"))
    from newsloom.functions.urls import identifier

    known = new.filter("id % 2 = 0").withColumn("source_identifier", identifier(F.col("connector_type"), F.col("config")))
    ok, conflict = M.add_channels(known, new)
    return ok.select("id", F.lit("added").alias("state")).unionByName(conflict.select("id", F.lit("conflict").alias("state")))


@add("rules_reordered", "K25", "SELECT n_nationkey AS id, CASE WHEN n_nationkey < 10 THEN 100 - n_nationkey ELSE n_regionkey END AS place FROM nation", model=False)
def _(m):
    rules = m.table("nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("order"))
    places = rules.filter("id < 10").select("id", (100 - F.col("id")).alias("order"))
    return M.reordered(rules, places).select("id", F.col("order").alias("place"))


@add("messages_replaced", "K26", "SELECT n_nationkey AS id, false AS active FROM nation UNION ALL SELECT 99, true", model=False)
def _(m):
    old = m.table("nation").select(F.col("n_nationkey").alias("id"), F.lit(True).alias("active"))
    return M.new_message(old, m.spark.range(1).select(F.lit(99).alias("id"), F.lit(True).alias("active")))


@add("training_records", "K02 K03 S15", "SELECT id, substr(content, 1, 2000) AS content, relevance_score > 0.5 AS relevant, CASE WHEN assigned_ak IS NULL THEN '' ELSE assigned_ak END AS groups, strftime(published_at, '%Y-%m-%d') AS date FROM items WHERE summary IS NOT NULL AND relevance_score >= 0.25")
def _(m):
    items = m.items.withColumn("source_name", F.lit("s")).withColumn("assigned_aks", F.lit(None).cast("array<string>"))
    out = M.training_records(items, 0.25)
    return out.select(F.col("provenance.item_id").alias("id"), "input.content", "labels.relevant", F.array_join("labels.aks", ",").alias("groups"), "input.date")


_BRIEFING = "WITH b AS (SELECT id, title, priority, priority_score FROM items WHERE fetched_at >= TIMESTAMP '1997-01-01' AND NOT is_read AND priority IN ('high', 'medium') ORDER BY priority_score DESC, fetched_at DESC, id DESC LIMIT 200) SELECT priority, string_agg('- ' || title || ' (' || CAST(priority_score AS STRING) || ')', chr(10) ORDER BY priority_score DESC, id) AS body, count(*) AS n FROM b GROUP BY 1"


@add("briefing_text", "K19 A25", _BRIEFING)
@add("briefing_text_selected", "K19 A25", _BRIEFING)
def _(m):
    chosen = L.briefing(m.items, datetime(1997, 1, 1), "medium").orderBy(F.col("priority_score").desc(), F.col("fetched_at").desc(), F.col("id").desc()).limit(200)
    return M.briefing_text(chosen)


@add("labels_merged", "U03 E09 S16", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 - quality ELSE quality END AS quality FROM labels", model=False)
def _(m):
    l = m.table("labels").select("doc_id", "quality")
    return M.upsert(l, l.filter("doc_id % 2 = 0").withColumn("quality", 1 - F.col("quality")), "doc_id")


@add("latest_metrics", "W04", "SELECT event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1", model=False)
def _(m):
    return m.table("events").groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


_LOOKUP = f"WITH d AS (SELECT doc_id, {_TITLE} AS k FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY k) AS n FROM d WHERE k IS NOT NULL"


@add("title_hash_lookup", "J15 E10", _LOOKUP, model=False)
@add("title_lookup", "J15 E10", _LOOKUP, model=False)
def _(m):
    d = _docs(m).select(F.col("seq").alias("doc_id"), normalize_title(F.col("title")).alias("k"))
    return d.join(d.groupBy("k").agg(F.count("*").alias("n")), "k").select("doc_id", "n")
