"""Ingest as a function of a batch and the store, and the same as a stream by foreachBatch.

The order of a batch: rows too old go, titles and texts are cleaned, exact copies go; then links to what is stored, first by
address, then by cleaned address, then by meaning, and within the batch by title; then rules and keywords score, and a
classifier's confidence, where there is one, overrules them. Items, events and vectors of a batch are written under its number, so a
batch that comes again replaces what its first try wrote.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.text import confidence_bucket, content_hash, normalize_content, retry_priority, strip_boilerplate
from newsloom.operators.dedupe import CONFIRMED, MAYBE, drop_known, link_by_title, link_by_url
from newsloom.operators.history import History
from newsloom.operators.neighbours import VectorIndex
from newsloom.operators.rules import apply_rules
from newsloom.shared import removed, workspace

STORED = [
    "channel_id", "external_id", "content_hash", "title", "content", "url", "published_at", "priority", "priority_score", "rule_ids", "retry_priority", "needs_llm_processing",
    "similar_to_seq", "link_method", "similarity", "candidate_seq", "seq",
]
KNOWN = "channel_id string, external_id string, content_hash string, url string, seq bigint"


def fresh(batch: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Rows not older than so many days before as_of; a row without a date counts as new."""
    return batch.withColumn("published_at", F.coalesce("published_at", F.lit(as_of))).filter(F.col("published_at") >= F.lit(as_of) - F.expr(f"INTERVAL '{days}' DAY"))


def cleaned(batch: DataFrame, as_of: datetime, days: int | None = 7) -> DataFrame:
    """Recent rows of the batch, cleaned and hashed."""
    rows = batch if days is None else fresh(batch, as_of, days)
    return rows.withColumn("title", normalize_content(F.col("title"))).withColumn("content", normalize_content(F.col("content"))).withColumn("content_hash", content_hash(F.col("content")))


def with_address_links(rows: DataFrame, store: DataFrame) -> DataFrame:
    """rows with similar_to_seq and link_method where a stored item of another channel has the address, or the cleaned address."""
    known = store.withColumn("id", F.col("seq"))
    exact = link_by_url(rows, known).withColumnRenamed("similar_to_id", "_exact")
    clean = link_by_url(rows, known, normalized=True).withColumnRenamed("similar_to_id", "_clean")
    rows = rows.join(exact, "seq", "left").join(clean, "seq", "left")
    method = F.when(F.col("_exact").isNotNull(), "url").when(F.col("_clean").isNotNull(), "url_normalized")
    return rows.withColumn("similar_to_seq", F.coalesce("_exact", "_clean")).withColumn("link_method", method).drop("_exact", "_clean")


def with_meaning_links(rows: DataFrame, matches: DataFrame, store: DataFrame) -> DataFrame:
    """rows with the stored item of the nearest vector (matches: query_id, rank, vec_id, score), for those without a link.

    A score of 0.75 and more links; one of 0.60 and more makes a candidate_seq that a slow model is to judge. Only the best match counts, and if its
    item has gone from the store there is none.
    """
    best = matches.filter(F.col("rank") == 1).select(F.col("query_id").alias("seq"), F.col("vec_id").alias("_near"), F.col("score").alias("similarity"))
    best = best.join(store.select(F.col("seq").alias("_near")), "_near", "left_semi").filter(F.col("similarity") >= MAYBE)
    free = F.col("similar_to_seq").isNull()
    near, score = F.when(free, F.col("_near")), F.when(free, F.col("similarity"))
    rows = rows.join(best, "seq", "left").withColumn("_near", near).withColumn("similarity", score)
    sure = F.col("similarity") >= CONFIRMED
    method = F.coalesce("link_method", F.when(sure, "semantic"))
    return rows.withColumn("link_method", method).withColumn("similar_to_seq", F.coalesce("similar_to_seq", F.when(sure, F.col("_near")))).withColumn("candidate_seq", F.when(~sure, F.col("_near"))).drop("_near")


def with_title_links(rows: DataFrame) -> DataFrame:
    """rows linked to the first earlier item of the batch with a similar title, where nothing stored was found."""
    titles = link_by_title(rows.select("seq", strip_boilerplate(F.col("title")).alias("title"))).withColumnRenamed("first", "_title")
    rows = rows.join(titles, "seq", "left")
    found = F.col("similar_to_seq").isNull() & F.col("_title").isNotNull()
    return rows.withColumn("link_method", F.when(found, "title").otherwise(F.col("link_method"))).withColumn("similar_to_seq", F.coalesce("similar_to_seq", "_title")).drop("_title")


def scored(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """rows with rules' and keywords' score and priority, or the classifier's, and what the slow model is to see."""
    bucket, known = confidence_bucket(F.col("confidence")), F.col("confidence").isNotNull()
    rows = apply_rules(rows, rules)
    rows = rows.withColumn("priority", F.when(known, bucket["priority"]).otherwise(F.col("priority"))).withColumn("priority_score", F.when(known, bucket["score"]).otherwise(F.col("priority_score")))
    skip = known & bucket["skip"] & F.col("candidate_seq").isNull()
    return rows.withColumn("retry_priority", retry_priority(F.col("confidence"))).withColumn("needs_llm_processing", ~skip)


def ingest(batch: DataFrame, store: DataFrame, as_of: datetime, days: int | None = 7, rules: list[dict] = (), matches: DataFrame | None = None) -> DataFrame:
    """New items of a batch (seq, channel_id, external_id, title, content, url, published_at, confidence) over a store of items.

    matches: the nearest stored vectors of the batch's rows; without them no row is linked by meaning. Links are
    the other item's seq.
    """
    rows = with_address_links(drop_known(cleaned(batch, as_of, days), store), store)
    return _finished(rows, store, rules, matches)


def _finished(rows: DataFrame, store: DataFrame, rules: list[dict], matches: DataFrame | None) -> DataFrame:
    none = rows.withColumn("similarity", F.lit(None).cast("double")).withColumn("candidate_seq", F.lit(None).cast("long"))
    rows = none if matches is None else with_meaning_links(rows, matches, store)
    return scored(with_title_links(rows), list(rules)).select(*STORED)


def ingest_events(items: DataFrame) -> DataFrame:
    """(item_seq, event_type, other_seq, method, score): one `created` for each new item, and one `duplicate_detected` for the stored
    item that a new one was linked to by address or meaning."""
    made = items.select(F.col("seq").alias("item_seq"), F.lit("created").alias("event_type"), F.lit(None).cast("long").alias("other_seq"), F.col("priority").alias("method"), F.lit(None).cast("double").alias("score"))
    linked = items.filter(F.col("link_method").isin("url", "url_normalized", "semantic"))
    return made.unionByName(linked.select(F.col("similar_to_seq").alias("item_seq"), F.lit("duplicate_detected").alias("event_type"), F.col("seq").alias("other_seq"), F.col("link_method").alias("method"), F.col("similarity").alias("score")))


class Ingest:
    """A store of items, events, keys and vectors that grows by numbered batches: path/items, path/events, path/history, path/vectors.

    A batch has the columns of `ingest` and, where meaning counts, `vector`. It sees the items of earlier numbers only, so
    running it again gives the same and replaces what was written. Stored items are looked up by key (`History`) and by vector (`VectorIndex`);
    the items themselves are written and not read, so a batch costs about the same however many there are.
    """

    def __init__(self, spark: SparkSession, path: str, as_of: datetime, days: int | None = 7, rules: list[dict] = ()) -> None:
        self.spark, self.path, self.as_of, self.days, self.rules = spark, path, as_of, days, list(rules)
        self.index, self.history = VectorIndex(spark, f"{path}/vectors"), History(spark, f"{path}/history")

    def items(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/items") if _exists(self.spark, f"{self.path}/items") else self.spark.createDataFrame([], KNOWN)

    def _gone(self) -> DataFrame:
        """seq of items that were taken out: their keys and vectors are still known."""
        return self.spark.read.parquet(f"{self.path}/gone") if _exists(self.spark, f"{self.path}/gone") else self.spark.createDataFrame([], "seq bigint")

    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/events")

    def step(self, batch: DataFrame, number: int) -> None:
        last = self.index.manifest()["last"] if "vector" in batch.columns else None
        if last is not None and number <= last:
            return  # the index comes last, so all of the batch is there
        stage, place = workspace(self.spark, "ingest"), f"{self.path}/items/batch={number}"
        cleaned(batch, self.as_of, self.days).write.parquet(f"{stage}/cleaned")
        rows, gone = self.spark.read.parquet(f"{stage}/cleaned"), self._gone()
        known = self.history.lookup(rows).join(gone, "seq", "left_anti")
        if _exists(self.spark, place):  # a try before this one got that far; its items may be in the history
            known = known.join(self.spark.read.parquet(place).select("seq"), "seq", "left_anti")
        known.write.parquet(f"{stage}/known")
        known = self.spark.read.parquet(f"{stage}/known")
        with_address_links(drop_known(rows, known), known).write.parquet(f"{stage}/rows")
        rows, there, matches = self.spark.read.parquet(f"{stage}/rows"), known, None
        asks = "vector" in rows.columns
        if asks:
            asked = rows.filter("similar_to_seq IS NULL").select(F.col("seq").alias("vec_id"), F.col("vector").alias("embedding"))
            matches = self.index.search(asked, 5, least=MAYBE).matches()
            there = matches.select(F.col("vec_id").alias("seq")).distinct().join(gone, "seq", "left_anti")
        _finished(rows, there, self.rules, matches).write.mode("overwrite").parquet(place)
        new = self.spark.read.parquet(place)
        ingest_events(new).write.mode("overwrite").parquet(f"{self.path}/events/batch={number}")
        self.history.append(number, new)
        if asks:
            # Last: a further try of the batch must not find its own vectors.
            self.index.append(number, rows.select(F.col("seq").alias("vec_id"), F.col("vector").alias("embedding")))
        removed(self.spark, stage)

    def remove(self, gone: DataFrame) -> None:
        """Take items (seq) out of the store; their keys and vectors stay where they are, and lookups leave them out."""
        gone.select("seq").write.mode("append").parquet(f"{self.path}/gone")
        for r in self.items().select("batch").distinct().collect():
            place, kept = f"{self.path}/items/batch={r['batch']}", workspace(self.spark, "kept")
            self.spark.read.parquet(place).join(gone.select("seq"), "seq", "left_anti").write.parquet(kept)
            self.spark.read.parquet(kept).write.mode("overwrite").parquet(place)
            removed(self.spark, kept)


def stream_ingest(spark: SparkSession, source: DataFrame, store: str, checkpoint: str, as_of: datetime, days: int | None = 7, rules: list[dict] = ()) -> StreamingQuery:
    """Run `Ingest.step` on every micro-batch of a streaming DataFrame; ends when input does."""
    into = Ingest(spark, store, as_of, days, rules)
    return source.writeStream.foreachBatch(into.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "7 days") -> DataFrame:
    """A stream's first row of each key, with state bounded by a watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, at: str, key: str, size: str, late: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, size), key).agg(F.count("*").alias("n"))


def worker_passes(items: DataFrame, as_of: datetime, batch: int = 50, days: int = 7) -> list[tuple[str, DataFrame]]:
    """What a classifier worker does next, in order: unclassified, unindexed, unchecked items, newest first."""
    from newsloom.operators.listing import unchecked_duplicates, unclassified, unindexed

    newest = [F.col("fetched_at").desc(), F.col("id").desc()]
    return [(name, rows.orderBy(*newest).limit(batch)) for name, rows in (("classify", unclassified(items)), ("index", unindexed(items)), ("check", unchecked_duplicates(items, as_of, days)))]


def model_schedule(fresh: DataFrame, backlog: DataFrame, room: int = 1000, batch: int = 10, backlog_batch: int = 50) -> DataFrame:
    """(id, kind, run): what the slow model does next. fresh: id and seq, in order of arrival; backlog: id, rank, fetched_at.

    The queue of fresh items is first in, first out and has room for so many; what finds it full is left to the
    backlog. Runs of fresh items come first, and the backlog's one run, by rank and then newest, is put off until they
    are through. Only the queue's room is ranked, not all that arrived.
    """
    queue = fresh.orderBy("seq", "id").limit(room)
    taken = queue.withColumn("run", F.floor((F.row_number().over(Window.orderBy("seq", "id")) - 1) / batch).cast("int")).select("id", F.lit("fresh").alias("kind"), "run")
    waiting = backlog.join(queue.select("id"), "id", "left_anti").orderBy("rank", F.col("fetched_at").desc(), F.col("id").desc()).limit(backlog_batch)
    after = taken.agg(F.coalesce(F.max("run") + 1, F.lit(0)).alias("run"))
    return taken.unionByName(waiting.select("id", F.lit("backlog").alias("kind")).crossJoin(F.broadcast(after)))


def backoff(errors: int, base: int = 10, most: int = 120, stop: int = 10) -> int | None:
    """Seconds to wait after so many errors in a row; None once a worker stops."""
    return None if errors >= stop else min(most, base * 2**errors)


def live_commands(commands: DataFrame, as_of: datetime, seconds: int = 60) -> DataFrame:
    """The newest command of each worker that isn't stale."""
    recent = commands.filter(F.unix_timestamp(F.lit(as_of)) - F.unix_timestamp("at") <= seconds)
    return recent.groupBy("name").agg(F.max_by("action", "at").alias("action"))
