"""The news model over the test tables.

Each table of the model is one SELECT that Spark and DuckDB both read: Spark runs it over a DataFrame, and
the oracle has it as a common table expression.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

AS_OF = datetime(1998, 8, 2, 15, 30)
LOG_AS_OF = datetime(2024, 1, 31)

MODEL = {
    "sources": (
        "nation",
        """SELECT CAST(n_nationkey AS BIGINT) AS id, CASE WHEN n_nationkey % 6 = 1 THEN 'Google Alert ' || n_name ELSE n_name END AS name,
        n_regionkey = 3 AS is_stakeholder, n_nationkey % 7 <> 3 AS enabled, CAST(n_regionkey AS BIGINT) AS region FROM {t}""",
    ),
    "channels": (
        "supplier",
        """SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS source_id, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS name,
        CASE s_suppkey % 5 WHEN 0 THEN 'rss' WHEN 1 THEN 'html' WHEN 2 THEN 'mastodon' WHEN 3 THEN 'telegram' ELSE 'linkedin' END AS connector_type,
        s_acctbal > 1000 AS enabled, CAST(30 + s_suppkey % 4 * 15 AS INTEGER) AS fetch_interval_minutes,
        CASE WHEN s_suppkey % 11 <> 0 THEN TIMESTAMP '1998-08-02 15:30:00' - INTERVAL '1' MINUTE * (s_suppkey * 7 % 100) END AS last_fetch_at,
        CASE WHEN s_suppkey % 8 = 3 THEN 'timeout' END AS last_error FROM {t}""",
    ),
    "items": (
        "orders",
        """SELECT o_orderkey AS id, o_custkey % 10 + 1 AS channel_id, CAST(o_orderkey % 400 AS STRING) AS external_id,
        o_orderpriority || ' Auftrag ' || CAST(o_custkey AS STRING) AS title, 'Bericht zu ' || o_orderpriority || ' von ' || CAST(o_custkey % 97 AS STRING) AS content,
        'https://www.example.org/' || CAST(o_custkey % 307 AS STRING) AS url,
        CASE WHEN o_orderkey % 4 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 4 = 1 THEN '' ELSE 'Zusammenfassung ' || o_orderpriority END AS summary,
        CASE WHEN o_orderkey % 50 = 0 THEN CAST(NULL AS STRING) WHEN o_orderpriority = '1-URGENT' THEN 'high' WHEN o_orderpriority = '2-HIGH' THEN 'medium' WHEN o_orderpriority = '3-MEDIUM' THEN 'low' ELSE 'none' END AS priority,
        CAST(o_custkey % 101 AS INTEGER) AS priority_score, o_orderdate AS published_at, o_orderdate + INTERVAL '1' HOUR * (o_orderkey % 48) AS fetched_at,
        o_orderstatus <> 'O' AS is_read, o_orderkey % 10 = 0 AS is_starred, o_orderkey % 13 = 0 AS is_archived, o_orderkey % 29 = 0 AS is_manually_reviewed,
        o_orderkey % 3 = 0 AS needs_llm_processing, CASE WHEN o_orderkey % 17 = 0 THEN o_orderkey - 1 WHEN o_orderkey % 17 = 1 THEN o_orderkey - 2 END AS similar_to_id,
        CASE o_orderkey % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'edge_case' WHEN 2 THEN 'low' WHEN 3 THEN 'unknown' END AS retry_priority,
        CASE o_orderkey % 7 WHEN 0 THEN 'Pflege' WHEN 1 THEN 'Integration' WHEN 2 THEN 'Sonstiges' WHEN 3 THEN 'Demenz' WHEN 4 THEN 'Bildung' END AS topic,
        CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o_orderkey % 100 AS DOUBLE) / 100 END AS confidence,
        CASE WHEN o_orderkey % 4 = 1 THEN 'AK' || CAST(o_orderkey % 5 + 1 AS STRING) END AS assigned_ak,
        CASE WHEN o_orderkey % 4 = 2 THEN 'AK' || CAST(o_orderkey % 5 + 1 AS STRING) END AS model_ak,
        CAST(o_orderkey % 20 AS DOUBLE) / 20 AS relevance_score, o_orderkey % 12 = 5 AS duplicate_checked, o_orderkey % 9 = 2 AS indexed FROM {t}""",
    ),
    "logs": (
        "events",
        """SELECT event_id AS id, user_id AS item_id, ts AS created_at, props,
        CASE event_type WHEN 'click' THEN 'classifier' WHEN 'view' THEN 'llm_analysis' WHEN 'error' THEN 'fetch' WHEN 'signup' THEN 'rule_match' ELSE 'pre_filter' END AS step_type,
        CAST(event_id % 7 AS INTEGER) AS step_order, CAST(event_id % 1000 AS DOUBLE) / 1000 AS confidence_score,
        CASE WHEN event_id % 9 <> 4 THEN CAST(event_id * 37 % 5000 AS BIGINT) END AS duration_ms,
        CASE WHEN event_type IN ('click', 'view') THEN 'model-' || CAST(event_id % 3 AS STRING) END AS model_name, CASE WHEN event_id % 2 = 0 THEN 'ollama' ELSE 'openrouter' END AS model_provider,
        CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS priority_input, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' WHEN 3 THEN 'none' END AS priority_output,
        CASE WHEN event_id % 3 > 0 THEN 'AK' || CAST(event_id % 6 AS STRING) END AS ak_primary, event_id % 20 <> 0 AS success FROM {t}""",
    ),
}

CTE = "WITH " + ", ".join(f"{name} AS ({sql.format(t=table)})" for name, (table, sql) in MODEL.items())


class Model:
    """Tables of a folder, and the model's tables over them, read when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in MODEL:
            raise AttributeError(name)
        table, sql = MODEL[name]
        return self.spark.sql(sql, t=self.table(table))


class Catalog:
    """Queries by name, with the SQL of those that SQL can express and the operators each covers."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}
        self.covers: dict[str, list[str]] = {}

    def add(self, name: str, covers: str, sql: str | None = None, model: bool = True):
        """Register a function of a Model under name; its SQL may use the model's tables."""

        def register(f):
            self.queries[name] = lambda spark, sf_dir: f(Model(spark, sf_dir))
            self.covers[name] = covers.split()
            if sql:
                self.sql[name] = f"{CTE}, {sql.strip()[5:]}" if model and sql.strip().startswith("WITH ") else f"{CTE} {sql}" if model else sql
            return f

        return register
