"""Call metrics over the events table: each event is a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import telemetry as t
from pactline.sources.tables import load

_CALLS = """calls AS (
  SELECT event_id, ts, CASE WHEN event_type = 'error' THEN 'DENETCI' ELSE 'OKUYUCU' END AS agent,
    CASE WHEN user_id % 2 = 0 THEN '' ELSE 'uc2' END AS uc, CAST(floor(value) AS BIGINT) AS ms, event_type <> 'error' AS ok,
    CASE CAST(json_extract(props, '$.k') AS INTEGER) % 5 WHEN 0 THEN 'zaman_asimi' WHEN 1 THEN 'http_404' WHEN 2 THEN 'http_503' WHEN 3 THEN 'parse' ELSE 'yok' END AS kind
  FROM events)"""
_LEVELS = """SELECT CASE WHEN GROUPING(agent) = 1 AND GROUPING(endpoint) = 1 THEN 'total' WHEN GROUPING(agent) = 0 THEN 'agent' ELSE 'endpoint' END AS level,
    coalesce(agent, endpoint, '') AS name, count(*) AS n_calls, CAST(sum(CAST(ok AS INTEGER)) AS BIGINT) AS n_ok, CAST(sum(1 - CAST(ok AS INTEGER)) AS BIGINT) AS n_failed,
    round(avg(ms), 6) AS mean_ms, CAST(quantile_disc(ms, 0.95) AS DOUBLE) AS p95_ms
  FROM (SELECT agent, CASE WHEN uc = '' THEN 'uc1' ELSE uc END AS endpoint, greatest(ms, 0) AS ms, ok FROM {0}) GROUP BY GROUPING SETS ((), (agent), (endpoint))"""


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int") % 5
    kind = F.when(k == 0, "zaman_asimi").when(k == 1, "http_404").when(k == 2, "http_503").when(k == 3, "parse").otherwise("yok")
    agent = F.when(F.col("event_type") == "error", "DENETCI").otherwise("PARCA_A")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), agent.alias("agent"), F.when(F.col("user_id") % 2 == 0, "").otherwise("uc2").alias("endpoint"), F.floor("value").cast("long").alias("duration_ms"), (F.col("event_type") != "error").alias("success"), kind.alias("error"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean_ms", F.round("mean_ms", 6))


QUERIES = {
    "llm_metrics_grouping": lambda s, d: _rounded(t.call_metrics(calls(s, d))),
    "llm_metrics_since": lambda s, d: _rounded(t.call_metrics(t.since(calls(s, d), hours=168))),
    "llm_metrics_agent_bucket": lambda s, d: calls(s, d).groupBy(t.agent_bucket(F.col("agent")).alias("agent")).agg(F.count("*").alias("n")),
    "llm_metrics_error_histogram": lambda s, d: t.error_histogram(calls(s, d)),
    "recent_calls_topn": lambda s, d: t.recent(calls(s, d), "event_id").select("event_id", "agent", "endpoint", "duration_ms", "success"),
    "load_test_summary": lambda s, d: calls(s, d).agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 6).alias("mean_ms"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY duration_ms)").cast("double").alias("p95_ms"), F.round(F.avg(F.col("success").cast("int")), 9).alias("success_rate")),
}
SQL = {
    "llm_metrics_grouping": f"WITH {_CALLS} {_LEVELS.format('calls')}",
    "llm_metrics_since": f"WITH {_CALLS} {_LEVELS.format('calls WHERE ts >= (SELECT max(ts) FROM calls) - INTERVAL 168 HOURS')}",
    "llm_metrics_agent_bucket": f"WITH {_CALLS} SELECT agent, count(*) AS n FROM calls GROUP BY agent",
    "llm_metrics_error_histogram": f"WITH {_CALLS}, kinds AS (SELECT CASE kind WHEN 'zaman_asimi' THEN 'timeout' WHEN 'http_404' THEN '4xx' WHEN 'http_503' THEN '5xx' ELSE kind END AS error FROM calls WHERE NOT ok AND kind <> 'yok') SELECT CASE error WHEN 'timeout' THEN 1 WHEN '5xx' THEN 2 WHEN '4xx' THEN 3 ELSE 4 END AS rank, error, count(*) AS n FROM kinds GROUP BY error",
    "recent_calls_topn": f"WITH {_CALLS} SELECT event_id, CASE agent WHEN 'OKUYUCU' THEN 'PARCA_A' ELSE agent END AS agent, uc AS endpoint, ms AS duration_ms, ok AS success FROM calls ORDER BY ts DESC, event_id DESC LIMIT 20",
    "load_test_summary": f"WITH {_CALLS} SELECT count(*) AS n, round(avg(ms), 6) AS mean_ms, CAST(quantile_disc(ms, 0.95) AS DOUBLE) AS p95_ms, round(avg(CAST(ok AS INTEGER)), 9) AS success_rate FROM calls",
}
