"""Document-store queries, state machines and governance on the star tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import documents as d
from pactline.operators import statemachines as m
from pactline.sources.tables import load


def _events(s: SparkSession, p: str) -> DataFrame:
    return load(s, p, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _owned(s: SparkSession, p: str) -> DataFrame:
    """Orders with the nation of their customer as organisation; nation 0 stands for none."""
    c = load(s, p, "customer").select(F.col("c_custkey").alias("o_custkey"), F.nullif("c_nationkey", F.lit(0)).cast("string").alias("org"))
    return load(s, p, "orders").join(c, "o_custkey", "left")


def _prompts(s: SparkSession, p: str) -> DataFrame:
    """Each part is a prompt version of its brand."""
    x = load(s, p, "part").select(F.col("p_brand").alias("org"), F.col("p_partkey").alias("version"), F.col("p_name").alias("content"))
    return x


def settings_with_defaults(orgs: DataFrame, settings: DataFrame, prompts: DataFrame) -> DataFrame:
    """(org, risk_threshold, max_token, prompt): an organisation's settings and active prompt, else the defaults."""
    active = prompts.groupBy("org").agg(F.max(F.struct("version", "content")).alias("p"))
    out = orgs.join(settings, "org", "left").join(active, "org", "left")
    return out.select("org", F.coalesce("risk_threshold", F.lit(0.75)).alias("risk_threshold"), F.coalesce("max_token", F.lit(600)).alias("max_token"), F.coalesce("p.content", F.lit("varsayilan")).alias("prompt"))


def _settings(s: SparkSession, p: str) -> DataFrame:
    n = load(s, p, "nation").select(F.col("n_name").alias("org"), "n_nationkey")
    chosen = n.where("n_nationkey % 3 = 0").select("org", (F.col("n_nationkey") / 100).alias("risk_threshold"), (F.col("n_nationkey") * 10).alias("max_token"))
    names = n.where("n_nationkey % 2 = 0").select("org", F.col("n_nationkey").alias("version"), F.concat(F.lit("p-"), "org").alias("content"))
    return settings_with_defaults(n.select("org"), chosen, names)


def export_bundle(s: SparkSession, p: str) -> DataFrame:
    """One row for each customer with how many orders and line items it has and its first order, each child grouped before the join."""
    c = load(s, p, "customer").select("c_custkey", "c_name")
    o = load(s, p, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    lines = load(s, p, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    orders = o.groupBy("c_custkey").agg(F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_order"))
    items = lines.join(o, "o_orderkey").groupBy("c_custkey").agg(F.count("*").alias("n_lines"))
    return c.join(orders, "c_custkey", "left").join(items, "c_custkey", "left")


def _bundle_counts(s: SparkSession, p: str) -> DataFrame:
    x = export_bundle(s, p)
    return x.select("c_custkey", "c_name", F.coalesce("n_orders", F.lit(0)).alias("n_orders"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "first_order")


def _ordered(s: SparkSession, p: str) -> DataFrame:
    return _events(s, p).withColumn("failed", F.col("event_type") == "error")


QUERIES = {
    "contract_list_page": lambda s, p: d.page(load(s, p, "orders"), "o_orderdate", "o_orderkey", 150, 40).select("o_orderkey", "o_custkey", "o_orderstatus"),
    "tenant_filter_org": lambda s, p: d.visible(_owned(s, p), F.col("org"), F.col("o_custkey"), "7", "1").select("o_orderkey", "org"),
    "tenant_filter_user": lambda s, p: d.visible(_owned(s, p), F.col("org"), F.col("o_custkey").cast("string"), None, "103").select("o_orderkey", "o_custkey"),
    "count_by_tenant": lambda s, p: load(s, p, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")),
    "latest_per_event": lambda s, p: d.latest(_events(s, p), "event_type", "ts", "event_id").select("event_type", "event_id", "user_id"),
    "active_unexpired": lambda s, p: _events(s, p).where((F.col("ts") + F.expr("INTERVAL 7 DAYS") > F.lit("2024-01-15").cast("timestamp")) & (F.col("value") < 5)).select("event_id", "user_id"),
    "retention_90d": lambda s, p: d.retained(_events(s, p), "ts", 90).select("event_id"),
    "conditional_update": lambda s, p: _events(s, p).groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n")).select("user_id", (F.col("n") + 1).alias("attempts"), (F.col("n") + 1 >= 5).alias("invalid")),
    "max_version_active": lambda s, p: d.latest(_prompts(s, p), "org", "version").select("org", "version", "content"),
    "upsert_device": lambda s, p: d.upsert(_events(s, p), ["user_id", "event_type"], "ts", ["event_id"]).select("user_id", "event_type", F.date_format("first_seen", "yyyy-MM-dd HH:mm:ss").alias("first_seen"), F.date_format("last_seen", "yyyy-MM-dd HH:mm:ss").alias("last_seen"), "event_id"),
    "prompt_default_join": _settings,
    "export_bundle": _bundle_counts,
    "erasure_cascade": lambda s, p: d.without_deleted(load(s, p, "orders"), load(s, p, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey", "o_custkey"),
    "erasure_cascade_lines": lambda s, p: d.without_deleted(load(s, p, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), load(s, p, "orders").join(load(s, p, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey").select("o_orderkey"), "o_orderkey").select("o_orderkey", "l_linenumber"),
    "anonymize": lambda s, p: d.anonymised(load(s, p, "events").select("event_id", "user_id", "props"), F.col("user_id") % 10 == 3, "user_id", ["props"]),
    "backfill_organization": lambda s, p: _owned(s, p).select("o_orderkey", F.coalesce("org", F.concat(F.lit("u"), F.col("o_custkey").cast("string"))).alias("org")),
    "last_member_leaves": lambda s, p: load(s, p, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("members")).where("members = 1 or s_nationkey % 5 = 0").select("s_nationkey", "members"),
    "device_fingerprint": lambda s, p: load(s, p, "customer").select("c_custkey", F.sha2(F.concat_ws("\u001e", F.trim("c_name"), F.trim("c_mktsegment")), 256).alias("fingerprint")),
    "token_hash": lambda s, p: load(s, p, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("hash")),
    "settings_domain": lambda s, p: load(s, p, "part").select("p_partkey", (F.col("p_retailprice") / 2000).between(0, 1).alias("risk_ok"), F.col("p_size").between(1, 8192).alias("tokens_ok")),
    "rate_limiter": lambda s, p: m.rate_limited(_events(s, p), "user_id", "ts", "event_id", 5 * 86_400).select("user_id", "event_id", "allowed"),
    "login_guard": lambda s, p: m.login_guarded(_ordered(s, p).where("event_type in ('error', 'signup')"), "user_id", "ts", "event_id", "failed", 20 * 86_400, 3),
    "consecutive_failures": lambda s, p: m.failure_runs(_events(s, p), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "user_id", "run"),
    "rolling_latency": lambda s, p: m.rolling_mean(_events(s, p).where("event_type <> 'error'"), "user_id", ["ts", "event_id"], "value").select("event_id", F.round("rolling", 6).alias("rolling")),
    "oldest_unhealthy": lambda s, p: _events(s, p).where("event_type = 'error'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", F.col("x.event_id").alias("event_id")),
}
_OWNED = "WITH owned AS (SELECT o.*, CAST(nullif(c_nationkey, 0) AS VARCHAR) AS org FROM orders o LEFT JOIN customer ON c_custkey = o_custkey)"
SQL = {
    "contract_list_page": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100 OFFSET 40",
    "tenant_filter_org": f"{_OWNED} SELECT o_orderkey, org FROM owned WHERE org = '7'",
    "tenant_filter_user": f"{_OWNED} SELECT o_orderkey, o_custkey FROM owned WHERE o_custkey = 103 AND org IS NULL",
    "count_by_tenant": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey",
    "latest_per_event": "SELECT event_type, event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) = 1",
    "active_unexpired": "SELECT event_id, user_id FROM events WHERE ts + INTERVAL 7 DAYS > TIMESTAMP '2024-01-15' AND value < 5",
    "retention_90d": "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 90 DAYS",
    "conditional_update": "SELECT user_id, count(*) FILTER (event_type = 'error') + 1 AS attempts, count(*) FILTER (event_type = 'error') + 1 >= 5 AS invalid FROM events GROUP BY user_id",
    "max_version_active": "SELECT p_brand AS org, p_partkey AS version, p_name AS content FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) = 1",
    "upsert_device": "SELECT user_id, event_type, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen, max(struct_pack(t := ts, e := event_id)).e AS event_id FROM events GROUP BY user_id, event_type",
    "prompt_default_join": "SELECT n_name AS org, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey / 100 ELSE 0.75 END AS risk_threshold, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 10 ELSE 600 END AS max_token, CASE WHEN n_nationkey % 2 = 0 THEN 'p-' || n_name ELSE 'varsayilan' END AS prompt FROM nation",
    "export_bundle": "SELECT c_custkey, c_name, coalesce((SELECT count(*) FROM orders WHERE o_custkey = c_custkey), 0) AS n_orders, coalesce((SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey), 0) AS n_lines, (SELECT min(o_orderkey) FROM orders WHERE o_custkey = c_custkey) AS first_order FROM customer",
    "erasure_cascade": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "erasure_cascade_lines": "SELECT l_orderkey AS o_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 0)",
    "anonymize": "SELECT event_id, CASE WHEN user_id % 10 = 3 THEN 'silinmis' ELSE CAST(user_id AS VARCHAR) END AS user_id, CASE WHEN user_id % 10 = 3 THEN '' ELSE props END AS props FROM events",
    "backfill_organization": f"{_OWNED} SELECT o_orderkey, coalesce(org, 'u' || o_custkey) AS org FROM owned",
    "last_member_leaves": "SELECT s_nationkey, count(*) AS members FROM supplier GROUP BY s_nationkey HAVING count(*) = 1 OR s_nationkey % 5 = 0",
    "device_fingerprint": "SELECT c_custkey, sha256(trim(c_name) || chr(30) || trim(c_mktsegment)) AS fingerprint FROM customer",
    "token_hash": "SELECT s_suppkey, sha256(s_name) AS hash FROM supplier",
    "settings_domain": "SELECT p_partkey, p_retailprice / 2000 BETWEEN 0 AND 1 AS risk_ok, p_size BETWEEN 1 AND 8192 AS tokens_ok FROM part",
    "rate_limiter": """WITH RECURSIVE o AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
      f AS (SELECT user_id, event_id, r, ts AS last, true AS allowed FROM o WHERE r = 1
        UNION ALL SELECT o.user_id, o.event_id, o.r, CASE WHEN o.ts - f.last >= INTERVAL 5 DAYS THEN o.ts ELSE f.last END, o.ts - f.last >= INTERVAL 5 DAYS FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
      SELECT user_id, event_id, allowed FROM f""",
    "login_guard": """WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS t, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events WHERE event_type IN ('error', 'signup')),
      f AS (SELECT user_id, event_id, r, CASE WHEN failed THEN [t] ELSE CAST([] AS BIGINT[]) END AS kept, false AS locked FROM o WHERE r = 1
        UNION ALL SELECT o.user_id, o.event_id, o.r,
          CASE WHEN len(list_filter(f.kept, lambda x: x > o.t - 1728000000000)) >= 3 THEN list_filter(f.kept, lambda x: x > o.t - 1728000000000) WHEN o.failed THEN list_append(list_filter(f.kept, lambda x: x > o.t - 1728000000000), o.t) ELSE CAST([] AS BIGINT[]) END,
          len(list_filter(f.kept, lambda x: x > o.t - 1728000000000)) >= 3 FROM f JOIN o ON o.user_id = f.user_id AND o.r = f.r + 1)
      SELECT user_id, event_id, locked FROM f""",
    "consecutive_failures": """WITH i AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM events)
      SELECT event_id, user_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS BIGINT) AS run FROM i""",
    "rolling_latency": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS rolling FROM events WHERE event_type <> 'error'",
    "oldest_unhealthy": "SELECT user_id, min(struct_pack(t := ts, e := event_id)).e AS event_id FROM events WHERE event_type = 'error' GROUP BY user_id",
}
