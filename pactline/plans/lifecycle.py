"""Contracts from upload to approval, refresh tokens, roles and invitations, over the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import organisation as o
from pactline.sources.tables import load
from pactline.streaming import transitions as t

#: SQL, the same for both engines: what an event means for the contract of its user
_JOB = "CASE event_type WHEN 'signup' THEN 'uploaded' WHEN 'view' THEN 'started' WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'finished' END WHEN 'purchase' THEN 'approved' ELSE CASE WHEN event_id % 7 = 0 THEN 'deleted' ELSE 'edited' END END"
_SESSION = "CASE event_type WHEN 'signup' THEN 'login' WHEN 'error' THEN CASE WHEN event_id % 5 = 0 THEN 'logout' ELSE 'refresh' END ELSE 'refresh' END"
_DEVICE = "CASE WHEN event_id % 6 = 0 THEN NULL ELSE user_id % 40 END"
TTL = 5 * 86_400


def _events(s: SparkSession, p: str) -> DataFrame:
    e = load(s, p, "events")
    return e.withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def _jobs(s: SparkSession, p: str) -> DataFrame:
    return t.settled(_events(s, p).selectExpr("user_id", "at", "event_id", f"{_JOB} AS event"), "user_id", ["at", "event_id"], t.job).select("event_id", "accepted", "state")


def _sessions(s: SparkSession, p: str) -> DataFrame:
    """A refresh shows the token that the event before it got, every fourth an older one."""
    w = "OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    e = _events(s, p).selectExpr("user_id", "at", "event_id", f"{_SESSION} AS event", "CAST(event_id AS STRING) AS token", f"CAST(CASE WHEN event_id % 4 = 0 THEN lag(event_id, 2) {w} ELSE lag(event_id, 1) {w} END AS STRING) AS shown", f"{_DEVICE} AS device")
    return t.settled(e, "user_id", ["at", "event_id"], t.session(TTL)).select("event_id", "accepted", F.get_json_object("state", "$.token").alias("token"))


def _members(s: SparkSession, p: str) -> DataFrame:
    """Users 0 to 149 in 25 organisations, each owned by its first."""
    u = load(s, p, "customer").where("c_custkey < 150")
    return u.selectExpr("c_custkey % 25 AS org", "c_custkey AS user", "CASE WHEN c_custkey < 25 THEN 'SAHIP' WHEN c_custkey % 2 = 0 THEN 'YONETICI' ELSE 'IZLEYICI' END AS role")


_TARGET = "(user_id + 25 * (event_id % 7)) % 175"
_ROLE = "CASE event_type WHEN 'signup' THEN 'SAHIP' WHEN 'view' THEN 'YONETICI' WHEN 'click' THEN 'IZLEYICI' WHEN 'purchase' THEN 'SAHIP' ELSE 'KONUK' END"


def _changes(s: SparkSession, p: str) -> DataFrame:
    return o.role_changes(_members(s, p), load(s, p, "events").selectExpr("user_id % 25 AS org", "event_id AS id", "user_id AS actor", f"{_TARGET} AS target", f"{_ROLE} AS role"))


#: SQL, the same for both engines: whom an event invites; some addresses are broken, some are those of members
_EMAIL = "CASE event_id % 5 WHEN 0 THEN ' U' || CAST(event_id % 200 AS STRING) || '@Example.org ' WHEN 1 THEN 'kim' ELSE 'u' || CAST(event_id % 300 AS STRING) || '@example.org' END"
_USERS = "c_custkey % 25 AS org, 'u' || CAST(c_custkey AS STRING) || '@example.org' AS email"


def _invited(s: SparkSession, p: str) -> DataFrame:
    users = load(s, p, "customer").where("c_custkey < 150").selectExpr(*[x.strip() for x in _USERS.split(", ")])
    requests = load(s, p, "events").selectExpr("user_id % 25 AS org", "event_id AS id", "CASE WHEN event_id % 3 = 0 THEN user_id ELSE user_id % 25 END AS actor", f"{_EMAIL} AS email", f"{_ROLE} AS role")
    return o.invited(_members(s, p), users, requests)


def _accepted(s: SparkSession, p: str) -> DataFrame:
    users = load(s, p, "customer").where("c_custkey < 150 AND c_custkey % 3 = 0").selectExpr(*[x.strip() for x in _USERS.split(", ")])
    tries = load(s, p, "events").where("event_id % 2 = 0").selectExpr("event_id + 100000 AS id", "event_id AS invitation").unionByName(load(s, p, "events").where("event_id % 3 = 0").selectExpr("event_id + 200000 AS id", "event_id AS invitation"))
    return o.accepted(_invited(s, p), users, tries)


_ORDERED = "o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events)"
_MOVED = f"""CASE WHEN x = 'uploaded' AND s IS NULL THEN 'YUKLENDI' WHEN x = 'started' AND s IS NOT NULL THEN 'ISLENIYOR' WHEN x = 'finished' AND s = 'ISLENIYOR' THEN 'INCELENMEYI_BEKLIYOR' WHEN x = 'failed' AND s = 'ISLENIYOR' THEN 'HATA'
  WHEN x = 'approved' AND s = 'INCELENMEYI_BEKLIYOR' THEN 'ONAYLANDI' WHEN x = 'deleted' THEN NULL ELSE s END"""
_JOBS = f"""WITH RECURSIVE {_ORDERED}, e AS (SELECT user_id, event_id, r, {_JOB} AS x FROM o),
  f AS (SELECT user_id, event_id, r, x, CAST(NULL AS VARCHAR) AS s, CASE WHEN x = 'uploaded' THEN 'YUKLENDI' END AS state FROM e WHERE r = 1
    UNION ALL SELECT user_id, event_id, r, x, s, {_MOVED} FROM (SELECT e.*, f.state AS s FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) z)
  SELECT event_id, coalesce(CASE x WHEN 'uploaded' THEN s IS NULL WHEN 'started' THEN s IS NOT NULL WHEN 'finished' THEN s = 'ISLENIYOR' WHEN 'failed' THEN s = 'ISLENIYOR' WHEN 'approved' THEN s = 'INCELENMEYI_BEKLIYOR' WHEN 'edited' THEN s <> 'ONAYLANDI' ELSE s IS NOT NULL END, false) AS accepted, state FROM f"""
_ACCEPTS = "x = 'login' OR (s IS NOT NULL AND (x = 'logout' OR (shown = s AND micros < until AND dev)))"
_SESSIONS = f"""WITH RECURSIVE {_ORDERED}, e AS (SELECT user_id, event_id, r, epoch_us(ts) AS micros, {_SESSION} AS x, {_DEVICE} IS NOT NULL AS has, CASE WHEN event_id % 4 = 0 THEN lag(event_id, 2) OVER w ELSE lag(event_id) OVER w END AS shown FROM o WINDOW w AS (PARTITION BY user_id ORDER BY r)),
  f AS (SELECT user_id, event_id, r, x = 'login' AS accepted, CASE WHEN x = 'login' THEN event_id END AS token, CASE WHEN x = 'login' THEN micros + {TTL * 1_000_000} END AS until, has AS dev FROM e WHERE r = 1
    UNION ALL SELECT user_id, event_id, r, coalesce({_ACCEPTS}, false),
      CASE WHEN x = 'logout' THEN NULL WHEN coalesce({_ACCEPTS}, false) THEN event_id WHEN x = 'refresh' AND s IS NOT NULL AND shown = s AND micros < until AND NOT dev THEN NULL ELSE s END,
      CASE WHEN coalesce({_ACCEPTS}, false) THEN micros + {TTL * 1_000_000} ELSE until END, CASE WHEN x = 'login' THEN has ELSE dev END
      FROM (SELECT e.*, f.token AS s, f.until, f.dev FROM f JOIN e ON e.user_id = f.user_id AND e.r = f.r + 1) z)
  SELECT event_id, accepted, CAST(token AS VARCHAR) AS token FROM f"""
_MEMBERS = "m AS (SELECT c_custkey % 25 AS org, c_custkey AS user, CASE WHEN c_custkey < 25 THEN 'SAHIP' WHEN c_custkey % 2 = 0 THEN 'YONETICI' ELSE 'IZLEYICI' END AS role FROM customer WHERE c_custkey < 150)"
_CHANGES = f"""{_MEMBERS}, q AS (SELECT user_id % 25 AS org, event_id AS id, user_id AS actor, {_TARGET} AS target, {_ROLE} AS role, row_number() OVER (PARTITION BY user_id % 25 ORDER BY event_id) AS r FROM events),
  z AS (SELECT org, CAST(0 AS BIGINT) AS id, CAST(NULL AS BIGINT) AS actor, CAST(NULL AS BIGINT) AS target, '' AS role, CAST(0 AS BIGINT) AS r, false AS accepted, org AS owner FROM (SELECT DISTINCT org FROM q)
    UNION ALL SELECT q.*, q.actor = owner AND q.target < 150 AND q.role <> 'KONUK' AND (q.role = 'SAHIP' OR q.target <> owner),
      CASE WHEN q.actor = owner AND q.target < 150 AND q.role = 'SAHIP' THEN q.target ELSE owner END FROM z JOIN q ON q.org = z.org AND q.r = z.r + 1)"""
_ROLES = f"""WITH RECURSIVE {_CHANGES}, g AS (SELECT org, id, target AS user, role FROM z WHERE accepted UNION ALL SELECT org, id, actor, 'YONETICI' FROM z WHERE accepted AND role = 'SAHIP' AND actor <> target)
  SELECT m.org, m.user, coalesce((SELECT arg_max(g.role, g.id) FROM g WHERE g.org = m.org AND g.user = m.user), m.role) AS role FROM m"""
_ASKED = f"""i AS (SELECT user_id % 25 AS org, event_id AS id, CASE WHEN event_id % 3 = 0 THEN user_id ELSE user_id % 25 END AS actor, CASE WHEN event_id % 5 <> 1 THEN lower(trim({_EMAIL})) END AS email, {_ROLE} AS role FROM events),
  j AS (SELECT *, CASE WHEN actor <> org OR role NOT IN ('YONETICI', 'IZLEYICI') THEN 'yasak' WHEN email IS NULL OR EXISTS (SELECT 1 FROM (SELECT {_USERS} FROM customer WHERE c_custkey < 150) u WHERE u.org = i.org AND u.email = i.email) THEN 'yok' ELSE 'davet' END AS outcome FROM i),
  k AS (SELECT *, outcome = 'davet' AND id = max(CASE WHEN outcome = 'davet' THEN id END) OVER (PARTITION BY org, email) AS open FROM j)"""
QUERIES = {
    "job_lifecycle": _jobs, "token_rotation": _sessions, "role_changes": lambda s, p: _changes(s, p).select("id", "accepted", "owner"),
    "member_roles": lambda s, p: o.roles_after(_members(s, p), _changes(s, p)), "invitations": _invited, "accepted_invitations": _accepted,
}
SQL = {
    "job_lifecycle": _JOBS, "token_rotation": _SESSIONS, "role_changes": f"WITH RECURSIVE {_CHANGES} SELECT id, accepted, owner FROM z WHERE r > 0", "member_roles": _ROLES,
    "invitations": f"WITH {_ASKED} SELECT org, id, actor, email, role, outcome, open FROM k",
    "accepted_invitations": f"""WITH {_ASKED}, tries AS (SELECT event_id + 100000 AS id, event_id AS invitation FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id + 200000, event_id FROM events WHERE event_id % 3 = 0),
      x AS (SELECT t.id, invitation, k.org, k.role, k.email, row_number() OVER (PARTITION BY invitation ORDER BY t.id) AS n FROM tries t LEFT JOIN k ON k.id = invitation AND open),
      u AS (SELECT email, min(org) AS own FROM (SELECT {_USERS} FROM customer WHERE c_custkey < 150 AND c_custkey % 3 = 0) z GROUP BY email),
      y AS (SELECT x.*, own, org IS NOT NULL AND n = 1 AND own IS NULL AS fresh FROM x LEFT JOIN u USING (email)),
      z AS (SELECT *, CASE WHEN fresh AND id = min(CASE WHEN fresh THEN id END) OVER (PARTITION BY email) THEN 'kayit' WHEN org IS NOT NULL AND n = 1 AND own = org THEN 'uye' ELSE 'yok' END AS outcome FROM y)
      SELECT id, invitation, outcome, CASE WHEN outcome = 'kayit' THEN org END AS org, CASE WHEN outcome = 'kayit' THEN role END AS role FROM z""",
}
