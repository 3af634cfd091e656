"""Sessions, devices and contracts as their users see and end them; every request is a row of the collections themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import access as a
from pactline.plans.repository import COLLECTIONS, NOW, collection


def _own(s: SparkSession, p: str) -> DataFrame:
    """The first of each user's sessions whose id is divisible by seven asks for the list."""
    x = collection(s, p, "session")
    asks = x.where("id % 7 = 0").groupBy("user_id").agg(F.min("id").alias("session_id"))
    return a.own_sessions(x, asks, NOW)


def _others(s: SparkSession, p: str) -> DataFrame:
    x = collection(s, p, "session")
    return a.others_ended(x, x.where("id % 5 = 0").selectExpr("-id AS at", "user_id", "id AS session_id")).select("id", "user_id", "revoked", "reason", "ended_by")


def _removed(s: SparkSession, p: str) -> DataFrame:
    """Every other device is to be removed, every fourth request is another user's."""
    d, x = collection(s, p, "device"), collection(s, p, "session")
    asks = d.where("id % 2 = 0").selectExpr("user_id + CASE WHEN id % 8 = 0 THEN 1 ELSE 0 END AS user_id", "id AS device_id")
    devices, sessions = a.devices_removed(d, x, asks)
    return devices.selectExpr("'cihaz' AS kind", "id", "false AS revoked", "'' AS reason").unionByName(sessions.selectExpr("'oturum' AS kind", "id", "revoked", "reason"))


def _visible(s: SparkSession, p: str) -> DataFrame:
    """Each contract is asked for by its customer or, for some, by the next or a missing one."""
    c = collection(s, p, "contract")
    asks = c.selectExpr("user_id + CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 100000000 ELSE 0 END AS user_id", "id AS contract_id")
    return a.visible(c, collection(s, p, "user"), asks).select("user_id", "contract_id", F.col("contract.status").alias("status"))


def _keys(s: SparkSession, p: str) -> DataFrame:
    return collection(s, p, "user").select("id", a.email_key(F.col("email")).alias("key"))


def _with(*names: str) -> str:
    table = lambda n: f"{n}_ AS (SELECT {', '.join(f'{e} AS {k}' for k, e in COLLECTIONS[n][2].items())} FROM {COLLECTIONS[n][0]} WHERE {COLLECTIONS[n][1]})"
    return f"WITH {', '.join(map(table, names))}"


QUERIES = {"own_sessions": _own, "others_ended": _others, "devices_removed": _removed, "visible_contracts": _visible, "email_keys": _keys}
SQL = {
    "own_sessions": f"{_with('session')}, r AS (SELECT user_id, min(id) AS session_id FROM session_ WHERE id % 7 = 0 GROUP BY user_id) SELECT session_id, id, id = session_id AS current FROM session_ JOIN r USING (user_id) WHERE NOT revoked AND expires > {NOW}",
    "others_ended": f"""{_with('session')}, r AS (SELECT user_id, max(id) AS m FROM session_ WHERE id % 5 = 0 GROUP BY user_id), x AS (SELECT session_.*, m, NOT revoked AND m IS NOT NULL AND id <> m AS hit FROM session_ LEFT JOIN r USING (user_id))
      SELECT id, user_id, revoked OR hit AS revoked, CASE WHEN hit THEN 'diger' ELSE reason END AS reason, CASE WHEN hit THEN m END AS ended_by FROM x""",
    "devices_removed": f"""{_with('device', 'session')} SELECT 'cihaz' AS kind, id, false AS revoked, '' AS reason FROM device_ WHERE id % 2 = 1 OR id % 8 = 0
      UNION ALL SELECT 'oturum', id, revoked OR gone, CASE WHEN gone THEN 'cihaz' ELSE reason END FROM (SELECT *, NOT revoked AND coalesce(device_id IN (SELECT id FROM device_ WHERE id % 2 = 0 AND id % 8 <> 0), false) AS gone FROM session_) x""",
    "visible_contracts": f"""{_with('contract', 'user')}, q AS (SELECT c.*, c.user_id + CASE c.id % 4 WHEN 0 THEN 1 WHEN 1 THEN 100000000 ELSE 0 END AS asks FROM contract_ c)
      SELECT q.asks AS user_id, q.id AS contract_id, CASE WHEN u.id IS NOT NULL AND CASE WHEN u.org_id IS NULL THEN q.org_id IS NULL AND q.user_id = u.id ELSE q.org_id = u.org_id END THEN q.status END AS status FROM q LEFT JOIN user_ u ON u.id = q.asks""",
    "email_keys": f"{_with('user')} SELECT id, sha256(email) AS key FROM user_",
}
