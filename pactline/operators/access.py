"""What users may see and end: their sessions, devices and contracts, for many requests at once.

Requests are rows, joined with the stored documents on their keys; nothing is looked up one by
one. A request with a null in its key finds nothing, and null keys of documents match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OTHERS, DEVICE = "diger", "cihaz"  # why a session was ended


def email_key(email: Column) -> Column:
    """What a person's attempts are counted under: the address's SHA-256."""
    return F.sha2(email, 256)


def own_sessions(sessions: DataFrame, requests: DataFrame, now: str) -> DataFrame:
    """(session_id, id, current): for each request (user_id, session_id) the user's live sessions, and which one asks."""
    live = sessions.where(f"NOT revoked AND expires > {now}").select("user_id", "id")
    return requests.select("user_id", "session_id").join(live, "user_id").select("session_id", "id", (F.col("id") == F.col("session_id")).alias("current"))


def _ended(sessions: DataFrame, hit: Column, reason: str) -> list[Column]:
    changed = {"revoked": F.when(hit, F.lit(True)).otherwise(F.col("revoked")), "reason": F.when(hit, F.lit(reason)).otherwise(F.col("reason"))}
    return [changed[c].alias(c) if c in changed else F.col(c) for c in sessions.columns]


def others_ended(sessions: DataFrame, requests: DataFrame) -> DataFrame:
    """The sessions once each user's first request (at, user_id, session_id) has ended all the user's others, and in ``ended_by`` which session did it.

    Later requests of a user come from sessions that the first has ended, or find nothing to end.
    Counts of ``ended_by`` are what the callers are told.
    """
    first = requests.where("user_id IS NOT NULL AND session_id IS NOT NULL").groupBy("user_id").agg(F.min(F.struct("at", "session_id")).alias("__r")).select("user_id", F.col("__r.session_id").alias("__by"))
    hit = F.coalesce(~F.col("revoked") & (F.col("id") != F.col("__by")), F.lit(False))
    return sessions.join(first, "user_id", "left").select(*_ended(sessions, hit, OTHERS), F.when(hit, F.col("__by")).alias("ended_by"))


def devices_removed(devices: DataFrame, sessions: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(devices, sessions) after requests (user_id, device_id): a user's own devices go, and their sessions end; others stay."""
    asked = requests.select("user_id", F.col("device_id").alias("id")).distinct()
    gone = devices.join(asked, ["user_id", "id"], "left_semi").select(F.col("id").alias("device_id"), F.lit(True).alias("__gone")).distinct()
    left = devices.join(asked, ["user_id", "id"], "left_anti")
    hit = F.coalesce(~F.col("revoked") & F.col("__gone"), F.lit(False))
    return left, sessions.join(gone, "device_id", "left").select(*_ended(sessions, hit, DEVICE))


def visible(contracts: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (user_id, contract_id) with the contract's row as ``contract``: null where there is none or it is not the user's to see.

    Members of an organisation see its contracts, others those of their own without one. Of
    several documents of an id the one of the least user counts.
    """
    one = lambda df, *by: df.withColumn("__k", F.row_number().over(Window.partitionBy("id").orderBy(*by))).where("__k = 1").drop("__k")
    actors = one(users.select("id", "org_id"), "org_id").select(F.col("id").alias("user_id"), F.col("org_id").alias("__org"), F.lit(True).alias("__known"))
    found = one(contracts, "user_id", "org_id").select(F.col("id").alias("contract_id"), F.struct(*contracts.columns).alias("contract"))
    owner, org = F.col("contract.user_id"), F.col("contract.org_id")
    sees = F.when(F.col("__org").isNotNull(), org == F.col("__org")).otherwise(F.col("__known") & (owner == F.col("user_id")) & org.isNull())
    rows = requests.select("user_id", "contract_id").join(actors, "user_id", "left").join(found, "contract_id", "left")
    return rows.select("user_id", "contract_id", F.when(sees, F.col("contract")).alias("contract"))
