"""Organisations: requests to change roles, invitations, and what accepting one does.

Requests come as tables and are settled in order. Whether a change of role is allowed depends on
who owns the organisation at that moment alone, so that one id is the state of an organisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactline.functions.text import normalize_email
from pactline.streaming.transitions import settled

#: fixed values: roles
OWNER, ADMIN, VIEWER = "SAHIP", "YONETICI", "IZLEYICI"


def _ownership(owner: int | None, e: dict) -> tuple[bool, int | None]:
    """Only the owner changes roles, only of members, and gives up its own by naming another owner."""
    owner = e["owner"] if owner is None else owner
    ok = owner is not None and e["actor"] == owner and bool(e["member"]) and e["role"] in (OWNER, ADMIN, VIEWER) and (e["role"] == OWNER or e["target"] != owner)
    return ok, e["target"] if ok and e["role"] == OWNER else owner


def role_changes(members: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (org, id, actor, target, role), in the order of id, with ``accepted`` and the organisation's ``owner`` afterwards.

    ``members`` (org, user, role) are those before the first request; a request for a user of another organisation is refused.
    """
    owners = members.where(F.col("role") == OWNER).groupBy("org").agg(F.min("user").alias("owner"))
    known = members.select("org", F.col("user").alias("target"), F.lit(True).alias("member")).distinct()
    rows = requests.select("org", "id", "actor", "target", "role").join(owners, "org", "left").join(known, ["org", "target"], "left")
    done = settled(rows.withColumn("member", F.coalesce("member", F.lit(False))), "org", ["id"], _ownership)
    return done.select("org", "id", "actor", "target", "role", "accepted", F.col("state").cast("bigint").alias("owner"))


def roles_after(members: DataFrame, changes: DataFrame) -> DataFrame:
    """(org, user, role) once the accepted ``changes`` of ``role_changes`` are made: who hands over an organisation becomes an administrator."""
    done = changes.where("accepted")
    handed = done.where((F.col("role") == OWNER) & (F.col("actor") != F.col("target"))).select("org", "id", F.col("actor").alias("user"), F.lit(ADMIN).alias("new"))
    given = done.select("org", "id", F.col("target").alias("user"), F.col("role").alias("new")).unionByName(handed)
    last = given.groupBy("org", "user").agg(F.max_by("new", "id").alias("new"))
    return members.join(last, ["org", "user"], "left").select("org", "user", F.coalesce("new", "role").alias("role"))


def invited(members: DataFrame, users: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (org, id, actor, email, role) with ``outcome``, the normal ``email``, and ``open``: whether its invitation can be accepted.

    Owners alone invite, and nobody as an owner (``yasak``); a broken address, and one of a member
    (``users``: org, email), does nothing (``yok``); else there is a new invitation (``davet``), which closes the ones before it.
    """
    owners = members.where(F.col("role") == OWNER).select("org", F.col("user").alias("actor"), F.lit(True).alias("owns")).distinct()
    there = users.where("email is not null").select("org", "email", F.lit(True).alias("there")).distinct()
    rows = requests.select("org", "id", "actor", normalize_email(F.col("email")).alias("email"), "role").join(owners, ["org", "actor"], "left").join(there, ["org", "email"], "left")
    outcome = F.when(F.col("owns").isNull() | ~F.coalesce(F.col("role").isin(ADMIN, VIEWER), F.lit(False)), "yasak").when(F.col("email").isNull() | F.col("there").isNotNull(), "yok").otherwise("davet")
    rows = rows.select("org", "id", "actor", "email", "role", outcome.alias("outcome"))
    newest = rows.where("outcome = 'davet'").groupBy("org", "email").agg(F.max("id").alias("newest"))
    return rows.join(newest, ["org", "email"], "left").select("org", "id", "actor", "email", "role", "outcome", ((F.col("outcome") == "davet") & (F.col("id") == F.col("newest"))).alias("open"))


def accepted(invitations: DataFrame, users: DataFrame, acceptances: DataFrame) -> DataFrame:
    """``acceptances`` (id, invitation) with ``outcome``: ``kayit`` (a user with the invitation's org and role is new), ``uye`` (was a member; the invitation is used up), ``yok``.

    ``invitations`` (id, org, email, role, open); an invitation works once, for the first that
    accepts it, and an address becomes a user once: of several organisations the first one's.
    """
    given = invitations.where("open").select(F.col("id").alias("invitation"), "org", "email", "role")
    rows = acceptances.select("id", "invitation").join(given, "invitation", "left").withColumn("again", F.row_number().over(Window.partitionBy("invitation").orderBy("id")) > 1)
    own = users.where("email is not null").groupBy("email").agg(F.min("org").alias("own"), F.lit(True).alias("exists")).select("email", "own", "exists")
    rows = rows.join(own, "email", "left")
    usable = F.col("org").isNotNull() & ~F.col("again")
    new = usable & F.col("exists").isNull()
    first = F.min(F.when(new, F.col("id"))).over(Window.partitionBy("email"))
    outcome = F.when(new & (F.col("id") == first), "kayit").when(usable & (F.col("own") == F.col("org")), "uye").otherwise("yok")
    out = rows.withColumn("outcome", outcome)
    made = F.col("outcome") == "kayit"
    return out.select("id", "invitation", "outcome", F.when(made, F.col("org")).alias("org"), F.when(made, F.col("role")).alias("role"))
