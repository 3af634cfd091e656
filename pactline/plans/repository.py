"""Every repository method over collections that the star tables stand for.

A collection is a list of SQL expressions over one table, the same for Spark and the oracle;
what a method does with it is a DataFrame operation here and a statement of its own there.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import repository as r
from pactline.sources.tables import load

_TEXT = "CAST({} AS STRING)".format
NOW = "TIMESTAMP '2024-01-20 00:00:00'"

#: table, rows, and the columns of each collection
COLLECTIONS: dict[str, tuple[str, str, dict[str, str]]] = {
    "audit": ("events", "true", {"id": "event_id", "user_id": "CASE WHEN user_id % 10 = 3 THEN 'silinmis' ELSE CAST(user_id AS STRING) END", "event": "event_type", "at": "ts", "ip": "'10.0.0.' || " + _TEXT("user_id"), "agent": "event_type || '-ua'"}),
    "contract": ("orders", "true", {"id": "o_orderkey", "user_id": "o_custkey", "org_id": "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 25 END", "status": "o_orderstatus", "created": "o_orderdate", "total": "o_totalprice"}),
    "device": ("customer", "true", {"id": "c_custkey", "user_id": "c_custkey % 300", "fingerprint": "c_nationkey", "name": "c_mktsegment", "trusted": "c_acctbal > 5000", "seen": "DATE '2024-01-01' + CAST(c_custkey % 60 AS INT)", "ip": "'10.0.0.' || " + _TEXT("c_nationkey")}),
    "invite": ("events", "event_type = 'view'", {"id": "event_id", "org_id": "user_id % 25", "email": "'u' || CAST(user_id AS STRING) || '@example.org'", "hash": "md5(CAST(event_id AS STRING))", "used": "event_id % 4 = 0", "expires": "ts + INTERVAL 7 DAY"}),
    "llm_call": ("events", "true", {"id": "event_id", "org_id": "user_id % 25", "started": "ts", "ms": "value"}),
    "mfa": ("events", "event_type = 'click'", {"id": "event_id", "user_id": "user_id", "used": "event_id % 3 = 0", "attempts": "CAST(event_id % 6 AS INT)", "created": "ts", "expires": "ts + INTERVAL 10 DAY"}),
    "settings": ("nation", "n_nationkey % 3 = 0", {"id": "n_nationkey", "org_id": "n_nationkey", "risk": "CAST(n_nationkey AS DOUBLE) / 100", "max_token": "n_nationkey * 10"}),
    "organization": ("nation", "true", {"id": "n_nationkey", "name": "n_name", "owner_id": "n_regionkey", "status": "CASE WHEN n_nationkey % 4 = 0 THEN 'PASIF' ELSE 'AKTIF' END"}),
    "prompt": ("part", "true", {"id": "p_partkey", "org_id": "p_size % 25", "kind": "p_brand", "version": "CAST(p_partkey AS INT)", "active": "p_partkey % 7 = 0", "content": "p_name"}),
    "session": ("events", "event_type <> 'view'", {"id": "event_id", "user_id": "user_id", "device_id": "CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id % 40 END", "hash": "md5(CAST(event_id AS STRING))", "revoked": "event_id % 3 = 0", "reason": "CASE WHEN event_id % 3 = 0 THEN 'cikis' ELSE '' END", "created": "ts", "expires": "ts + INTERVAL 14 DAY"}),
    "user": ("customer", "true", {"id": "c_custkey", "email": "lower(c_name) || '@example.org'", "org_id": "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END", "account": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN 'BIREYSEL' ELSE 'KURUMSAL' END", "role": "CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'YONETICI' ELSE 'SAHIP' END", "verified": "c_acctbal > 0", "status": "CASE WHEN c_acctbal > 0 THEN 'AKTIF' WHEN c_custkey % 2 = 0 THEN 'DOGRULAMA_BEKLIYOR' ELSE 'PASIF' END", "password": "md5(c_name)", "created": "DATE '2023-01-01' + CAST(c_custkey % 365 AS INT)"}),
    "token": ("events", "event_type IN ('signup', 'error')", {"id": "event_id", "user_id": "user_id", "purpose": "event_type", "hash": "md5(CAST(event_id AS STRING))", "used": "event_id % 4 = 1", "expires": "ts + INTERVAL 1 DAY"}),
}


def collection(s: SparkSession, p: str, name: str) -> DataFrame:
    table, rows, columns = COLLECTIONS[name]
    df = load(s, p, table)
    stamps = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind.startswith("timestamp")}
    return df.withColumns(stamps).where(rows).selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))


def _stored(name: str) -> str:
    table, rows, columns = COLLECTIONS[name]
    return f"WITH c AS (SELECT {', '.join(f'{e} AS {k}' for k, e in columns.items())} FROM {table} WHERE {rows})"


def _assigned(name: str, where: str, values: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN {where} THEN {values[k]} ELSE {k} END AS {k}" if k in values else k for k in COLLECTIONS[name][2])


_UNTYPED = {"at", "created", "expires", "started", "seen"}  # not part of results: engines print times in their own ways


def _shown(df: DataFrame) -> DataFrame:
    return df.select(*(c for c in df.columns if c not in _UNTYPED))


def _columns(name: str) -> str:
    return ", ".join(c for c in COLLECTIONS[name][2] if c not in _UNTYPED)


Method = tuple[Callable[[DataFrame], DataFrame], str]


def get(name: str, /, where: str) -> Method:
    return partial(r.point, where=where), f"SELECT {_columns(name)} FROM c WHERE {where} ORDER BY id LIMIT 1"


def list_(name: str, /, where: str, *order: str) -> Method:
    """All matching documents, each with its place in the order."""

    def run(df: DataFrame) -> DataFrame:
        return r.scan(df, where, list(order))

    return run, f"SELECT {_columns(name)} FROM c WHERE {where}"


def count(name: str, /, where: str) -> Method:
    return partial(r.count, where=where), f"SELECT count(*) AS n FROM c WHERE {where}"


def insert(name: str, /, *keys: str) -> Method:
    """Documents of even ids are stored; those whose id is divisible by three come new, some with a key that is taken."""

    def run(df: DataFrame) -> DataFrame:
        return r.inserted(df.where("id % 2 = 0"), df.where("id % 3 = 0"), list(keys))

    same = " AND ".join(f"o.{k} = n.{k}" for k in keys)
    least = f"NOT EXISTS (SELECT 1 FROM c o WHERE o.id % 3 = 0 AND {same} AND o.id < n.id)"
    return run, f"SELECT {_columns(name)} FROM c WHERE id % 2 = 0 UNION ALL SELECT {_columns(name)} FROM c n WHERE id % 3 = 0 AND {least} AND NOT EXISTS (SELECT 1 FROM c o WHERE o.id % 2 = 0 AND {same})"


def replace(name: str, /, **values: str) -> Method:
    """Documents whose id is divisible by three are replaced as wholes."""

    def run(df: DataFrame) -> DataFrame:
        return r.replaced(df, r.updated(df.where("id % 3 = 0"), "true", values), ["id"])

    return run, f"SELECT {_columns(name)} FROM (SELECT {_assigned(name, 'id % 3 = 0', values)} FROM c) x"


def upsert(name: str, key: str, /, **values: str) -> Method:
    """Documents of even ids are stored; all documents come again with new values."""

    def run(df: DataFrame) -> DataFrame:
        return r.upserted(df.where("id % 2 = 0"), r.updated(df.where("id % 6 < 4"), "true", values), [key])

    changed = ", ".join(f"{values.get(k, k)} AS {k}" for k in COLLECTIONS[name][2])
    return run, f"SELECT {_columns(name)} FROM (SELECT {changed} FROM c WHERE id % 6 < 4 UNION ALL SELECT * FROM c WHERE id % 2 = 0 AND id % 6 >= 4) x"


def delete(name: str, /, where: str) -> Method:
    return partial(r.deleted, where=where), f"SELECT {_columns(name)} FROM c WHERE ({where}) IS NOT TRUE"


def update(name: str, /, where: str, **values: str) -> Method:
    return partial(r.updated, where=where, values=values), f"SELECT {_columns(name)} FROM (SELECT {_assigned(name, where, values)} FROM c) x"


def consume(name: str, /, where: str, **values: str) -> Method:
    return partial(r.consumed, where=where, values=values), f"SELECT {_columns(name)}, returned FROM (SELECT {_assigned(name, where, values)}, coalesce({where}, false) AS returned FROM c) x"


_OPEN = f"NOT used AND expires > {NOW}"
_LIVE = f"NOT revoked AND expires > {NOW}"
_LEFT = {"org_id": "NULL", "account": "'BIREYSEL'", "role": "'SAHIP'"}

METHODS: dict[str, tuple[str, Callable[..., Method], tuple, dict]] = {
    # audit trail
    "audit_insert": ("audit", insert, ("id",), {}),
    "audit_list_by_user": ("audit", list_, ("user_id = '42'", "-at"), {}),
    "audit_count_by_user": ("audit", count, ("user_id = '42'",), {}),
    "audit_count_deleted": ("audit", count, ("user_id = 'silinmis'",), {}),
    "audit_list_deleted": ("audit", list_, ("user_id = 'silinmis'", "-at"), {}),
    # contracts
    "contract_create": ("contract", insert, ("id",), {}),
    "contract_get": ("contract", get, ("id = 77",), {}),
    "contract_update": ("contract", replace, (), {"status": "'X'", "total": "total + 1"}),
    "contract_delete": ("contract", delete, ("id = 77",), {}),
    "contract_delete_by_user": ("contract", delete, ("user_id = 42",), {}),
    "contract_count_by_user": ("contract", count, ("user_id = 42",), {}),
    "contract_delete_by_org": ("contract", delete, ("org_id = 7",), {}),
    # devices
    "device_get": ("device", get, ("id = 12",), {}),
    "device_get_by_fingerprint": ("device", get, ("user_id = 12 AND fingerprint = 18",), {}),
    "device_create": ("device", insert, ("user_id", "fingerprint"), {}),
    "device_touch": ("device", update, ("id = 12",), {"seen": "DATE '2024-03-01'", "ip": "'192.0.2.1'"}),
    "device_list_by_user": ("device", list_, ("user_id = 12", "-seen"), {}),
    "device_rename": ("device", update, ("id = 12",), {"name": "'telefon'"}),
    "device_set_trusted": ("device", update, ("id = 12",), {"trusted": "true"}),
    "device_delete": ("device", delete, ("id = 12",), {}),
    "device_delete_by_user": ("device", delete, ("user_id = 12",), {}),
    "device_count_by_user": ("device", count, ("user_id = 12",), {}),
    # invitations
    "invite_create": ("invite", insert, ("hash",), {}),
    "invite_get_by_hash": ("invite", get, (f"hash = md5('9999') AND {_OPEN}",), {}),
    "invite_consume": ("invite", consume, (f"org_id = 5 AND {_OPEN}",), {"used": "true"}),
    "invite_invalidate_unused": ("invite", update, ("org_id = 5 AND email = 'u30@example.org' AND NOT used",), {"used": "true"}),
    "invite_delete_by_org": ("invite", delete, ("org_id = 5",), {}),
    "invite_count_by_org": ("invite", count, ("org_id = 5",), {}),
    # model calls
    "llm_call_insert": ("llm_call", insert, ("id",), {}),
    "llm_call_count_by_org": ("llm_call", count, ("org_id = 5",), {}),
    "llm_call_delete_by_org": ("llm_call", delete, ("org_id = 5",), {}),
    # codes of the second factor
    "mfa_create": ("mfa", insert, ("id",), {}),
    "mfa_invalidate_unused": ("mfa", update, ("user_id = 42 AND NOT used",), {"used": "true"}),
    "mfa_get": ("mfa", get, ("id % 1000 = 1",), {}),
    "mfa_update": ("mfa", replace, (), {"attempts": "0"}),
    "mfa_register_failure": ("mfa", update, ("user_id = 42",), {"attempts": "attempts + 1", "used": "used OR attempts + 1 >= 5"}),
    "mfa_mark_used": ("mfa", update, ("id % 1000 = 1",), {"used": "true"}),
    "mfa_delete_by_user": ("mfa", delete, ("user_id = 42",), {}),
    "mfa_count_by_user": ("mfa", count, ("user_id = 42",), {}),
    # settings and organisations
    "settings_get_by_org": ("settings", get, ("org_id = 9",), {}),
    "settings_upsert": ("settings", upsert, ("org_id",), {"risk": "CAST(0.5 AS DOUBLE)", "max_token": "900"}),
    "settings_delete_by_org": ("settings", delete, ("org_id = 9",), {}),
    "settings_count_by_org": ("settings", count, ("org_id = 9",), {}),
    "organization_create": ("organization", insert, ("id",), {}),
    "organization_get": ("organization", get, ("id = 9",), {}),
    "organization_set_owner": ("organization", update, ("id = 9",), {"owner_id": "4"}),
    "organization_delete": ("organization", delete, ("id = 9",), {}),
    # prompt versions
    "prompt_insert": ("prompt", insert, ("org_id", "kind", "version"), {}),
    "prompt_get": ("prompt", get, ("id = 9",), {}),
    "prompt_list_by_kind": ("prompt", list_, ("org_id = 9 AND kind = 'Brand#11'", "-version"), {}),
    "prompt_get_active": ("prompt", get, ("org_id = 9 AND active",), {}),
    "prompt_deactivate_kind": ("prompt", update, ("org_id = 9 AND active",), {"active": "false"}),
    "prompt_activate": ("prompt", update, ("id = 9",), {"active": "true"}),
    "prompt_delete_by_org": ("prompt", delete, ("org_id = 9",), {}),
    "prompt_count_by_org": ("prompt", count, ("org_id = 9",), {}),
    # sessions
    "session_create": ("session", insert, ("hash",), {}),
    "session_get": ("session", get, ("id % 1000 = 1",), {}),
    "session_get_by_refresh_hash": ("session", get, (f"hash = md5('9997') AND {_LIVE}",), {}),
    "session_list_active_by_user": ("session", list_, (f"user_id = 42 AND {_LIVE}", "-created"), {}),
    "session_revoke": ("session", update, ("id % 1000 = 1",), {"revoked": "true", "reason": "'cikis'"}),
    "session_revoke_all_for_user": ("session", update, ("user_id = 42 AND NOT revoked",), {"revoked": "true", "reason": "'sifre'"}),
    "session_revoke_by_device": ("session", update, ("device_id = 2 AND NOT revoked",), {"revoked": "true", "reason": "'cihaz'"}),
    "session_revoke_missing_device": ("session", update, ("NOT revoked AND device_id IS NULL",), {"revoked": "true", "reason": "'cihazsiz'"}),
    "session_revoke_all_except": ("session", update, ("user_id = 42 AND NOT revoked AND id % 1000 <> 1",), {"revoked": "true", "reason": "'diger'"}),
    "session_list_by_user": ("session", list_, ("user_id = 42", "-created"), {}),
    "session_delete_by_user": ("session", delete, ("user_id = 42",), {}),
    "session_count_by_user": ("session", count, ("user_id = 42",), {}),
    # users
    "user_create": ("user", insert, ("email",), {}),
    "user_get_by_email": ("user", get, ("email = 'customer#000000042@example.org'",), {}),
    "user_get": ("user", get, ("id = 42",), {}),
    "user_mark_email_verified": ("user", update, ("id % 50 = 2",), {"verified": "true", "status": "CASE WHEN status = 'DOGRULAMA_BEKLIYOR' THEN 'AKTIF' ELSE status END"}),
    "user_update_password": ("user", update, ("id = 42",), {"password": "md5('yeni')"}),
    "user_delete": ("user", delete, ("id = 42",), {}),
    "user_backfill_account_fields": ("user", update, ("account IS NULL",), {"account": "'BIREYSEL'", "role": "'SAHIP'"}),
    "user_set_organization": ("user", update, ("id = 42",), {"org_id": "3", "account": "'KURUMSAL'", "role": "'IZLEYICI'"}),
    "user_set_role": ("user", update, ("id = 42",), {"role": "'IZLEYICI'"}),
    "user_list_by_org": ("user", list_, ("org_id = 7", "created"), {}),
    "user_count_by_org": ("user", count, ("org_id = 7",), {}),
    "user_list_corporate": ("user", list_, ("org_id IS NOT NULL",), {}),
    "user_detach_org": ("user", update, ("id = 43",), _LEFT),
    "user_detach_org_by_org": ("user", update, ("org_id = 7",), _LEFT),
    # verification tokens
    "token_create": ("token", insert, ("hash",), {}),
    "token_get_by_hash": ("token", get, ("hash = md5('10')",), {}),
    "token_update": ("token", replace, (), {"purpose": "'parola'"}),
    "token_invalidate_unused": ("token", update, ("user_id = 42 AND purpose = 'signup' AND NOT used",), {"used": "true"}),
    "token_consume": ("token", consume, (f"user_id % 10 = 2 AND purpose = 'signup' AND {_OPEN}",), {"used": "true"}),
    "token_delete_by_user": ("token", delete, ("user_id = 42",), {}),
    "token_count_by_user": ("token", count, ("user_id = 42",), {}),
}

#: unique keys of the collections, those of a partial index with its condition
UNIQUE = {"user": (["email"], "true"), "device": (["user_id", "fingerprint"], "true"), "settings": (["org_id"], "true"), "prompt": (["org_id", "kind"], "active"), "session": (["hash"], "true")}


def _query(name: str, make: Callable[..., Method], args: tuple, values: dict) -> tuple[Callable, str]:
    run, sql = make(name, *args, **values)
    return lambda s, p: _shown(run(collection(s, p, name))), f"{_stored(name)} {sql}"


def _unique(name: str, keys: list[str], where: str) -> tuple[Callable, str]:
    own = ", ".join(keys)
    run = lambda s, p: r.duplicates(collection(s, p, name), keys, where).agg(F.count("*").alias("n_keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
    return run, f"{_stored(name)} SELECT count(*) AS n_keys, coalesce(max(n), 0) AS most FROM (SELECT count(*) AS n FROM c WHERE {where} GROUP BY {own} HAVING count(*) > 1) x"


_ALL = {f"repo_{k}": _query(*v) for k, v in METHODS.items()} | {f"repo_{k}_unique": _unique(k, *v) for k, v in UNIQUE.items()}
QUERIES = {k: run for k, (run, _) in _ALL.items()}
SQL = {k: sql for k, (_, sql) in _ALL.items()}
