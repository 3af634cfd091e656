"""Pages, field edits, access rights and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.functions import fields as f
from pactline.functions import labels as n
from pactline.functions.grounding import room_type
from pactline.operators import pages as g
from pactline.plans.repository import COLLECTIONS, _stored, collection
from pactline.sources.tables import load

#: SQL, the same for both engines: a page of each turn of a conversation, with a header, a footer and a page number
_PAGE = "'SÖZLEŞME ' || CAST(conv_id % 3 AS STRING) || '  ' || chr(13) || chr(10) || CASE WHEN turn % 2 = 0 THEN 'Gizli' || chr(10) ELSE '' END || coalesce(text, '') || chr(10) || chr(10) || chr(10) || chr(10) || 'Son satır' || chr(10) || 'Sayfa ' || CAST(turn AS STRING)"


def _pages(s: SparkSession, p: str) -> DataFrame:
    return load(s, p, "conversations").selectExpr("conv_id AS doc_id", "turn AS page", f"{_PAGE} AS text")


_ENDS = r"regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t]+$', '', 'g')"
_CLEAN = f"""WITH p AS (SELECT conv_id AS doc_id, turn AS page, {_PAGE} AS text FROM conversations),
  l AS (SELECT doc_id, page, unnest(string_split({_ENDS}, chr(10))) AS line, unnest(range(len(string_split({_ENDS}, chr(10))))) AS pos FROM p),
  f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos) <= 3 AS top, row_number() OVER (PARTITION BY doc_id, page ORDER BY pos DESC) <= 3 AS bottom FROM l WHERE regexp_matches(line, '\\S')),
  n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY doc_id),
  k AS (SELECT doc_id, line, count(*) FILTER (top) >= least AS header, count(*) FILTER (bottom) >= least AS footer FROM f JOIN (SELECT doc_id, n, CASE WHEN n >= 4 THEN (n + 1) // 2 ELSE 2 END AS least FROM n) USING (doc_id) WHERE n > 1 GROUP BY doc_id, line, least),
  g AS (SELECT doc_id, page, pos FROM f JOIN k USING (doc_id, line) WHERE (top AND header) OR (bottom AND footer)),
  c AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY pos) AS text FROM l ANTI JOIN g USING (doc_id, page, pos) GROUP BY doc_id, page),
  t AS (SELECT doc_id, page, trim(regexp_replace(coalesce(c.text, ''), '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM p LEFT JOIN c USING (doc_id, page))"""

#: SQL, the same for both engines: what users typed, from orders and line items
_PERIOD = "CASE o_orderkey % 6 WHEN 0 THEN '2026-01-' || CAST(10 + o_custkey % 20 AS STRING) || ' – 2026-03-01' WHEN 1 THEN ' 2026-01-05—2026-02-' || CAST(10 + o_custkey % 18 AS STRING) WHEN 2 THEN '1 Ocak - ' WHEN 3 THEN '2026-01-05' WHEN 4 THEN '– 2026-05-01' ELSE 'a - b – c' END"
_START = "CASE o_orderkey % 6 WHEN 0 THEN '2026-01-' || CAST(10 + o_custkey % 20 AS STRING) WHEN 1 THEN '2026-01-05' WHEN 5 THEN 'a - b' END"
_END = "CASE o_orderkey % 6 WHEN 0 THEN '2026-03-01' WHEN 1 THEN '2026-02-' || CAST(10 + o_custkey % 18 AS STRING) WHEN 4 THEN '2026-05-01' WHEN 5 THEN 'c' END"
_N = "CAST(o_custkey AS STRING)"
_ROOM = f"CASE o_orderkey % 5 WHEN 0 THEN 'standart: ' || {_N} || ' (deniz)' WHEN 1 THEN ' suit : ' || {_N} WHEN 2 THEN 'aile ' || {_N} WHEN 3 THEN ': 5' ELSE 'tek: beş' END"
_PRICE = f"CASE o_orderkey % 6 WHEN 0 THEN 'suit · hb · ' || {_N} || ',50 (oda_gecelik)' WHEN 1 THEN 'tek · — · ' || {_N} || ' (KISI_GECELIK)' WHEN 2 THEN 'tek · yarım · 5 (oda_gecelik)' WHEN 3 THEN 'tek · 5 (oda_gecelik)' WHEN 4 THEN 'tek · AI · 5 (kat)' ELSE 'tek · AI · beş (oda_gecelik)' END"
_RELEASE = f"CASE o_orderkey % 4 WHEN 0 THEN {_N} || ' gün · isim_listesi' WHEN 1 THEN ' ' || {_N} || ' gün' WHEN 2 THEN 'on gün' ELSE {_N} END"
_STOP = "CASE o_orderkey % 3 WHEN 0 THEN '2026-05-01 – 2026-05-10 · suit' WHEN 1 THEN '2026-05-01 - 2026-05-10' ELSE 'kapalı' END"
_READ = {"period": (_PERIOD, f.period, ("start", "end")), "room": (_ROOM, f.room, ("room", "quantity", "note")), "price": (_PRICE, f.price, ("room", "board", "amount", "unit")), "release": (_RELEASE, f.release, ("days", "scope")), "stop_sale": (_STOP, f.stop_sale, ("start", "end", "scope"))}


def _edit(name: str):
    typed, read, columns = _READ[name]

    def run(s: SparkSession, p: str) -> DataFrame:
        rows = load(s, p, "orders").selectExpr("o_orderkey", f"{typed} AS typed").withColumn("x", read(F.col("typed")))
        return rows.select("o_orderkey", F.col("x").isNotNull().alias("valid"), *(F.col(f"x.{c}").alias(c) for c in columns))

    return run


def _lists(s: SparkSession, p: str) -> DataFrame:
    """Several rooms in one text: a line that cannot be read rejects them all."""
    rows = load(s, p, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list(F.expr(f"lpad(CAST(o_orderkey AS STRING), 9, '0') || ' x: ' || CASE WHEN o_orderkey % 9 = 0 THEN 'beş' ELSE CAST(o_orderkey AS STRING) END"))), "\n\n ").alias("typed"))
    return rows.select("o_custkey", F.size(f.all_lines(F.col("typed"), f.room)).cast("long").alias("n"), F.size(f.lines(F.col("typed"))).cast("long").alias("n_lines"))


#: fixed values: what each role may do
RIGHTS = {"SAHIP": ("oku", "yaz", "onayla", "uye_gor", "uye_yonet", "davet", "ayar", "sil"), "YONETICI": ("oku", "yaz", "onayla", "uye_gor"), "IZLEYICI": ("oku",)}
_GRANTS = [(role, op) for role, ops in RIGHTS.items() for op in ops]
_ACTOR = "coalesce(role, 'SAHIP')"


def _rights(s: SparkSession, p: str) -> DataFrame:
    """What each user may do; the table of rights has a dozen rows."""
    grants = s.createDataFrame(_GRANTS, "role string, operation string")
    return collection(s, p, "user").selectExpr("id", f"{_ACTOR} AS role").join(F.broadcast(grants), "role").select("id", "operation")


def _owned(s: SparkSession, p: str) -> DataFrame:
    """How many contracts each user may see: those of the organisation, or the user's own that belong to none."""
    u, c = collection(s, p, "user").selectExpr("id", "org_id"), collection(s, p, "contract")
    by_org, by_user = c.groupBy("org_id").agg(F.count("*").alias("n_org")), c.where("org_id IS NULL").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n_own"))
    return u.join(by_org, "org_id", "left").join(by_user, "id", "left").select("id", F.when(F.col("org_id").isNotNull(), F.coalesce("n_org", F.lit(0))).otherwise(F.coalesce("n_own", F.lit(0))).alias("n"))


def _gates(s: SparkSession, p: str) -> DataFrame:
    """For each member: whether settings are open to it, and whether it may leave (an owner only as the last)."""
    u = collection(s, p, "user").where("org_id IS NOT NULL").selectExpr("id", "org_id", f"{_ACTOR} AS role")
    n = u.groupBy("org_id").agg(F.count("*").alias("n"))
    return u.join(n, "org_id").selectExpr("id", "role = 'SAHIP' AS may_set", "role <> 'SAHIP' OR n = 1 AS may_leave", "n = 1 AS org_goes")


def _org_cascade(s: SparkSession, p: str) -> DataFrame:
    """What is left of every collection when an organisation is deleted; its users stay, detached."""
    gone, out = F.col("org_id") == 9, None
    for name in ("contract", "invite", "llm_call", "settings", "prompt", "user"):
        left = collection(s, p, name).select((F.coalesce(gone, F.lit(False)) & F.lit(name != "user")).alias("gone")).groupBy("gone").agg(F.count("*").alias("n"))
        part = left.where("not gone").select(F.lit(name).alias("collection"), "n")
        out = part if out is None else out.unionByName(part)
    return out


_CASCADED = " UNION ALL ".join(f"SELECT '{n}' AS collection, count(*) AS n FROM ({_stored(n)} SELECT * FROM c) x WHERE {'true' if n == 'user' else '(org_id = 9) IS NOT TRUE'}" for n in ("contract", "invite", "llm_call", "settings", "prompt", "user"))

#: SQL, the same for both engines: what an export shows of each collection; no hashes, no passwords
EXPORTS = {
    "device": "user_id = 12", "session": "user_id = 42", "contract": "user_id = 42", "audit": "user_id = '42'",
}
_SHOWN = {"device": "id, name, trusted, ip", "session": "id, revoked, device_id", "contract": "id, status", "audit": "event"}

#: SQL, the same for both engines: raw values from rows, which small rules of the library turn into names and labels
_RAW = {
    "file_names": ("pages", "page_id", {"path": "CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN url || '//' WHEN page_id % 7 = 2 THEN url || '.tar.gz' ELSE url END"}),
    "dump_ids": ("events", "event_id", {"raw": "CASE event_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN '../ç?' ELSE event_type || '/' || CAST(user_id AS STRING) || '-É ' END"}),
    "log_snippets": ("conversations", "conv_id, turn", {"raw": "' ' || chr(9) || coalesce(text, '') || chr(10)"}),
    "file_id_validity": ("events", "event_id", {"raw": "CASE event_id % 4 WHEN 0 THEN md5(event_type) WHEN 1 THEN upper(md5(event_type)) WHEN 2 THEN md5(event_type) || 'a' ELSE event_type END"}),
    "room_types": ("part", "p_partkey", {"raw": "CASE WHEN contains(p_name, 'red') THEN ' Junior_Suite' WHEN contains(p_name, 'blue') THEN 'FAMILY  room' ELSE p_name END"}),
    "settings_changes": ("part", "p_partkey", {"risk": "CAST(p_retailprice AS DOUBLE) / 1500", "tokens": "p_size * 200 - 100", "old_tokens": "p_partkey % 50 * 200 - 100"}),
    "audit_seconds": ("lineitem", "l_orderkey, l_linenumber", {"seconds": "CAST(l_discount AS DOUBLE) * 40"}),
    "confidence_labels": ("documents", "doc_id", {"page": "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 40 + 1 END", "score": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(n_chars % 1000 AS DOUBLE) / 1000 END"}),
    "status_labels": ("orders", "o_orderkey", {"status": "CASE o_orderkey % 6 WHEN 0 THEN 'YUKLENDI' WHEN 1 THEN 'ISLENIYOR' WHEN 2 THEN 'INCELENMEYI_BEKLIYOR' WHEN 3 THEN 'ONAYLANDI' WHEN 4 THEN 'HATA' ELSE o_orderstatus END", "start": "CASE WHEN o_custkey % 2 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) END", "till": "CASE WHEN o_custkey % 3 = 0 THEN CAST(o_custkey AS STRING) END"}),
}
_col = F.col


def _rules() -> dict:
    return {
        "file_names": {"file": n.file_name(_col("path")), "export": n.export_name(n.file_name(_col("path")))},
        "dump_ids": {"dump_id": n.dump_id(_col("raw"))},
        "log_snippets": {"snippet": n.snippet(_col("raw"))},
        "file_id_validity": {"valid": n.is_file_id(_col("raw"))},
        "room_types": {"room": room_type(_col("raw"))},
        "settings_changes": {"accepted": n.settings_accepted(_col("risk"), _col("tokens")), "changed": n.settings_changed({"risk": F.lit(0.75), "max_token": _col("old_tokens")}, {"risk": _col("risk"), "max_token": _col("tokens")})},
        "audit_seconds": {"seconds": n.whole_seconds(_col("seconds"))},
        "confidence_labels": {"label": n.confidence_label(_col("page"), _col("score"))},
        "status_labels": {"label": n.status_label(_col("status")), "tone": n.status_tone(_col("status")), "pending": n.is_pending(_col("status")), "period": n.period_text(_col("start"), _col("till"))},
    }


_SHOWN_BY = {
    "file_names": ("file", "export"), "dump_ids": ("dump_id",), "log_snippets": ("snippet",), "file_id_validity": ("valid",), "room_types": ("room",), "settings_changes": ("accepted", "changed"),
    "audit_seconds": ("seconds",), "confidence_labels": ("label",), "status_labels": ("label", "tone", "pending", "period"),
}
_RULES_SQL = {
    "file_names": "coalesce(nullif(string_split(rtrim(path, '/'), '/')[-1], ''), 'sozlesme.pdf') AS file, CASE WHEN strpos(file, '.') > 0 AND file NOT LIKE '%.' THEN substr(file, 1, length(file) - strpos(reverse(file), '.')) ELSE file END || '-cikarim.json' AS export",
    "dump_ids": "CASE WHEN event_id % 5 < 2 THEN 'bilinmeyen' ELSE event_type || CAST(user_id AS VARCHAR) || '-' END AS dump_id",
    "log_snippets": "array_to_string(list_filter(string_split_regex(raw, '\\s+'), lambda w: w <> ''), ' ') AS line, CASE WHEN length(line) > 512 THEN substr(line, 1, 512) || '…' ELSE line END AS snippet",
    "file_id_validity": "event_id % 4 = 0 AS valid",
    "room_types": "CASE WHEN contains(p_name, 'red') THEN 'suit' WHEN contains(p_name, 'blue') THEN 'aile' ELSE '' END AS room",
    "settings_changes": "p_retailprice BETWEEN 0 AND 1500 AND tokens BETWEEN 1 AND 8192 AS accepted, array_to_string(list_filter([CASE WHEN risk <> 0.75 THEN 'risk' END, CASE WHEN tokens <> old_tokens THEN 'max_token' END], lambda c: c IS NOT NULL), ',') AS changed",
    "audit_seconds": "CAST(CASE WHEN seconds > 0 THEN greatest(1, floor(seconds)) ELSE floor(seconds) END AS BIGINT) AS seconds",
    "confidence_labels": "CASE WHEN page IS NULL AND score IS NULL THEN NULL WHEN page IS NULL THEN '%' || CAST(floor(score * 100 + 0.5) AS BIGINT) WHEN score IS NULL THEN 's.' || page ELSE 's.' || page || ' · %' || CAST(floor(score * 100 + 0.5) AS BIGINT) END AS label",
    "status_labels": "coalesce(['Sırada', 'İşleniyor', 'İncelenmeyi bekliyor', 'Onaylandı', 'Hata'][list_position(['YUKLENDI', 'ISLENIYOR', 'INCELENMEYI_BEKLIYOR', 'ONAYLANDI', 'HATA'], status)], status) AS label, CASE o_orderkey % 6 WHEN 1 THEN 'blue' WHEN 2 THEN 'yellow' WHEN 3 THEN 'green' WHEN 4 THEN 'red' ELSE 'muted' END AS tone, o_orderkey % 6 < 2 AS pending, CASE WHEN start IS NULL AND till IS NULL THEN '—' ELSE coalesce(start, '—') || ' – ' || coalesce(till, '—') END AS period",
}


def _raw(name: str) -> tuple[str, list[str], list[str]]:
    table, keys, values = _RAW[name]
    return table, keys.split(", "), [f"{e} AS {c}" for c, e in values.items()]


def _rule(name: str):
    table, keys, values = _raw(name)

    def run(s: SparkSession, p: str) -> DataFrame:
        return load(s, p, table).selectExpr(*keys, *values).select(*keys, *(c.alias(k) for k, c in _rules()[name].items()))

    return run


QUERIES = {
    "clean_pages": lambda s, p: g.cleaned(_pages(s, p)).select("doc_id", "page", F.md5("text").alias("md5")),
    "join_pages": lambda s, p: g.joined(g.cleaned(_pages(s, p))).select("doc_id", F.md5("text").alias("md5")),
    "extraction_status": lambda s, p: g.extraction_status(load(s, p, "conversations").selectExpr("conv_id AS doc_id", "CASE WHEN conv_id % 4 = 0 THEN ' ' || chr(9) || chr(10) ELSE text END AS text")),
    **{f"edit_{name}": _edit(name) for name in _READ},
    "edit_room_lists": _lists,
    "rights_matrix": _rights, "contracts_owned": _owned, "member_gates": _gates, "org_cascade": _org_cascade,
    **{f"export_{name}": (lambda s, p, name=name, where=where: collection(s, p, name).where(where).selectExpr(*_SHOWN[name].split(", "))) for name, where in EXPORTS.items()},
    **{name: _rule(name) for name in _RAW},
}
SQL = {
    "clean_pages": f"{_CLEAN} SELECT doc_id, page, md5(text) AS md5 FROM t",
    "join_pages": f"{_CLEAN} SELECT doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY page)) AS md5 FROM t GROUP BY doc_id",
    "extraction_status": "SELECT conv_id AS doc_id, CASE WHEN max(CASE WHEN conv_id % 4 > 0 AND regexp_matches(text, '\\S') THEN 1 ELSE 0 END) = 1 THEN 'metin' ELSE 'metin_katmani_yok' END AS status FROM conversations GROUP BY conv_id",
    "edit_period": f"SELECT o_orderkey, o_orderkey % 6 <> 3 AS valid, CASE WHEN o_orderkey % 6 = 2 THEN NULL ELSE {_START} END AS start, {_END} AS \"end\" FROM orders WHERE o_orderkey % 6 <> 2 UNION ALL SELECT o_orderkey, false, NULL, NULL FROM orders WHERE o_orderkey % 6 = 2",
    "edit_room": "SELECT o_orderkey, o_orderkey % 5 < 2 AS valid, CASE o_orderkey % 5 WHEN 0 THEN 'standart' WHEN 1 THEN 'suit' END AS room, CASE WHEN o_orderkey % 5 < 2 THEN CAST(o_custkey AS INTEGER) END AS quantity, CASE WHEN o_orderkey % 5 = 0 THEN 'deniz' END AS note FROM orders",
    "edit_price": "SELECT o_orderkey, o_orderkey % 6 < 3 AS valid, CASE o_orderkey % 6 WHEN 0 THEN 'suit' WHEN 1 THEN 'tek' WHEN 2 THEN 'tek' END AS room, CASE o_orderkey % 6 WHEN 0 THEN 'HB' WHEN 2 THEN 'yarım' END AS board, CAST(CASE o_orderkey % 6 WHEN 0 THEN o_custkey + 0.5 WHEN 1 THEN o_custkey WHEN 2 THEN 5 END AS DOUBLE) AS amount, CASE o_orderkey % 6 WHEN 0 THEN 'oda_gecelik' WHEN 1 THEN 'kisi_gecelik' WHEN 2 THEN 'oda_gecelik' END AS unit FROM orders",
    "edit_release": "SELECT o_orderkey, o_orderkey % 4 < 2 AS valid, CASE WHEN o_orderkey % 4 < 2 THEN CAST(o_custkey AS INTEGER) END AS days, CASE WHEN o_orderkey % 4 = 0 THEN 'isim_listesi' END AS scope FROM orders",
    "edit_stop_sale": "SELECT o_orderkey, o_orderkey % 3 < 2 AS valid, CASE WHEN o_orderkey % 3 < 2 THEN '2026-05-01' END AS start, CASE WHEN o_orderkey % 3 < 2 THEN '2026-05-10' END AS \"end\", CASE WHEN o_orderkey % 3 = 0 THEN 'suit' END AS scope FROM orders",
    "edit_room_lists": "SELECT o_custkey, CAST(CASE WHEN count(*) FILTER (o_orderkey % 9 = 0) > 0 THEN NULL ELSE count(*) END AS BIGINT) AS n, count(*) AS n_lines FROM orders GROUP BY o_custkey",
    "rights_matrix": f"{_stored('user')} SELECT id, operation FROM (SELECT id, {_ACTOR} AS role FROM c) x JOIN (VALUES {', '.join(map(str, _GRANTS))}) g(role, operation) USING (role)",
    "contracts_owned": f"WITH u AS (SELECT * FROM ({_stored('user')} SELECT id, org_id FROM c) x), k AS (SELECT * FROM ({_stored('contract')} SELECT id, user_id, org_id FROM c) x) SELECT u.id, (SELECT count(*) FROM k WHERE CASE WHEN u.org_id IS NOT NULL THEN k.org_id = u.org_id ELSE k.user_id = u.id AND k.org_id IS NULL END) AS n FROM u",
    "member_gates": f"{_stored('user')}, m AS (SELECT id, {_ACTOR} AS role, count(*) OVER (PARTITION BY org_id) AS n FROM c WHERE org_id IS NOT NULL) SELECT id, role = 'SAHIP' AS may_set, role <> 'SAHIP' OR n = 1 AS may_leave, n = 1 AS org_goes FROM m",
    "org_cascade": _CASCADED,
    **{f"export_{name}": f"{_stored(name)} SELECT {_SHOWN[name]} FROM c WHERE {where}" for name, where in EXPORTS.items()},
    **{name: f"SELECT {', '.join([*_raw(name)[1], *(c for c in _SHOWN_BY[name])])} FROM (SELECT {', '.join(_raw(name)[1])}, {sql} FROM (SELECT *, {', '.join(_raw(name)[2])} FROM {_RAW[name][0]}) x) y" for name, sql in _RULES_SQL.items()},
}
assert set(EXPORTS) <= set(COLLECTIONS)
