"""Contracts held against their texts and against gold: allotments, glyphs, scores, source pages.

Contracts are orders and their clauses line items, so that texts, values and pages vary with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import evidence as e
from pactline.operators import layout as y
from pactline.operators import rooms as r
from pactline.operators import scoring as c
from pactline.sources.tables import load

_NL = "chr(10)"
_Q = "CAST(CAST(l_quantity AS BIGINT) AS STRING)"
#: names of rooms as clauses have them, and their types
NAMES = ("standart", "normal oda", "junior suite", "penthouse", "suit", "balayı odası", "honeymoon", "özürlü oda", "accessible", "aile odası", "family room", "deluxe room")
KINDS = ("standart", "standart", "suit", "suit", "suit", "balayi", "balayi", "engelli", "engelli", "aile", "aile", "deluxe")
_NAME = "CASE l_partkey % 12 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(NAMES)) + " END"
_KIND = "CASE l_partkey % 12 " + " ".join(f"WHEN {k} THEN '{n}'" for k, n in enumerate(KINDS)) + " END"
#: SQL, the same for both engines: a clause; in forms 2 and 3 the number stands too far away (of bytes, not characters)
_CLAUSE = f"""CASE l_suppkey % 6 WHEN 0 THEN CASE WHEN l_partkey % 12 IN (5, 9) THEN {_NAME} ELSE upper({_NAME}) END || ': ' || {_Q} WHEN 1 THEN {_Q} || ' ' || {_NAME} WHEN 2 THEN {_NAME} || repeat('ş', 20) || ' ' || {_Q}
  WHEN 3 THEN {_Q} || repeat('ö', 12) || ' ' || {_NAME} WHEN 4 THEN {_NAME} || ' ' || {_Q} || ' / 777' ELSE '777 ve ' || {_Q} || ' ' || {_NAME} END"""


def _clauses(s: SparkSession, p: str) -> DataFrame:
    """Contracts (doc_id, text): every third has no allotment section."""
    x = load(s, p, "lineitem").selectExpr("l_orderkey AS doc_id", "l_linenumber AS k", f"{_CLAUSE} AS line")
    body = x.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda i: i["line"]), "\n").alias("body"))
    head = F.when(F.col("doc_id") % 3 == 0, F.lit("sözleşme\n")).otherwise(F.lit("MADDE 2 Oda kontenjanları aşağıdaki gibi ayrılmıştır\n"))
    return body.select("doc_id", F.concat(head, "body", F.lit("\nMadde 4 oda fiyatları\n31 standart\ndeluxe: 32")).alias("text"))


def _extracted(s: SparkSession, p: str) -> DataFrame:
    """What a model gave of them: a third of the quantities are not those of the text."""
    return load(s, p, "lineitem").selectExpr("l_orderkey AS doc_id", f"{_NAME} AS room", "CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 3 = 0 THEN 1000 ELSE 0 END AS quantity")


_SYNONYMS = ", ".join(f"('{kind}', {k}, '{w}')" for kind, words in r.g.ROOM_WORDS.items() for k, w in enumerate(words))
_ROOMS = f"""WITH x AS (SELECT l_orderkey AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {_CLAUSE}) AS line, {_NAME} AS name, {_KIND} AS kind, CAST(l_quantity AS BIGINT) AS q, l_quantity + CASE WHEN l_linenumber % 3 = 0 THEN 1000 ELSE 0 END AS given, l_suppkey % 6 AS form FROM lineitem),
  w(kind, word, syn) AS (VALUES {_SYNONYMS}),
  -- in forms 2 and 3 the number is out of reach; contracts without a section are read whole, with the two lines at their end
  seen AS (SELECT d, x.kind, word, line, q AS n FROM x JOIN w ON w.kind = x.kind AND strpos(x.name, syn) > 0 WHERE form NOT IN (2, 3)
    UNION ALL SELECT DISTINCT d, 'standart', 3, 1000, 31 FROM x WHERE d % 3 = 0 UNION ALL SELECT DISTINCT d, 'deluxe', 4, 1001, 32 FROM x WHERE d % 3 = 0),
  agg AS (SELECT d, kind, CASE WHEN kind = 'engelli' THEN min(given) FILTER (near) ELSE max(given) FILTER (near) END AS near, CASE WHEN kind = 'engelli' THEN min(given) ELSE max(given) END AS every
    FROM (SELECT x.*, EXISTS (SELECT 1 FROM seen s WHERE s.d = x.d AND s.kind = x.kind AND s.n = x.given) AS near FROM x) y GROUP BY d, kind),
  stated AS (SELECT d, kind, arg_min(n, (word, line)) AS n FROM seen WHERE d % 3 > 0 GROUP BY d, kind),
  found AS (SELECT d, kind, coalesce(near, n) AS quantity FROM agg LEFT JOIN stated USING (d, kind) WHERE near IS NOT NULL OR n IS NOT NULL),
  rows AS (SELECT * FROM found UNION ALL SELECT d, kind, every FROM agg WHERE d NOT IN (SELECT d FROM found))
  SELECT d AS doc_id, list_position(['standart', 'suit', 'balayi', 'engelli', 'aile', 'deluxe'], kind)::INT AS rank, kind AS room, quantity::BIGINT AS quantity FROM rows"""


def _mentions(s: SparkSession, p: str) -> DataFrame:
    """Which of the types that customers' orders ask for their contract's section names."""
    asked = load(s, p, "orders").selectExpr("o_orderkey AS doc_id", f"{_NAME.replace('l_partkey', 'o_custkey')} AS asked")
    return _clauses(s, p).join(asked, "doc_id").select("doc_id", r.mentioned_types(F.col("text"), F.col("asked")).alias("mentioned"), r.hint_lines(F.col("text")).cast("long").alias("hints"))


_MENTIONS = f"""WITH x AS (SELECT l_orderkey AS d, {_KIND} AS kind FROM lineitem), o AS (SELECT o_orderkey AS d, {_KIND.replace('l_partkey', 'o_custkey')} AS kind FROM orders)
  SELECT d AS doc_id, kind IN ('standart', 'deluxe') OR EXISTS (SELECT 1 FROM x WHERE x.d = o.d AND x.kind = o.kind) AS mentioned, (SELECT count(*) FROM x WHERE x.d = o.d) + 2 AS hints FROM o WHERE d IN (SELECT d FROM x)"""

#: SQL, the same for both engines: where the word at ``pos`` of a page stands; every eighth is put where the one before stands
_GLYPH = "doc_id, page, pos, s, 60.0 * (pos % 8 - CASE WHEN pos % 8 = 7 THEN 1 ELSE 0 END) AS x, 8000.0 - 12 * floor(pos / 8) + pos % 4 AS y, CASE WHEN pos % 5 = 0 THEN 0.0 ELSE 5.0 * length(s) END AS width, CASE WHEN pos % 11 = 0 THEN 0.0 ELSE 8.0 + page % 3 END AS font"


def _glyphs(s: SparkSession, p: str) -> DataFrame:
    words = load(s, p, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("pos", "s"))
    return words.selectExpr(*_split(_GLYPH))


def _split(columns: str) -> list[str]:
    """The columns of a list, parted at commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        out = [*out, ""] if c == "," and not depth else [*out[:-1], out[-1] + c]
    return out


_PAGES = f"""WITH w AS (SELECT conv_id AS doc_id, turn AS page, unnest(string_split(coalesce(text, ''), ' ')) AS s, unnest(range(len(string_split(coalesce(text, ''), ' '))))::INT AS pos FROM conversations),
  k AS (SELECT {_GLYPH} FROM w), v AS (SELECT *, floor(pos / 8) AS line, x + CASE WHEN width = 0 AND font > 0 THEN font * 0.5 * length(s) ELSE width END AS "right" FROM k WHERE s <> ''),
  l AS (SELECT *, x - lag("right") OVER o AS gap, lag(s) OVER o AS before, CASE WHEN font = 0 THEN 12 ELSE font END AS size FROM v WINDOW o AS (PARTITION BY doc_id, page, line ORDER BY x, pos)),
  t AS (SELECT doc_id, page, line, string_agg(CASE WHEN before IS NULL OR gap < size * 0.25 OR ends_with(before, ' ') THEN '' ELSE repeat(' ', greatest(1, least(24, round(gap / (size * 0.5))))::INT) END || s, '' ORDER BY x, pos) AS text FROM l GROUP BY ALL),
  j AS (SELECT doc_id, page, string_agg(text, {_NL} ORDER BY line) AS text FROM t GROUP BY ALL)
  SELECT doc_id, page, md5(coalesce(text, '')) AS md5, length(coalesce(text, ''))::BIGINT AS chars FROM (SELECT DISTINCT doc_id, page FROM k) d LEFT JOIN j USING (doc_id, page)"""

_F = "l_orderkey % 9"


def _gold(s: SparkSession, p: str) -> tuple[DataFrame, DataFrame]:
    """Gold contracts of orders, and predictions that an order's key spoils in one of nine ways."""
    day = F.date_format(F.col("l_shipdate").cast("timestamp"), "yyyy-MM-dd")
    x = load(s, p, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), F.col("l_extendedprice").cast("double").alias("price"), day.alias("day"))
    room = lambda q, more: F.concat(F.lit('{"oda_tipi":"o'), F.col("l_linenumber").cast("string"), F.lit('","adet":'), q.cast("string"), F.lit(more), F.lit("}"))
    price = lambda board: F.concat(F.lit('{"birim":"oda_gecelik","tutar":'), F.col("price").cast("string"), F.lit(f',"oda_tipi":"o"{board}'), F.lit("}"))
    rows = lambda c, back: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", c.alias("j"))), asc=not back), lambda i: i["j"]), ",")
    each = x.groupBy("l_orderkey").agg(
        F.min("day").alias("first"), F.max("day").alias("last"), rows(room(F.col("q"), ""), False).alias("rooms"), rows(room(F.col("q"), ',"aciklama":"deniz"'), True).alias("noted"), rows(room(F.col("q").cast("double"), ""), True).alias("real"),
        rows(room(F.col("q") + (F.col("l_linenumber") == 1).cast("long"), ""), False).alias("more"), rows(price(""), False).alias("prices"), rows(price(',"pansiyon":"belirtilmemis"'), True).alias("named"),
    )
    tree = lambda rooms, prices, last, tail: F.concat(F.lit('{"donem":{"bitis":"'), last, F.lit('","baslangic":"'), F.col("first"), F.lit('"},"oda_kontenjanlari":['), rooms, F.lit('],"fiyatlar":['), prices, F.lit(f"]{tail}}}"))
    col, release = F.col, ',"release":{"gun":7}'
    kind = col("l_orderkey") % 9
    answer = (
        F.when(kind == 0, tree(col("noted"), col("named"), col("last"), ',"release":{"kapsam":"belirtilmemis","gun":7.0}')).when(kind == 1, tree(col("more"), col("prices"), col("last"), release)).when(kind == 2, tree(col("real"), col("named"), col("first"), release))
        .when(kind == 3, F.lit("{bozuk")).when(kind == 5, F.concat(F.lit("Sonuç:\n```json\n"), tree(col("rooms"), col("prices"), col("last"), ',"release":{"gun":8},"stop_sale":[]'), F.lit("\n```\nson")))
        .when(kind == 6, tree(F.lit(""), col("prices"), col("last"), release)).when(kind == 7, tree(col("rooms"), F.lit('{"oda_tipi":"o"}'), col("last"), ',"release":[]')).otherwise(tree(col("rooms"), col("prices"), col("last"), release))
    )
    gold = each.select(col("l_orderkey").alias("doc_id"), tree(col("rooms"), col("prices"), col("last"), release).alias("contract"))
    return gold, each.where(kind != 8).select(col("l_orderkey").alias("doc_id"), answer.alias("answer"), F.when(kind == 4, "HTTP 500").alias("error"))


_SCORES = f"""WITH x AS (SELECT l_orderkey AS doc_id, {_F} AS k, min(l_shipdate) = max(l_shipdate) AS one, min(l_linenumber) > 1 AS no_first FROM lineitem GROUP BY ALL)
  SELECT doc_id, k NOT IN (3, 4, 8) AS valid_json, k IN (5) AS schema_ok, k IN (0, 1, 5, 6, 7) OR (k = 2 AND one) AS donem, k IN (0, 2, 5, 7) OR (k = 1 AND no_first) AS oda_kontenjanlari, k IN (0, 1, 2, 5, 6) AS fiyatlar, k IN (0, 1, 2, 6) AS release, k NOT IN (4, 5, 8) AS stop_sale,
    CASE k WHEN 4 THEN 'HTTP 500' WHEN 8 THEN 'yanıt yok' END AS error FROM x"""


def _scores(s: SparkSession, p: str) -> DataFrame:
    return c.scored(*_gold(s, p))


def _summary(s: SparkSession, p: str) -> DataFrame:
    rows = c.summary(_scores(s, p).withColumn("part", F.col("doc_id") % 4), "part")
    return rows.select("part", "n", *(c.percent(F.col(k)).alias(k) for k in ("valid_json_rate", "schema_ok_rate", *c.CORE)), "errors")


#: SQL, the same for both engines: the text of a line item's page; the date is missing from every other one
_PAGE = "'Sayfa ' || CAST(l_linenumber AS STRING) || ' ' || l_returnflag || ' NET ' || regexp_replace(CAST(CAST(l_extendedprice AS DOUBLE) AS STRING), '[.]0$', '') || CASE WHEN l_linenumber % 2 = 0 THEN ' tarih ' || CAST(CAST(l_shipdate AS DATE) AS STRING) ELSE '' END"


def _field_pages(s: SparkSession, p: str) -> DataFrame:
    """Fields of orders: a period in an object, prices in an array of objects, and days that are too short to look for."""
    x = load(s, p, "lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))
    pages = x.selectExpr("l_orderkey AS doc_id", "l_linenumber AS page", f"{_PAGE} AS text")
    late = F.collect_list(F.when(F.col("l_linenumber") > 1, F.struct(F.struct(F.col("l_extendedprice").cast("double").alias("tutar")).alias("net"))))
    each = x.groupBy("l_orderkey").agg(F.to_json(F.struct(F.struct(F.max("l_shipdate").cast("date").cast("string").alias("bitis")).alias("d"))).alias("donem"), F.to_json(F.struct(late.alias("satir"))).alias("fiyatlar"), F.first(F.lit('{"gun": 7}')).alias("release"))
    fields = F.array(*(F.struct(F.lit(k).alias("field"), F.parse_json(F.col(k)).alias("value")) for k in ("donem", "fiyatlar", "release")))
    return e.field_pages(each.select(F.col("l_orderkey").alias("doc_id"), F.explode(fields).alias("x")).select("doc_id", "x.*"), pages)


_FIELD_PAGES = f"""WITH p AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, {_PAGE} AS text, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, regexp_replace(CAST(CAST(l_extendedprice AS DOUBLE) AS STRING), '[.]0$', '') AS price FROM lineitem),
  d AS (SELECT doc_id, max(day) AS day FROM p GROUP BY doc_id)
  SELECT doc_id, 'donem' AS field, (SELECT min(page) FROM p WHERE p.doc_id = d.doc_id AND contains(text, d.day)) AS page FROM d
  UNION ALL SELECT doc_id, 'fiyatlar', (SELECT min(a.page) FROM p a, p b WHERE a.doc_id = d.doc_id AND b.doc_id = d.doc_id AND b.page > 1 AND contains(a.text, b.price)) FROM d
  UNION ALL SELECT doc_id, 'release', NULL FROM d"""

QUERIES = {
    "grounded_rooms": lambda s, p: r.grounded_rooms(_clauses(s, p), _extracted(s, p)),
    "room_mentions": _mentions,
    "glyph_pages": lambda s, p: y.page_text(_glyphs(s, p)).select("doc_id", "page", F.md5("text").alias("md5"), F.length("text").cast("long").alias("chars")),
    "prediction_scores": _scores,
    "prediction_summary": _summary,
    "field_source_pages": _field_pages,
}
SQL = {
    "grounded_rooms": _ROOMS, "room_mentions": _MENTIONS, "glyph_pages": _PAGES, "prediction_scores": _SCORES,
    "prediction_summary": f"SELECT doc_id % 4 AS part, count(*) AS n, {', '.join(f'printf(chr(37) || {chr(39)}5.1f{chr(39)} || chr(37) || chr(37), 100 * avg({k}::INT)) AS {n}' for k, n in (('valid_json', 'valid_json_rate'), ('schema_ok', 'schema_ok_rate'), *((k, k) for k in c.CORE)))}, count(error) AS errors FROM ({_SCORES}) z GROUP BY part",
    "field_source_pages": _FIELD_PAGES,
}
