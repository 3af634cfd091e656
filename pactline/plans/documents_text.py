"""Contracts of orders and their lines, written as documents and as prose of checked values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.operators import documents_text as t
from pactline.operators.synthesis import MONTHS, ROOMS
from pactline.plans import synthesis as y
from pactline.sources.tables import load

K, L = "o_orderkey", "l_linenumber"
ORDER = (L, "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")  # an order can have several lines of a number


def _list(values) -> str:
    return f"array({', '.join(repr(v) for v in values)})"


def _contracts(s: SparkSession, p: str) -> DataFrame:
    """An order's first lines are its allotment, all its lines prices, and those sent by air closed ranges."""
    room, price, stop = (
        F.expr(f"struct(element_at({_list(ROOMS)}, CAST({L} + l_orderkey % 2 AS INT)) AS room, CAST(l_quantity AS INT) AS quantity)"),
        F.expr(f"struct(element_at({_list(ROOMS)}, CAST(({L} - 1) % 6 + 1 AS INT)) AS room, CASE l_returnflag WHEN 'A' THEN 'HB' WHEN 'R' THEN 'AI' END AS board, CAST(l_extendedprice AS DOUBLE) AS amount, CASE l_linestatus WHEN 'F' THEN 'oda_gecelik' ELSE 'kisi_gecelik' END AS unit, CASE WHEN {L} % 2 = 0 THEN 'yaz' END AS part)"),
        F.expr(f"struct(CAST(l_shipdate AS DATE) AS begins, date_add(CAST(l_shipdate AS DATE), CAST({L} AS INT)) AS ends, CASE {L} % 3 WHEN 0 THEN 'tüm tesis' WHEN 1 THEN 'suit' ELSE '' END AS scope)"),
    )
    rows = lambda x, when: F.transform(F.array_sort(F.collect_list(F.when(F.expr(when), F.struct(*ORDER, x.alias("x"))))), lambda r: r["x"])
    lines = load(s, p, "lineitem").groupBy(F.col("l_orderkey").alias(K)).agg(rows(room, f"{L} <= 3").alias("rooms"), rows(price, "true").alias("prices"), rows(stop, "l_partkey % 5 = 0").alias("stop_sale"))
    days = "CAST(o_orderdate AS DATE)"
    heads = load(s, p, "orders").selectExpr(
        K, f"CASE WHEN {K} % 7 > 0 THEN {days} END AS begins", f"date_add({days}, 200) AS ends", f"CASE WHEN {K} % 4 = 0 THEN array(struct('Erken' AS name, {days} AS begins, date_add({days}, 99) AS ends), struct('Geç' AS name, date_add({days}, 100) AS begins, date_add({days}, 200) AS ends)) END AS parts",
        f"CAST({K} % 30 AS INT) AS release_days", f"CASE WHEN {K} % 5 > 0 THEN 'Kum Otel ' || o_custkey ELSE '' END AS hotel", f"CASE WHEN {K} % 11 > 0 THEN 'Deniz Turizm' END AS agent", f"element_at({_list(('EUR', 'GBP', ''))}, CAST({K} % 3 + 1 AS INT)) AS currency", f"element_at({_list(('İzmir', 'London', ''))}, CAST(o_custkey % 3 + 1 AS INT)) AS city",
        f"CASE WHEN {K} % 9 < 6 THEN 'tr' ELSE 'en' END AS language", f"CAST(CASE WHEN {K} % 9 < 6 THEN {K} % 9 + 1 ELSE {K} % 9 - 5 END AS INT) AS layout", f"element_at({_list(t.DATES)}, CAST(o_custkey % 3 + 1 AS INT)) AS dates", f"element_at({_list(t.NUMBERS)}, CAST(o_custkey % 4 % 3 + 1 AS INT)) AS numbers", f"{K} % 10 = 0 AS glued", f"{K} % 5 = 1 AS extra",
        f"CASE WHEN {K} % 2 = 0 THEN 'giris_gunu_tcmb' END AS rate_basis", f"CASE WHEN {K} % 6 = 0 THEN 'Gelmeyen misafir için bir gece alınır.' ELSE '' END AS no_show", f"CASE WHEN {K} % 8 = 0 THEN 'Otel benzer bir tesis bulur.' END AS overbooking",
    )
    return heads.join(lines, K, "left")


def _written(s: SparkSession, p: str) -> DataFrame:
    return t.with_documents(_contracts(s, p)).select(F.col(K).alias("doc_id"), "language", "layout", "text")


def _prose(s: SparkSession, p: str) -> DataFrame:
    return _contracts(s, p).select(F.col(K).alias("doc_id"), t.prose().alias("text"))


def _drawn(s: SparkSession, p: str) -> DataFrame:
    """Seeded contracts in drawn styles; whether each text names both parties and each room's quantity."""
    x = t.with_documents(t.with_styles(y.made(s, p), "doc_id", y.SEED + 2))
    shown = F.forall("rooms", lambda r: F.contains("text", r["quantity"].cast("string"))) & F.contains("text", F.col("hotel")) & F.contains("text", F.col("agent"))
    return x.select("doc_id", "language", "layout", "dates", "numbers", "glued", "extra", "hotel", "agent", "currency", "city", shown.alias("shown"))


def _q(text: str) -> str:
    return "'" + text + "'"


def _fill(pattern: str, **values: str) -> str:
    for name, sql in values.items():
        pattern = pattern.replace("{" + name + "}", f"' || {sql} || '")
    return _q(pattern)


def _case(of: str, words: dict) -> str:
    return f"CASE {of} {' '.join(f'WHEN {_q(k)} THEN {_q(v)}' for k, v in words.items())} ELSE {of} END"


def _by(tr: str, en: str) -> str:
    return f"CASE WHEN language = 'tr' THEN {tr} ELSE {en} END"


def _number(n: str) -> str:
    english = f"CASE WHEN {n} = floor({n}) THEN format('{{:,}}', ({n})::BIGINT) ELSE format('{{:,.2f}}', ({n})::DOUBLE) END"
    return f"CASE numbers WHEN 'en' THEN {english} WHEN 'tr' THEN translate({english}, ',.', '.,') ELSE replace({english}, ',', '') END"


def _day(d: str) -> str:
    month = _by(*(f"{list(MONTHS[x])}[month({d})]" for x in ("tr", "en")))
    return f"CASE dates WHEN 'iso' THEN strftime({d}, '%Y-%m-%d') WHEN 'nokta' THEN strftime({d}, '%d.%m.%Y') ELSE day({d}) || ' ' || ({month}) || ' ' || year({d}) END"


TR, EN, A, C, S, P = t.WORDS["tr"], t.WORDS["en"], t.AGREEMENT, t.CONFIRMATION, t.SCHEDULES, t.PROSE
_LABEL = _by("{0}", f"CASE WHEN {{0}} = 'suit' AND {{1}} % 2 = 1 THEN 'junior suite' ELSE {_case('{0}', t.ROOMS_EN)} END").format
_HEADS = f"""h AS (SELECT {K} AS k, CASE WHEN {K} % 7 > 0 THEN o_orderdate::DATE END AS b, o_orderdate::DATE AS d, {K} % 30 AS days, CASE WHEN {K} % 9 < 6 THEN 'tr' ELSE 'en' END AS language, (CASE WHEN {K} % 9 < 6 THEN {K} % 9 + 1 ELSE {K} % 9 - 5 END)::INT AS layout,
    ['nokta', 'iso', 'uzun'][o_custkey % 3 + 1] AS dates, ['duz', 'tr', 'en'][o_custkey % 4 % 3 + 1] AS numbers, CASE WHEN {K} % 5 > 0 THEN 'Kum Otel ' || o_custkey END AS hotel, CASE WHEN {K} % 11 > 0 THEN 'Deniz Turizm' END AS agent, ['EUR', 'GBP', ''][{K} % 3 + 1] AS currency, o_custkey % 3 AS c FROM orders),
  n AS (SELECT h.*, {L} AS l, row_number() OVER (PARTITION BY k ORDER BY {", ".join(ORDER)}) AS s, l_quantity::INT AS q, ['standart', 'suit', 'aile', 'deluxe', 'balayi', 'engelli'] AS kinds, kinds[({L} + k % 2)::INT] AS room, kinds[(({L} - 1) % 6 + 1)::INT] AS sold, CASE l_returnflag WHEN 'A' THEN 'HB' WHEN 'R' THEN 'AI' END AS board, l_extendedprice::DOUBLE AS amount, l_linestatus = 'F' AS by_room, l_partkey % 5 = 0 AS air, l_shipdate::DATE AS b1, l_shipdate::DATE + {L}::INT AS e1 FROM h JOIN lineitem ON l_orderkey = k)"""
_UNIT = "CASE WHEN by_room THEN 'per room per night' ELSE 'per person per night' END"
_MONEY = f"({_number('x.amount')}) || CASE WHEN currency = '' THEN '' WHEN x.k % 10 = 0 THEN currency ELSE ' ' || currency END"
_BOARD = f"CASE x.board WHEN 'HB' THEN {_by(_q(', yarım pansiyon'), _q(', half board'))} WHEN 'AI' THEN {_by(_q(', her şey dahil'), _q(', all inclusive'))} ELSE '' END"
_SCOPE = f"CASE l % 3 WHEN 0 THEN {_by(_q(' (tüm tesis)'), _q(' (entire property)'))} WHEN 1 THEN {_by(_q(' (suit)'), _q(' (suite)'))} ELSE '' END"
_LINES = f"""r AS (SELECT k, string_agg(({_number('q')}) || ' ' || ({_LABEL('room', 'q')}), ', ' ORDER BY s) AS listed, string_agg('- ' || ({_number('q')}) || ' ' || ({_LABEL('room', 'q')}) || ' rooms', chr(10) ORDER BY s) AS bullets, string_agg(({_LABEL('room', 'q')}) || ' | ' || ({_number('q')}), chr(10) ORDER BY s) AS cells FROM n WHERE l <= 3 GROUP BY k),
  v AS (SELECT x.*, {_LABEL('x.sold', 'o.q')} AS name, {_MONEY} AS money, {_by("CASE WHEN by_room THEN 'oda / gece' ELSE 'kişi / gece' END", _UNIT)} AS unit FROM (SELECT * EXCLUDE (q, room) FROM n) x LEFT JOIN (SELECT k AS ok, room, arg_min(q, s) AS q FROM n WHERE l <= 3 GROUP BY k, room) o ON ok = k AND o.room = x.sold),
  w AS (SELECT k, string_agg(name || ' | ' || coalesce(board, {_by("'belirtilmemiş'", "'unspecified'")}) || ' | ' || money || ' | ' || unit || ' | ' || CASE WHEN l % 2 = 0 THEN 'yaz' ELSE '-' END, chr(10) ORDER BY s) AS cells, arg_min({_UNIT}, s) AS unit,
    string_agg(name || ({_BOARD}) || CASE WHEN l % 2 = 0 THEN ' (yaz)' ELSE '' END || {_by("' için '", "' at '")} || money || ' ' || unit, '; ' ORDER BY s) AS listed FROM v x GROUP BY k),
  z AS (SELECT k, string_agg('- ' || ({_day('b1')}) || ' – ' || ({_day('e1')}) || ({_SCOPE}), chr(10) ORDER BY s) AS stops FROM n WHERE air GROUP BY k)"""
_PARTS = f"'Erken: ' || ({_day('d')}) || ' – ' || ({_day('d + 99')}) || chr(10) || 'Geç: ' || ({_day('d + 100')}) || ' – ' || ({_day('d + 200')})"
_EXTRA = lambda x: _fill(x["extra"], days="days2", city="city")
_BLOCKS = f"""m AS (SELECT h.*, coalesce(hotel, {_by("'Otel'", "'the Hotel'")}) AS ho, coalesce(agent, {_by("'Acente'", "'the Agent'")}) AS ag, CASE WHEN currency = '' THEN 'EUR' ELSE currency END AS cur, coalesce(w.unit, 'per room per night') AS per,
    CASE WHEN b IS NOT NULL THEN {_by(_fill(TR['term'], begins=f'({_day("b")})', ends=f'({_day("d + 200")})'), _fill(EN['term'], begins=f'({_day("b")})', ends=f'({_day("d + 200")})'))} END AS term, CASE WHEN h.k % 4 = 0 THEN {_by(_q(TR['parts']), _q(EN['parts']))} || chr(10) || {_PARTS} END AS parts,
    {_fill(TR['rooms'], list="coalesce(r.listed, '')")} AS rooms, coalesce(r.bullets, '') AS bullets, r.cells AS room_cells, concat_ws(chr(10), {_by(_q(TR['rooms_head']), _q(EN['rooms_head']))}, r.cells) AS room_table, concat_ws(chr(10), {_by(_q(TR['prices_head']), _q(EN['prices_head']))}, w.cells) AS price_table,
    {_by(_fill(TR['prices'], list="coalesce(w.listed, '')"), _fill(EN['prices'], unit='per', list="coalesce(w.listed, '')"))} AS prices, {_by(_fill(TR['release'], days='days'), _fill(EN['release'], days='days'))} AS release, {_by(_q(TR['stops']), _q(EN['stops']))} || chr(10) || z.stops AS stops,
    ['İzmir', 'London', 'Antalya'][c + 1] AS city, CASE WHEN list_sum([ord(ch) FOR ch IN string_split(['İzmir', 'London', 'Antalya'][c + 1], '')]) % 2 = 0 THEN 15 ELSE 30 END AS days2
    FROM h LEFT JOIN r USING (k) LEFT JOIN w ON w.k = h.k LEFT JOIN z ON z.k = h.k)"""
_NN = "chr(10) || chr(10)"
_ws = lambda *blocks: f"concat_ws({_NN}, {', '.join(blocks)})"
_TITLE = f"{_q(TR['title'])} || chr(10) || ag || ' – ' || ho || chr(10)"
_DATED = "CASE WHEN term IS NOT NULL THEN concat_ws(" + _NN + ", term, parts) END"
_no = lambda n: f"({n} + (term IS NOT NULL)::INT)"
_h1, _h2, _h3, _h4, _h5 = TR["headings"]
_ARTICLES = _ws(_TITLE, _fill(TR["between"], agent="ag", hotel="ho") + " || chr(10)", f"'MADDE 1 — {_h1}' || chr(10) || {_DATED}", f"'MADDE ' || {_no(1)} || ' — {_h2}' || chr(10) || rooms", f"'MADDE ' || {_no(2)} || ' — {_h3}' || chr(10) || release", f"'MADDE ' || {_no(3)} || ' — {_h4}' || chr(10) || stops", f"'MADDE ' || ({_no(3)} + (stops IS NOT NULL)::INT) || ' — {_h5}' || chr(10) || prices")
_g1, _g2, _g3, _g4, _g5 = A["headings"]
_LAYOUTS = {
    ("tr", 1): _ARTICLES,
    ("tr", 2): _ws(_TITLE, _DATED, f"{_q(TR['tables'][0])} || chr(10) || room_table", f"{_q(TR['tables'][1])} || chr(10) || price_table", "release", "stops"),
    ("tr", 3): _ws(f"concat_ws(' ', {_fill(TR['agreed'], agent='ag', hotel='ho')}, term, rooms, release)", "parts", "prices", "stops"),
    ("tr", 4): _ws(_ARTICLES, _q(TR["annex"]), "room_table", "price_table"),
    ("tr", 5): _ws(f"ag || ' / ' || ho || chr(10) || {_q(TR['annexes'][0])} || chr(10) || coalesce(term, '')", *(f"{_q(x)} || chr(10) || {y}" for x, y in zip(TR["annexes"][1:], ("room_table", "price_table", "release"))), "stops"),
    ("tr", 6): _ws(_q(TR["letter"][0]), f"concat_ws(' ', {_fill(TR['letter'][1], hotel='ho', agent='ag')}, term, {_q(TR['letter'][2])})", "rooms", "price_table", "release", "stops", f"CASE WHEN stops IS NULL THEN chr(10) ELSE '' END || {_q(TR['letter'][3])}"),
    ("en", 1): _ws(f"{_fill(A['title'], agent='ag', hotel='ho')} || chr(10)", f"{_q(A['agreed'])} || chr(10)", f"'ARTICLE 1 — {_g1}' || chr(10) || {_DATED}", f"'ARTICLE ' || {_no(1)} || ' — {_g2}' || chr(10) || {_q(A['rooms'])} || chr(10) || bullets", f"'ARTICLE ' || {_no(2)} || ' — {_g3}' || chr(10) || release",
        f"'ARTICLE ' || {_no(3)} || ' — {_g4}' || chr(10) || {_fill(A['rates'], unit='per', currency='cur')} || chr(10) || price_table", f"'ARTICLE ' || {_no(4)} || ' — {_g5}' || chr(10) || stops"),
    ("en", 2): _ws(f"{_q(C['title'])} || chr(10)", f"{_fill(C['parties'], hotel='ho', agent='ag', currency='cur')} || chr(10)", f"CASE WHEN term IS NOT NULL THEN concat_ws({_NN}, {_fill(C['term'], term='term')}, parts) END", f"{_q(C['rooms'])} || chr(10) || room_table", f"{_fill(C['rates'], unit='per')} || chr(10) || prices", f"{_q(C['release'])} || chr(10) || release", f"{_q(C['stops'])} || chr(10) || stops", _q(C["end"])),
    ("en", 3): f"concat_ws(chr(10), {_fill(S['title'], hotel='ho', agent='ag', term=f'coalesce(term, {_q(S['no_term'])})')}, {_q(S['rooms'])}, room_cells, {_q(S['rates'])} || chr(10) || price_table, {_fill(S['release'], days='days', release='release')}, stops, {_q(S['parts'])} || chr(10) || parts)",
}
_p = P["headings"]
_PRICE = "CASE WHEN amount = floor(amount) THEN amount::BIGINT::VARCHAR ELSE amount::VARCHAR END"
QUERIES = {"written_contracts": _written, "contract_prose": _prose, "synthetic_documents": _drawn}
SQL = {
    "written_contracts": f"WITH {_HEADS}, {_LINES}, {_BLOCKS} SELECT k AS doc_id, language, layout, (CASE {' '.join(f'WHEN language = {_q(x)} AND layout = {n} THEN {sql}' for (x, n), sql in _LAYOUTS.items())} END) || chr(10) || CASE WHEN k % 5 = 1 THEN chr(10) || {_by(_EXTRA(TR), _EXTRA(EN))} || chr(10) ELSE '' END AS text FROM m",
    "contract_prose": f"""WITH {_HEADS}, r AS (SELECT k, string_agg(chr(10) || '- ' || ({_case('room', t.ROOMS_PROSE)}) || ': ' || q || ' adet', '' ORDER BY s) AS rooms FROM n WHERE l <= 3 GROUP BY k),
      v AS (SELECT k, string_agg(chr(10) || '- ' || ({_case('sold', t.ROOMS_PROSE)}) || ': ' || {_PRICE} || ' ' || CASE WHEN currency = '' THEN 'GBP' ELSE currency END, '' ORDER BY s) AS prices FROM n GROUP BY k), m AS (SELECT h.*, rooms, prices, CASE WHEN currency = '' THEN 'GBP' ELSE currency END AS cur FROM h LEFT JOIN r USING (k) LEFT JOIN v USING (k))
      SELECT k AS doc_id, {_ws(f"{_q(TR['title'])} || chr(10) || coalesce(agent, 'Side Turizm') || ' – ' || coalesce(hotel, 'Argos Otel')", f"{_q(_p[0])} || chr(10) || {_q(P['no_term'])}", f"{_q(_p[1])} || chr(10) || {_q(P['rooms'])} || coalesce(rooms, '')", f"{_q(_p[2])} || chr(10) || {_fill(TR['release'], days='days')}", f"CASE WHEN k % 6 = 0 THEN {_q(_p[3])} || chr(10) || 'Gelmeyen misafir için bir gece alınır.' END",
        f"CASE WHEN k % 8 = 0 THEN {_q(_p[4])} || chr(10) || 'Otel benzer bir tesis bulur.' END", f"{_q(_p[5])} || chr(10) || 'Fiyatlar ' || cur || ' cinsindendir. ' || CASE WHEN k % 2 = 0 THEN {_q(P['bank'])} ELSE {_q(P['rate'])} END", f"{_q(_p[6])} || chr(10) || {_fill(P['court'], city="nullif(['İzmir', 'London', ''][c + 1], '')")}", f"{_q(_p[7])} || chr(10) || {_fill(P['prices'], currency='cur')} || coalesce(prices, '')")} || chr(10) AS text FROM m""",
    "synthetic_documents": f"""WITH k AS (SELECT *, {y._draw("'dil'", y.SEED + 2)} < 0.5 AS tr FROM (SELECT {K} AS k FROM orders)) SELECT k AS doc_id, CASE WHEN tr THEN 'tr' ELSE 'en' END AS language, CASE WHEN tr THEN {y._whole('1', '6', "'sablon'", y.SEED + 2)} ELSE {y._whole('1', '3', "'sablon'", y.SEED + 2)} END AS layout, {y._one(t.DATES, "'tarih'", y.SEED + 2)} AS dates, {y._one(t.NUMBERS, "'sayi'", y.SEED + 2)} AS numbers,
      {y._draw("'yapisik'", y.SEED + 2)} < 0.1 AS glued, {y._draw("'fazladan'", y.SEED + 2)} < 0.2 AS extra, {y._one(t.FAMILIES, "'otel'", y.SEED + 2)} || CASE WHEN tr THEN ' Otel' ELSE ' Hotel' END AS hotel, {y._one(t.FAMILIES, "'acente'", y.SEED + 2)} || CASE WHEN tr THEN ' Turizm' ELSE ' Travel' END AS agent, {y._one(t.CURRENCIES, "'para'", y.SEED + 2)} AS currency,
      CASE WHEN tr THEN {y._one(t.CITIES['tr'], "'sehir'", y.SEED + 2)} ELSE {y._one(t.CITIES['en'], "'sehir'", y.SEED + 2)} END AS city, true AS shown FROM k""",
}
