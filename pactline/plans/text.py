"""Text, number and date functions over the text tables and literal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.functions import text as x
from pactline.sources.tables import load

#: fixed values: masking samples that the tables lack
PII = ("Tel: 0532 123 45 67", "Tel: 05321234567", "Tel: +90 532 123 45 67", "Tel: +905321234567", "Kimlik no 12345678901 var", "a@b.co 05321234567 12345678901", "ç12345678901", "x12345678901", "123456789012", "")
#: fixed values: Turkish samples
TURKISH = ("İSTANBUL Kış ", " ŞUBAT", "ığdır ÖÇÜ", "I i İ ı")
#: fixed values: numbers and dates as people write them
NUMBERS = ("1.500,25", "1,500.25", "48,00", "161GBP", "€ 12", "", "1.500", "12", "12.5", "abc")
DATES = ("1 Nisan 2026", "31.10.2026", "2026-04-01", "15/08/2026", "3-9-2026", "1 March 2026", "31.02.2026", "yarın", "")


def _literal(s: SparkSession, values: tuple[str, ...]) -> DataFrame:
    return s.createDataFrame([(-k - 1, v) for k, v in enumerate(values)], "id long, text string")


def _values(values: tuple[str, ...]) -> str:
    return ", ".join(f"({-k - 1}, '{v}')" for k, v in enumerate(values))


def _texts(s: SparkSession, p: str) -> DataFrame:
    return load(s, p, "documents").select(F.col("doc_id").alias("id"), "text").unionByName(_literal(s, PII))


def _masked(s: SparkSession, p: str) -> DataFrame:
    text, count = x.masked(F.col("text"))
    return _texts(s, p).select("id", F.md5(text).alias("masked_md5"), count.cast("long").alias("n"))


def _counts(s: SparkSession, p: str) -> DataFrame:
    return _texts(s, p).agg(*(F.sum(F.regexp_count("text", F.lit(pattern))).alias(f"n_{k}") for k, (_, pattern) in enumerate(x.MASKS)))


def _numbers(s: SparkSession, p: str) -> DataFrame:
    o = load(s, p, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").cast("long").alias("v"))
    dotted = F.regexp_replace(F.reverse(F.regexp_replace(F.reverse(F.col("v").cast("string")), r"([0-9]{3})(?=[0-9])", "$1.")), "x", "")
    text = F.when(F.col("id") % 3 == 0, F.concat(dotted, F.lit(",50 EUR"))).when(F.col("id") % 3 == 1, F.concat(F.lit("USD "), F.replace(dotted, F.lit("."), F.lit(",")), F.lit(".25"))).otherwise(F.concat(F.col("v").cast("string"), F.lit(",75")))
    return o.select("id", text.alias("text")).unionByName(_literal(s, NUMBERS)).select("id", x.loose_number(F.col("text")).alias("number"))


def _dates(s: SparkSession, p: str) -> DataFrame:
    o = load(s, p, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("d"))
    text = F.when(F.col("id") % 3 == 0, F.date_format("d", "yyyy-MM-dd")).when(F.col("id") % 3 == 1, F.date_format("d", "dd.MM.yyyy")).otherwise(F.date_format("d", "dd/MM/yyyy"))
    return o.select("id", text.alias("text")).unionByName(_literal(s, DATES)).select("id", F.date_format(x.parse_date(F.col("text")), "yyyy-MM-dd").alias("day"))


def _margins(s: SparkSession, p: str) -> DataFrame:
    """Lines that stand among the first three lines of several documents of a source, with their counts."""
    d = load(s, p, "documents").select("source", "doc_id", F.slice(F.filter(F.split(x.line_endings(F.col("text")), "\n"), lambda v: F.trim(v) != ""), 1, 3).alias("lines"))
    pages = d.groupBy("source").agg(F.count("*").alias("pages"))
    seen = d.select("source", "doc_id", F.explode(F.array_distinct("lines")).alias("line")).groupBy("source", "line").agg(F.count("*").alias("n"))
    return seen.join(pages, "source").where("pages >= 2 and n >= 2").select("source", F.md5("line").alias("line_md5"), "n")


#: fixed values: an alias table and the values it leads to
PRIORITY = {"acil": "urgent", "1-urgent": "urgent", "2-high": "high", "3-medium": "medium"}
LEVELS = ("urgent", "high", "medium", "low", "not_specified")

QUERIES = {
    "mask_pii": _masked,
    "mask_counts": _counts,
    "clean_line_endings": lambda s, p: load(s, p, "pages").select("page_id", F.md5(x.line_endings(F.col("html"))).alias("md5")),
    "collapse_blank_lines": lambda s, p: load(s, p, "pages").select("page_id", F.md5(x.collapse_blank_lines(F.regexp_replace("html", ">", ">\n\n\n"))).alias("md5")),
    "repeated_margin_lines": _margins,
    "page_info": lambda s, p: load(s, p, "documents").select("doc_id", F.length("text").cast("long").alias("chars"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"), (F.trim("text") != "").alias("has_text")),
    "fold_tr": lambda s, p: load(s, p, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("text")).unionByName(_literal(s, TURKISH)).select("id", x.fold_turkish(F.col("text")).alias("folded")),
    "section_between": lambda s, p: load(s, p, "pages").select("page_id", F.md5(x.section_between(F.col("html"), ["<body", "<p"], ["</body>", "</p>"])).alias("md5")),
    "first_last_int": lambda s, p: load(s, p, "pages").select("page_id", x.first_int(F.col("url")).alias("first"), x.last_int(F.col("url")).alias("last")),
    "evidence_contains": lambda s, p: load(s, p, "documents").select("doc_id", *(F.contains(F.lower("text"), F.lit(w)).alias(n) for w, n in (("license", "license"), ("token", "token"), ("public", "public")))),
    "currency_tokens": lambda s, p: load(s, p, "conversations").select("conv_id", "turn", x.has_currency(F.col("text"), "the").alias("has")),
    "parse_loose_number": _numbers,
    "parse_date_multi": _dates,
    "canonical_enum": lambda s, p: load(s, p, "orders").select("o_orderkey", x.canonical(F.col("o_orderpriority"), PRIORITY, LEVELS).alias("level")),
    "prune_unknown_keys": lambda s, p: load(s, p, "events").select("event_id", F.array_join(F.array_except(F.json_object_keys("props"), F.array(F.lit("event"))), ",").alias("unknown")),
    "ua_label": lambda s, p: load(s, p, "pages").select("page_id", x.device_label(F.concat("url", F.when(F.col("page_id") % 3 == 0, " Firefox Linux").when(F.col("page_id") % 3 == 1, " Chrome Safari Windows").otherwise(" curl"))).alias("label")),
    "search_filter": lambda s, p: load(s, p, "part").where(F.contains(F.lower(F.translate(F.concat_ws(" ", "p_name", "p_brand", "p_type"), "Iİ", "ıi")), F.lit("red"))).select("p_partkey"),
    "slug_codes": lambda s, p: load(s, p, "part").select("p_partkey", x.slug(F.concat_ws(" - ", "p_type", "p_brand")).alias("slug")),
    "email_masking": lambda s, p: load(s, p, "supplier").select("s_suppkey", x.mask_email(F.concat(F.lower("s_name"), F.when(F.col("s_suppkey") % 4 == 0, "").otherwise("@example.com"))).alias("masked")),
}
_A = r"'[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}'"
_B = r"'\+90[\t\n\f\r ]*[0-9]{3}[\t\n\f\r ]*[0-9]{3}[\t\n\f\r ]*[0-9]{2}[\t\n\f\r ]*[0-9]{2}'"
_D = r"'\b05[0-9]{2}[\t\n\f\r ]*[0-9]{3}[\t\n\f\r ]*[0-9]{2}[\t\n\f\r ]*[0-9]{2}\b'"
_E = r"'\b[0-9]{11}\b'"
_TEXTS = f"texts AS (SELECT doc_id AS id, text FROM documents UNION ALL SELECT * FROM (VALUES {_values(PII)}) t(id, text))"
_LINES = r"regexp_replace(replace(replace({0}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?m)[ \t]+$', '', 'g')"
_TR = "translate(trim({0}), 'İIıŞşĞğÜüÖöÇç', 'iiissgguuoocc')"
SQL = {
    "mask_pii": f"WITH {_TEXTS}, a AS (SELECT id, regexp_replace(text, {_A}, '[EPOSTA]', 'g') AS t, len(regexp_extract_all(text, {_A})) AS n FROM texts), b AS (SELECT id, regexp_replace(t, {_B}, '[TELEFON]', 'g') AS t, n + len(regexp_extract_all(t, {_B})) AS n FROM a), c AS (SELECT id, regexp_replace(t, {_D}, '[TELEFON]', 'g') AS t, n + len(regexp_extract_all(t, {_D})) AS n FROM b) SELECT id, md5(regexp_replace(t, {_E}, '[TCKN]', 'g')) AS masked_md5, n + len(regexp_extract_all(t, {_E})) AS n FROM c",
    "mask_counts": f"WITH {_TEXTS} SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, {r}))) AS BIGINT) AS n_{k}" for k, r in enumerate((_A, _B, _D, _E))) + " FROM texts",
    "clean_line_endings": f"SELECT page_id, md5({_LINES.format('html')}) AS md5 FROM pages",
    "collapse_blank_lines": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '>', '>' || chr(10) || chr(10) || chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10))) AS md5 FROM pages",
    "repeated_margin_lines": f"WITH d AS (SELECT source, doc_id, list_distinct(list_filter(string_split({_LINES.format('text')}, chr(10)), lambda x: trim(x) <> '')[1:3]) AS lines FROM documents), l AS (SELECT source, unnest(lines) AS line FROM d), n AS (SELECT source, line, count(*) AS n FROM l GROUP BY source, line) SELECT source, md5(line) AS line_md5, n FROM n JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) USING (source) WHERE pages >= 2 AND n >= 2",
    "page_info": "SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, trim(text) <> '' AS has_text FROM documents",
    "fold_tr": f"SELECT id, lower({_TR.format('text')}) AS folded FROM (SELECT c_custkey AS id, c_name AS text FROM customer UNION ALL SELECT * FROM (VALUES {_values(TURKISH)}) t(id, text))",
    "section_between": "WITH l AS (SELECT page_id, lower(html) AS h FROM pages), s AS (SELECT page_id, h, list_min(list_filter([strpos(h, '<body'), strpos(h, '<p')], lambda x: x > 0)) AS a FROM l), t AS (SELECT page_id, a, substr(h, a) AS t FROM s), e AS (SELECT page_id, a, t, list_min(list_filter([strpos(substr(t, 41), '</body>'), strpos(substr(t, 41), '</p>')], lambda x: x > 0)) AS b FROM t) SELECT page_id, md5(CASE WHEN a IS NULL THEN '' WHEN b IS NULL THEN t ELSE substr(t, 1, b + 39) END) AS md5 FROM e",
    "first_last_int": "SELECT page_id, TRY_CAST(regexp_extract(url, '([0-9]+)', 1) AS INTEGER) AS first, TRY_CAST(regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS INTEGER) AS last FROM pages",
    "evidence_contains": "SELECT doc_id, contains(lower(text), 'license') AS license, contains(lower(text), 'token') AS token, contains(lower(text), 'public') AS public FROM documents",
    "currency_tokens": "SELECT conv_id, turn, regexp_matches(lower(text), '(^|[^a-z0-9])the($|[^a-z0-9])') AS has FROM conversations",
    "parse_loose_number": "SELECT o_orderkey AS id, CAST(CASE o_orderkey % 3 WHEN 0 THEN floor(o_totalprice) + 0.5 WHEN 1 THEN floor(o_totalprice) + 0.25 ELSE floor(o_totalprice) + 0.75 END AS DOUBLE) AS number FROM orders UNION ALL SELECT * FROM (VALUES (-1, 1500.25), (-2, 1500.25), (-3, 48.0), (-4, 161.0), (-5, 12.0), (-6, NULL), (-7, 1500.0), (-8, 12.0), (-9, 12.5), (-10, NULL)) t(id, number)",
    "parse_date_multi": "SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION ALL SELECT * FROM (VALUES (-1, '2026-04-01'), (-2, '2026-10-31'), (-3, '2026-04-01'), (-4, '2026-08-15'), (-5, '2026-09-03'), (-6, '2026-03-01'), (-7, NULL), (-8, NULL), (-9, NULL)) t(id, day)",
    "canonical_enum": "SELECT o_orderkey, CASE lower(o_orderpriority) WHEN '1-urgent' THEN 'urgent' WHEN '2-high' THEN 'high' WHEN '3-medium' THEN 'medium' WHEN 'urgent' THEN 'urgent' WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' WHEN 'low' THEN 'low' ELSE 'belirtilmemis' END AS level FROM orders",
    "prune_unknown_keys": "SELECT event_id, array_to_string(list_filter(json_keys(props), lambda x: x <> 'event'), ',') AS unknown FROM events",
    "ua_label": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'Firefox / Linux' WHEN 1 THEN 'Chrome / Windows' ELSE 'Tarayıcı / Bilinmeyen' END AS label FROM pages",
    "search_filter": "SELECT p_partkey FROM part WHERE contains(lower(translate(concat_ws(' ', p_name, p_brand, p_type), 'Iİ', 'ıi')), 'red')",
    "slug_codes": r"SELECT p_partkey, trim(substr(regexp_replace(upper(p_type || ' - ' || p_brand), '[^A-Z0-9]+', '_', 'g'), 1, 40), '_') AS slug FROM part",
    "email_masking": "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '***' ELSE substr(lower(s_name), 1, 1) || '***@example.com' END AS masked FROM supplier",
}
