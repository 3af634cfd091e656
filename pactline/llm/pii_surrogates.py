"""Surrogates for personal data, in DataFrame operations only.

E-mail addresses, phone numbers, IPv4 addresses, payment card numbers and names after a
form of address are found by one expression. Each is taken apart into items: a mail domain and
a local part, the digits after a country code, the digits of a card, the parts of an address,
a family name and a given name. Every distinct item gets a replacement derived from a key.

* Local parts, domains and digits are permuted: each character is shifted within its alphabet
  or the digits by an amount drawn from the key and the characters before it, once from the
  left and once from the right. That is a bijection of all strings of one shape, so items of a
  shape stay distinct by construction and keep their format. Mail domains end in the reserved
  ``example`` and are shared by their addresses; country codes and the first digit of cards
  stay, and a card number with a valid check digit gets a valid one; address parts keep their
  number of digits and stay below 256 if they were.
* Family names are built from syllables in the same script and do not depend on the form of
  address, given names come from a list for its gender, so ``Mr Smith``, ``Mr. Smith`` and
  ``Mr John Smith`` agree.

Distinctness is checked: a replacement that another item of its scope also has, or that is
itself an item of the corpus, is derived anew. Where a shape has no room, replacements grow:
names by a syllable or a further given name at each attempt, strings and digits by a character
from the ``WIDEN``-th attempt on, address parts become three digits one by one. So the
attempts end; more than ``ATTEMPTS`` raise an error.

Defined cases: a null text stays null; texts without entities stay as they are; repeated rows
and repeated or null doc_ids keep their own texts and get equal replacements; an empty table
gives an empty result; other columns are kept as they are, whatever their names; an empty key
is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._spark import by_row, saved, table, unused

_L = r"[\p{L}\p{N}._%+-]"
#: fixed values: forms of address by gender
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Господин"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Госпожа")
EMAIL = rf"(?<!{_L}){_L}++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+"
PHONE = r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+(])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?![\p{L}\p{N}])"
IP = r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)"
CARD = r"(?<![\p{L}\p{N}])(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{13,19})(?![\p{L}\p{N}])"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(MALE + FEMALE)})\.? \p{{Lu}}\p{{Ll}}+(?: \p{{Lu}}\p{{Ll}}+)?"
ENTITY = "|".join((EMAIL, IP, CARD, PHONE, NAME))
#: fixed values: alphabets in which a letter is replaced by another
ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "àáâäçèéêëíîïñóôöúùûüß", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω")
#: fixed values: given names by gender and script
GIVEN = {
    ("m", "latin"): ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Robert", "Simon", "Thomas", "Victor"),
    ("f", "latin"): ("Alice", "Bella", "Clara", "Diana", "Emma", "Flora", "Helena", "Julia", "Laura", "Maria", "Nora", "Olivia", "Paula", "Rosa", "Sara", "Vera"),
    ("m", "cyrillic"): ("Антон", "Борис", "Виктор", "Денис", "Иван", "Максим", "Павел", "Роман"),
    ("f", "cyrillic"): ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Ольга", "София"),
}
#: fixed values: syllables of family names by script
SYLLABLES = {"latin": ("ba", "den", "fel", "gar", "hol", "ker", "lin", "mar", "nor", "pas", "ren", "sel", "tor", "val", "wen", "zan"), "cyrillic": ("ба", "вел", "гор", "дан", "зор", "кел", "лин", "мар", "нов", "пел", "рам", "сев", "тор", "фед", "хол", "юр")}
WIDEN = 6
ATTEMPTS = 60
FEW = 20_000  # distinct entities whose replacements are sent to every task; more are joined by a shuffle


def _kind(entity: Column) -> Column:
    whole = lambda pattern: entity.rlike(f"^(?:{pattern})$")
    return F.when(entity.contains("@"), "email").when(whole(IP), "ip").when(whole(CARD), "card").when(whole(PHONE), "phone").otherwise("name")


def _draw(seed: Column, i: Column, n: int) -> Column:
    """A number below n for place i of a replacement."""
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _shifted(text: Column, seed: Column) -> Column:
    """Each letter and digit moved within its alphabet by what the seed and the characters before it say."""

    def step(state: Column, c: Column) -> Column:
        out = c
        for letters in ("0123456789", *ALPHABETS):
            n = len(letters)
            place = F.pmod(F.instr(F.lit(letters), c) - 1 + _draw(seed, state["seen"], n), F.lit(n)) + 1
            out = F.when(F.lit(letters).contains(c), F.substr(F.lit(letters), place, F.lit(1))).otherwise(out)
        return F.struct(F.xxhash64(state["seen"], c).alias("seen"), F.concat(state["out"], out).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit("").alias("out"))
    return F.aggregate(F.split(text, ""), start, step, lambda state: state["out"])


def _permuted(text: Column, seed: Column) -> Column:
    """A bijection of the strings of one shape in which each character depends on all others."""
    return F.when(F.length(text) > 0, F.reverse(_shifted(F.reverse(_shifted(text, seed)), F.concat(seed, F.lit("r"))))).otherwise(text)


def _checked(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    twice = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, twice(c.cast("int"))).otherwise(c.cast("int")))
    return F.aggregate(values, F.lit(0), lambda t, x: t + x)


def _replacement(key: str) -> Column:
    """The replacement of an item (kind, scope, form, attempt)."""
    kind, scope, form, attempt = (F.col(c) for c in ("kind", "scope", "form", "attempt"))
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, scope, attempt.cast("string")), 256)
    own = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, scope, attempt.cast("string"), form), 256)
    wider = F.greatest(F.lit(0), attempt - (WIDEN - 1))
    longer = lambda x, fill: F.concat(x, F.repeat(F.lit(fill), wider))
    domain = F.concat(_permuted(longer(F.regexp_replace(form, r"\.[^.]*$", ""), "a"), F.concat(seed, F.substring_index(form, ".", -1))), F.lit(".example"))
    # a card's last digit keeps its distance from the check digit
    first, last = F.substr(form, F.lit(1), F.lit(1)), F.substr(form, F.length(form)).cast("int")
    check = lambda digits: (10 - _checked(F.concat(digits, F.lit("0"))) % 10) % 10
    body = F.concat(first, _permuted(longer(F.substr(form, F.lit(2), F.length(form) - 2), "0"), F.concat(seed, first)))
    card = F.concat(body, F.pmod(check(body) + last - check(F.substr(form, F.lit(1), F.length(form) - 1)), F.lit(10)).cast("string"))

    def part(state: Column, p: Column) -> Column:
        """One part of an address, moved within the numbers of its class."""
        grown = F.when(state["i"] < wider, F.lpad((F.pmod(p.cast("int"), F.lit(156)) + 100).cast("string"), 3, "0")).otherwise(p)
        value, n = grown.cast("int"), F.length(grown)
        low = F.when(grown.startswith("0") | (n == 1), 0).when(n == 2, 10).when(value > 255, 256).otherwise(100)
        size = F.when(n == 1, 10).when(grown.startswith("0"), F.when(n == 2, 10).otherwise(100)).when(n == 2, 90).when(value > 255, 744).otherwise(156)
        moved = low + F.pmod(value - low + F.xxhash64(seed, state["seen"]), size)
        return F.struct((state["i"] + 1).alias("i"), F.xxhash64(state["seen"], p).alias("seen"), F.array_append(state["out"], F.lpad(moved.cast("string"), n, "0")).alias("out"))

    start = F.struct(F.lit(0).alias("i"), F.lit(0).cast("long").alias("seen"), F.array().cast("array<string>").alias("out"))
    ip = F.aggregate(F.split(form, r"\."), start, part, lambda state: F.array_join(state["out"], "."))
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), _draw(own, i, len(values)) + 1)
    family = given = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        built = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 3), lambda i: pick(syllables, i)), ""))  # noqa: B023
        family = F.when(scope == script, built).otherwise(family)
    for (gender, script), names in GIVEN.items():
        chosen = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: pick(names, i)), "-")  # noqa: B023
        given = F.when(scope.startswith(f"{gender} {script} "), chosen).otherwise(given)
    return (
        F.when(kind == "local", _permuted(longer(form, "a"), seed)).when(kind == "domain", domain).when(kind == "card", card)
        .when(kind == "phone", _permuted(longer(form, "0"), seed)).when(kind == "ip", ip).when(kind == "family", family).when(kind == "given", given)
    )


def _items(e: Column, kind: Column) -> Column:
    """The items (kind, scope, form) that an entity is made of; replacements are distinct within a scope."""
    item = lambda k, scope, form: F.struct(F.lit(k).alias("kind"), scope.alias("scope"), form.alias("form"))
    none, digits = F.lit(""), F.regexp_replace(e, r"\D", "")
    local, domain = F.lower(F.substring_index(e, "@", 1)), F.lower(F.substring_index(e, "@", -1))
    names = F.split(e, " ")
    family, script = F.lower(F.element_at(names, -1)), F.when(e.rlike(r" \p{IsCyrillic}"), "cyrillic").otherwise("latin")
    gender = F.when(F.regexp_replace(F.get(names, 0), r"\.", "").isin(*FEMALE), "f").otherwise("m")
    named = F.array(item("family", script, family))
    full = F.concat(named, F.array(item("given", F.concat_ws(" ", gender, script, family), F.lower(F.get(names, 1)))))
    return (
        F.when(kind == "email", F.array(item("domain", none, domain), item("local", domain, local)))
        .when(kind == "ip", F.array(item("ip", none, e)))
        .when(kind == "card", F.array(item("card", none, digits)))
        .when(kind == "phone", F.array(item("phone", F.substr(digits, F.lit(1), _code(e)), F.substr(digits, _code(e) + 1))))
        .otherwise(F.when(F.size(names) > 2, full).otherwise(named))
    )


def _code(e: Column) -> Column:
    """How many digits of a phone number are its country code."""
    return F.length(F.regexp_replace(F.regexp_extract(e, r"^\+(\d{1,3})[ .(-]", 1), r"\D", ""))


def _chosen(items: DataFrame, key: str) -> DataFrame:
    """(kind, scope, form, new) for each distinct item."""
    own = ["kind", "scope"]
    real = items.select(*own, F.col("form").alias("taken"))
    pending, accepted = items.withColumn("attempt", F.lit(0)), None
    for _ in range(ATTEMPTS):
        drawn = saved(pending.withColumn("new", _replacement(key)).withColumn("taken", F.lower("new")))
        used = real if accepted is None else real.unionByName(accepted.select(*own, F.lower("new").alias("taken")))
        owners = drawn.groupBy(*own, "taken").agg(F.min("form").alias("owner"))
        judged = drawn.join(owners, [*own, "taken"]).join(used.distinct().withColumn("clash", F.lit(True)), [*own, "taken"], "left")
        judged = saved(judged.select(*own, "form", "attempt", "new", (F.col("clash").isNull() & (F.col("owner") == F.col("form"))).alias("good")))
        good = judged.where("good").select(*own, "form", "new")
        accepted = good if accepted is None else accepted.unionByName(good)
        pending = judged.where("not good").select(*own, "form", (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return accepted
    raise ValueError(f"no distinct replacements after {ATTEMPTS} attempts")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(entity, kind, surrogate) for each distinct value of the column entity."""
    if not key:
        raise ValueError("surrogates need a key of the caller's")
    e = F.col("entity")
    marked = saved(entities.select("entity").distinct().withColumn("kind", _kind(e)).withColumn("items", _items(e, F.col("kind"))))
    every = marked.select("entity", F.col("kind").alias("of"), F.explode("items").alias("x")).select("entity", "of", "x.*")
    chosen = _chosen(saved(every.select("kind", "scope", "form").distinct()), key)
    pick = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("new")))
    both = every.join(chosen, ["kind", "scope", "form"]).groupBy("entity", "of").agg(pick("local").alias("local"), pick("domain").alias("domain"), pick("family").alias("family"), pick("given").alias("given"), F.max("new").alias("new"))
    code = F.when(F.col("of") == "phone", _code(e)).otherwise(0)
    digit_at = lambda i: F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), r"\D", "")) - code
    numbered = F.array_join(F.transform(F.split("entity", ""), lambda c, i: F.when(c.between("0", "9") & (digit_at(i) > 0), F.substr("new", digit_at(i), F.lit(1))).otherwise(c)), "")
    more = F.substr("new", F.length(F.regexp_replace(e, r"\D", "")) - code + 1)  # digits that a grown replacement has besides
    upper = lambda i: (i < F.instr(e, "@") - 1) & (F.substr(e, i + 1, F.lit(1)) != F.lower(F.substr(e, i + 1, F.lit(1))))
    cased = F.array_join(F.transform(F.split("local", ""), lambda c, i: F.when(upper(i), F.upper(c)).otherwise(c)), "")
    name = F.concat_ws(" ", F.substring_index(e, " ", 1), "given", "family")
    whole = F.when(F.col("of").isin("phone", "card"), F.concat(numbered, more)).when(F.col("of") == "email", F.concat(cased, F.lit("@"), "domain")).when(F.col("of") == "ip", F.col("new")).otherwise(name)
    return both.select("entity", F.col("of").alias("kind"), whole.alias("surrogate"))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with entities in text replaced, and the column n_entities added (_n_entities where ``docs`` has one of its own, in whatever case)."""
    added = unused(docs, "n_entities")
    return by_row(docs, lambda d: _replaced(d, key, added))


def _replaced(docs: DataFrame, key: str, added: str) -> DataFrame:
    new = unused(docs, "new")
    found = saved(docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(ENTITY), 0)).alias("at", "entity")))
    named = saved(surrogates(found, key).select("entity", "surrogate"))
    small = F.broadcast(named) if named.count() <= FEW else named  # a checked bound
    lists = found.join(small, "entity").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias(new))
    out = docs.join(lists, "doc_id", "left")
    pieces = F.split("text", ENTITY, -1)
    text = F.array_join(F.zip_with(pieces, F.col(new), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    names = [c for c in docs.columns if c != "text"]
    return out.select(*names, F.when(F.col(new).isNull(), F.col("text")).otherwise(text).alias("text"), F.coalesce(F.size(new), F.lit(0)).cast("long").alias(added))


#: the query's key unless the session names one; it hides nothing and serves tests
SAMPLE_KEY = "sample key"


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, spark.conf.get("spark.pactline.surrogates.key", SAMPLE_KEY)).select("doc_id", "n_entities", "text")
