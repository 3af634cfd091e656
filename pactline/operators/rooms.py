"""Room allotments held against the contract's text: which numbers stand near which room names.

A room name is near a number that stands in the same line, in the 24 bytes before the name (the
last one there) or else in the 40 bytes after it (the first one). Texts are read as lines, and
all names are looked up in a line at once, so a contract of any length is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactline.functions import grounding as g
from pactline.functions import text as x

BEFORE, AFTER = 24, 40  # bytes
MOST = 10_000  # what the text alone says counts below this
#: fixed values: the order in which room types are given
ORDER = ("standart", "suit", "balayi", "engelli", "aile", "deluxe")


def _as_bytes(text: Column) -> Column:
    """A character for each byte of the UTF-8 text, so that places and lengths are those of bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def _number(pattern: str, text: Column) -> Column:
    # an empty text would cost an exception for each row
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("bigint")


def scope_lines(contracts: DataFrame) -> DataFrame:
    """(doc_id, sectioned, line, text): lines of the allotment section; of the whole contract, in lower case, where it has none."""
    sections = F.transform(F.array(g.allotment_section(F.col("text"))), lambda s: F.struct((s != "").alias("sectioned"), F.split(F.when(s != "", s).otherwise(x.lower_simple(F.col("text"))), "\n", -1).alias("lines")))
    each = contracts.select("doc_id", F.explode(sections).alias("x")).select("doc_id", "x.sectioned", F.posexplode("x.lines").alias("line", "text"))
    return each.where(F.col("text").rlike("[0-9]"))


def near_numbers(lines: DataFrame) -> DataFrame:
    """``lines`` (a column ``text`` in lower case) with a row for each place of a room name: kind, word (its rank among the names of its kind), place, n.

    Names that contain each other are found at each of their places; ``n`` is the number near, null without one.
    """
    names = F.array(*(F.struct(F.lit(kind).alias("kind"), F.lit(k).alias("word"), F.lit(word.encode().decode("latin-1")).alias("name")) for kind, words in g.ROOM_WORDS.items() for k, word in enumerate(words)))
    own = lines.columns
    rows = lines.withColumn("__b", _as_bytes(F.col("text"))).withColumn("__m", F.explode(F.filter(names, lambda m: F.contains("__b", m["name"]))))
    name = F.col("__m.name")
    times = (F.length("__b") - F.length(F.replace("__b", name, F.lit("")))) / F.length(name)
    rows = rows.withColumn("__k", F.explode(F.sequence(F.lit(1), times.cast("int")))).withColumn("__before", F.call_function("substring_index", F.col("__b"), name, F.col("__k")))
    place = F.length("__before")
    after = F.substr(F.col("__b"), place + F.length(name) + 1, F.lit(AFTER))
    return rows.select(*own, "__m.kind", "__m.word", place.alias("place"), F.coalesce(_number("([0-9]+)[^0-9]*$", F.right("__before", F.lit(BEFORE))), _number("([0-9]+)", after)).alias("n"))


def json_int(v: Column) -> Column:
    """A JSON value as a whole number: numbers are truncated, texts give their number or the first one in them; else 0."""
    kind, text = F.schema_of_variant(v), F.trim(F.try_variant_get(v, "$", "string"))
    number = F.try_variant_get(v, "$", "double")
    cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("bigint")
    return F.coalesce(F.when(kind == "STRING", F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")), _number("([0-9]+)", text))).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), cut), F.lit(0)).cast("bigint")


def grounded_rooms(contracts: DataFrame, rows: DataFrame) -> DataFrame:
    """(doc_id, rank, room, quantity): the allotments of a contract (doc_id, text) that its text bears out.

    ``rows`` (doc_id, room, quantity) are extracted ones; those count whose quantity stands near a
    name of their type. Types that are missing then are read from the allotment section. Where
    both leave a contract with nothing, the extracted rows count as they are. Of several
    quantities of a type the largest counts, of accessible rooms the smallest.
    """
    given = rows.select("doc_id", g.room_type(F.col("room")).alias("kind"), F.col("quantity").cast("bigint").alias("n"), F.lit(True).alias("given")).where("kind <> '' and n > 0")
    # (word, line, place) as one number, 3 + 30 + 30 bits, as a text has at most 2^30 lines and bytes here: least structs are found by sorting, least numbers by hashing
    at = F.shiftleft(F.col("word").cast("bigint"), 60).bitwiseOR(F.shiftleft(F.col("line").cast("bigint"), 30)).bitwiseOR(F.col("place").cast("bigint"))
    stated = F.col("sectioned") & (F.col("n") > 0) & (F.col("n") < MOST)
    seen = near_numbers(scope_lines(contracts)).where("n is not null").select("doc_id", "kind", "n", F.lit(True).alias("seen"), F.when(stated, at).alias("at"))
    # one row for each number of a type, then one for each type
    numbers = given.unionByName(seen, allowMissingColumns=True).groupBy("doc_id", "kind", "n").agg(F.max("given").alias("given"), F.max("seen").alias("seen"), F.min("at").alias("at"))
    largest = lambda who: F.when(F.col("kind") == "engelli", F.min(F.when(who, F.col("n")))).otherwise(F.max(F.when(who, F.col("n"))))
    types = numbers.groupBy("doc_id", "kind").agg(largest(F.col("given") & F.col("seen")).alias("near"), largest(F.col("given")).alias("every"), F.min_by("n", "at").alias("stated"), F.max("at").alias("at"))
    types = types.withColumn("found", F.coalesce("near", F.when(F.col("at").isNotNull(), F.col("stated"))))
    some = F.max(F.col("found").isNotNull()).over(Window.partitionBy("doc_id"))
    rank = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind")).cast("int")
    return types.withColumn("quantity", F.when(some, F.col("found")).otherwise(F.col("every"))).where("quantity is not null").select("doc_id", rank.alias("rank"), F.col("kind").alias("room"), "quantity")


def mentioned_types(section: Column, raw: Column) -> Column:
    """Whether a section names the room type that a text stands for, by that text or any name of the type."""
    low, own, kind, found = x.lower_simple(section), F.lower(g.stripped(raw)), g.room_type(raw), F.lit(False)
    for name, words in g.ROOM_WORDS.items():
        found = found | ((kind == name) & g.mentions(low, words))
    return F.coalesce(((own != "") & F.contains(low, own)) | found, F.lit(False))


def hint_lines(section: Column) -> Column:
    """How many lines of a price section are about rooms and hold a number."""
    return F.size(F.filter(F.split(x.lower_simple(section), "\n", -1), lambda line: g.mentions(line, g.ROOM_HINTS) & line.rlike("[0-9]")))
