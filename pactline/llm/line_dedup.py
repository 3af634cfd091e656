"""Line deduplication by a segment-partition edit join, in DataFrame operations only.

Lines of at least ``MIN_CHARS`` characters take part; a line goes if an equal line, or one
within ``EDITS`` edits, stands earlier in order of (doc_id, line). Lines are judged on the
input, not on what is left. Shorter lines always stay.

Equal lines become one row first (combined on the map side). Each distinct line is split
into ``EDITS + 1`` segments of nearly equal length. If two lines are within ``EDITS`` edits,
some segment of the shorter one stands unchanged in the longer one, at a start that the
position and the lengths bound. So the segments of all lines are posted under (length,
segment number, text), the longer line probes with the few substrings that could be that
segment, and the pairs that meet are verified.

For the verdict a line needs one earlier partner: in each posting list lines first meet
the line that stands for it (a star); only lines that are still unmatched meet the others
of their lists, and lists that one line stands for are one list then. Pairs whose letters differ in number too often, or that lack too many
of a finer set of segments, are dropped, common
starts and ends are cut, and what differs is verified by a bit-parallel edit distance over a
band of ``2 * EDITS + 1`` diagonals, one step for each character.

Defined cases: a null text has no lines and stays null; an empty text is one empty line;
rows with null or repeated doc_ids are told apart, in the order of doc_id, nulls last, and
among equals in an order fixed for the run; an empty table gives an empty result; other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pactline.llm._spark import by_row, saved, table, unused

EDITS = 2
MIN_CHARS = 30
SHORT = 32  # lines of a list that are compared without a look at their letters
BLOCK = 256
BLOCK_CHARS = 1 << 20
#: fixed values: letters whose counts tell lines apart; which they are changes the work, never the result
LETTERS = "etaoinsrhldcumfpgbvyоеаинтсрвл"
FIRST = 32  # characters of the differing parts that are compared before the rest
FEW = 200_000  # pairs whose ids are sent to every task; more are joined by a shuffle


def _segment(size: str, i: str, k: int) -> tuple[Column, Column]:
    """(start from 1, length) of the i-th of k segments of a line, in integers; the last ones take what is left over."""
    short, whole = f"({size} div {k})", f"({k} - {size} % {k})"  # segments from ``whole`` on (counted from 0) have one character more
    return F.expr(f"CAST({short} * {i} + greatest(0, {i} - {whole}) + 1 AS INT)"), F.expr(f"CAST({short} + IF({i} >= {whole}, 1, 0) AS INT)")


def _probes(edits: int):
    """(length difference, segment, shift) at which the longer line can hold a segment of the shorter one.

    With the segment number from both ends, shifts further out imply more edits on one side
    than are left for it.
    """
    for d in range(edits + 1):
        for i in range(edits + 1):
            for shift in range(-edits, edits + 1):
                if abs(shift) <= i and abs(shift - d) <= edits - i:
                    yield d, i, shift


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def banded_edit_distance(a: Column, b: Column, edits: int) -> Column:
    """The edit distance of two strings if it is at most ``edits``, else some greater number.

    Bit-parallel over the band of 2 * edits + 1 diagonals (Hyyrö's form of Myers' algorithm):
    in column i of b, bit k of the vectors stands for character i - edits + k of a. The score
    follows the lowest diagonal of the band until a ends, then a's last row. The lengths
    differ by at most ``edits``, and a has at least ``edits`` characters.
    """
    width = 2 * edits + 1
    full, top = F.lit((1 << width) - 1), F.lit(1 << (width - 1))
    before = F.array_repeat(F.lit(None).cast("string"), edits)

    def step(state: Column, x: Column) -> Column:
        i, vp, vn = state["i"], state["vp"], state["vn"]
        equal = F.lit(0)
        for k in range(width):
            equal = equal.bitwiseOR(F.when(F.get(state["a"], i + k) == x, 1 << k).otherwise(0))

        def with_equal(eq: Column) -> Column:
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn).bitwiseAND(full)
            return _let(d0, with_d0)

        def with_d0(d0: Column) -> Column:
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp)).bitwiseAND(full))
            hn = d0.bitwiseAND(vp)
            right = F.shiftright(d0, 1)
            row = F.element_at(F.array(*(F.lit(1 << k) for k in range(width))), F.greatest(F.lit(1), state["left"] + (width - 1)))
            along = F.when(hp.bitwiseAND(row) != 0, 1).when(hn.bitwiseAND(row) != 0, -1).otherwise(0)
            change = F.when(state["left"] > 0, F.when(d0.bitwiseAND(top) == 0, 1).otherwise(0)).otherwise(along)
            return F.struct(
                state["a"].alias("a"),
                (i + 1).alias("i"),
                (state["left"] - 1).alias("left"),
                hn.bitwiseOR(F.bitwise_not(right.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"),
                right.bitwiseAND(hp).alias("vn"),
                (state["score"] + change).alias("score"),
            )

        # no cell of the band is below this bound, nor can one of a later column be
        lost = (state["left"] > 0) & (state["score"] - F.bit_count(vp) > edits)
        return F.when(lost, state).otherwise(_let(equal, with_equal))

    start = F.struct(
        F.concat(before, F.split(a, "")).alias("a"),
        F.lit(0).alias("i"),
        (F.length(a) - edits).alias("left"),  # columns until the lowest diagonal leaves a
        F.lit(((1 << (edits + 1)) - 1) << edits).alias("vp"),
        F.lit(0).alias("vn"),
        F.lit(edits).alias("score"),
    )
    lost = lambda state: (state["left"] > 0) & (state["score"] - F.bit_count(state["vp"]) > edits)
    whole = lambda state: F.aggregate(F.split(F.substr(b, F.lit(FIRST + 1)), ""), state, step, lambda end: end["score"])
    # most pairs that are too far apart show it in their first characters; the rest is not cut up then
    return _let(F.aggregate(F.split(F.substr(b, F.lit(1), F.lit(FIRST)), ""), start, step), lambda state: F.when(lost(state), edits + 1).when(F.length(b) <= FIRST, state["score"]).otherwise(whole(state)))


def _most_segments(a: Column, b: Column, edits: int) -> Column:
    """Whether all but ``edits`` of 3 * edits segments of a stand somewhere in b, as they must within ``edits`` edits."""
    pieces = 3 * max(edits, 1)
    size = F.floor(F.length(a) / pieces).cast("int")
    held = F.lit(0)
    for k in range(pieces):
        held = held + F.contains(b, F.substr(a, size * k + 1, size)).cast("int")
    return held >= pieces - edits


def _common(a: Column, b: Column, limit: Column, ends: bool) -> Column:
    """How many characters, at most ``limit`` and 2^18, two strings share at their starts, or at their ends."""

    def grown(n: Column, p: Column) -> Column:
        part = lambda x: F.substr(x, F.length(x) - n - p + 1 if ends else n + 1, p)
        return F.when((n + p <= limit) & (part(a) == part(b)), n + p).otherwise(n)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(17, -1, -1))), F.lit(0), grown)


def within(a: Column, b: Column, edits: int) -> Column:
    """Whether two strings are within ``edits`` edits: segments first, then the distance of what differs.

    Common starts and ends do not change the distance, so they are cut before it is computed.
    """
    most = F.least(F.length(a), F.length(b)) - max(edits, 1)

    def cut(start: Column) -> Column:
        return _let(_common(a, b, most - start, ends=True), lambda end: banded_edit_distance(middle(a, start, end), middle(b, start, end), edits) <= edits)

    middle = lambda x, start, end: F.substr(x, start + 1, F.length(x) - start - end)
    possible = (F.abs(F.length(a) - F.length(b)) <= edits) & _most_segments(a, b, edits)
    return F.when(possible, _let(_common(a, b, most, ends=False), cut)).otherwise(False)


def _within_pair(a: Column, b: Column, edits: int) -> Column:
    """``within`` of two columns, evaluated inside one lambda: as part of a join's generated code it makes a method that takes the compiler very much memory."""
    return _let(F.struct(a.alias("a"), b.alias("b")), lambda p: within(p["a"], p["b"], edits))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, line, text, chars, id, check) of the lines that take part; id and check are two hashes that together stand for the text."""
    every = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("chars", F.length("text"))
    return every.where(F.col("chars") >= min_chars).withColumn("id", F.xxhash64("text")).withColumn("check", F.hash("text"))


def _keys(lines: DataFrame, probes: list[tuple[int, int, int]], edits: int) -> DataFrame:
    """(id, key, posted) of each line and each of the probes (length difference, segment, shift); all fit in a line of at least 2 * edits + 1 characters."""
    # a list of constants is exploded and one expression computes all keys, so that it stays compiled
    places = F.explode(F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(shift).alias("shift")) for d, i, shift in probes))).alias("p")
    placed = lines.select("id", "chars", "text", places).select("id", "chars", "text", (F.col("chars") - F.col("p.d")).alias("size"), F.col("p.i").alias("i"), F.col("p.shift").alias("shift"))
    start, n = _segment("size", "i", edits + 1)
    cut = placed.select("id", "chars", "text", "size", "i", "shift", (start + F.col("shift")).alias("at"), n.alias("n"))
    # where every character is one byte, places are counted in bytes: characters are found by a walk from the start
    part = F.when(F.octet_length("text") == F.col("chars"), F.substr(F.col("text").cast("binary"), F.col("at"), F.col("n"))).otherwise(F.substr("text", F.col("at"), F.col("n")).cast("binary"))
    posted = (F.col("size") == F.col("chars")) & (F.col("shift") == 0)
    return cut.select("id", F.xxhash64("size", "i", part).alias("key"), posted.alias("posted"))


def _letter_counts(text: Column) -> Column:
    """How often each letter of LETTERS occurs, modulo 4, in two bits for each."""
    count = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.aggregate(F.array(*map(F.lit, LETTERS)), F.lit(0).cast("long"), lambda bits, c: F.shiftleft(bits, 2).bitwiseOR(count(c).bitwiseAND(3)))


def _counts_allow(a: Column, b: Column, edits: int) -> Column:
    """Whether two lines of these letter counts can be within ``edits`` edits: each changes how often at most two letters occur."""
    differ = a.bitwiseXOR(b)
    return F.bit_count(differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(0x5555555555555555))) <= 2 * edits


def _near_stars(pairs: DataFrame, known: DataFrame, edits: int) -> DataFrame:
    """(id, check) of the later lines of the pairs (a, b) that are within ``edits`` edits."""
    a, b = (known.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("check", "text", "letters", "first"))) for x in "ab")
    close = pairs.join(a, "a").join(b, "b").where(_counts_allow(F.col("letters_a"), F.col("letters_b"), edits)).where(_within_pair(F.col("text_a"), F.col("text_b"), edits))
    later = F.col("first_a") > F.col("first_b")
    return close.select(F.when(later, F.col("a")).otherwise(F.col("b")).alias("id"), F.when(later, F.col("check_a")).otherwise(F.col("check_b")).alias("check")).distinct()


def _letter_keys(key: Column, text: Column, edits: int) -> Column:
    """``2 * edits + 1`` keys, of which two lines within ``edits`` edits share at least one.

    The letters of LETTERS are dealt to as many groups; an edit changes how often at most two
    letters occur, so the counts of some group are equal.
    """
    groups = 2 * edits + 1
    own = [LETTERS[g::groups] for g in range(groups)]
    count = lambda c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    return F.transform(F.array(*(F.array(*map(F.lit, g)) for g in own)), lambda letters, g: F.xxhash64(key, g, F.transform(letters, count)))


def _near_in_lists(lists: DataFrame, edits: int) -> DataFrame:
    """(id, check) of the open lines that are within ``edits`` edits of an earlier line of one of their lists.

    ``lists``: (key, id, check, text, letters, first, posted, open). Lists of more than ``SHORT`` lines are
    dealt out again by the counts of letters. What stands in one list then meets in blocks of
    at most about ``BLOCK`` lines or ``BLOCK_CHARS`` characters, a row for each pair of blocks;
    lines that have no earlier partner yet look for one in the rows' arrays, and pairs of lines
    are never written.
    """
    sizes = lists.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any and n > 1").select("key", "n")
    lists = lists.join(sizes, "key")
    # saved, as it is read for the sizes and for the blocks
    fine = saved(lists.withColumn("key", F.explode(F.when(F.col("n") > SHORT, _letter_keys(F.col("key"), F.col("text"), edits)).otherwise(F.array("key")))).drop("n"))
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("m") / BLOCK_CHARS)).cast("int")
    sizes = fine.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("m"), F.max("open").alias("any")).where("any and n > 1").select("key", parts.alias("parts"))
    placed = fine.join(sizes, "key").withColumn("own", F.pmod(F.hash("id"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = placed.groupBy("key", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y")).agg(F.collect_list(F.struct("id", "check", "text", F.length("text").alias("chars"), "letters", "first", "posted", "open", "own")).alias("own"))

    def partner(x: Column) -> Column:
        near = lambda y: (y["first"] < x["first"]) & (x["posted"] | y["posted"]) & (F.abs(x["chars"] - y["chars"]) <= edits) & _counts_allow(x["letters"], y["letters"], edits) & within(x["text"], y["text"], edits)
        return F.exists("own", near)

    return blocks.select(F.explode(F.filter("own", lambda x: x["open"] & partner(x))).alias("x")).select("x.id", "x.check").distinct()


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line) of the lines that repeat an earlier line, lines counted from 0."""
    min_chars = max(min_chars, 3 * max(edits, 1))
    lines = _lines(docs, min_chars)
    at = F.struct("doc_id", "line")
    firsts = saved(lines.select("id", "check", at.alias("at")).groupBy("id", "check").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    posts = [(0, i, 0) for i in range(edits + 1)]
    probes = posts + [p for p in _probes(edits) if p not in posts]
    # the least and the greatest id stand for a list: a list of one line has no other use
    heads = _keys(lines, posts, edits).groupBy("key").agg(F.min("id").alias("head"), F.max("id").alias("last"))
    # a row for each list is held while lines stream past: neither side is sorted
    met = _keys(lines, probes, edits).join(heads.hint("shuffle_hash"), "key").where("id <> head or head <> last")
    hits = saved(met.select("key", "id", "head", "posted", (F.col("head") != F.col("last")).alias("many")).distinct())
    ids = saved(hits.select(F.explode(F.array("id", "head")).alias("id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= FEW else ids  # only so many ids are sent to every task; more are joined by a shuffle
    texts = lines.join(ids, "id", "left_semi").groupBy("id", "check").agg(F.min("text").alias("text"))
    known = saved(texts.join(firsts, ["id", "check"]).select("id", "check", "text", _letter_counts(F.col("text")).alias("letters"), "first"))
    stars = hits.where("id <> head").select(F.least("id", "head").alias("a"), F.greatest("id", "head").alias("b")).distinct()
    done = saved(_near_stars(stars, known, edits))
    # lists of several lines: those without a partner yet look for one among the others
    # lists of one head are one list: lines that share several lists would meet in each of them
    several = hits.where("many").groupBy("head", "id").agg(F.max("posted").alias("posted"))
    members = several.join(known, "id").join(done.withColumn("done", F.lit(True)), ["id", "check"], "left")
    members = members.select(F.col("head").alias("key"), "id", "check", "text", "letters", "first", "posted", (F.col("done").isNull() & (F.col("id") != F.col("head"))).alias("open"))
    gone = done.unionByName(_near_in_lists(members, edits)).distinct()
    flagged = firsts.join(gone.withColumn("near", F.lit(True)), ["id", "check"], "left").where("n > 1 or near").select("id", "check", "first", F.coalesce("near", F.lit(False)).alias("near"))
    return lines.select("doc_id", "line", "id", "check").join(flagged, ["id", "check"]).where(F.col("near") | (at != F.col("first"))).select("doc_id", "line")


def without_repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the repeated lines taken out of text, and the columns n_lines and n_removed added.

    Columns of ``docs`` that have these names, in whatever case, are kept, and the added ones are _n_lines and _n_removed then.
    """
    added = unused(docs, "n_lines"), unused(docs, "n_removed")
    return by_row(docs, lambda d: _without(d, added, edits, min_chars))


def _without(docs: DataFrame, added: tuple[str, str], edits: int, min_chars: int) -> DataFrame:
    gone = unused(docs, "gone")
    repeated = repeated_lines(docs, edits, min_chars).groupBy("doc_id").agg(F.collect_list("line").alias(gone))
    # the places that stay come from a set, so that a long text takes time in proportion to its lines
    stay = lambda lines: F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone)), lambda i: F.get(lines, i))
    kept = F.array_join(F.get(F.transform(F.array(F.split("text", "\n")), stay), 0), "\n")
    names = [c for c in docs.columns if c != "text"]
    lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    return docs.join(repeated, "doc_id", "left").select(*names, F.when(F.col(gone).isNull(), F.col("text")).otherwise(kept).alias("text"), lines.alias(added[0]), F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(added[1]))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


def without_line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with repeated lines taken out of their texts."""
    return without_repeated_lines(docs).select(docs.columns)
