"""Column functions for field edits: what a user types into a form becomes typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: separators of a period's two dates, in the order in which they are tried
PERIOD_SEPARATORS = (" – ", " — ", " - ", "–", "—")
#: fixed values: spellings of enumerations in forms
UNITS = {"ODA_GECELIK": "oda_gecelik", "KISI_GECELIK": "kisi_gecelik"}
BOARDS = {k: k for k in ("RO", "BB", "HB", "FB", "AI")} | {"BELIRTILMEMIS": "belirtilmemis"}
SCOPES = {"ISIM_LISTESI": "isim_listesi", "KONTENJAN_IADESI": "kontenjan_iadesi", "HER_IKISI": "her_ikisi", "BELIRTILMEMIS": "belirtilmemis"}


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Text without white space around it; null for nothing."""
    return F.nullif(stripped(text), F.lit(""))


def lines(text: Column) -> Column:
    """The lines with something in them, without white space around them."""
    return F.filter(F.transform(F.split(text, "\n"), stripped), lambda line: line != "")


def mapped(text: Column, values: dict[str, str]) -> Column:
    """A form's spelling of an enumeration in upper or lower case; null for any other."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.try_element_at(table, F.upper(stripped(text)))


def period(text: Column) -> Column:
    """struct<start, end> of two dates with a separator between them; null without one."""
    s, out = stripped(text), F.lit(None).cast("struct<start:string,end:string>")
    for sep in reversed(PERIOD_SEPARATORS):
        at = F.instr(s, sep)
        both = F.struct(filled(F.substr(s, F.lit(1), at - 1)).alias("start"), filled(F.substr(s, at + len(sep))).alias("end"))
        out = F.when(at > 0, both).otherwise(out)
    return out


def room(line: Column) -> Column:
    """struct<room, quantity, note> of ``type: n (note)``; null for anything else."""
    at = F.instr(line, ":")
    rest = stripped(F.substr(line, at + 1))
    noted = rest.contains(" (") & rest.endswith(")")
    note = F.regexp_extract(rest, r"^.*? \((.*)\)$", 1)
    quantity = stripped(F.when(noted, F.substring_index(rest, " (", 1)).otherwise(rest))
    name = stripped(F.substr(line, F.lit(1), at - 1))
    whole = (at > 0) & (name != "") & quantity.rlike(r"^[+-]?\d+$")
    return F.when(whole, F.struct(name.alias("room"), quantity.try_cast("int").alias("quantity"), F.when(noted, F.nullif(note, F.lit(""))).alias("note")))


def price(line: Column) -> Column:
    """struct<room, board, amount, unit> of ``type · board · amount (unit)``; null for anything else."""
    parts = F.split(line, " · ", 3)
    name, board, rest = (stripped(F.get(parts, k)) for k in range(3))
    amount = F.replace(stripped(F.substring_index(rest, " (", 1)), F.lit(","), F.lit(".")).try_cast("double")
    unit = mapped(F.regexp_extract(rest, r"^.*? \((.*)\)$", 1), UNITS)
    own = F.when(~board.isin("", "—"), F.coalesce(mapped(board, BOARDS), board))
    return F.when((F.size(parts) == 3) & (name != "") & amount.isNotNull() & unit.isNotNull(), F.struct(name.alias("room"), own.alias("board"), amount.alias("amount"), unit.alias("unit")))


def release(text: Column) -> Column:
    """struct<days, scope> of ``n gün · scope``; null without days."""
    s = stripped(text)
    days = stripped(F.substring_index(s, " gün", 1)).try_cast("int")
    rest = F.regexp_replace(F.substr(s, F.instr(s, " gün") + 4), "^[· ]+", "")
    return F.when(s.contains(" gün") & days.isNotNull(), F.struct(days.alias("days"), mapped(rest, SCOPES).alias("scope")))


def stop_sale(line: Column) -> Column:
    """struct<start, end, scope> of ``period · scope``; null without a period."""
    dates = period(F.substring_index(line, " · ", 1))
    scope = F.when(line.contains(" · "), filled(F.substr(line, F.instr(line, " · ") + 3)))
    return F.when(dates.isNotNull(), F.struct(dates["start"].alias("start"), dates["end"].alias("end"), scope.alias("scope")))


def all_lines(text: Column, read) -> Column:
    """The typed rows of a text's lines; null if any line cannot be read."""
    rows = F.transform(lines(text), read)
    return F.when(~F.exists(rows, lambda row: row.isNull()), rows)
