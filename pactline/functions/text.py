"""Column functions for contract text: masking, cleaning, folding, numbers, dates and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactline.functions.bind import let

#: fixed values: patterns of personal data in the order in which they are masked
MASKS = (
    ("EPOSTA", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("TELEFON", r"\+90[\t\n\f\r ]*[0-9]{3}[\t\n\f\r ]*[0-9]{3}[\t\n\f\r ]*[0-9]{2}[\t\n\f\r ]*[0-9]{2}"),
    ("TELEFON", r"(?<![0-9A-Za-z_])05[0-9]{2}[\t\n\f\r ]*[0-9]{3}[\t\n\f\r ]*[0-9]{2}[\t\n\f\r ]*[0-9]{2}(?![0-9A-Za-z_])"),
    ("TCKN", r"(?<![0-9A-Za-z_])[0-9]{11}(?![0-9A-Za-z_])"),
)
#: for each pattern: its tag, a sign without which it cannot match, and the same pattern for a single pass over each run of letters
_SEARCHED = (("EPOSTA", "@", r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), ("TELEFON", r"\+90", MASKS[1][1]), ("TELEFON", "05", MASKS[2][1]), ("TCKN", "[0-9]{11}", MASKS[3][1]))
#: fixed values: letters that are folded before lower-casing, and what they become
TURKISH, PLAIN = "İIıŞşĞğÜüÖöÇç", "iiissgguuoocc"
#: fixed values: month names, Turkish (folded) and English
MONTHS = {
    "ocak": 1, "subat": 2, "mart": 3, "nisan": 4, "mayis": 5, "haziran": 6, "temmuz": 7, "agustos": 8, "eylul": 9, "ekim": 10, "kasim": 11, "aralik": 12,
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
}


def masked(text: Column) -> tuple[Column, Column]:
    """(text with personal data replaced by tags, number of replacements), step by step in a fixed order.

    A text is searched only for what a sign of it is there, and the replacements are counted by
    the tags that the result has more than the text.
    """
    out = text
    for tag, sign, own in _SEARCHED:
        out = F.when(out.rlike(sign), F.regexp_replace(out, own, f"[{tag}]")).otherwise(out)
    tags = lambda t, tag: (F.length(t) - F.length(F.replace(t, F.lit(f"[{tag}]"), F.lit("")))) / (len(tag) + 2)
    count = F.lit(0)
    for tag in dict.fromkeys(tag for tag, _ in MASKS):
        count = count + (tags(out, tag) - tags(text, tag)).cast("int")
    return out, count


def mask_email(address: Column) -> Column:
    """``a***@domain``; ``***`` where there is no address."""
    valid = address.rlike(r"^[^@]+@.+$")
    return F.when(valid, F.concat(F.substring(address, 1, 1), F.lit("***@"), F.substring_index(address, "@", -1))).otherwise("***")


def normalize_email(raw: Column) -> Column:
    """Trimmed and lower-cased; NULL unless there is something before the last @ and a dot after it."""
    e = F.lower(F.trim(raw))
    return F.when(e.rlike(r"^[^\s]+@[^\s@]*[^\s@.]\.[^\s@.][^\s@]*$"), e)


def fold_turkish(text: Column) -> Column:
    return F.lower(F.translate(F.trim(text), TURKISH, PLAIN))


def lower_simple(text: Column) -> Column:
    """Lower case in which the dotted capital I is one letter."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def line_endings(text: Column) -> Column:
    """LF line ends, without blanks and tabs before them."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"(?md)[ \t]+$", "")


def collapse_blank_lines(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"), F.lit("\n"))


def section_between(text: Column, starts: list[str], ends: list[str], skip: int = 40) -> Column:
    """From the earliest start marker to the earliest end marker after ``skip`` characters, in lower case; '' without a start."""
    earliest = lambda marks, low: F.array_min(F.filter(F.array(*(F.locate(m, low) for m in marks)), lambda p: p > 0))
    # the text in lower case and its tail are bound once, for all the markers that are looked up in them
    tails = F.transform(F.array(lower_simple(text)), lambda low: F.substr(low, earliest(starts, low)))
    cut = lambda tail: let(F.substr(tail, F.lit(skip + 1)), lambda rest: earliest(ends, rest))
    whole = F.transform(tails, lambda tail: F.coalesce(F.substr(tail, F.lit(1), cut(tail) + (skip - 1)), tail, F.lit("")))
    return F.when(text.isNotNull(), F.get(whole, 0))


def first_int(text: Column) -> Column:
    return F.regexp_extract(text, "([0-9]+)", 1).try_cast("int")


def last_int(text: Column) -> Column:
    return F.regexp_extract(text, "([0-9]+)[^0-9]*$", 1).try_cast("int")


def has_currency(text: Column, token: str) -> Column:
    """Whether a currency token stands by itself among letters and digits."""
    return F.lower(text).rlike(f"(?<![a-z0-9]){token}(?![a-z0-9])")


def slug(text: Column, most: int = 40) -> Column:
    """The first ``most`` letters and digits in upper case, an underscore for whatever stands between two of them."""
    return F.regexp_extract(F.regexp_replace(F.upper(text), r"[^\p{L}\p{Nd}]+", "_"), rf"^_?((?:_?[\p{{L}}\p{{Nd}}]){{1,{most}}})", 1)


def loose_number(raw: Column) -> Column:
    """Numbers as people write them: currency signs and codes, blanks, European and US separators."""
    s = F.regexp_replace(raw, r"(?i)[€$£₺]|eur|usd|gbp|try|tl", "")
    s = F.regexp_replace(s, r"[\t\n\f\r ]+", "")
    return (
        F.when(s.rlike(r"^-?[0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?$"), F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"))
        .when(s.rlike(r"^-?[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?$"), F.replace(s, F.lit(","), F.lit("")).try_cast("double"))
        .when(s.rlike(r"^-?[0-9]+,[0-9]+$"), F.replace(s, F.lit(","), F.lit(".")).try_cast("double"))
        .when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    )


def parse_date(raw: Column) -> Column:
    """ISO, day-first numeric dates with . / or -, and ``d Month yyyy`` in Turkish or English; NULL otherwise."""
    s = F.trim(raw)
    month = F.create_map(*(F.lit(x) for kv in MONTHS.items() for x in kv))
    named = r"^([0-9]{1,2})[ ]+([^ 0-9]+)[ ]+([0-9]{4})$"
    number = F.try_element_at(month, fold_turkish(F.regexp_extract(s, named, 2)))
    spelled = F.concat_ws("-", F.regexp_extract(s, named, 3), F.lpad(number.cast("string"), 2, "0"), F.lpad(F.regexp_extract(s, named, 1), 2, "0"))
    dotted = F.translate(s, "./", "--")
    return (
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(s, "yyyy-MM-dd"))
        .when(dotted.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}$"), F.try_to_date(dotted, "d-M-yyyy"))
        .when(s.rlike(named) & number.isNotNull(), F.try_to_date(spelled, "yyyy-MM-dd"))
    )


def canonical(raw: Column, aliases: dict[str, str], domain: tuple[str, ...], default: str = "belirtilmemis") -> Column:
    """A value of the domain: as it is, through folding and aliases, with underscores for blanks, or the default."""
    folded = fold_turkish(raw)
    under = F.regexp_replace(folded, r"[ \-]+", "_")
    alias = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.when(raw.isin(*domain), raw).when(F.map_contains_key(alias, folded), F.try_element_at(alias, folded)).when(folded.isin(*domain), folded).when(under.isin(*domain), under).otherwise(default)


def device_label(agent: Column) -> Column:
    """``Browser / System`` from a user agent; the first match counts."""
    low = F.lower(agent)
    browser = F.when(low.contains("edg"), "Edge").when(low.contains("firefox"), "Firefox").when(low.contains("chrome"), "Chrome").when(low.contains("safari"), "Safari").otherwise("Tarayıcı")
    system = F.when(low.contains("windows"), "Windows").when(low.contains("mac os"), "macOS").when(low.contains("android"), "Android").when(low.contains("linux"), "Linux").otherwise("Bilinmeyen")
    return F.concat(browser, F.lit(" / "), system)
