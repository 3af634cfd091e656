"""Column functions for names, ids and labels that users and logs see."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: fixed values: names where there is none, labels and colours of a contract's states, states in which an extraction is pending
DEFAULT_FILE, UNKNOWN_ID, NOTHING = "sozlesme.pdf", "bilinmeyen", "—"
STATUS = {"YUKLENDI": "Sırada", "ISLENIYOR": "İşleniyor", "INCELENMEYI_BEKLIYOR": "İncelenmeyi bekliyor", "ONAYLANDI": "Onaylandı", "HATA": "Hata"}
TONES = {"ISLENIYOR": "blue", "INCELENMEYI_BEKLIYOR": "yellow", "ONAYLANDI": "green", "HATA": "red"}
PENDING = ("YUKLENDI", "ISLENIYOR")
SNIPPET, MOST_TOKENS = 512, 8192


def _looked_up(key: Column, table: dict[str, str], otherwise: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), otherwise)


def file_name(path: Column) -> Column:
    """The last part of a path, slashes at its end aside; a default for nothing."""
    return F.coalesce(F.nullif(F.regexp_extract(path, r"([^/]*)/*$", 1), F.lit("")), F.lit(DEFAULT_FILE))


def export_name(name: Column) -> Column:
    """The name of a file's export: without its last extension."""
    return F.concat(F.regexp_replace(name, r"\.[^.]+$", ""), F.lit("-cikarim.json"))


def dump_id(raw: Column) -> Column:
    """An id that may stand in a file's name: ASCII letters, digits and hyphens."""
    return F.coalesce(F.nullif(F.regexp_replace(raw, "[^A-Za-z0-9-]", ""), F.lit("")), F.lit(UNKNOWN_ID))


def snippet(text: Column, most: int = SNIPPET) -> Column:
    """Text in one line, cut after so many characters."""
    line = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.when(F.length(line) > most, F.concat(F.substring(line, 1, most), F.lit("…"))).otherwise(line)


def is_file_id(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def settings_accepted(risk: Column, tokens: Column) -> Column:
    """Whether an organisation's settings are within their bounds."""
    return F.coalesce(risk.between(0, 1) & tokens.between(1, MOST_TOKENS), F.lit(False))


def settings_changed(old: dict[str, Column], new: dict[str, Column]) -> Column:
    """Names of the settings that differ, in the order in which they are given."""
    return F.concat_ws(",", *(F.when(~value.eqNullSafe(old[name]), name) for name, value in new.items()))


def whole_seconds(seconds: Column) -> Column:
    """A duration in whole seconds; one that took any time took at least one."""
    whole = F.floor(seconds).cast("bigint")
    return F.when((seconds > 0) & (whole == 0), 1).otherwise(whole).cast("bigint")


def confidence_label(page: Column, score: Column) -> Column:
    """``s.<page> · %<score>``, or the part that is there; null for none."""
    parts = F.concat_ws(" · ", F.concat(F.lit("s."), page.cast("string")), F.concat(F.lit("%"), F.floor(score.cast("double") * 100 + 0.5).cast("bigint").cast("string")))
    return F.nullif(parts, F.lit(""))


def status_label(status: Column) -> Column:
    return _looked_up(status, STATUS, status)


def status_tone(status: Column) -> Column:
    return _looked_up(status, TONES, F.lit("muted"))


def is_pending(status: Column) -> Column:
    return F.coalesce(status.isin(*PENDING), F.lit(False))


def period_text(start: Column, end: Column) -> Column:
    """``start – end`` with a dash for what is missing."""
    shown = lambda day: F.coalesce(day, F.lit(NOTHING))
    return F.when(start.isNull() & end.isNull(), NOTHING).otherwise(F.concat_ws(" – ", shown(start), shown(end)))
