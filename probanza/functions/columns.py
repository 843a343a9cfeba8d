"""Column-returning helpers: text, truth, time, percent and money. No UDFs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from probanza.functions import vocab

# Fixed value: the characters that count as white space at either end of a text.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_WORD = r"\p{L}\p{N}_"
_WORD_START, _WORD_END = rf"(?<![{_WORD}])", rf"(?![{_WORD}])"
_SPACE = r"[\x09-\x0d\x1c-\x20\x85\p{Z}]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -----------------------------------------------------------------------------------------
def trimmed(c: Column | str) -> Column:
    """Text of a value without the spaces around it (a tab is not a space)."""
    return F.trim(_col(c).cast("string"))


def key_of(c: Column | str) -> Column:
    """Trimmed key; blank becomes NULL so that blanks never match anything."""
    return F.nullif(trimmed(c), F.lit(""))


def nonempty(c: Column | str) -> Column:
    """True for a value that is neither NULL nor blank; never NULL itself."""
    return F.coalesce(trimmed(c) != "", F.lit(False))


def blank(c: Column | str) -> Column:
    """True for a value that is present but blank."""
    return F.coalesce(trimmed(c) == "", F.lit(False))


def blank_to(c: Column | str, default: str = "UNKNOWN") -> Column:
    return F.coalesce(key_of(c), F.lit(default))


def first_nonblank(*cols: Column | str, default: str = "UNKNOWN") -> Column:
    return F.coalesce(*(key_of(c) for c in cols), F.lit(default))


def strip(c: Column | str) -> Column:
    """Text without any white space around it; NULL becomes ''."""
    return F.coalesce(F.btrim(_col(c).cast("string"), F.lit(WHITE_SPACE)), F.lit(""))


def folded(c: Column | str) -> Column:
    return F.lower(strip(c))


def audit_true(c: Column | str) -> Column:
    return F.lower(F.coalesce(trimmed(c), F.lit(""))).isin(*vocab.AUDIT_TRUE_WORDS)


def score_true(c: Column | str) -> Column:
    return folded(c).isin(*vocab.SCORE_TRUE_WORDS)


def failed_status(c: Column | str) -> Column:
    return F.lower(F.coalesce(_col(c).cast("string"), F.lit(""))).isin(*vocab.FAILED_STATUS_WORDS)


def contains_folded(needle: str, *cols: Column | str) -> Column:
    """Case-folded substring test over any of several columns."""
    tests = [F.coalesce(F.lower(_col(c).cast("string")).contains(needle.lower()), F.lit(False)) for c in cols]
    return reduce(Column.__or__, tests)


def unicode_pattern(pattern: str) -> str:
    """A pattern whose case, word edges and spaces follow Unicode on every Java version.

    A word edge must touch a word in the pattern: it starts one when a letter or a group follows.
    """
    edged = re.sub(r"\\b(?=[\w(])", lambda _: _WORD_START, pattern).replace(r"\b", _WORD_END)
    return "(?iu)" + edged.replace(r"\s", _SPACE)


def matches(c: Column | str, pattern: str) -> Column:
    """Case-insensitive search; NULL does not match."""
    return F.coalesce(_col(c).cast("string").rlike(unicode_pattern(pattern)), F.lit(False))


def has_any_token(c: Column | str, tokens: tuple[str, ...]) -> Column:
    """True once however many of the tokens occur."""
    return reduce(Column.__or__, [contains_folded(token, c) for token in tokens])


def without_prefix(c: Column | str, prefix: str) -> Column:
    """Key text without a leading ``prefix-`` or ``prefix_``."""
    return F.regexp_replace(_col(c), f"^{prefix}[-_]", "")


# --- time -----------------------------------------------------------------------------------------
_TIMESTAMP_SHAPE = r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)? ?(Z|[+-]\d{1,2}(:?\d{2})?)?)?$"


def parse_ts(c: Column | str) -> Column:
    """TIMESTAMP_NTZ of a text value, NULL when blank or malformed.

    A cast alone would read '2026' as a year and '09:00' as today; the shape is checked first.
    The wall time of a value with an offset is kept.
    """
    raw = F.translate(trimmed(c), "/", "-")
    return F.when(raw.rlike(_TIMESTAMP_SHAPE), raw.try_cast("timestamp_ntz"))


def parse_ts_lenient(c: Column | str) -> Column:
    """ISO text (wall time kept, offset ignored), or ``Y/m/d``."""
    raw = strip(c)
    iso = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}"), raw.try_cast("timestamp_ntz"))
    slashed = F.when(raw.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), F.translate(raw, "/", "-").try_cast("timestamp_ntz"))
    return F.coalesce(iso, slashed)


def day_of(ts: Column | str) -> Column:
    return _col(ts).cast("date")


def has_time(ts: Column | str) -> Column:
    """True when a parsed timestamp carries a time of day other than midnight."""
    return F.coalesce(_col(ts) != day_of(ts).cast("timestamp_ntz"), F.lit(False))


def both_timed(process: Column | str, event: Column | str) -> Column:
    return has_time(process) & has_time(event)


def granularity(process: Column | str, event: Column | str, timed: Column | None = None) -> Column:
    """How two parsed timestamps may be compared; ``timed`` may hold ``both_timed`` computed before."""
    process, event = _col(process), _col(event)
    timed = both_timed(process, event) if timed is None else timed
    return (
        F.when(process.isNull() | event.isNull(), "UNKNOWN")
        .when(timed, "BOTH_TIMESTAMP")
        .otherwise("CALENDAR_DAY")
    )


def comparison(process: Column | str, event: Column | str, timed: Column | None = None) -> Column:
    """-1 when the process lies before the event, 0 on the same day (or instant), 1 after; NULL unknown."""
    process, event = _col(process), _col(event)
    timed = both_timed(process, event) if timed is None else timed
    instant = F.when(process < event, -1).when(process > event, 1).otherwise(0)
    days = F.signum(F.datediff(day_of(process), day_of(event))).cast("int")
    return F.when(process.isNull() | event.isNull(), None).when(timed, instant).otherwise(days)


def ordering_label(compared: Column | str) -> Column:
    """Name of a comparison."""
    compared = _col(compared)
    return (
        F.when(compared.isNull(), "UNKNOWN")
        .when(compared < 0, "PROCESS_BEFORE_EVENT")
        .when(compared > 0, "EVENT_BEFORE_PROCESS")
        .otherwise("SAME_CALENDAR_DAY")
    )


def ordering_class(process: Column | str, event: Column | str) -> Column:
    """Order of process and event, by instant when both are timed and by day otherwise."""
    return ordering_label(comparison(process, event))


def whole_seconds(ts: Column | str) -> Column:
    """Seconds since 1970 of a zone-less timestamp, fractions dropped."""
    ts = _col(ts)
    return F.unix_date(day_of(ts)).cast("bigint") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def lag_seconds(process: Column | str, event: Column | str, timed: Column | None = None) -> Column:
    """Seconds from event to process; whole days when either side has no time of day."""
    process, event = _col(process), _col(event)
    timed = both_timed(process, event) if timed is None else timed
    return (
        F.when(process.isNull() | event.isNull(), None)
        .when(timed, whole_seconds(process) - whole_seconds(event))
        .otherwise(F.datediff(day_of(process), day_of(event)).cast("bigint") * 86400)
    )


def after_run_date(ts: Column | str, run_date: str) -> Column:
    """True past the last second of the run date, which the caller passes in."""
    return F.coalesce(_col(ts) > F.lit(f"{run_date} 23:59:59").cast("timestamp_ntz"), F.lit(False))


def partition_part(path: Column | str, name: str, digits: int) -> Column:
    """Integer of a ``name=digits`` path segment, NULL when absent."""
    found = F.regexp_extract(_col(path), rf"{name}=(\d{{{digits}}})", 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def partition_date(path: Column | str) -> Column:
    """Date named by ``year=/month=/day=`` segments; without a day, the first of the month."""
    year, month = partition_part(path, "year", 4), partition_part(path, "month", 2)
    day = F.coalesce(partition_part(path, "day", 2), F.lit(1))
    text = F.format_string("%04d-%02d-%02d", year, month, day)
    return F.when(year.isNotNull() & month.isNotNull(), text.try_cast("date"))


# --- numbers --------------------------------------------------------------------------------------
def pct(part: Column, whole: Column, digits: int = 6) -> Column:
    """Percentage as DOUBLE; 0 when there is nothing to divide by."""
    share = F.round(part.cast("double") / whole.cast("double") * 100, digits)
    return F.when(whole > 0, share).otherwise(F.lit(0.0))


def pct_or_null(part: Column, whole: Column, digits: int = 6) -> Column:
    """Percentage as DOUBLE; NULL (unknown) when there is nothing to divide by."""
    return F.when(whole > 0, F.round(part.cast("double") / whole.cast("double") * 100, digits))


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds, as BIGINT."""
    return F.count_if(condition)


def money(c: Column | str) -> Column:
    """Amount with two decimals, half to even; NULL when blank or unreadable.

    Up to 20 whole digits are read with 18 decimals, longer amounts (up to 34 digits) with four.
    """
    text = F.nullif(strip(c), F.lit(""))
    read = [F.bround(text.try_cast(kind), 2).cast("decimal(38,2)") for kind in ("decimal(38,18)", "decimal(38,4)")]
    return F.coalesce(*read)


def money_text(c: Column | str) -> Column:
    return F.coalesce(money(c).cast("string"), F.lit(""))
