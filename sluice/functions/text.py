"""Text functions as JVM-side column expressions (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Go's unicode.IsSpace treats as white space
# (ASCII \t \n \v \f \r and space, U+0085, U+00A0, and the Unicode
# White_Space code points U+1680, U+2000-U+200A, U+2028, U+2029, U+202F,
# U+205F, U+3000).
UNICODE_SPACE_CODES = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680,
                       0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007,
                       0x2008, 0x2009, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
UNICODE_SPACE_CHARS = "".join(chr(c) for c in UNICODE_SPACE_CODES)
UNICODE_SPACE_CLASS = (
    "[\\t\\n\\x{B}\\f\\r \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
)
# Tags: from '<' up to and including the next '>' (or to the end when it is
# never closed); a '>' outside a tag is dropped too. Entities and the text
# inside <script>/<style> are kept, as in the item model. (The possessive
# '*+' cannot change the match -- '[^>]' never matches '>' -- it only
# spares the engine backtracking.)
HTML_TAG_PATTERN = "<[^>]*+>?|>"
REPLACEMENT_CHAR = "\ufffd"
DEFAULT_SUFFIX = "..."
DEFAULT_MAX_LENGTH = 200


def unicode_trim(c: Column) -> Column:
    """Trim Unicode white space at both ends (a character-set trim: only the
    ends are looked at, unlike an anchored regex that scans the text)."""
    return F.trim(c, F.lit(UNICODE_SPACE_CHARS))


def unicode_rtrim(c: Column) -> Column:
    return F.rtrim(c, F.lit(UNICODE_SPACE_CHARS))


def strip_html(c: Column) -> Column:
    """Drop tags, then trim Unicode white space."""
    return unicode_trim(F.regexp_replace(c, HTML_TAG_PATTERN, ""))


def truncate_text(c: Column, max_length: int = DEFAULT_MAX_LENGTH,
                  suffix: str = DEFAULT_SUFFIX) -> Column:
    """Strip HTML, then shorten to ``max_length`` **bytes** on a word boundary.

    If the stripped text is longer than ``max_length`` bytes: take the
    first ``max_length`` bytes; if its last space lies beyond
    ``max_length // 2`` cut there, else keep the whole byte prefix; trim
    and append ``suffix``. A multi-byte character cut in half leaves its
    dangling bytes, which render as one U+FFFD each (what a JSON or XML
    writer emits for them), so the visible text is the item model's.
    """
    if max_length < 0:
        raise ValueError("max_length must be >= 0")
    n = int(max_length)
    v = strip_html(c)
    prefix = F.substring(F.encode(v, "UTF-8"), 1, n)
    tail = F.hex(F.substring(prefix, max(n - 2, 1), 3))
    dangling = (F.when(tail.rlike("[C-F][0-9A-F]$"), F.lit(1))
                .when(tail.rlike("F[0-9A-F][89AB][0-9A-F][89AB][0-9A-F]$"), F.lit(3))
                .when(tail.rlike("[E-F][0-9A-F][89AB][0-9A-F]$"), F.lit(2))
                .otherwise(F.lit(0)))
    whole = F.substring(prefix, F.lit(1), F.lit(n) - dangling).cast("string")
    after_last_space = F.substring_index(whole, " ", -1)
    has_space = F.instr(whole, " ") > 0
    space_at = F.when(has_space, F.octet_length(whole) - F.octet_length(after_last_space) - 1) \
        .otherwise(F.lit(-1))
    head = whole.substr(F.lit(1), F.length(whole) - F.length(after_last_space) - 1)
    at_word = F.concat(unicode_rtrim(head), F.lit(suffix))
    at_bytes = F.concat(
        F.when(dangling > 0, F.concat(whole, F.repeat(F.lit(REPLACEMENT_CHAR), dangling)))
        .otherwise(unicode_rtrim(whole)),
        F.lit(suffix))
    cut = F.when(space_at > F.lit(n // 2), at_word).otherwise(at_bytes)
    return F.when(F.octet_length(v) > F.lit(n), cut).otherwise(v)


# ---------------------------------------------------------------------------
# dates
# ---------------------------------------------------------------------------

def _utc_wall_clock(instant: Column) -> Column:
    """A TIMESTAMP instant as its UTC wall-clock time (TIMESTAMP_NTZ),
    whatever the session time zone is."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), instant.cast("timestamp_ntz"))


def epoch_to_rfc1123z(seconds: Column) -> Column:
    """Epoch seconds -> ``Mon, 02 Jan 2006 15:04:05 +0000`` (UTC, independent
    of the session time zone)."""
    return F.concat(F.date_format(_utc_wall_clock(F.timestamp_seconds(seconds)), "EEE, dd MMM yyyy HH:mm:ss"),
                    F.lit(" +0000"))


def utc_ntz_to_epoch(ts_ntz: Column) -> Column:
    """A TIMESTAMP_NTZ read as UTC wall-clock time -> epoch seconds,
    independent of the session time zone."""
    return F.unix_seconds(F.convert_timezone(F.lit("UTC"), F.current_timezone(), ts_ntz).cast("timestamp"))


# The date layouts tried in order after the feed parser's own
# (Go reference layouts): RFC1123Z "Mon, 02 Jan 2006 15:04:05 -0700",
# RFC1123 "Mon, 02 Jan 2006 15:04:05 MST", RFC3339
# "2006-01-02T15:04:05Z07:00", RFC822Z "02 Jan 06 15:04 -0700", RFC822
# "02 Jan 06 15:04 MST", "Mon, 2 Jan 2006 15:04:05 MST",
# "Mon, 2 Jan 2006 15:04:05 -0700", "2006-01-02T15:04:05Z",
# "2006-01-02T15:04:05-07:00", "2006-01-02 15:04:05", "2006-01-02".
# They fall into five shapes. A zone abbreviation parsed against UTC gets
# offset 0 (only numeric offsets move the time); day and month names match
# without regard to case; hours take one or two digits; a fraction may
# follow the seconds; two-digit years from 69 are 19xx.
_DAY = "(?i:mon|tue|wed|thu|fri|sat|sun)"
ZONE_ABBR = "(?:UTC|GMT|[A-Z]{3}|[A-Z]{3}T|[A-Z]{4}T|WITA|ChST|MeST)"
SHAPE_RFC1123 = (f"^{_DAY}, (?<d>[0-9]{{1,2}}) (?<mon>[A-Za-z]{{3}}) (?<y>[0-9]{{4}}) "
                 "(?<h>[0-9]{1,2}):(?<mi>[0-9]{2}):(?<s>[0-9]{2})(?:\\.[0-9]+)? (?<z>[+-][0-9]{4})$")
SHAPE_RFC822 = ("^(?<d>[0-9]{2}) (?<mon>[A-Za-z]{3}) (?<yy>[0-9]{2}) "
                "(?<h>[0-9]{1,2}):(?<mi>[0-9]{2}) (?<z>[+-][0-9]{4})$")
SHAPE_ISO_T = ("^(?<date>[0-9]{4}-[0-9]{2}-[0-9]{2})T(?<h>[0-9]{1,2}):(?<mi>[0-9]{2}):(?<s>[0-9]{2})"
               "(?:\\.[0-9]+)?(?<z>Z|[+-][0-9]{2}:[0-9]{2})$")
SHAPE_DATETIME = ("^(?<date>[0-9]{4}-[0-9]{2}-[0-9]{2}) (?<h>[0-9]{1,2}):(?<mi>[0-9]{2}):(?<s>[0-9]{2})"
                  "(?:\\.[0-9]+)?$")
SHAPE_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def _ts(text: Column, fmt: str) -> Column:
    return F.unix_seconds(F.try_to_timestamp(text, F.lit(fmt)))


def parse_feed_date(text: Column) -> Column:
    """Date text -> epoch seconds (bigint), or 0 when no layout matches.

    Each shape is one ``rlike`` test plus one ``regexp_replace`` that
    rewrites the text into a fixed layout for ``try_to_timestamp`` (which
    also rejects impossible dates such as 30 February)."""
    # names as zones (RFC1123, RFC822 shapes) mean offset 0
    t = F.regexp_replace(text, f" {ZONE_ABBR}$", " +0000")
    rfc1123 = _ts(F.regexp_replace(t, SHAPE_RFC1123, "${d} ${mon} ${y} ${h}:${mi}:${s} ${z}"),
                  "d MMM yyyy H:mm:ss Z")
    century = F.when(F.regexp_extract(t, SHAPE_RFC822, 3).cast("int") >= 69, F.lit("19")).otherwise(F.lit("20"))
    rfc822 = _ts(F.concat(century, F.regexp_replace(t, SHAPE_RFC822, "${yy} ${mon} ${d} ${h}:${mi} ${z}")),
                 "yyyy MMM dd H:mm Z")
    iso_t = _ts(F.regexp_replace(text, SHAPE_ISO_T, "${date} ${h}:${mi}:${s} ${z}"), "yyyy-MM-dd H:mm:ss XXX")
    dt = _ts(F.concat(F.regexp_replace(text, SHAPE_DATETIME, "${date} ${h}:${mi}:${s}"), F.lit(" +0000")),
             "yyyy-MM-dd H:mm:ss Z")
    d = _ts(F.concat(text, F.lit(" +0000")), "yyyy-MM-dd Z")
    return (F.when(t.rlike(SHAPE_RFC1123), F.coalesce(rfc1123, F.lit(0)))
            .when(t.rlike(SHAPE_RFC822), F.coalesce(rfc822, F.lit(0)))
            .when(text.rlike(SHAPE_ISO_T), F.coalesce(iso_t, F.lit(0)))
            .when(text.rlike(SHAPE_DATETIME), F.coalesce(dt, F.lit(0)))
            .when(text.rlike(SHAPE_DATE), F.coalesce(d, F.lit(0)))
            .otherwise(F.lit(0)).cast("bigint"))
