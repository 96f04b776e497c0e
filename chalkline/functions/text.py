"""Text clean-up as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.binding import let

# The characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Clean-up rules as (flag, pattern, replacement), in order. "m" marks rules whose ^ matches
# at every line. The signs after a rule are texts without one of which it has nothing to replace.
PAGE_RULES = [
    ("", r"\n{3,}", "\n\n", ["\n\n\n"]),
    ("", r"[ \t]+", " ", ["  ", "\t"]),
]
SPEECH_RULES = [
    ("", r"<[^>]+>", "", ["<"]),
    ("", r"\*\*(.+?)\*\*", "$1", ["**"]),
    ("", r"\*(.+?)\*", "$1", ["*"]),
    ("", r"__(.+?)__", "$1", ["__"]),
    ("", r"_(.+?)_", "$1", ["_"]),
    ("", r"~~(.+?)~~", "$1", ["~~"]),
    ("", r"`(.+?)`", "$1", ["`"]),
    ("m", r"^#{1,6}\s+", "", ["#"]),
    ("m", r"^\s*[-*+]\s+", "", ["-", "*", "+"]),
    ("m", r"^\s*\d+\.\s+", "", ["."]),
    ("m", r"^\s*>\s*", "", [">"]),
    ("", r"\[([^\]]+)\]\([^\)]+\)", "$1", ["]("]),
    ("", r"[|]", " ", ["|"]),
    ("", r"-{3,}", "", ["---"]),
    ("", r"\s+", " ", []),
]
PLAIN_SPEECH_RULES = [
    ("", r"```[\s\S]*?```", " ", ["```"]),
    ("", r"`([^`]+)`", "$1", ["`"]),
    ("", r"\[([^\]]+)\]\([^)]+\)", "$1", ["]("]),
    ("", r"[*_#>|]+", " ", ["*", "_", "#", ">", "|"]),
    ("", r"\s+", " ", []),
]

# Lengths at which speech text is cut.
SPEECH_CUT = 500
PLAIN_SPEECH_CUT = 2400
SPEECH_REQUEST_CUT = 2500

PAGE_MIN_CHARS = 100

# (?d): only \n ends a line; (?U): \s and \d cover all of Unicode, but for four separators.
_FLAGS = "(?dU{})"
_SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Drop white space (of any script) at both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _rewrite(text: Column, rules: list[tuple[str, str, str, list[str]]]) -> Column:
    """Most texts show few of the signs, and a plain search for one is far cheaper than a pattern."""
    for flag, pattern, replacement, signs in rules:
        regex = _FLAGS.format(flag) + pattern.replace(r"\s", _SPACE)

        def rewritten(given: Column) -> Column:
            out = F.regexp_replace(given, regex, replacement)
            if not signs:
                return out
            needed = reduce(Column.__or__, [F.contains(given, F.lit(sign)) for sign in signs])
            return F.when(needed, out).otherwise(given)

        text = let(text, rewritten)
    return strip(text)


def clean_page(text: Column) -> Column:
    return _rewrite(text, PAGE_RULES)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def speech_text(text: Column) -> Column:
    """Markup-free text for reading aloud."""
    return _rewrite(text, SPEECH_RULES)


def plain_speech_text(text: Column, max_chars: int = PLAIN_SPEECH_CUT) -> Column:
    """The shorter clean-up; cut to ``max_chars`` characters."""
    return truncate(_rewrite(text, PLAIN_SPEECH_RULES), max_chars)


def truncate(text: Column, max_chars: int) -> Column:
    return F.substring(text, 1, max_chars)


def title(text: Column) -> Column:
    """Underscores as blanks, and a capital at the start of each run of letters, also after hyphens and digits."""
    runs = F.regexp_extract_all(F.replace(text, F.lit("_"), F.lit(" ")), F.lit(r"\P{L}+|\p{L}+"), F.lit(0))
    return F.array_join(F.transform(runs, F.initcap), "")


def safe_text(value: Column, kind: str) -> Column:
    """Any scalar as text; null and NaN become the empty string.

    ``kind`` is the Spark type name. Floats are written the way a Python reader expects them.
    """
    if kind in ("double", "float"):
        value = F.when(~F.isnan(value), _float_text(value.cast("double")))
    elif kind in ("timestamp", "timestamp_ntz"):
        whole = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        value = F.concat(whole, F.regexp_replace(F.date_format(value, ".SSSSSS"), r"^\.0{6}$", ""))
    elif kind == "boolean":
        value = F.initcap(value.cast("string"))
    else:
        value = value.cast("string")
    return F.coalesce(value, F.lit(""))


def _float_text(value: Column) -> Column:
    """Spark writes 1.25E10 and 1.0E-4 where Python writes 12500000000.0 and 0.0001."""
    size = F.abs(value)
    plain = F.rtrim(value.try_cast("decimal(38,21)").cast("string"), F.lit("0"))
    plain = F.concat(plain, F.when(plain.endswith("."), "0").otherwise(""))
    parts = F.split(value.cast("string"), "E")
    exponent = F.get(parts, F.lit(1)).try_cast("int")
    scientific = F.concat(
        F.regexp_replace(F.get(parts, F.lit(0)), r"\.0$", ""),
        F.when(exponent < 0, "e-").otherwise("e+"),
        F.when(F.abs(exponent) < 10, "0").otherwise(""),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when(size == float("inf"), F.when(value > 0, "inf").otherwise("-inf"))
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(size == 0, value.cast("string"))
        .otherwise(scientific)
    )


def utc_text(instant: Column) -> Column:
    """A timestamp as ``YYYY-MM-DDTHH:MM:SSZ``, whatever the session time zone."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    seconds = F.make_dt_interval(secs=F.unix_seconds(instant.cast("timestamp")).cast("decimal(18,6)"))
    return F.concat(F.replace((epoch + seconds).cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))
