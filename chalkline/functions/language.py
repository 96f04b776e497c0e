"""Script detection and language lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last letter of each script, in the order they are tried.
SCRIPTS = [
    ("hi", "\u0900", "\u097f"),
    ("ta", "\u0b80", "\u0bff"),
    ("te", "\u0c00", "\u0c7f"),
    ("kn", "\u0c80", "\u0cff"),
    ("ml", "\u0d00", "\u0d7f"),
    ("bn", "\u0980", "\u09ff"),
]

# Speech codes and display names.
SPEECH_CODES = {
    "hi": "hi-IN", "en": "en-IN", "ta": "ta-IN", "te": "te-IN", "kn": "kn-IN", "ml": "ml-IN",
    "bn": "bn-IN", "gu": "gu-IN", "mr": "mr-IN", "pa": "pa-IN", "od": "od-IN",
}
DISPLAY_NAMES = {
    "hi": "Hindi", "en": "English", "ta": "Tamil", "te": "Telugu", "kn": "Kannada",
    "ml": "Malayalam", "bn": "Bengali", "gu": "Gujarati", "mr": "Marathi", "pa": "Punjabi",
    "od": "Odia",
}

DEFAULT_LANGUAGE = "en"
DEFAULT_SPEECH_CODE = "en-IN"


def detect_language(text: Column) -> Column:
    """Language of the first listed script that the text uses; English when it uses none."""
    found = F.lit(None).cast("string")
    for code, first, last in SCRIPTS:
        found = F.coalesce(found, F.when(text.rlike(f"[{first}-{last}]"), code))
    return F.coalesce(found, F.lit(DEFAULT_LANGUAGE))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*pairs), key)


def _prefix(code: Column) -> Column:
    return F.substring(code, 1, 2)


def speech_code(code: Column) -> Column:
    """Speech code of the first two letters; a missing or empty code counts as English."""
    given = F.when(F.coalesce(code, F.lit("")) == "", DEFAULT_LANGUAGE).otherwise(_prefix(code))
    return F.coalesce(_lookup(SPEECH_CODES, given), F.lit(DEFAULT_SPEECH_CODE))


def language_name(code: Column) -> Column:
    """Display name of the first two letters; an unknown code stands for itself."""
    return F.coalesce(_lookup(DISPLAY_NAMES, _prefix(code)), code)
