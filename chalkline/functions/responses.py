"""Fields of remote replies, read from their JSON or text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline.functions.text import strip

# The marks around a model's thinking, and the fields a translation may come in.
THINK = r"(?s)<think>(.*?)</think>"
TRANSLATION_FIELDS = ["translated_text", "output", "text"]

_CONTENT = "$.choices[0].message.content"


def chat_content(reply: Column) -> Column:
    """Text of the first choice as it came; null where the reply has another shape."""
    return F.get_json_object(reply, _CONTENT)


def has_thinking(text: Column) -> Column:
    return text.rlike(THINK)


def thinking(text: Column) -> Column:
    """The first thinking block; null when there is none."""
    return F.when(has_thinking(text), strip(F.regexp_extract(text, THINK, 1)))


def without_thinking(text: Column) -> Column:
    return strip(F.regexp_replace(text, THINK, ""))


def answer(text: Column) -> Column:
    """The text without its thinking blocks; untouched when it has none."""
    return F.when(has_thinking(text), without_thinking(text)).otherwise(text)


def translation(reply: Column) -> Column:
    """The first field that is present and not blank."""
    fields = [strip(F.get_json_object(reply, f"$.{name}")) for name in TRANSLATION_FIELDS]
    return F.coalesce(*[F.nullif(field, F.lit("")) for field in fields])


def transcript_text(reply: Column) -> Column:
    return F.coalesce(F.get_json_object(reply, "$.transcript"), F.lit(""))


def transcript_language(reply: Column) -> Column:
    return F.coalesce(F.get_json_object(reply, "$.language_code"), F.lit("en"))


def _bytes(encoded: Column) -> Column:
    return F.try_to_binary(encoded, F.lit("base64"))


def data_url_bytes(data_url: Column) -> Column:
    """Bytes after the ``base64,`` mark; a value without the mark is taken whole."""
    parts = F.split(data_url, "base64,")
    return _bytes(F.coalesce(F.get(parts, F.lit(1)), data_url))


def first_audio_bytes(reply: Column) -> Column:
    return _bytes(F.get_json_object(reply, "$.audios[0]"))
