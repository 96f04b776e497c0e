"""Class, subject and chapter from a file name such as ``class6_social_science_ch3.pdf``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _without(text: Column, word: str) -> Column:
    return F.replace(text, F.lit(word), F.lit(""))


def filename_fields(filename: Column) -> dict[str, Column]:
    parts = F.split(_without(filename, ".pdf"), "_")
    return {
        "class_num": _without(F.element_at(parts, 1), "class"),
        "subject": F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))), "_"),
        "chapter": _without(F.element_at(parts, -1), "ch"),
    }
