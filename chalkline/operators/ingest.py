"""Page text to chapters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.filename import filename_fields
from chalkline.functions.text import PAGE_MIN_CHARS, clean_page
from chalkline.schemas import CHAPTER_KEYS, RAW_PAGES

# Page numbers per segment. A chapter is handled in segments of this many page numbers, so the
# text one task holds is bounded however long the chapter is.
PAGES_PER_SEGMENT = 256


def with_filename_fields(files: DataFrame) -> DataFrame:
    return files.withColumns(filename_fields(F.col("filename")))


def clean_pages(pages: DataFrame, min_chars: int = PAGE_MIN_CHARS) -> DataFrame:
    """Cleaned pages longer than ``min_chars`` characters; page numbers stay as they are.

    Each page is cleaned once, inside the generator. A filter above a projection would be pushed
    below it, and clean every page a second time.
    """
    kept = F.filter(F.array(clean_page(F.col("page_text"))), lambda text: F.length(text) > min_chars)
    others = [name for name in RAW_PAGES.fieldNames() if name != "page_text"]
    return pages.select(*others, F.explode(kept).alias("page_text"))


def with_values(table: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have a value in every column. Spelled out ahead of a join by these columns, this
    leaves the join nothing to add, so that two uses of the table share one shuffle."""
    return table.filter(reduce(Column.__and__, [F.col(name).isNotNull() for name in columns]))


def number_pages(files: DataFrame, pages_column: str = "pages") -> DataFrame:
    """One row per page of a file whose pages come as an array; pages count from 1."""
    others = [name for name in files.columns if name != pages_column]
    return files.select(*others, F.posexplode(pages_column).alias("position", "page_text")).select(
        *others, (F.col("position") + 1).alias("page_num"), "page_text"
    )


def chapter_segments(pages: DataFrame, pages_per_segment: int = PAGES_PER_SEGMENT) -> DataFrame:
    """Pages of each chapter in page order, joined by a blank line, one row per segment.

    The whole chapter is its segments in order, joined the same way; a chapter whose page numbers
    stay below ``pages_per_segment`` is one row. Grouping by chapter alone would put a long chapter
    into one task and one string. Pages without some file field form chapters of their own, with null
    there; a page without a number comes before the others, in segment 0.
    """
    segment = F.coalesce(F.floor(F.col("page_num") / pages_per_segment).cast("int"), F.lit(0))
    in_order = F.sort_array(F.collect_list(F.struct("page_num", "page_text")))
    return (
        pages.withColumn("segment", segment)
        .groupBy(*CHAPTER_KEYS, "segment")
        .agg(in_order.alias("pages"))
        .select(
            *CHAPTER_KEYS,
            "segment",
            F.size("pages").alias("n_pages"),
            F.array_join(F.transform("pages", lambda page: page.page_text), "\n\n").alias("text"),
        )
    )
