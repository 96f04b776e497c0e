"""Chapters to overlapping chunks, without ever holding a whole chapter.

Chunks are packed from small pieces, left to right, so where a chunk starts depends on the chunk
before it. But the start that follows a given start depends on the nearby pieces only. So each
segment of a chapter can work out, for every piece near its beginning, where a packing that
enters there would leave the segment and how many chunks it would make on the way: its span. Spans
that follow each other combine to the span of a block, and one ordered pass over a chapter's blocks
fixes how each is entered. Blocks then fix the entries of their segments, and the segments cut
their chunks, all in parallel. The result is the same as packing the chapter in one go.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chalkline.functions.text import WHITESPACE, word_count
from chalkline.operators.ingest import PAGES_PER_SEGMENT, chapter_segments, with_values
from chalkline.schemas import CHAPTER_KEYS, CHUNKS

# Chunk size, overlap and separators.
CHUNK_SIZE = 400
CHUNK_OVERLAP = 50
SEPARATORS = ["\n\n", "\n", ". ", " "]

SEGMENTS_PER_BLOCK = 1024

# What a task turns into Python objects at a time, of the larger Arrow batch it is given.
PART_BYTES = 4 * 1024 * 1024
PART_ROWS = 1024


@dataclass(frozen=True)
class Cutter:
    """The cutting rule: pieces never cross the first separator, which also joins the pages."""

    size: int = CHUNK_SIZE
    overlap: int = CHUNK_OVERLAP
    separators: tuple[str, ...] = tuple(SEPARATORS)

    def fine(self, paragraph: str) -> list[str]:
        """Cut a paragraph before the finer separators, inside parts that are still too long."""
        pieces = [paragraph] if paragraph else []
        for separator in self.separators[1:]:
            pieces = [
                part
                for piece in pieces
                for part in (_cut_before(piece, separator) if len(piece) >= self.size else [piece])
            ]
        return pieces

    def steps(self, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For a chunk starting at each piece: the piece that overflows it, and the next start.

        ``ends`` holds the running lengths, from 0. An overflow at ``len(ends) - 1`` means that
        the pieces at hand do not overflow the chunk.
        """
        starts = np.arange(len(ends) - 1)
        overflow = np.searchsorted(ends, ends[:-1] + self.size, side="right") - 1
        overflow = np.maximum(overflow, starts + 1)
        within = np.minimum(overflow, len(ends) - 2)
        following = np.maximum(
            np.searchsorted(ends, ends[within] - self.overlap, side="left"),
            np.searchsorted(ends, ends[within + 1] - self.size, side="left"),
        )
        return overflow, np.minimum(following, within)


def _cut_before(text: str, separator: str) -> list[str]:
    head, *rest = text.split(separator)
    return ([head] if head else []) + [separator + part for part in rest]


def _running(lengths: list[int]) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))


class Segment:
    """One segment of a chapter, cut into pieces. All but a chapter's first follow a page break."""

    def __init__(self, cutter: Cutter, text: str, leading: bool, later: list[int] | None = None) -> None:
        """``later`` are the lengths of the pieces after the first paragraph, if they are known."""
        mark = cutter.separators[0]
        first, *others = text.split(mark)
        if later is None:
            later = [len(piece) for other in others for piece in cutter.fine(mark + other)]
        self.cutter, self.text, self.later = cutter, text if leading else mark + text, later
        self.lengths = [len(piece) for piece in cutter.fine(first if leading else mark + first)] + later
        self.ends = _running(self.lengths)
        self.overflow, self.following = cutter.steps(self.ends)

    def is_open(self, start: int) -> bool:
        """Whether the chunk from ``start`` runs on into the next segment."""
        return start >= len(self.lengths) or bool(self.overflow[start] >= len(self.lengths))

    def chunk(self, start: int) -> str:
        return self.text[self.ends[start] : self.ends[self.overflow[start]]].strip(WHITESPACE)

    def walk(self, entry: int) -> Iterator[str]:
        """The chunks that start at ``entry`` or later and end inside this segment."""
        while not self.is_open(entry):
            chunk = self.chunk(entry)
            if chunk:
                yield chunk
            entry = int(self.following[entry])

    def exits(self, entries: Iterable[int]) -> list[tuple[int, int]]:
        """For each entry piece: the start of the chunk left open, and how many were made."""
        known: dict[int, tuple[int, int]] = {}
        for entry in entries:
            path, at = [], entry
            while at not in known and not self.is_open(at):
                path.append(at)
                at = int(self.following[at])
            left, made = known.get(at, (at, 0))
            known.setdefault(at, (left, made))
            for start in reversed(path):
                made += bool(self.chunk(start))
                known[start] = (left, made)
        return [known[entry] for entry in entries]

    def rest(self, start: int) -> Open:
        return Open(self.lengths[start:], self.text[self.ends[start] :])


class Open(NamedTuple):
    """A chunk that is still open: the lengths of its pieces, and its text."""

    lengths: list[int]
    text: str


@dataclass
class Span:
    """What a run of segments does to the packing.

    ``head`` holds the first pieces. When they are longer than a chunk the last of them counts by
    its length only, and the span is full; else they are all there is. ``exits`` and ``made`` tell,
    per entry piece, the chunk left open (a place in ``opens``) and the number of chunks made.
    ``lead`` and ``lead_made`` tell the same for a span that begins its chapter.
    """

    head: Open
    full: bool
    exits: list[int]
    made: list[int]
    opens: list[Open]
    lead: Open
    lead_made: int

    @classmethod
    def of(cls, cutter: Cutter, text: str) -> Span:
        inner = Segment(cutter, text, leading=False)
        first = Segment(cutter, text, leading=True, later=inner.later)
        near = min(int(np.searchsorted(inner.ends, cutter.size, side="right")), len(inner.lengths))
        full = bool(inner.ends[near] > cutter.size)
        exits = inner.exits(range(near))
        lefts = sorted({left for left, _ in exits})
        ((lead, lead_made),) = first.exits([0])
        return cls(
            head=Open(inner.lengths[:near], inner.text[: inner.ends[near - full]]),
            full=full,
            exits=[lefts.index(left) for left, _ in exits],
            made=[made for _, made in exits],
            opens=[inner.rest(left) for left in lefts],
            lead=first.rest(lead),
            lead_made=lead_made,
        )

    def then(self, after: Span, cutter: Cutter) -> Span:
        """This span and the one that follows it, as one."""
        passed = [Stitcher.resume(cutter, left) for left in self.opens]
        for stitcher in passed:
            stitcher.step(after)
        lead = Stitcher.resume(cutter, self.lead)
        lead.step(after)
        ends = [(passed[at].open, made + passed[at].sequence) for at, made in zip(self.exits, self.made)]
        head, full = self.head, self.full
        if not full:
            offsets = _running(after.head.lengths) + sum(head.lengths)
            ends += [
                (after.opens[at], made)
                for at, made, offset in zip(after.exits, after.made, offsets)
                if offset <= cutter.size
            ]
            head, full = Open(head.lengths + after.head.lengths, head.text + after.head.text), after.full
        opens: list[Open] = []
        for left, _ in ends:
            if left not in opens:
                opens.append(left)
        return Span(
            head=head,
            full=full,
            exits=[opens.index(left) for left, _ in ends],
            made=[made for _, made in ends],
            opens=opens,
            lead=lead.open,
            lead_made=self.lead_made + lead.sequence,
        )

    def row(self) -> dict:
        return {
            "head_lengths": self.head.lengths,
            "head_text": self.head.text,
            "full": self.full,
            "exits": self.exits,
            "made": self.made,
            "open_lengths": [left.lengths for left in self.opens],
            "open_texts": [left.text for left in self.opens],
            "lead_lengths": self.lead.lengths,
            "lead_text": self.lead.text,
            "lead_made": self.lead_made,
        }

    @classmethod
    def from_row(cls, row: dict) -> Span:
        return cls(
            head=_open(row["head_lengths"], row["head_text"]),
            full=bool(row["full"]),
            exits=[int(n) for n in row["exits"]],
            made=[int(n) for n in row["made"]],
            opens=[_open(*pair) for pair in zip(row["open_lengths"], row["open_texts"])],
            lead=_open(row["lead_lengths"], row["lead_text"]),
            lead_made=int(row["lead_made"]),
        )


def _open(lengths: Iterable[int], text: str) -> Open:
    return Open([int(n) for n in lengths], text)


class Stitcher:
    """Follows the packing of one chapter over spans, in order."""

    def __init__(self, cutter: Cutter) -> None:
        self.cutter = cutter
        self.open: Open | None = None
        self.sequence = 0

    @classmethod
    def resume(cls, cutter: Cutter, left: Open | None, sequence: int = 0) -> Stitcher:
        stitcher = cls(cutter)
        stitcher.open, stitcher.sequence = left, sequence
        return stitcher

    def _emit(self, text: str, out: list[dict]) -> None:
        chunk = text.strip(WHITESPACE)
        if chunk:
            out.append({"chunk_sequence": self.sequence, "content": chunk})
            self.sequence += 1

    def step(self, span: Span) -> tuple[int | None, int, list[dict]]:
        """Entry piece of the span (None when no chunk starts in it), the number of its first chunk,
        and the chunks that cross into it."""
        crossing: list[dict] = []
        if self.open is None:
            self.open, self.sequence = span.lead, span.lead_made
            return 0, 0, crossing
        carried = len(self.open.lengths)
        lengths, text = self.open.lengths + span.head.lengths, self.open.text + span.head.text
        ends = _running(lengths)
        overflow, following = self.cutter.steps(ends)
        start = 0
        while start < carried and overflow[start] < len(lengths):
            self._emit(text[ends[start] : ends[overflow[start]]], crossing)
            start = int(following[start])
        if start < carried:
            self.open = Open(lengths[start:], text[ends[start] :])
            return None, self.sequence, crossing
        entry, first = start - carried, self.sequence
        self.sequence += span.made[entry]
        self.open = span.opens[span.exits[entry]]
        return entry, first, crossing

    def finish(self) -> list[dict]:
        last: list[dict] = []
        if self.open is not None:
            self._emit(self.open.text, last)
        return last


_MISSING = "\0"
_KEYS = [T.StructField(name, T.StringType()) for name in CHAPTER_KEYS]
_CROSSING = T.ArrayType(
    T.StructType(
        [T.StructField("chunk_sequence", T.IntegerType()), T.StructField("content", T.StringType())]
    )
)
_INTS = T.ArrayType(T.IntegerType())
_SPAN = [
    T.StructField("head_lengths", _INTS),
    T.StructField("head_text", T.StringType()),
    T.StructField("full", T.BooleanType()),
    T.StructField("exits", _INTS),
    T.StructField("made", _INTS),
    T.StructField("open_lengths", T.ArrayType(_INTS)),
    T.StructField("open_texts", T.ArrayType(T.StringType())),
    T.StructField("lead_lengths", _INTS),
    T.StructField("lead_text", T.StringType()),
    T.StructField("lead_made", T.IntegerType()),
]
_BLOCK, _SEGMENT = T.StructField("block", T.IntegerType()), T.StructField("segment", T.IntegerType())
_SEGMENT_SPAN = T.StructType([*_KEYS, _SEGMENT, *_SPAN])
_BLOCK_SPAN = T.StructType([*_KEYS, _BLOCK, *_SPAN])
_START = T.StructType(
    [
        *_KEYS,
        _BLOCK,
        T.StructField("begins", T.BooleanType()),
        T.StructField("ends", T.BooleanType()),
        T.StructField("start_lengths", _INTS),
        T.StructField("start_text", T.StringType()),
        T.StructField("start_sequence", T.IntegerType()),
    ]
)
_ENTRY = T.StructType(
    [
        *_KEYS,
        _SEGMENT,
        T.StructField("leading", T.BooleanType()),
        T.StructField("entry", T.IntegerType()),
        T.StructField("first_sequence", T.IntegerType()),
        T.StructField("crossing", _CROSSING),
    ]
)
_PIECE = T.StructType(
    [
        *_KEYS,
        T.StructField("chunk_sequence", T.IntegerType()),
        T.StructField("content", T.StringType()),
    ]
)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, _arrow(field.dataType)) for field in kind])
    return {"string": pa.string(), "integer": pa.int32(), "boolean": pa.bool_()}[kind.typeName()]


def _frame(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([(field.name, _arrow(field.dataType)) for field in schema]))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of all batches in order, at most PART_BYTES of text (or one row) and PART_ROWS rows at a time.

    Batches come large, and Python objects take several times the bytes of their Arrow columns.
    """
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends, at = _running(sizes), 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(ends, ends[at] + PART_BYTES, side="right")) - 1
            stop = min(max(stop, at + 1), at + PART_ROWS)
            yield batch.slice(at, stop - at).to_pylist()
            at = stop


def _keys(row: dict, *more: str) -> dict:
    return {name: row[name] for name in [*CHAPTER_KEYS, *more]}


def _spans(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            spans = [_keys(row, "segment") | Span.of(cutter, row["text"]).row() for row in rows]
            yield _frame(spans, _SEGMENT_SPAN)

    return run


def _blocks(cutter: Cutter):
    """Spans arrive whole block by whole block, in segment order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, span = None, None
        for rows in _parts(batches):
            done = []
            for row in rows:
                at = _keys(row, "block")
                if at == key:
                    span = span.then(Span.from_row(row), cutter)
                    continue
                if key is not None:
                    done.append(key | span.row())
                key, span = at, Span.from_row(row)
            yield _frame(done, _BLOCK_SPAN)
        if key is not None:
            yield _frame([key | span.row()], _BLOCK_SPAN)

    return run


def _starts(cutter: Cutter):
    """Blocks arrive whole chapter by whole chapter, in order; what is kept is one open chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chapter, stitcher, held = None, Stitcher(cutter), None
        for rows in _parts(batches):
            done = []
            for row in rows:
                begins = _keys(row) != chapter
                if held is not None:
                    done.append(held | {"ends": begins})
                if begins:
                    chapter, stitcher = _keys(row), Stitcher(cutter)
                left = stitcher.open or Open([], "")
                held = _keys(row, "block") | {"begins": begins, "start_sequence": stitcher.sequence}
                held |= {"start_lengths": left.lengths, "start_text": left.text}
                stitcher.step(Span.from_row(row))
            yield _frame(done, _START)
        if held is not None:
            yield _frame([held | {"ends": True}], _START)

    return run


def _entries(cutter: Cutter):
    """Spans arrive whole block by whole block, in segment order, each with its block's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, stitcher, held, ends = None, Stitcher(cutter), None, False
        for rows in _parts(batches):
            done = []
            for row in rows:
                fresh = _keys(row, "block") != block
                if held is not None:
                    if fresh and ends:
                        held["crossing"] += stitcher.finish()
                    done.append(held)
                if fresh:
                    block, ends = _keys(row, "block"), row["ends"]
                    start = None if row["begins"] else _open(row["start_lengths"], row["start_text"])
                    stitcher = Stitcher.resume(cutter, start, int(row["start_sequence"]))
                leading = stitcher.open is None
                entry, first, crossing = stitcher.step(Span.from_row(row))
                held = _keys(row, "segment") | {"leading": leading, "entry": entry}
                held |= {"first_sequence": first, "crossing": crossing}
            yield _frame(done, _ENTRY)
        if held is not None:
            if ends:
                held["crossing"] += stitcher.finish()
            yield _frame([held], _ENTRY)

    return run


def _chunks(cutter: Cutter):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _parts(batches):
            owners, sequence, content = [], [], []
            for at, row in enumerate(rows):
                for chunk in row["crossing"]:
                    sequence.append(chunk["chunk_sequence"])
                    content.append(chunk["content"])
                if row["entry"] is not None:
                    segment = Segment(cutter, row["text"], row["leading"])
                    content += segment.walk(row["entry"])
                    made = len(content) - len(sequence)
                    sequence += range(row["first_sequence"], row["first_sequence"] + made)
                owners += [at] * (len(content) - len(owners))
            keys = [pa.array([row[name] for row in rows], pa.string()).take(pa.array(owners, pa.int32())) for name in CHAPTER_KEYS]
            columns = [*keys, pa.array(sequence, pa.int32()), pa.array(content, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=_PIECE.fieldNames())

    return run


def _in_order(table: DataFrame, groups: list[str], *order: str) -> DataFrame:
    """Whole groups per task, each in order. The shuffle is asked for by name, so adaptive execution
    never splits a group."""
    return table.repartition(*groups).sortWithinPartitions(*groups, *order)


def split_chapters(
    pages: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    pages_per_segment: int = PAGES_PER_SEGMENT,
    segments_per_block: int = SEGMENTS_PER_BLOCK,
) -> DataFrame:
    """Chunks of every chapter: chapter keys, ``chunk_sequence`` from 0 and ``content``.

    The text is shuffled once, by chapter and segment; both passes over it read that shuffle. Spans
    are about a thousand characters per segment. They are brought together by block, and only the
    blocks, one row per ``pages_per_segment * segments_per_block`` page numbers, by chapter.
    """
    cutter = Cutter(size, overlap)
    # Joins drop null keys, so a missing file field travels as a text that no field can be.
    named = pages.withColumns({name: F.coalesce(F.col(name), F.lit(_MISSING)) for name in CHAPTER_KEYS})
    segments = chapter_segments(named, pages_per_segment)
    block_keys = [*CHAPTER_KEYS, "block"]
    spans = segments.select(*CHAPTER_KEYS, "segment", "text").mapInArrow(_spans(cutter), _SEGMENT_SPAN)
    spans = spans.withColumn("block", F.floor(F.col("segment") / segments_per_block).cast("int"))
    # As in the segments: with nothing left to infer, both uses of the spans share one shuffle.
    spans = with_values(spans, block_keys).repartition(*block_keys)
    blocks = spans.sortWithinPartitions(*block_keys, "segment").mapInArrow(_blocks(cutter), _BLOCK_SPAN)
    starts = _in_order(blocks, CHAPTER_KEYS, "block").mapInArrow(_starts(cutter), _START)
    entries = _in_order(spans.join(starts, block_keys), block_keys, "segment").mapInArrow(
        _entries(cutter), _ENTRY
    )
    return (
        segments.select(*CHAPTER_KEYS, "segment", "text")
        .join(entries, [*CHAPTER_KEYS, "segment"])
        .mapInArrow(_chunks(cutter), _PIECE)
        .withColumns({name: F.when(F.col(name) != _MISSING, F.col(name)) for name in CHAPTER_KEYS})
    )


def _chunk_id() -> Column:
    """A missing file field is left out of the id."""
    number, subject, chapter = (F.coalesce(F.col(name), F.lit("")) for name in ("class_num", "subject", "chapter"))
    return F.concat(F.lit("c"), number, F.lit("_"), subject, F.lit("_ch"), chapter, F.lit("_"), "chunk_sequence")


def chunk_table(pages: DataFrame, **options: int) -> DataFrame:
    """The chunk table of all chapters."""
    return (
        split_chapters(pages, **options)
        .withColumns(
            {
                "chunk_id": _chunk_id(),
                "source_file": F.col("filename"),
                "word_count": word_count(F.col("content")),
            }
        )
        .select(*CHUNKS.fieldNames())
    )
