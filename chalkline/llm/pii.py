"""Personal data: fixed patterns, and more of it found by the contexts these occur in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chalkline.functions.binding import let
from chalkline.session import scratch_path

KINDS = ("email", "ip", "card", "phone")

# Each begins at the end of the last match or where no earlier start is possible, and does not give back what
# it could not use otherwise; the matches are those of the plain patterns, found in one pass over a text.
_EMAIL = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
)
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}+"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PATTERNS = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}
# What a text must have for the pattern to be tried.
_SIGNS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
# Addresses with a mark or a word for the at; groups of digits one after the other; words with a digit.
_AT = r"(?i:[(\[{<]\x20?at\x20?[)\]}>])"
_ADDRESS = (
    rf"[^\s@(\[{{<]++(?:\x20?{_AT}\x20?|@)[\p{{L}}0-9]\S*+"
    r"|[\p{L}0-9._%+-]++\x20at\x20\p{L}[\p{L}0-9-]*+(?:(?:\.|\x20dot\x20)[\p{L}0-9-]++)++"
)
_GROUP = r"[(+]*+[0-9]{1,6}+(?:[)./-]++[0-9]{1,6}+)*+\)?+(?![\p{L}0-9_@])"
_CANDIDATE = rf"(?<!\S)(?:{_ADDRESS}|{_GROUP}(?:[\x20\xA0](?:[./-]\x20)?{_GROUP})++|[^\s0-9]*+[0-9]\S*+)"
# The part of a candidate between other marks, with a bracket around its first digits.
_LEAD = r"(?:(?!\([0-9]+\))[^\p{L}0-9@+])*"
_CORE = rf"(?s)^({_LEAD})(\(?[\p{{L}}0-9@+](?:.*[\p{{L}}0-9])?)(.*)$"

CONTEXT_CHARS = 64
MIN_DIGITS = 4  # of a candidate that is no address
MIN_SEEDS = 3  # distinct known identifiers that a pattern must have led to
MIN_CONFIDENCE = 0.8

_SPAN = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
_CHARS = 512  # code points of a block of a text that is redacted
_BLOCK = 128  # elements of an array that grows; appending to a longer one would copy it ever again


def _running(items: Column, kind: str, zero: Column, step, result: str, emit) -> Column:
    """``emit(state, item)`` of every item in order, the state being ``step`` applied to all items before it.

    Blocks of items are folded to find the state each of them begins with, then each is walked by itself, so the
    work grows with the number of items however many there are.
    """

    def found(items: Column) -> Column:
        count = F.ceil(F.size(items) / _BLOCK).cast("int")
        numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))

        def states(blocks: Column) -> Column:
            after = lambda state, item: step(state, item).cast(kind)
            begun = F.aggregate(
                blocks,
                F.array(zero.cast(kind)).cast(f"array<{kind}>"),
                lambda all_, block: F.array_append(all_, F.aggregate(block, F.element_at(all_, -1), after)).cast(f"array<{kind}>"),
            )
            walk = f"struct<state:{kind},out:array<{result}>>"

            def walked(block: Column, state: Column) -> Column:
                start = F.struct(state.alias("state"), F.array().cast(f"array<{result}>").alias("out")).cast(walk)
                return F.aggregate(
                    block,
                    start,
                    lambda so, item: F.struct(
                        after(so["state"], item).alias("state"), F.array_append(so["out"], emit(so["state"], item).cast(result)).alias("out")
                    ).cast(walk),
                    lambda so: so["out"],
                )

            return F.flatten(F.zip_with(blocks, F.slice(begun, F.lit(1), F.size(blocks)), walked))

        return let(F.transform(numbers, lambda i: F.slice(items, i * _BLOCK + 1, F.lit(_BLOCK))), states)

    return let(items, found)


def _matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points and the characters of the text on either side."""
    chars = F.lit(CONTEXT_CHARS)

    def placed(pieces: Column) -> Column:
        pairs = F.arrays_zip(
            F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("piece"),
            F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"),
        )

        def head(after: Column, pair: Column) -> Column:
            return F.left(F.concat(F.left(pair["piece"], chars), F.left(pair["value"], chars), after), chars)

        backwards = let(pairs, lambda every: _running(F.reverse(every), "string", F.left(F.element_at(pieces, -1), chars), head, "string", lambda after, _: after))
        state = "struct<at:int,tail:string>"

        def left_of(before: Column, item: Column) -> Column:
            return F.right(F.concat(before["tail"], F.right(item["piece"], chars)), chars)

        def passed(before: Column, item: Column) -> Column:
            return F.struct(
                (before["at"] + F.length(item["piece"]) + F.length(item["value"])).alias("at"),
                F.right(F.concat(left_of(before, item), F.right(item["value"], chars)), chars).alias("tail"),
            )

        def span(before: Column, item: Column) -> Column:
            begin = before["at"] + F.length(item["piece"])
            return F.struct(
                begin.alias("start"), (begin + F.length(item["value"])).alias("end"), item["value"].alias("value"),
                left_of(before, item).alias("left"), item["right"].alias("right"),
            )

        both = F.zip_with(
            pairs,
            F.reverse(backwards),
            lambda pair, right: F.struct(pair["piece"].alias("piece"), pair["value"].alias("value"), right.alias("right")),
        )
        zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"))
        return _running(both, state, zero, passed, _SPAN.removeprefix("array<").removesuffix(">"), span)

    return let(F.split(text, pattern, -1), placed)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def step(total: Column, back: Column) -> Column:
        digit = F.substring(digits, n - back, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return total + F.when(back % 2 == 1, doubled).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        short = F.transform(F.split(value, r"\."), lambda part: F.regexp_replace(part, "^0+(?=[0-9])", ""))
        return F.forall(short, lambda part: (F.length(part) <= 3) & (F.substring(part, 1, 3).cast("int") <= 255))
    if kind == "card":
        return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """The matches of a kind's pattern that pass its test, leftmost first and without overlap."""
    found = F.filter(_matches(text, _PATTERNS[kind]), lambda span: _passes(kind, span["value"]))
    return F.when(text.rlike(_SIGNS[kind]), found).otherwise(F.array().cast(_SPAN))


def _meets(spans: Column, one: Column) -> Column:
    """Whether ``one`` overlaps any of some spans in order that do not overlap each other, by halving."""
    halvings = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    every = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state["low"] + state["high"]) / 2).cast("int")
        before = F.get(spans, middle)["start"] < one["end"]
        return F.struct(
            F.when(before, middle).otherwise(state["low"]).alias("low"), F.when(before, state["high"]).otherwise(middle).alias("high")
        )

    last = F.aggregate(halvings, every, halve, lambda state: F.get(spans, state["low"]))
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(
        let(last, lambda span: (span["start"] < one["end"]) & (one["start"] < span["end"]))
    )


def _candidates(text: Column, taken: list[Column]) -> Column:
    """Addresses, runs of digit groups, and words with several digits that overlap no span of the arrays ``taken``."""

    def trimmed(span: Column) -> Column:
        lead, core, rest = (F.regexp_extract(span["value"], _CORE, i) for i in (1, 2, 3))
        start = span["start"] + F.length(lead)
        return F.struct(
            start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"),
            F.concat(span["left"], lead).alias("left"), F.concat(rest, span["right"]).alias("right"),
        )

    found = F.transform(_matches(text, _CANDIDATE), trimmed)
    free = F.filter(
        found,
        lambda one: ((F.length(_digits(one["value"])) >= MIN_DIGITS) | one["value"].rlike(f"^(?:{_ADDRESS})"))
        & ~reduce(Column.__or__, [_meets(spans, one) for spans in taken]),
    )
    signs = rf"@|{_AT}|\x20at\x20|[0-9](?:[^0-9]*+[0-9]){{{MIN_DIGITS - 1}}}"
    return F.when(text.rlike(signs), free).otherwise(F.array().cast(_SPAN))


def _patterns_of(left: Column, right: Column) -> Column:
    """The lexical patterns: one and two words on either side in lower case with digits masked, as far as there are such.

    A single word must have a letter or digit, for a mark alone leads anywhere.
    """
    word = r"[^\s\p{L}0-9]*[\p{L}0-9]\S*"
    found = [
        ("<", left, rf"(?<!\S)({word})\s*$"), ("<", left, r"(?<!\S)(\S+\s+\S+)\s*$"),
        (">", right, rf"^\s*({word})(?!\S)"), (">", right, r"^\s*(\S+\s+\S+)(?!\S)"),
    ]

    def masked(side: str, words: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(F.lower(words), "[0-9]", "0"), r"\s+", " ")
        return F.when(words != "", F.concat(F.lit(side), plain))

    return F.array_compact(F.array(*[masked(side, F.regexp_extract(text, shape, 1)) for side, text, shape in found]))


def _read(docs: DataFrame, text: str) -> DataFrame:
    """One pass over the texts: the base spans by kind, and candidates, with their patterns."""
    body = F.coalesce(F.col(text), F.lit(""))
    spans = docs.select("*", *[base_spans(body, kind).alias(f"__{kind}") for kind in KINDS])
    taken = [F.col(f"__{kind}") for kind in KINDS]

    def narrow(column: Column) -> Column:
        return F.transform(
            column,
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"),
                F.lower(s["value"]).alias("value"), _patterns_of(s["left"], s["right"]).alias("patterns"),
            ),
        )

    return spans.select(
        *docs.columns, *[narrow(F.col(f"__{k}")).alias(f"__{k}") for k in KINDS], narrow(_candidates(body, taken)).alias("__other")
    )


def learn_patterns(found: DataFrame, spark) -> DataFrame:
    """pattern, kind, confidence of the patterns that lead to identifiers.

    The graph has an edge for each pattern and instance (an identifier's text) seen together. Known instances
    weigh 1 at first: the base entities. A pattern's confidence in a kind is the weighted share of its
    distinct instances known to be of the kind, and it counts once it has MIN_SEEDS of them; an unknown
    instance then weighs 1 less the product of what its patterns leave open, and is known for the next
    round from MIN_CONFIDENCE on. Weights only rise from round to round, and rounds end when no instance becomes
    known. Copies of a text add nothing, for instances count once.
    """
    parts = [
        found.select(F.lit(kind).alias("kind"), F.inline(f"__{kind}")).select("kind", F.explode("patterns").alias("pattern"), "value")
        for kind in KINDS
    ]
    parts.append(
        found.select(F.lit(None).cast("string").alias("kind"), F.inline("__other")).select("kind", F.explode("patterns").alias("pattern"), "value")
    )
    edges = parts[0]
    for part in parts[1:]:
        edges = edges.unionByName(part)
    path = scratch_path(spark, "pattern-graph")
    edges.groupBy("pattern", "value").agg(F.max("kind").alias("seed")).write.parquet(path)
    edges = spark.read.schema("pattern string, value string, seed string").parquet(path)

    known = edges.where(F.col("seed").isNotNull()).select("pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("weight"))
    before = 0
    while True:
        totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
        votes = known.groupBy("pattern", "kind").agg(F.sum("weight").alias("votes"))
        patterns = (
            votes.join(totals, "pattern")
            .where((F.col("votes") >= MIN_SEEDS) & (F.col("votes") >= MIN_CONFIDENCE * F.col("n")))
            .select("pattern", "kind", (F.col("votes") / F.col("n")).alias("confidence"))
        )
        path = scratch_path(spark, "patterns")
        patterns.write.parquet(path)
        patterns = spark.read.schema(patterns.schema).parquet(path)
        weights = (
            edges.where(F.col("seed").isNull())
            .join(patterns, "pattern")
            .groupBy("value", "kind")
            .agg((1 - F.product(1 - F.col("confidence"))).alias("weight"))
            .where(F.col("weight") >= MIN_CONFIDENCE)
        )
        path = scratch_path(spark, "instances")
        weights.write.parquet(path)
        weights = spark.read.schema(weights.schema).parquet(path)
        size = weights.count()
        if size == before:
            return patterns
        before = size
        unseen = edges.where(F.col("seed").isNull()).join(weights, "value").select("pattern", "value", "kind", "weight")
        seeds = edges.where(F.col("seed").isNotNull()).select(
            "pattern", "value", F.col("seed").alias("kind"), F.lit(1.0).alias("weight")
        )
        known = seeds.unionByName(unseen)


def _ordered(spans: Column) -> Column:
    return F.array_sort(spans)


def _text(spans: Column) -> Column:
    """kind:start:end of spans in order, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
    )


def _labelled(column: str, kind: Column) -> Column:
    return F.transform(
        column, lambda s: F.struct(s["start"].alias("start"), kind.alias("kind"), s["end"].alias("end"))
    )


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, counts by kind, base spans and all spans of each row of ``docs``.

    Spans are struct(start, kind, end) in code points, ordered by start, then kind as listed. Null texts are
    empty and have none; equal rows are found alike; other columns are not read. What contexts add never
    overlaps a base span of the same text, and carries the kind that its pattern leads to.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    path = scratch_path(spark, "base-spans")
    read = _read(rows, "text").drop("text").withColumn("row", F.monotonically_increasing_id())
    read.write.parquet(path)
    found = spark.read.schema(read.schema).parquet(path)
    patterns = learn_patterns(found, spark)
    more = (
        found.select("row", F.inline("__other"))
        .select("row", "start", "end", F.explode("patterns").alias("pattern"))
        .join(patterns, "pattern")
        .groupBy("row", "start", "end")
        .agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
        .select("row", "start", (F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")) - 1).cast("int").alias("kind"), "end")
        .groupBy("row")
        .agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    )
    base = F.concat(*[_labelled(f"__{kind}", F.lit(i)) for i, kind in enumerate(KINDS)])
    joined = found.withColumn("base", _ordered(base)).join(more, "row", "left")
    return joined.select(
        "key",
        *[F.size(f"__{kind}").cast("long").alias(f"n_{kind}") for kind in KINDS],
        "base",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(_ordered(F.concat("base", F.coalesce("more", "base")))).alias("spans"),
    )


def _between(blocks: Column, low: Column, high: Column) -> Column:
    """The code points from ``low`` up to ``high`` of a text in blocks of _CHARS; a substring of all of it would count them from its start."""

    def part(i: Column) -> Column:
        first = F.greatest(low - i * _CHARS, F.lit(0))
        return F.substring(F.get(blocks, i), first + 1, F.least(high - i * _CHARS, F.lit(_CHARS)) - first)

    numbers = F.sequence(F.floor(low / _CHARS).cast("int"), F.floor((high - 1) / _CHARS).cast("int"))
    return F.when(high > low, F.array_join(F.transform(numbers, part), "")).otherwise(F.lit(""))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with each span of personal data in ``text`` replaced by its kind.

    An email address becomes ``<EMAIL>`` and so on; spans that overlap become one mark, that of the first, so nothing of any
    is left. Texts without any, null ones among them, stay as they are. Spans come back to the texts by the digests
    of these; columns of any name pass.
    """
    digest = F.sha2(F.col(text), 256)
    spans = find(docs.select(digest.alias("key"), F.col(text).alias("body")), "key", "body")
    hits = spans.where(F.size("spans") > 0).groupBy(F.col("key").alias("hit")).agg(F.first("spans").alias("spans"))
    rows = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("row"), docs[text].alias("body"))
    joined = rows.withColumn("digest", F.sha2("body", 256)).join(hits, F.col("digest") == F.col("hit"), "left")
    marks = F.array(*[F.lit(f"<{kind.upper()}>") for kind in KINDS])
    body = F.col("body")

    def cleaned(spans: Column) -> Column:
        # Where the text before a span ends that no earlier span covers, and the mark of a span that begins there.
        reach = lambda end, span: F.greatest(end, span["end"])
        cut = "struct<from:int,upto:int,mark:string>"
        cuts = _running(
            spans, "int", F.lit(0), reach, cut,
            lambda end, span: F.struct(
                end.alias("from"), F.greatest(end, span["start"]).alias("upto"),
                F.when(span["start"] >= end, F.get(marks, span["kind"])).otherwise(F.lit("")).alias("mark"),
            ),
        )
        last = F.aggregate(spans, F.lit(0), reach)
        return let(
            F.regexp_extract_all(body, F.lit(f"(?s).{{1,{_CHARS}}}"), F.lit(0)),
            lambda blocks: F.concat(
                F.array_join(F.transform(cuts, lambda c: F.concat(_between(blocks, c["from"], c["upto"]), c["mark"])), ""),
                _between(blocks, last, F.length(body)),
            ),
        )

    changed = F.when(F.col("spans").isNull(), body).otherwise(cleaned(F.col("spans")))
    out = joined.withColumn("cleaned", changed)
    return out.select(*[F.col("cleaned").alias(text) if name == text else F.col("row")[name].alias(name) for name in docs.columns])


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, the digest of the base spans and all spans as text, per row."""
    return find(docs, doc_id, text).select(
        F.col("key").alias("doc_id"),
        *[f"n_{kind}" for kind in KINDS],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"),
        _text(F.col("spans")).alias("spans"),
    )
