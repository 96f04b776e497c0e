"""Toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word enters as the vector of the word in lower case, if it is known, beside the mean vector of its runs of
characters, in lower case and as they are written.
A gated recurrent layer reads each window from either end, attention pools its states, and a window's
score is a logistic function of the pooled state. A text scores as its highest window. The network is trained
in numpy inside one task on a bounded sample; scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks as B

WINDOW = 48  # words
STRIDE = 32  # between starts of windows; neighbouring windows share the words between
WORD_SIZE, CHAR_SIZE, HIDDEN, ATTENTION = 12, 8, 8, 8
GRAMS, GRAM_BITS = (3, 4, 5), 14  # lengths of character n-grams, and the binary logarithm of their cells
SAMPLE_ROWS = 4096  # labelled rows that are learnt from, at most half of them of either label; others are not used
SAMPLE_WINDOWS = 64  # of each of these, spread evenly over the text
KNOWN_DOCS = 20  # sampled rows that a word with a vector of its own is in
KNOWN_WORDS = 20_000  # with a vector, those in the most rows
EPOCHS, STEPS, BATCH, RATE = 8, 700, 64, 0.01  # at least so many rounds and steps; windows in a step; size of the first steps
DECAY = 0.2  # of every weight, times the rate
FORGET = 0.3  # of the words in a batch are read by their characters alone, so that these are learnt, too
THRESHOLD = 0.3
_MARK = 0x20  # stands before and after a word; no word holds it
_BATCH_WINDOWS = 2048


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Model:
    """Bounded by KNOWN_WORDS and GRAM_BITS whatever the corpus; about 2 MB."""

    known: np.ndarray  # hashes of the words with vectors, in order
    prior: float
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _fresh(known: np.ndarray, prior: float, seed: int = 5) -> Model:
    rng = np.random.default_rng(seed)
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    weights = {"words": draw(len(known) + 1, WORD_SIZE, scale=0.1), "chars": draw(1 << GRAM_BITS, CHAR_SIZE, scale=0.1)}
    weights["words"][0] = 0
    for way in ("ahead", "back"):
        weights[f"{way}_in"] = draw(WORD_SIZE + CHAR_SIZE, 3 * HIDDEN, scale=0.3)
        weights[f"{way}_bias"] = np.zeros(3 * HIDDEN, np.float32)
        weights[f"{way}_gates"] = draw(HIDDEN, 2 * HIDDEN, scale=0.3)
        weights[f"{way}_state"] = draw(HIDDEN, HIDDEN, scale=0.3)
    weights["look_in"], weights["look"] = draw(2 * HIDDEN, ATTENTION, scale=0.3), draw(ATTENTION, scale=0.3)
    weights["out"], weights["out_bias"] = draw(2 * HIDDEN, scale=0.3), np.zeros(1, np.float32)
    return Model(known, prior, weights)


# Input


@dataclass(frozen=True)
class Words:
    """Distinct words: their places among the known ones (0: none), and the cells of their character n-grams."""

    places: np.ndarray
    cells: np.ndarray
    starts: np.ndarray
    counts: np.ndarray


def _lower(words: pa.LargeBinaryArray) -> pa.LargeBinaryArray:
    data, offsets = B.text_bytes(words)
    return B.slices(B.LOWER[data], offsets)


def _words(distinct: pa.LargeBinaryArray, known: np.ndarray) -> Words:
    data, offsets = B.text_bytes(distinct)
    lengths = np.diff(offsets)
    hashes = B.word_hashes(_lower(distinct))
    at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
    places = np.where(known[at] == hashes, at + 1, 0) if len(known) else np.zeros(len(lengths), np.int64)
    # Words between marks, one after the other; an n-gram may start at any place that leaves it inside its word.
    owner = np.repeat(np.arange(len(lengths)), lengths + 2)
    marked = np.full(len(owner), _MARK, dtype=np.uint64)
    marked[np.arange(len(data)) + 2 * np.repeat(np.arange(len(lengths)), lengths) + 1] = data
    owners, cells = [], []
    for shape, written in enumerate((B.LOWER[marked.astype(np.uint8)].astype(np.uint64), marked)):
        for size in GRAMS:
            count = max(len(owner) - size + 1, 0)
            code = np.zeros(count, np.uint64)
            for i in range(size):
                code = code << np.uint64(8) | written[i : i + count]
            inside = np.flatnonzero(owner[:count] == owner[len(owner) - count :])
            mixed = B.mixed(code[inside] + (np.uint64(2 * size + shape) << np.uint64(48)))
            owners.append(owner[inside])
            cells.append((mixed >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(lengths))
    cells = np.concatenate(cells)[order]
    return Words(places, cells, B.offsets_of(counts)[:-1], counts)


def _inputs(words: Words, weights: dict[str, np.ndarray]) -> np.ndarray:
    if not len(words.places):
        return np.zeros((0, WORD_SIZE + CHAR_SIZE), np.float32)
    chars = np.add.reduceat(weights["chars"][words.cells], words.starts, axis=0) / words.counts[:, None]
    return np.hstack([weights["words"][words.places], chars.astype(np.float32)])


def _windows(firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window, and the first window of each text; texts without words have none."""
    sizes = np.diff(firsts)
    counts = np.where(sizes > WINDOW, 1 + -(-(sizes - WINDOW) // STRIDE), (sizes > 0).astype(np.int64))
    starts = B.gather(np.zeros(len(counts), np.int64), counts) * STRIDE
    lengths = np.minimum(WINDOW, np.repeat(sizes, counts) - starts)
    return np.repeat(firsts[:-1], counts) + starts, lengths, B.offsets_of(counts)


def _grid(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, absent: int) -> np.ndarray:
    """The word codes of each window in a row, ``absent`` behind a shorter one."""
    steps = np.arange(WINDOW)
    places = np.minimum(starts[:, None] + steps, max(len(codes) - 1, 0))
    return np.where(steps < lengths[:, None], codes[places], absent)


# The network


def _read(projected: np.ndarray, grid: np.ndarray, weights: dict, way: str, keep: list | None = None) -> np.ndarray:
    """States (step, window, HIDDEN) of one direction. A word code of the last row of ``projected`` leaves the state as it is."""
    steps = range(WINDOW) if way == "ahead" else range(WINDOW - 1, -1, -1)
    gates, inner = weights[f"{way}_gates"], weights[f"{way}_state"]
    state = np.zeros((len(grid), HIDDEN), np.float32)
    states = np.empty((WINDOW, len(grid), HIDDEN), np.float32)
    by_step = np.ascontiguousarray(grid.T)
    gone = by_step == len(projected) - 1
    some_gone = gone.any(axis=1)
    for step in steps:
        given = projected[by_step[step]]
        gate = _sigmoid(given[:, : 2 * HIDDEN] + state @ gates)
        stay, reset = gate[:, :HIDDEN], gate[:, HIDDEN:]
        fresh = np.tanh(given[:, 2 * HIDDEN :] + (reset * state) @ inner)
        if some_gone[step]:
            stay[gone[step]] = 1
        if keep is not None:
            keep.append((step, state, stay, reset, fresh))
        state = fresh + stay * (state - fresh)
        states[step] = state
    return states


def _projected(inputs: np.ndarray, weights: dict, way: str) -> np.ndarray:
    """What each distinct word adds to the gates and the state, with a row for no word at all."""
    rows = inputs @ weights[f"{way}_in"] + weights[f"{way}_bias"]
    return np.vstack([rows, np.zeros((1, 3 * HIDDEN), np.float32)])


def _pooled(states: np.ndarray, present: np.ndarray, weights: dict) -> tuple[np.ndarray, ...]:
    looked = np.tanh(states @ weights["look_in"])
    scores = np.where(present, looked @ weights["look"], -np.inf)
    shares = np.exp(scores - scores.max(axis=0))
    shares /= shares.sum(axis=0)
    pooled = (shares[:, :, None] * states).sum(axis=0)
    return pooled @ weights["out"] + weights["out_bias"][0], pooled, shares, looked


def _logits(inputs: np.ndarray, grid: np.ndarray, weights: dict) -> np.ndarray:
    sides = {way: _projected(inputs, weights, way) for way in ("ahead", "back")}
    found = [np.zeros(0, np.float32)]
    for low in range(0, len(grid), _BATCH_WINDOWS):
        part = grid[low : low + _BATCH_WINDOWS]
        states = np.concatenate([_read(side, part, weights, way) for way, side in sides.items()], axis=2)
        found.append(_pooled(states, (part != len(inputs)).T, weights)[0])
    return np.concatenate(found)


# Training


def _summed(index: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """The sum of the rows of ``values`` at each index."""
    found = np.zeros((size, values.shape[1]), np.float32)
    if len(index):
        order = np.argsort(index, kind="stable")
        ordered = index[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        found[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return found


def _gradients(words: Words, grid: np.ndarray, labels: np.ndarray, weights: dict) -> dict[str, np.ndarray]:
    """Of the mean logistic loss of these windows; by hand, from the last step to the first."""
    inputs = _inputs(words, weights)
    sides, kept, states = {}, {}, []
    for way in ("ahead", "back"):
        sides[way], kept[way] = _projected(inputs, weights, way), []
        states.append(_read(sides[way], grid, weights, way, kept[way]))
    states = np.concatenate(states, axis=2)
    logits, pooled, shares, looked = _pooled(states, (grid != len(inputs)).T, weights)
    slope = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
    found = {"out": pooled.T @ slope, "out_bias": np.array([slope.sum()], np.float32)}

    to_pooled = slope[:, None] * weights["out"]
    to_share = np.einsum("bh,sbh->sb", to_pooled, states)
    to_score = shares * (to_share - (shares * to_share).sum(axis=0))
    found["look"] = np.einsum("sb,sba->a", to_score, looked)
    to_look = to_score[:, :, None] * weights["look"] * (1 - looked**2)
    found["look_in"] = np.einsum("sbh,sba->ha", states, to_look)
    to_states = shares[:, :, None] * to_pooled + to_look @ weights["look_in"].T

    to_inputs = np.zeros_like(inputs)
    for side, way in enumerate(("ahead", "back")):
        gates, inner = weights[f"{way}_gates"], weights[f"{way}_state"]
        to_gates, to_inner = np.zeros_like(gates), np.zeros_like(inner)
        to_given = np.empty((WINDOW, len(grid), 3 * HIDDEN), np.float32)
        later = np.zeros((len(grid), HIDDEN), np.float32)
        for step, before, stay, reset, fresh in reversed(kept[way]):
            later = later + to_states[step, :, side * HIDDEN : (side + 1) * HIDDEN]
            to_fresh = later * (1 - stay) * (1 - fresh**2)
            to_stay = later * (before - fresh) * stay * (1 - stay)
            to_reset_state = to_fresh @ inner.T
            to_reset = to_reset_state * before * reset * (1 - reset)
            to_gate = np.hstack([to_stay, to_reset])
            to_inner += (reset * before).T @ to_fresh
            to_gates += before.T @ to_gate
            to_given[step] = np.hstack([to_gate, to_fresh])
            later = later * stay + to_reset_state * reset + to_gate @ gates.T
        rows = _summed(grid.T.ravel(), to_given.reshape(-1, 3 * HIDDEN), len(inputs) + 1)[:-1]
        found |= {f"{way}_gates": to_gates, f"{way}_state": to_inner, f"{way}_in": inputs.T @ rows, f"{way}_bias": rows.sum(axis=0)}
        to_inputs += rows @ weights[f"{way}_in"].T
    found["words"] = _summed(words.places, to_inputs[:, :WORD_SIZE], len(weights["words"]))
    found["words"][0] = 0  # words without a vector of their own share none
    each = np.repeat(to_inputs[:, WORD_SIZE:] / words.counts[:, None], words.counts, axis=0)
    found["chars"] = _summed(words.cells, each, len(weights["chars"]))
    return found


def _some(words: Words, grid: np.ndarray) -> tuple[Words, np.ndarray]:
    """Only the words of these windows, and the windows in their codes."""
    size = len(words.places)
    used, codes = np.unique(np.append(grid.ravel(), size), return_inverse=True)
    used = used[:-1]
    cells = words.cells[B.gather(words.starts[used], words.counts[used])]
    starts = B.offsets_of(words.counts[used])[:-1]
    return Words(words.places[used], cells, starts, words.counts[used]), codes[:-1].reshape(grid.shape)


def train(texts: pa.Array, labels: np.ndarray, prior: float) -> Model:
    """A network of labelled texts; the same rows in the same order give the same one.

    ``prior`` is the share of label 1 among all labelled rows, which the scores are adjusted to.

    In each round every text is learnt from by its highest window so far, and one more at random, which for a
    text of label 1 counts only at first; the rest of its windows may be harmless.
    """
    found, firsts = B.letter_runs(*B.text_bytes(texts), lower=False)
    coded = found.dictionary_encode()
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    lower = _lower(distinct).dictionary_encode()
    size = max(len(lower.dictionary), 1)
    rows = np.repeat(np.arange(len(labels)), np.diff(firsts))
    in_rows = np.bincount(np.unique(rows * size + lower.indices.to_numpy()[codes]) % size, minlength=len(lower.dictionary))
    hashes = B.word_hashes(lower.dictionary)
    often = np.flatnonzero(in_rows >= KNOWN_DOCS)
    often = often[np.lexsort((hashes[often], -in_rows[often]))][:KNOWN_WORDS]
    model = _fresh(np.unique(hashes[often]), prior)
    starts, lengths, bounds = _windows(firsts)
    if not len(starts):
        return model
    words, grid = _words(distinct, model.known), _grid(codes, starts, lengths, len(distinct))
    weights, rng = model.weights, np.random.default_rng(6)
    sums = {name: (np.zeros_like(value), np.zeros_like(value)) for name, value in weights.items()}
    full = np.flatnonzero(np.diff(bounds))
    turn, epochs = 0, max(EPOCHS, math.ceil(STEPS * BATCH / (2 * len(full))))
    for epoch in range(epochs):
        logits = _logits(_inputs(words, weights), grid, weights)
        top = np.maximum.reduceat(logits, bounds[full])
        highest = np.flatnonzero(logits == np.repeat(top, np.diff(bounds)[full]))
        highest = highest[np.unique(np.searchsorted(bounds, highest, side="right") - 1, return_index=True)[1]]
        other = bounds[full] + (rng.random(len(full)) * np.diff(bounds)[full]).astype(np.int64)
        harmless = (labels[full] == 0) | (epoch == 0)
        chosen = np.concatenate([highest, other[harmless]])
        truth = np.concatenate([labels[full], labels[full][harmless]]).astype(np.float32)
        order = rng.permutation(len(chosen))
        rate = RATE * (1 - epoch / epochs)
        for low in range(0, len(order), BATCH):
            part = order[low : low + BATCH]
            some, small = _some(words, grid[chosen[part]])
            some = replace(some, places=np.where(rng.random(len(some.places)) < FORGET, 0, some.places))
            turn += 1
            for name, slope in _gradients(some, small, truth[part], weights).items():
                mean, square = sums[name]
                mean *= 0.9
                mean += 0.1 * slope
                square *= 0.999
                square += 0.001 * slope**2
                step = mean / (1 - 0.9**turn) / (np.sqrt(square / (1 - 0.999**turn)) + 1e-8)
                weights[name] -= (rate * (step + DECAY * weights[name])).astype(np.float32)
    if 0 < prior < 1 and 0 < labels.mean() < 1:
        odds = lambda share: math.log(share / (1 - share))
        weights["out_bias"] += np.float32(odds(prior) - odds(labels.mean()))
    return model


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    """The score of each text: that of its highest window, or the mean label without any word."""
    found, firsts = B.letter_runs(*B.text_bytes(texts), lower=False)
    coded = found.dictionary_encode()
    starts, lengths, bounds = _windows(firsts)
    scores = np.full(len(bounds) - 1, model.prior)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        inputs = _inputs(_words(coded.dictionary, model.known), model.weights)
        codes, logits = coded.indices.to_numpy().astype(np.int64), []
        for low in range(0, len(starts), 16 * _BATCH_WINDOWS):
            part = slice(low, low + 16 * _BATCH_WINDOWS)
            logits.append(_logits(inputs, _grid(codes, starts[part], lengths[part], len(inputs)), model.weights))
        top = np.maximum.reduceat(np.concatenate(logits), bounds[full])
        scores[full] = _sigmoid(top.astype(np.float64))
    return scores


# Spark


def _excerpts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the words of at most SAMPLE_WINDOWS windows of a text in place of the text."""
    for batch in B.text_blocks(batches, "text"):
        found, firsts = B.letter_runs(*B.text_bytes(batch.column("text")), lower=False)
        starts, lengths, bounds = _windows(firsts)
        counts = np.diff(bounds)
        few = np.minimum(counts, SAMPLE_WINDOWS)
        nth = B.gather(np.zeros(len(few), np.int64), few)
        picked = np.repeat(bounds[:-1], few) + nth * np.repeat(counts, few) // np.maximum(np.repeat(few, few), 1)
        # Overlapping windows that stay side by side share their words.
        ends = np.minimum(starts[picked] + lengths[picked], np.append(starts[picked][1:], np.iinfo(np.int64).max))
        last = np.append(np.diff(np.repeat(np.arange(len(few)), few)) != 0, True)[: len(picked)]
        ends[last] = (starts[picked] + lengths[picked])[last]
        sizes = ends - starts[picked]
        words = found.take(pa.array(B.gather(starts[picked], sizes)))
        per_row = np.zeros(len(few), np.int64)
        np.add.at(per_row, np.repeat(np.arange(len(few)), few), sizes)
        lists = pa.LargeListArray.from_arrays(pa.array(B.offsets_of(per_row)), words)
        text = pa.compute.binary_join(lists, pa.scalar(b" ", pa.large_binary()))
        yield pa.RecordBatch.from_arrays([batch.column("at"), batch.column("label"), text.cast(pa.binary())], names=["at", "label", "text"])


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "label", sample_rows: int = SAMPLE_ROWS
) -> Model:
    """A model of the texts of ``docs`` whose ids ``labels`` gives a label of 0 or 1.

    Of either label, those of the ``sample_rows`` / 2 smallest hashes of ids are used, which depends on ids alone; only
    these few ids meet the documents, in the scan, and at most SAMPLE_WINDOWS windows of each text are sent to the
    one task that trains. Scores are adjusted to the share of label 1 among all labels. Rows without a label or id take no part; null texts count as empty. Without any labelled row
    every text scores one half.
    """
    spark = docs.sparkSession
    at = F.xxhash64(F.col("id"), F.lit("sample"))
    given = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label")).dropna()
    half = [given.where(F.col("label") == y).withColumn("at", at).orderBy("at", "id").limit(sample_rows // 2) for y in (0, 1)]
    few = half[0].unionByName(half[1])
    mean = given.agg(F.avg("label")).first()[0]
    prior = 0.5 if mean is None else mean
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    met = rows.join(F.broadcast(few), "id").select("at", "label", "text")
    parts = met.mapInArrow(_excerpts, "at long, label double, text binary")
    bounded = parts.orderBy("at", "text", "label").limit(sample_rows)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), pa.schema([("at", pa.int64()), ("label", pa.float64()), ("text", pa.binary())]))
        texts = table.column("text").cast(pa.large_binary()).combine_chunks()
        model = train(texts, table.column("label").to_numpy(), prior)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = bounded.coalesce(1).mapInArrow(learn, "model binary").first()
    return pickle.loads(found["model"]) if found else _fresh(np.zeros(0, np.uint64), 0.5)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1, higher where label 1 is likelier.

    All windows of whole texts are scored. Empty and null texts, and texts without any letter, score the mean label. All
    columns stay; one that has the name of the score is replaced. Equal texts score alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = [c for c in docs.columns if c != name]
    source = docs.select(F.struct(*[docs[c] for c in held]).alias("row"), docs[text].alias("text"))
    schema = source.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in B.text_blocks(batches, "text"):
            scores = pa.array(score_texts(batch.column("text"), model), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("row"), scores], names=["row", "score"])

    scored = source.mapInArrow(run, f"row {schema}, score double")
    return scored.select(*[F.col("row")[c].alias(c) for c in held], F.col("score").alias(name))
