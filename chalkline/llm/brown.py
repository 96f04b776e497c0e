"""Class-based bigram scoring: words fall into classes by exchange clustering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.llm.words import ASKED, KNOWN, PLACES, answered, by_position, homes_of, met, once, placed
from chalkline.session import scratch_path

SUPPORT = 5  # training tokens from which a word is dealt to a learnt class
WORDS = 1000  # the most frequent of them, with which the driver starts the classes
CLASSES = 40
OPEN = 64  # classes of rarer and unseen words, by their last two bytes
PASSES = 4  # over the words that start the classes
ROUNDS = 2  # over all words with SUPPORT
ADDED = 0.1  # to every count
_MATRIX_PARTS = 16

END = 0  # the symbol and the class of the end of a text


@dataclass(frozen=True)
class Model:
    """Bounded by CLASSES and OPEN, but for ``known``, a table that stays where it is written."""

    known: DataFrame  # the words with a learnt class, as KNOWN parcels
    learnt: int  # classes that words are dealt to; the open classes follow
    transitions: np.ndarray  # log10 P(class | class before)
    room: np.ndarray  # log10 of what the emissions of each class are divided by
    tokens: int  # in the training texts, ends among them
    distinct: int
    texts: int  # for training


def _cut(data: np.ndarray, offsets: np.ndarray):
    return B.words_of(data, offsets, lower=True)


def _open_class(words: pa.Array) -> np.ndarray:
    data, offsets = B.text_bytes(words)
    last = data[offsets[1:] - 1].astype(np.uint64) if len(words) else np.zeros(0, np.uint64)
    before = np.where(np.diff(offsets) > 1, data[offsets[1:] - 2], 0).astype(np.uint64) if len(words) else last
    return (B.mixed(last << np.uint64(8) | before) % np.uint64(OPEN)).astype(np.int64)


def _symbols(distinct: pa.Array, words: pa.Array) -> np.ndarray:
    """The symbol of each word: 1 on for listed words, then the open classes."""
    at = pc.index_in(distinct, value_set=words)
    listed = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(listed >= 0, listed + 1, 1 + len(words) + _open_class(distinct))


def _stream(firsts: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of texts one after the other, each closed by the end, and where each text begins."""
    places = firsts + np.arange(len(firsts))
    stream = np.full(places[-1], END, np.int64)
    inside = np.ones(len(stream), dtype=bool)
    inside[places[1:] - 1] = False
    stream[inside] = symbols
    return stream, places


def _train_counts(batch, firsts, codes, size) -> np.ndarray:
    train = batch.column("train").to_numpy(zero_copy_only=False).astype(np.float64)
    return np.bincount(codes, np.repeat(train, np.diff(firsts)), size).astype(np.int64)


def _prepared(docs: DataFrame, doc_id: str, text: str, train: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.col(train), F.lit(False)).alias("train"),
    )


def _read_once(rows: DataFrame) -> DataFrame:
    """The words of all training texts and their places, cut once and written for all rounds."""

    def keep(batch, firsts, codes, distinct):
        data, offsets = B.text_bytes(distinct)
        return data.tobytes(), B.narrow(np.diff(offsets))

    return _written(once(rows.where("train"), "doc_id", "text", _cut, keep, _train_counts), "words")


def _kept_words(kept: tuple) -> pa.LargeBinaryArray:
    return B.slices(np.frombuffer(kept[0], np.uint8), B.offsets_of(kept[1]))


def _vocabulary(texts: DataFrame) -> tuple[DataFrame, pa.Array, np.ndarray, np.ndarray]:
    """The words with SUPPORT and their counts by home, the most frequent, and the other words' tokens and kinds by open class.

    Every training word is counted; a partition returns its most frequent words and a sum per class.
    """
    spark, count = texts.sparkSession, B.partitions(texts)

    def counted(batches):
        home, parcels = 0, []
        for batch in batches:
            home = batch.column("target")[0].as_py() if batch.num_rows else home
            parcels += [(b"", payload) for payload in batch.column("payload").to_pylist()]
        if not parcels:
            return
        distinct, _, counts, _ = met(parcels)
        often = counts >= SUPPORT
        held, n = distinct.filter(pa.array(often)), counts[often]
        best = np.lexsort([pc.rank(held).to_numpy(), -n])[:WORDS]
        rare = _open_class(distinct)[~often]
        tokens = np.bincount(rare, counts[~often].astype(np.float64), OPEN).astype(np.int64)
        kinds = np.bincount(rare, minlength=OPEN)
        data, offsets = B.text_bytes(held)
        payload = B.pack(data.tobytes(), B.narrow(np.diff(offsets)), B.narrow(n))
        size = len(best) + OPEN
        none = np.zeros(len(best), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([home] * (size + 1), pa.int32()),
                pa.array([payload] + [None] * size, pa.binary()),
                pa.concat_arrays([pa.nulls(1, pa.binary()), held.take(pa.array(best)).cast(pa.binary()), pa.nulls(OPEN, pa.binary())]),
                pa.array(np.concatenate([[0], n[best], np.zeros(OPEN, np.int64)])),
                pa.array(np.concatenate([[-1], none - 1, np.arange(OPEN)])),
                pa.array(np.concatenate([[0], none, tokens])),
                pa.array(np.concatenate([[0], none, kinds])),
            ],
            names=["home", "payload", "word", "n", "open", "tokens", "kinds"],
        )

    schema = "home int, payload binary, word binary, n long, open long, tokens long, kinds long"
    path = scratch_path(spark, "word-counts")
    B.deliver(texts.where(F.col("kind") == ASKED), count).mapInArrow(counted, schema).write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    top = table.where("word is not null").orderBy(F.col("n").desc(), "word").limit(WORDS).select("word").toArrow()
    words = pa.array(top.column("word").to_pylist(), pa.large_binary())
    tokens, kinds = np.zeros(OPEN, np.int64), np.zeros(OPEN, np.int64)
    for row in table.where("open >= 0").groupBy("open").agg(F.sum("tokens"), F.sum("kinds")).collect():
        tokens[row[0]], kinds[row[0]] = row[1], row[2]
    return table.where("payload is not null").select("home", "payload"), words, tokens, kinds


def _bigrams(texts: DataFrame, words: pa.Array) -> np.ndarray:
    """How often each symbol follows each in the training texts; a text's first word follows an end.

    A task adds up all its texts and sends its sums once; the result is bounded by the number of symbols.
    """
    size = 1 + len(words) + OPEN
    bounds = np.linspace(0, size * size, _MATRIX_PARTS + 1).astype(np.int64)

    def add(batches):
        cells = np.zeros(size * size, np.int64)
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                kept, firsts, codes, _ = placed(payload)
                stream, _ = _stream(firsts, _symbols(_kept_words(kept), words)[codes])
                cells += np.bincount(np.concatenate([[END], stream[:-1]]) * size + stream, minlength=size * size)
        yield B.parcels([(i, b"", 0, B.pack(B.planes(cells[bounds[i] : bounds[i + 1]]))) for i in range(_MATRIX_PARTS)])

    def total(batches):
        sums = {}
        for batch in batches:
            for target, payload in zip(batch.column("target").to_pylist(), batch.column("payload").to_pylist()):
                found = B.from_planes(B.unpack(payload)[0]).astype(np.int64)
                sums[target] = found if target not in sums else sums[target] + found
        for target, cells in sums.items():
            yield B.parcels([(target, b"", 0, B.pack(B.planes(cells)))])

    sent = texts.where(F.col("kind") == PLACES).mapInArrow(add, B.PARCEL).repartitionById(_MATRIX_PARTS, F.col("target"))
    cells = np.zeros(size * size, np.int64)
    for row in sent.mapInArrow(total, B.PARCEL).collect():
        cells[bounds[row.target] : bounds[row.target + 1]] = B.from_planes(B.unpack(row.payload)[0])
    return cells.reshape(size, size)


def _plogp(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, words: int, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each symbol: words move one at a time to the class that makes the bigrams likeliest.

    Symbols 1 to ``words`` take classes 1 to ``classes``; the end and the open classes keep theirs.
    """
    size = len(bigrams)
    classes = max(1, min(classes, words))
    total = 1 + classes + size - 1 - words
    of = np.concatenate([[END], 1 + np.arange(words) % classes, 1 + classes + np.arange(size - 1 - words)])
    counts = bigrams.astype(np.float64)
    member = np.zeros((size, total))
    member[np.arange(size), of] = 1
    grid = member.T @ counts @ member
    choices = np.arange(1, classes + 1)
    for _ in range(passes):
        moved = 0
        for word in range(1, words + 1):
            after = np.bincount(of, counts[word], total)
            before = np.bincount(of, counts[:, word], total)
            own, old = counts[word, word], of[word]
            after[old] -= own
            before[old] -= own
            grid[old] -= after
            grid[:, old] -= before
            grid[old, old] -= own
            rows, columns = grid[choices], grid[:, choices].T
            gain = (_plogp(rows + after) - _plogp(rows)).sum(1) + (_plogp(columns + before) - _plogp(columns)).sum(1)
            corner = grid[choices, choices]
            gain += _plogp(corner + after[choices] + before[choices] + own) + _plogp(corner)
            gain -= _plogp(corner + after[choices]) + _plogp(corner + before[choices])
            # The other words' bigrams with this one count in their classes wherever it goes.
            left, right = rows.sum(1) + before[choices], columns.sum(1) + after[choices]
            gain -= _plogp(left + after.sum() + own) - _plogp(left) + _plogp(right + before.sum() + own) - _plogp(right)
            new = choices[np.argmax(gain)]
            grid[new] += after
            grid[:, new] += before
            grid[new, new] += own
            of[word] = new
            moved += new != old
        if not moved:
            break
    return of


def _written(parcels: DataFrame, name: str) -> DataFrame:
    path = scratch_path(parcels.sparkSession, name)
    parcels.write.parquet(path)
    return parcels.sparkSession.read.schema(B.PARCEL).parquet(path)


def _started(table: DataFrame, words: pa.Array, classes: np.ndarray) -> DataFrame:
    """The class of each word with SUPPORT before the first round: of those listed as clustered, of others by ending."""

    def place(batches):
        for batch in batches:
            for home, payload in zip(batch.column("home").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                data, lengths, n = B.unpack(payload)
                distinct = B.slices(np.frombuffer(data, np.uint8), B.offsets_of(lengths))
                own = classes[_symbols(distinct, words)].astype(np.uint8)
                yield B.parcels([(home, b"", KNOWN, B.pack(data, lengths, n, own))])

    return _written(table.mapInArrow(place, B.PARCEL), "word-classes")


def _classes(distinct: pa.Array, held: list[bytes], learnt: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each word, and whether it has SUPPORT."""
    classes, supported = 1 + learnt + _open_class(distinct), np.zeros(len(distinct), np.int64)
    for payload in held:
        data, lengths, _, own = B.unpack(payload)
        at = pc.index_in(distinct, value_set=B.slices(np.frombuffer(data, np.uint8), B.offsets_of(lengths)))
        at = pc.fill_null(at, -1).to_numpy(zero_copy_only=False)
        found = np.flatnonzero(at >= 0)
        classes[found], supported[found] = own[at[found]], 1
    return classes, supported


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sum of the counts of each; without counts, how often each is there."""
    order = None if counts is None else np.argsort(keys)
    keys = np.sort(keys) if counts is None else keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[heads], np.diff(np.append(heads, len(keys)))
    return keys[heads], np.add.reduceat(counts[order], heads) if len(keys) else np.zeros(0, np.int64)


_CONTEXTS, _GRID = 0, 1


def _neighbours(texts: DataFrame, known: DataFrame, learnt: int, contexts: bool = True) -> tuple[DataFrame, np.ndarray]:
    """How often classes follow and precede each word with SUPPORT, by home, and how often each class follows each.

    A block sends its sums of a word once to the word's home. Keys are (word * 2 + side) * classes + class, side 0 is what follows.
    """
    count, total = B.partitions(texts), 1 + learnt + OPEN

    def solve(distinct, summed, held):
        classes, supported = _classes(distinct, held, learnt)
        return classes + 256 * supported, np.ones(len(distinct), np.int64)

    def finish(kept, firsts, codes, values, found):
        values = values[found[0]].astype(np.int64)
        classes, supported = values % 256, values >= 256
        stream, _ = _stream(firsts, classes[codes] if len(codes) else codes)
        previous = np.concatenate([[END], stream[:-1]])
        cells = np.bincount(previous * total + stream, minlength=total * total)
        rows = [(int(cells[END] + len(codes)) % count, b"", _GRID, B.pack(B.planes(cells)))]
        if contexts and len(codes):
            places = np.arange(len(codes)) + np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
            used = np.flatnonzero(supported[codes])
            word, places = codes[used], places[used]
            keys, n = _summed(np.concatenate([2 * word * total + stream[places + 1], (2 * word + 1) * total + previous[places]]))
            distinct = _kept_words(kept)
            homes = np.where(supported, homes_of(distinct, count), -1)
            order = np.argsort(homes, kind="stable")
            bounds = np.searchsorted(homes[order], np.arange(count + 1))
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            moved = place[keys // (2 * total)] * 2 * total + keys % (2 * total)
            at = np.argsort(moved, kind="stable")
            moved, n = moved[at], n[at]
            cuts = np.searchsorted(moved, bounds * 2 * total)
            for home in np.flatnonzero(np.diff(bounds)).tolist():
                data, offsets = B.text_bytes(distinct.take(pa.array(order[bounds[home] : bounds[home + 1]])))
                part = slice(cuts[home], cuts[home + 1])
                own = np.diff(moved[part], prepend=bounds[home] * 2 * total)
                payload = B.pack(data.tobytes(), B.narrow(np.diff(offsets)), B.planes(own), B.planes(n[part]))
                rows.append((home, b"", _CONTEXTS, payload))
        return B.parcels(rows)

    def gather(batches):
        here, cells, texts, keys, counts, at = 0, np.zeros(total * total, np.int64), [], [], [], 0
        for batch in batches:
            here = batch.column("target")[0].as_py() if batch.num_rows else here
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == _GRID:
                    cells += B.from_planes(B.unpack(payload)[0]).astype(np.int64)
                    continue
                data, lengths, own, n = B.unpack(payload)
                texts.append(B.slices(np.frombuffer(data, np.uint8), B.offsets_of(lengths)))
                keys.append(np.cumsum(B.from_planes(own).astype(np.int64)) + at * 2 * total)
                counts.append(B.from_planes(n).astype(np.int64))
                at += len(lengths)
        rows = [(here, b"", _GRID, B.pack(B.planes(cells)))]
        if texts:
            coded = pa.concat_arrays(texts).dictionary_encode()
            found = np.concatenate(keys)
            found = coded.indices.to_numpy().astype(np.int64)[found // (2 * total)] * 2 * total + found % (2 * total)
            found, n = _summed(found, np.concatenate(counts))
            data, offsets = B.text_bytes(coded.dictionary)
            payload = B.pack(data.tobytes(), B.narrow(np.diff(offsets)), B.planes(np.diff(found, prepend=0)), B.planes(n))
            rows.append((here, b"", _CONTEXTS, payload))
        yield B.parcels(rows)

    words, places = texts.where(F.col("kind") == ASKED), texts.where(F.col("kind") == PLACES)
    sent = answered(words, places, solve, finish, B.PARCEL, known)
    table = _written(B.deliver(sent, count).mapInArrow(gather, B.PARCEL), "word-contexts")
    grid = np.zeros(total * total, np.int64)
    for row in table.where(F.col("kind") == _GRID).toLocalIterator():
        grid += B.from_planes(B.unpack(row.payload)[0]).astype(np.int64)
    return table.where(F.col("kind") == _CONTEXTS), grid.reshape(total, total).astype(np.float64)


def best_classes(grid: np.ndarray, learnt: int, keys: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The learnt class of each word that makes its bigrams likeliest, all other words staying where they are.

    ``keys`` as of ``_neighbours``, in order. A word's bigrams with itself and with its own class are taken as the
    classes stand.
    """
    total, choices = len(grid), np.arange(1, learnt + 1)
    sides = np.stack([grid[1 : learnt + 1].T, grid[:, 1 : learnt + 1]])
    word, side = keys // (2 * total), keys // total % 2
    gain = np.zeros((len(old), learnt))
    for a in range(0, len(keys), 50_000):
        part = slice(a, a + 50_000)
        n, w = counts[part, None].astype(np.float64), word[part]
        rest = sides[side[part], keys[part] % total]
        rest = np.maximum(rest - n * (old[w, None] == choices), 0)
        heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        gain[w[heads]] += np.add.reduceat(_plogp(rest + n) - _plogp(rest), heads)
    for of, sums in enumerate((grid.sum(axis=1), grid.sum(axis=0))):
        n = np.bincount(word, counts * (side == of), len(old))[:, None]
        for a in range(0, len(old), 50_000):
            part = slice(a, a + 50_000)
            rest = np.maximum(sums[1 : learnt + 1] - n[part] * (old[part, None] == choices), 0)
            gain[part] -= _plogp(rest + n[part]) - _plogp(rest)
    return choices[np.argmax(gain, axis=1)]


def _moved(known: DataFrame, contexts: DataFrame, grid: np.ndarray, learnt: int) -> DataFrame:
    """``known`` with every word in its best class; words move at the same time, each task its own."""
    count, total = B.partitions(known), len(grid)
    shared = known.sparkSession.sparkContext.broadcast(grid)

    def move(batches):
        here, held, seen = 0, None, None
        for batch in batches:
            here = batch.column("target")[0].as_py() if batch.num_rows else here
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == KNOWN:
                    held = B.unpack(payload)
                else:
                    seen = B.unpack(payload)
        if held is None:
            return
        data, lengths, n, own = held
        if seen is not None:
            words = B.slices(np.frombuffer(data, np.uint8), B.offsets_of(lengths))
            place = pc.index_in(B.slices(np.frombuffer(seen[0], np.uint8), B.offsets_of(seen[1])), value_set=words)
            keys = np.cumsum(B.from_planes(seen[2]).astype(np.int64))
            place = place.to_numpy(zero_copy_only=False).astype(np.int64)
            own = own.copy()
            own[place] = best_classes(shared.value, learnt, keys, B.from_planes(seen[3]).astype(np.int64), own[place])
        yield B.parcels([(here, b"", KNOWN, B.pack(data, lengths, n, own))])

    return _written(B.deliver(known.unionAll(contexts), count).mapInArrow(move, B.PARCEL), "word-classes")


def _likelihood(grid: np.ndarray) -> float:
    """The log likelihood of the bigrams of classes, less what does not depend on the classes."""
    return float(_plogp(grid).sum() - _plogp(grid.sum(axis=0)).sum() - _plogp(grid.sum(axis=1)).sum())


def _totals(known: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words with SUPPORT of each class."""

    def add(batches):
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                _, _, n, own = B.unpack(payload)
                sums = np.bincount(own, n.astype(np.float64), total).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(total)), pa.array(sums), pa.array(np.bincount(own, minlength=total))], names=["class", "tokens", "kinds"]
                )

    tokens, kinds = np.zeros(total, np.int64), np.zeros(total, np.int64)
    sums = known.mapInArrow(add, "class long, tokens long, kinds long").groupBy("class").agg(F.sum("tokens"), F.sum("kinds"))
    for row in sums.collect():
        tokens[row[0]], kinds[row[0]] = row[1], row[2]
    return tokens, kinds


def fit(docs: DataFrame, train: str, doc_id: str = "doc_id", text: str = "text") -> Model:
    """A model of the texts whose column ``train`` is true.

    The texts are read once; all their words are counted. Exchange clustering of the most frequent ones starts the classes; then, in each
    round, every word with SUPPORT goes to the class that its neighbours' classes make likeliest, and the round
    of the highest likelihood is taken. Words are held by their homes; the driver gets class bigrams only.
    Emissions are counts in the class plus ADDED, transitions are smoothed by how many classes were seen to follow.
    """
    rows = _read_once(_prepared(docs, doc_id, text, train))
    table, words, open_tokens, open_kinds = _vocabulary(rows)
    classes = exchange(_bigrams(rows, words), len(words))
    learnt = int(classes.max()) - OPEN
    known = _started(table, words, classes)
    contexts, grid = _neighbours(rows, known, learnt)
    best = None
    for round_ in range(ROUNDS):
        known = _moved(known, contexts, grid, learnt)
        contexts, grid = _neighbours(rows, known, learnt, contexts=round_ + 1 < ROUNDS)
        if best is None or _likelihood(grid) > _likelihood(best[1]):
            best = known, grid
    known, grid = best
    total, texts = len(grid), int(grid[:, END].sum())
    tokens, kinds = _totals(known, total)
    distinct = int(kinds.sum() + open_kinds.sum())
    tokens[END] = texts
    tokens[1 + learnt :] += open_tokens
    kinds[1 + learnt :] += open_kinds
    room = np.log10(np.maximum(tokens + ADDED * (kinds + 1), ADDED))
    shares = (grid.sum(axis=0) + 1) / (grid.sum() + total)
    follow = np.count_nonzero(grid, axis=1) + 1
    transitions = np.log10((grid + follow[:, None] * shares) / (grid.sum(axis=1) + follow)[:, None])
    return Model(known, learnt, transitions, room, int(tokens.sum()), distinct + (texts > 0), texts)


def score(docs: DataFrame, model: Model, train: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Tokens are the words in lower case and one end. ``score`` is the log10 probability of the whole text:
    each token's class given the class before, times the token given its class. ``base_score`` takes the
    tokens alone. A null or empty text is an end. Rows with equal or null doc_id each give a row; a null in
    ``train`` counts as false; other columns are not read. ``train`` must be as it was for ``fit``.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.transitions, model.room))
    learnt, trained, texts = model.learnt, model.tokens, model.texts
    whole = np.log10(model.tokens + ADDED * (model.distinct + 1))
    end = np.log10(model.texts + ADDED)

    def keep(batch, firsts, codes, distinct):
        return batch.column("doc_id")

    def solve(distinct, summed, held):
        classes, _ = _classes(distinct, held, learnt)
        return np.stack([summed, classes], axis=1).ravel(), np.full(len(distinct), 2)

    def finish(doc_ids, firsts, codes, values, found):
        transitions, room = shared.value
        counts = values[found[0]].astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        classes = values[found[0] + 1].astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        stream, places = _stream(firsts, classes)
        steps = transitions[np.concatenate([[END], stream[:-1]]), stream] - np.where(stream == END, 0, room[stream])
        steps = np.add.reduceat(steps, places[:-1]) if len(steps) else steps
        n = np.diff(firsts)
        sums, known = np.zeros(len(n)), np.zeros(len(n), np.int64)
        full = np.flatnonzero(n)
        if len(full):
            sums[full] = np.add.reduceat(np.log10(counts + ADDED), firsts[:-1][full])
            known[full] = np.add.reduceat((counts > 0).astype(np.int64), firsts[:-1][full])
        known += texts > 0
        probability = steps + sums
        return pa.RecordBatch.from_arrays(
            [
                doc_ids, pa.array(n + 1), pa.array(known), pa.array(np.full(len(n), trained)),
                pa.array(sums + end - (n + 1) * whole), pa.array(probability), pa.array(10 ** (-probability / (n + 1))),
            ],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"],
        )

    schema = (
        "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    )
    rows = _prepared(docs, doc_id, text, train)
    return by_position(rows, "doc_id", "text", _cut, solve, keep, finish, schema, weigh=_train_counts, known=model.known)
