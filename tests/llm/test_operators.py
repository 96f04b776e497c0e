"""Each operator against a brute-force version on a small table with all odd cases."""

from __future__ import annotations

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.llm import bpe, brown, exact, jaccard, packing, sketch, suffix, words

tokenizers = pytest.importorskip("public_tokenizers")
RANKS = tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_BPE = tokenizers.path("word_bpe_49k.json")


def ordered(rows):
    return sorted(rows, key=repr)


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


# Exact duplicates


@pytest.mark.parametrize("parts", ["1", "40"])
def test_exact_groups(spark, docs, nothing, texts, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)  # with many, groups lie across ranges
    try:
        found = [tuple(r) for r in exact.exact_groups(docs).collect()]
        assert exact.exact_groups(nothing).count() == 0
        many = spark.createDataFrame([(i, "same " * (i % 3)) for i in range(300)], "doc_id long, text string")
        groups = exact.exact_groups(many).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    members = collections.defaultdict(list)
    for i, t in texts:
        members[norm(t)].append((-len(t or ""), i is None, i))
    want = []
    for i, t in texts:
        keep = min(members[norm(t)], key=lambda x: (x[0], x[1], x[2] or 0))[2]
        want.append((i, keep, len(members[norm(t)]), i == keep, sha(norm(t))))
    assert ordered(found) == ordered(want)
    assert {(r["keep_id"], r["group_size"]) for r in groups} == {(0, 100), (1, 100), (2, 100)}


# Scoring


def test_class_scoring(docs, nothing, texts):
    marked = docs.withColumn("train", F.crc32(F.col("doc_id").cast("string")) % 10 != 0)
    model = brown.fit(marked, "train")
    found = brown.score(marked, model, "train").collect()
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 != 0
    counts = collections.Counter()
    for i, t in texts:
        if train(i):
            counts.update([*(t or "").encode().lower().split(), None])
    n, v = sum(counts.values()), len(counts)
    want = collections.Counter()
    for i, t in texts:
        tokens = [*(t or "").encode().lower().split(), None]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        want[i, len(tokens), sum(counts[w] > 0 for w in tokens), n, round(base, 5)] += 1
    assert want == collections.Counter(
        (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found
    )
    assert all(r["score"] < 0 and r["perplexity"] >= 1 for r in found)
    total = 10 ** model.transitions
    assert np.allclose(total.sum(axis=1), 1)
    assert brown.score(nothing.withColumn("train", F.lit(True)), brown.fit(nothing.withColumn("train", F.lit(True)), "train"), "train").count() == 0


def test_every_word_with_support_gets_a_learnt_class(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(brown, "WORDS", 20)
    random.seed(4)
    common, first, second = ([f"{c}{i}" for i in range(20 if c == "c" else 60)] for c in "cfs")
    texts = []  # words of two kinds in turns; endings tell nothing
    for i in range(400):
        texts.append((i, " ".join(random.choice([common[:10], first][j % 3 > 0] if j % 2 else [common[10:], second][j % 3 > 0]) for j in range(60)) + (" rare" if i == 7 else "")))
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    marked = spark.read.parquet(str(tmp_path / "d")).withColumn("train", F.lit(True))
    model = brown.fit(marked, "train")
    classes = {}
    for row in model.known.collect():
        data, lengths, _, own = brown.B.unpack(row.payload)
        at = brown.B.offsets_of(lengths)
        classes |= {data[a:b].decode(): int(c) for a, b, c in zip(at[:-1], at[1:], own, strict=True)}
    assert set(classes) == {w for _, t in texts for w in t.split()} - {"rare"}
    assert all(1 <= c <= model.learnt for c in classes.values())
    assert not {classes[w] for w in first} & {classes[w] for w in second}
    counts = np.zeros(len(model.room), np.int64)
    for w, n in collections.Counter(w for _, t in texts for w in t.split() if w != "rare").items():
        counts[classes[w]] += n
    assert (brown._totals(model.known, len(counts))[0] == counts).all()
    found = brown.score(marked, model, "train").collect()
    for r in found:
        path = [0, *(classes.get(w) or 1 + model.learnt + int(brown._open_class(brown.pa.array([w.encode()], brown.pa.large_binary()))[0]) for w in texts[r["doc_id"]][1].split()), 0]
        n = collections.Counter(w for _, t in texts for w in t.split())
        want = sum(model.transitions[a, b] for a, b in itertools.pairwise(path))
        want += sum(math.log10(n[w] + brown.ADDED) - model.room[c] for w, c in zip(texts[r["doc_id"]][1].split(), path[1:-1], strict=True))
        assert r["score"] == pytest.approx(want)


def test_words_and_places_of_one_reading_give_the_answers_of_two(docs):
    def keep(batch, firsts, codes, distinct):
        return batch.column("doc_id").to_pylist(), len(distinct)

    def solve(distinct, summed):
        return np.array([len(word) for word in distinct.to_pylist()]), np.ones(len(distinct), np.int64)

    def finish(kept, firsts, codes, values, found):
        lengths = values[found[0]][codes] if len(codes) else codes
        sums = [int(lengths[a:b].sum()) for a, b in itertools.pairwise(firsts.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int64()), pa.array(sums, pa.int64())], names=["doc_id", "n"])

    schema = "doc_id long, n long"
    two = words.by_position(docs, "doc_id", "text", brown._cut, solve, keep, finish, schema).collect()
    parcels = words.once(docs, "doc_id", "text", brown._cut, keep)
    asked, places = (parcels.where(F.col("kind") == kind) for kind in (words.ASKED, words.PLACES))
    one = words.answered(asked, places, solve, finish, schema).collect()
    assert sorted(map(str, one)) == sorted(map(str, two)) and len(one) == docs.count()
    sizes = {row.doc_id: len(re.sub(r"[\x20\x09-\x0D]", "", row.text or "").encode()) for row in docs.where("doc_id > 5").collect()}
    assert {row.doc_id: row.n for row in one if row.doc_id in sizes} == sizes


def test_exchange_raises_the_likelihood():
    rng = np.random.default_rng(1)
    kinds = rng.integers(0, 2, 21)
    stream = [0]
    for _ in range(6000):  # two kinds of words that take turns
        pool = [w for w in range(1, 21) if kinds[w] != kinds[stream[-1]]]
        stream.append(int(rng.choice(pool)))
    bigrams = np.zeros((21, 21))
    np.add.at(bigrams, (stream[:-1], stream[1:]), 1)
    found = brown.exchange(bigrams, 20, classes=2)
    assert len({(kinds[w], found[w]) for w in range(1, 21)}) == 2


# Byte-level BPE


def test_bpe_round_trip(docs, nothing, texts):
    encoder = bpe._encoder(RANKS, tokenizers.PATTERN)
    want = []
    for i, t in texts:
        ids = np.array(encoder.encode_ordinary(t or ""), "<u4")
        want.append((i, len(ids), sha(ids.tobytes()), sha(t or "")))
    found = bpe.round_trip_digests(docs, RANKS, tokenizers.PATTERN)
    assert ordered(tuple(r) for r in found.collect()) == ordered(want)
    decoded = bpe.decode(bpe.encode(docs, RANKS, tokenizers.PATTERN), RANKS)
    assert ordered(tuple(r) for r in decoded.collect()) == ordered((i, t or "") for i, t in texts)
    assert bpe.round_trip_digests(nothing, RANKS, tokenizers.PATTERN).count() == 0


def test_bpe_pieces_of_odd_white_space():
    random.seed(5)
    encoder = bpe._encoder(RANKS, tokenizers.PATTERN)
    odd = [" ", "  ", "\n", " ", " ", "\u0085", "　", "a", "é", "漢", "1", "'ll", "!", "\x1c", "\x7f", "ß"]
    for _ in range(3000):
        text = "".join(random.choice(odd) for _ in range(random.randint(0, 12)))
        data = np.frombuffer(text.encode(), np.uint8)
        pieces, _ = bpe.cut_before_single_blanks(data, np.array([0, len(data)]))
        ids = [i for piece in pieces.to_pylist() for i in encoder.encode_ordinary(piece.decode())]
        assert ids == encoder.encode_ordinary(text), repr(text)


# Packing


def test_packing_is_gapless_and_whole(docs, nothing, texts):
    found = packing.pack(docs, WORD_BPE, length=256).collect()
    by_place = sorted(found, key=lambda r: (r["sequence_id"], r["offset"]))
    assert [r["sequence_id"] * 256 + r["offset"] for r in by_place] == list(
        itertools.accumulate([0] + [r["length"] for r in by_place])
    )[:-1]
    tokenizer = packing._tokenizer(WORD_BPE)
    want = collections.Counter()
    for i, t in texts:
        want[i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
    assert want == collections.Counter((r["doc_id"], r["doc_tokens"]) for r in found if r["start"] == 0)
    (long_,) = [t for i, t in texts if i == 65]
    ids = np.array([*tokenizer.encode(long_, add_special_tokens=False).ids, 1], "<u4")
    for r in found:
        if r["doc_id"] == 65:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]]) == r["ids_crc32"]
    assert sum(r["length"] for r in found if r["doc_id"] == 65) == len(ids)
    assert packing.pack(nothing, WORD_BPE).count() == 0
    whole = packing.packed_documents(docs, WORD_BPE, length=256).collect()
    assert sorted(len(r["ids"]) for r in whole)[1:] == [512] * (len(whole) - 1)


def test_special_tokens_in_texts_are_encoded_as_the_file_says(spark, tmp_path):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    texts = ["one <|endoftext|> two", "a<|startoftext|>b c", "<|endoftext|>", "<|endoftext|><|startoftext|> x", "  <|endoftext|>\n<|ENDOFTEXT|> é"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = packing.pack(spark.read.parquet(str(tmp_path / "d")), WORD_BPE, length=4096).collect()
    want = {i: np.array([*plain.encode(t, add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["doc_tokens"], r["ids_crc32"]) for r in found} == {i: (len(x), zlib.crc32(x)) for i, x in want.items()}


def test_hilbert_neighbours_are_one_step_apart():
    points = np.array(list(itertools.product(range(8), repeat=3)))
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


# Repeated passages


def test_repeated_passages(docs, nothing, texts):
    places = collections.defaultdict(set)
    for i, t in texts:
        data = (t or "").encode()
        for s in range(len(data) - 49):
            places[data[s : s + 50]].add(2**63 if i is None else i)
    want = []
    for i, t in texts:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 49):
            if min(places[data[s : s + 50]]) < (2**63 if i is None else i):
                gone[s : s + 50] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + (len(gone) > 0 and gone[0]))
        want.append((i, len(data), int(gone.sum()), spans, sha(np.frombuffer(data, np.uint8)[~gone].tobytes())))
    found = suffix.drop_repeats(docs).drop("kept").collect()
    assert ordered(tuple(r) for r in found) == ordered(want)
    assert suffix.drop_repeats(nothing).count() == 0


def test_no_task_gets_all_spans_of_one_anchor(spark, docs, texts, monkeypatch, tmp_path):
    plain = ordered(tuple(r) for r in suffix.drop_repeats(docs).drop("kept").collect())
    monkeypatch.setattr(suffix, "MANY_SPANS", 8)
    assert ordered(tuple(r) for r in suffix.drop_repeats(docs).drop("kept").collect()) == plain
    random.seed(6)
    line = "a line of text that very many of all documents share word by word, edge to edge"
    rows = [("%020x " % random.getrandbits(80)) * 2 + line + " %040x" % random.getrandbits(160) for _ in range(400)]
    data = [x.encode() for x in rows]
    offsets = np.cumsum([0, *map(len, data)])
    block = suffix._Block(np.frombuffer(b"".join(data), np.uint8), offsets, np.arange(len(rows)))
    keys, _, homes = block.of(8)
    spans = block.span_counts(keys)
    assert spans.max() >= 100
    answers = {h: np.packbits(np.append(np.ones(len(own), bool), spans[own] > 8)).tobytes() for h, own in suffix._by_home(homes, 8)}
    found = suffix._shared_anchors(block, answers, 8)[0]
    distinct, keys, _, _ = found.spans(np.arange(len(found.key)))
    assert np.unique(keys, return_counts=True)[1].max() <= 8


@pytest.mark.parametrize("width", [1, 2, 3, 24, 26, 27])
def test_window_hashes_equal_those_from_prefixes(width):
    data = np.random.default_rng(3).integers(97, 101, 500, dtype=np.uint8)
    assert (suffix.window_hashes(data, width) == suffix.PrefixHashes(data).of(np.arange(501 - width), width)).all()
    assert len(suffix.window_hashes(data[:width], width)) == 1


@pytest.mark.parametrize("step", [1, 7, 1 << 15])
def test_anchors_do_not_depend_on_the_step(step, monkeypatch):
    """Every passage lies in the span of one anchor, the lowest hash in it, however many places are hashed at a time."""
    sizes = [0, 49, 50, 51, 300, 0, 75]
    data = np.random.default_rng(5).integers(97, 99, sum(sizes), dtype=np.uint8)
    offsets, ids = B.offsets_of(np.array(sizes)), np.arange(len(sizes)) * 3
    monkeypatch.setattr(suffix, "_STEP", step)
    block = suffix._Block(data, offsets, ids)
    hashes = B.mixed(suffix.PrefixHashes(data).of(np.arange(len(data) - suffix.SEED + 1), suffix.SEED))
    expected = []
    for text, (a, b) in enumerate(itertools.pairwise(offsets.tolist())):
        for start in range(a, b - suffix.LENGTH + 1):
            place = min(range(start, start + suffix.LENGTH - suffix.SEED + 1), key=lambda at: (hashes[at] >> np.uint64(32), at))
            expected.append((start, int(hashes[place]), int(ids[text])))
    found = [
        (start, int(key), int(owner))
        for first, last, key, owner in zip(block.first, block.last, block.key, block.owner, strict=True)
        for start in range(first, last + 1)
    ]
    assert found == expected
    keys, several, homes, place = block.of(4)
    assert (keys[place] == block.key).all() and (np.diff(keys.astype(object)) > 0).all() and (homes < 4).all()
    owners, spans = collections.defaultdict(set), collections.defaultdict(set)
    for first, last, key, owner in zip(block.first, block.last, block.key, block.owner, strict=True):
        owners[key].add(owner)
        spans[key].add(data[first : last + suffix.LENGTH].tobytes())
    assert several.tolist() == [len(owners[key]) > 1 for key in keys]
    assert block.span_counts(keys, place).tolist() == [len(spans[key]) for key in keys]


def test_suffixes_come_out_in_order():
    random.seed(3)
    text = ("".join(random.choice("ab") for _ in range(1500)) + "abab" * 100 + "a" * 300).encode()
    data, starts = np.frombuffer(text, np.uint8), np.arange(len(text) - 49)
    found = suffix.sorted_suffixes(data, starts, 50)
    cut = [text[i : i + 50] for i in found]
    assert cut == sorted(cut) and sorted(found) == list(starts)
    least = suffix.least_owner(data, starts, starts, 50)
    first = {}
    for s in starts:
        first.setdefault(text[s : s + 50], s)
    assert [first[text[s : s + 50]] for s in starts] == list(least)


# Fingerprints


def test_fingerprints_estimate_likeness(docs, nothing, texts):
    rows = sketch.fingerprints_and_edits(docs).withColumn("near", sketch.likeness(F.col("own"), F.col("changed")))
    rows = rows.withColumn("part", sketch.containment(F.col("own"), F.col("changed"))).collect()
    assert len(rows) == len(texts)
    plain = [(i, t or "") for i, t in texts if i != 5 and i is not None]
    following = dict(zip([i for i, _ in plain], [t for _, t in plain[1:]], strict=False))
    found = {r["doc_id"]: r for r in rows}
    for i, t in plain:
        if i in (4, 71):  # followed by the rows that share an id, and by the one without
            continue
        n, half = len(t), len(t) // 2
        edited = t[: n - half] + following[i][:half]
        assert (found[i]["n_chars"], found[i]["edited_sha256"]) == (n, sha(edited))
        a, b = shingles(t), shingles(edited)
        if len(a | b) <= sketch.LEAST and not re.search("[^\x00-\x7f]", t + edited):
            assert found[i]["near"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
        assert 0 <= found[i]["near"] <= 1 and 0 <= found[i]["part"] <= 1
    assert sketch.fingerprints_and_edits(nothing).count() == 0


# Jaccard


def brute_components(texts):
    ids = sorted({i for i, _ in texts if i is not None})
    rows = [(i, shingles(t)) for i, t in texts]
    parent = list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[root(a)] = min(i, least.get(root(a), ids[-1]))
    return [(i, len(s), least.get(root(a), i)) for a, (i, s) in enumerate(rows)]


@pytest.mark.parametrize("longest", [0, 48])
def test_linked_documents(docs, nothing, texts, longest, monkeypatch):
    monkeypatch.setattr(jaccard, "LONGEST_SMALL", longest)
    found = [tuple(r) for r in jaccard.linked_documents(docs).collect()]
    assert ordered(found) == ordered(brute_components(texts))
    assert jaccard.linked_documents(nothing).count() == 0


@pytest.mark.parametrize("small", [0, 12])
def test_no_link_between_short_sets_is_lost(spark, small, monkeypatch, tmp_path):
    random.seed(small)
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, met: small)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 3)
    monkeypatch.setattr(jaccard, "SPLIT", 4)
    rows = []
    for i in range(160):
        words = [str(w) for w in range(random.randint(1, 26))]
        for _ in range(random.randint(0, 2)):
            words[random.choice([0, len(words) - 1])] = random.choice("uvw")
        rows.append((i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = [tuple(r) for r in jaccard.linked_documents(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert ordered(found) == ordered(brute_components(rows))


@pytest.mark.parametrize("common", [0, 8, 10**9])
def test_rows_of_common_and_rare_sets_get_their_component(spark, common, monkeypatch, tmp_path):
    monkeypatch.setattr(jaccard, "COMMON", common)
    copies = [(i, "one text of six words here") for i in range(3, 120)] + [(None, "one text of six words here")]
    few = [(i, f"text {i // 3} that three rows have alike") for i in range(200, 230)]
    none = [(i, "") for i in range(300, 310)] + [(None, None), (2, " \n"), (320, None)]
    spark.createDataFrame(copies + few + none, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = [tuple(r) for r in jaccard.linked_documents(spark.read.parquet(str(tmp_path / "d"))).collect()]
    assert ordered(found) == ordered(brute_components(copies + few + none))


def test_one_of_each_keeps_rows_without_words(docs, texts):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, c in brute_components(texts) if i is not None and i == c}
    assert {r["doc_id"] for r in kept.collect() if r["doc_id"] is not None} == want


def test_one_of_each_keeps_one_row_of_a_group(spark, tmp_path):
    same, other = "a b c d e f g h", "quite another text with words of its own"
    rows = [(1, same), (1, same), (1, other), (2, same), (None, same), (None, "only null ids here"), (None, "only null ids here"), (3, ""), (3, ""), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = jaccard.one_of_each(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = [(1, same), (1, other), (None, "only null ids here"), (3, ""), (3, ""), (None, None)]
    assert ordered(tuple(r) for r in kept) == ordered(want)


def _saved_tables(monkeypatch):
    """What the operator saves from now on: the first table of each name."""
    found, save = {}, jaccard.saved

    def saved(table, name):
        table = save(table, name)
        found.setdefault(name, table)
        return table

    monkeypatch.setattr(jaccard, "saved", saved)
    return found


def _near_copies(spark, path):
    """Texts that are alike, texts that share but some words, and rows that repeat an id, a text or both."""
    random.seed(41)
    make = lambda n: [random.choice("abcdefgh") * random.randint(1, 3) + str(random.randrange(900)) for _ in range(n)]
    rows = []
    for _ in range(30):
        base = make(80)
        rows += [" ".join(base), " ".join([*base[:79], "changed"]), " ".join(base[:30] + make(50)), " ".join(make(80))]
    rows += ["tic tac toe tic tac " * 900 + "end", "tic tac toe tic tac " * 800 + "end"]
    table = list(enumerate(rows)) + [(None, rows[0]), (None, rows[3]), (3, rows[3]), (3, rows[7]), (500, rows[4])]
    spark.createDataFrame(table, "doc_id long, text string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("sids", [0, 2**20])
def test_what_is_shipped_to_verify_links_is_smaller_than_the_texts(spark, sids, monkeypatch, tmp_path):
    docs, found = _near_copies(spark, str(tmp_path / "d")), _saved_tables(monkeypatch)
    monkeypatch.setattr(jaccard, "SIDS", sids)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert ordered(tuple(r) for r in jaccard.linked_documents(docs).collect()) == ordered(brute_components(rows))
    sizes = [len(r[-1]) for r in found["candidate-sets"].collect()]
    assert len(sizes) > 60 and sum(sizes) < sum(len(text) for _, text in rows[:4]) / 4 * len(sizes)


def test_lists_of_two_sets_are_not_met_again(spark, monkeypatch, tmp_path):
    docs, found = _near_copies(spark, str(tmp_path / "d")), _saved_tables(monkeypatch)
    monkeypatch.setattr(jaccard, "FREQUENT_FROM", 100)
    jaccard.linked_documents(docs).count()
    assert found["mixed-lists"].groupBy("key").count().where("count < 3").isEmpty()


def test_one_of_each_shuffles_texts_once(spark, tmp_path):
    docs = _near_copies(spark, str(tmp_path / "d"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = jaccard.one_of_each(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "digest" in line]
    assert len(dealt) == 2, plan  # the rows with their texts, and the ids and digests of those to keep
