"""Documents linked by the Jaccard similarity of their word shingles, exactly."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chalkline.llm import blocks as B
from chalkline.llm.components import components, saved
from chalkline.operators.joins import join_small
from chalkline.session import scratch_path

WORDS = 5
PERCENT = 75
FREQUENT = 2**18  # of the most frequent shingles, whose counts every task gets: at most 4 MB
FREQUENT_FROM = 8  # documents that a frequent shingle has at least
LONGEST_SMALL = 48  # the boundary between small and large sets is sought up to here
SPLIT = 4096  # postings of one frequent shingle that a task gets at most
COMMON = 8  # a set with more than one in so many rows of a partition's share goes to the rows
SET_BYTES = 2 * 1024 * 1024  # text whose sets a task makes at a time, in some twenty arrays of a number per word
SIDS = 2**20  # candidates up to which their numbers are broadcast: 8 MB
ID_BITS = 2**27  # beyond that, bits that stand for their ids at most: 16 MB
KEY = np.uint64(2**48 - 1)  # the bits of a key that are kept; keys that agree by chance only make candidates
GATHERED = 2**21  # shingles, and POSTINGS postings, that a task gathers before it deals them out: 16 MB
POSTINGS = 2**19

_COUNTED, _SUMS, _NAMES = 0, 1, 2
_TEXT, _SET = b"t", b"s"
_NAME_FIELDS = ("doc_id", "digest", "n", "sid", "second")
_FOUND = "kind int, home int, key long, times double, doc_id long, digest binary, n long, sid long, second long"
_POSTED = "key long, sid long, second long, n int, pos int, many boolean"
_FOUND_ARROW = pa.schema(
    [("kind", pa.int32()), ("home", pa.int32()), ("key", pa.int64()), ("times", pa.float64())]
    + [("doc_id", pa.int64()), ("digest", pa.binary()), ("n", pa.int64()), ("sid", pa.int64()), ("second", pa.int64())]
)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, in order within each text, and where each text's begin.

    Words are split at white space and A-Z lowered. Fewer than WORDS words make one shingle of all of them.
    """
    words, firsts = B.words_of(data, offsets, lower=True)
    hashes = B.word_hashes(words)
    n = np.diff(firsts)
    count = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    at = B.gather(firsts[:-1], count)
    owner = np.repeat(np.arange(len(n)), count)
    factors = B.mixed(np.arange(1, WORDS + 1, dtype=np.uint64)) | np.uint64(1)
    found = np.zeros(len(at), np.uint64)
    size = np.minimum(n, WORDS)[owner]
    padded = np.concatenate([hashes, np.zeros(WORDS, np.uint64)])
    for i in range(WORDS):
        found += np.where(i < size, padded[at + i] * factors[i], np.uint64(0))
    found = B.mixed(found + size.astype(np.uint64))
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    found, owner = found[new], owner[new]
    return found, np.searchsorted(owner, np.arange(len(n) + 1))


def set_names(hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit number and a second hash of 32 bits of each set; together they name it."""
    names = []
    for salt in (0x51ED270B, 0x2545F491):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(B.mixed(hashes ^ np.uint64(salt)), dtype=np.uint64)])
        names.append(B.mixed(sums[firsts[1:]] - sums[firsts[:-1]]))
    return names[0].view(np.int64), (names[1] >> np.uint64(32)).view(np.int64)


def _prefix(n: np.ndarray) -> np.ndarray:
    """How many first elements two linked sets must share one of: all but what may be missing, and one."""
    return n - (PERCENT * n + 99) // 100 + 1


def _spread(hashes: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The task that counts each shingle, and 32 bits that tell it from most others there."""
    return ((hashes >> np.uint64(32)) % np.uint64(count)).astype(np.int64), (hashes & np.uint64(2**32 - 1)).astype(np.uint32)


def _first_of_equal(sids: np.ndarray) -> np.ndarray:
    return np.sort(np.unique(sids, return_index=True)[1])


def _sets(batches):
    """Blocks of texts as sets, equal sets of a block once: hashes, starts, sid, second name."""
    for batch in B.text_blocks(batches, "text", SET_BYTES):
        hashes, firsts = shingle_sets(*B.text_bytes(batch.column("text")))
        sids, seconds = set_names(hashes, firsts)
        n = np.diff(firsts)
        keep = _first_of_equal(sids)
        keep = keep[n[keep] > 0]
        yield hashes[B.gather(firsts[keep], n[keep])], B.offsets_of(n[keep]), sids[keep], seconds[keep]


def _named_and_counted(texts: DataFrame) -> tuple[DataFrame, dict[str, np.ndarray], float]:
    """Names of every row's set, counts of the most frequent shingles, and how many postings a posting meets on average.

    One reading of the texts makes the sets for both. All shingles of all distinct sets are counted. The counts only order
    the shingles of a set, so that the rare ones are looked up; any order that is the same for all sets finds the
    same links. Names pass the tasks that count, in blocks, beside the counts.
    """
    spark, count = texts.sparkSession, B.partitions(texts)

    def name(batch):
        """The parcel of a block's names, and the home and key of each shingle of its distinct sets as one number."""
        hashes, firsts = shingle_sets(*B.text_bytes(batch.column("text")))
        sids, seconds = set_names(hashes, firsts)
        n, every = np.diff(firsts), pa.array(np.arange(batch.num_rows))
        named = B.pack(batch.column("doc_id").take(every), batch.column("digest").take(every), n, sids, seconds)
        keep = _first_of_equal(sids)
        keep = keep[n[keep] > 0]
        homes, keys = _spread(hashes[B.gather(firsts[keep], n[keep])], count)
        codes = homes.astype(np.uint64) << np.uint64(32) | keys
        return B.parcels([(int(sids.view(np.uint64)[0] % np.uint64(count)), b"", _NAMES, named)]), codes

    def deal(gathered):
        codes = np.concatenate(gathered)
        codes.sort()
        keys = (codes & np.uint64(2**32 - 1)).astype(np.uint32)
        bounds = np.searchsorted(codes >> np.uint64(32), np.arange(count + 1, dtype=np.uint64))
        rows = []
        for home in np.flatnonzero(np.diff(bounds)).tolist():
            rows.append((home, b"", _COUNTED, B.pack(B.planes(np.diff(keys[bounds[home] : bounds[home + 1]], prepend=np.uint32(0))))))
        return B.parcels(rows)

    def send(batches):
        gathered = []
        for batch in B.text_blocks(batches, "text", SET_BYTES):
            names, codes = name(batch)
            yield names
            gathered.append(codes)
            if sum(map(len, gathered)) >= GATHERED:
                yield deal(gathered)
                gathered = []
        if gathered:
            yield deal(gathered)

    def add(batches):
        home, parts = 0, []
        for batch in batches:
            home = batch.column("target")[0].as_py() if batch.num_rows else home
            for kind, payload in zip(batch.column("kind").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                if kind == _NAMES:
                    yield _record(_NAMES, **dict(zip(_NAME_FIELDS, B.unpack(payload), strict=True)))
                else:
                    parts.append(np.cumsum(B.from_planes(B.unpack(payload)[0]), dtype=np.uint32))
        if not parts:
            return
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        often = np.flatnonzero(counts >= FREQUENT_FROM)
        often = often[np.argsort(-counts[often], kind="stable")[:FREQUENT]]
        homes = np.full(len(often), home, np.int32)
        yield _record(_COUNTED, home=homes, key=keys[often].astype(np.int64), times=counts[often].astype(np.float64))
        squares = float((counts.astype(np.float64) ** 2).sum())
        yield _record(_SUMS, home=np.array([home], np.int32), key=np.array([counts.sum()]), times=np.array([squares]))

    path = scratch_path(spark, "names-and-counts")
    B.deliver(texts.mapInArrow(send, B.PARCEL), count).mapInArrow(add, _FOUND).write.parquet(path)
    table = spark.read.schema(_FOUND).parquet(path)
    top = table.where(f"kind = {_COUNTED}").select("home", "key", "times").orderBy(F.desc("times"), "home", "key").limit(FREQUENT).toArrow()
    codes = top.column("home").to_numpy().astype(np.int64) << 32 | top.column("key").to_numpy()
    order = np.argsort(codes)
    met = table.where(f"kind = {_SUMS}").agg(F.sum("times") / F.sum("key")).first()[0]
    frequent = {"codes": codes[order], "counts": top.column("times").to_numpy().astype(np.int64)[order]}
    return table.where(f"kind = {_NAMES}").select(*_NAME_FIELDS), frequent, met or 1.0


def _record(kind: int, **columns) -> pa.RecordBatch:
    """Rows of the table of names and counts; columns that are not given are null."""
    rows = len(next(iter(columns.values())))
    arrays = []
    for field in _FOUND_ARROW:
        if field.name == "kind":
            arrays.append(pa.array(np.full(rows, kind, np.int32)))
        elif field.name in columns:
            value = columns[field.name]
            arrays.append((value if isinstance(value, pa.Array) else pa.array(value)).cast(field.type))
        else:
            arrays.append(pa.nulls(rows, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_FOUND_ARROW)


def boundary(sizes: dict[int, int], met: float) -> int:
    """The size up to which a set is small, at the least cost over all sets.

    A small set enumerates the pairs of its prefix, a set that may meet a large one has its prefix looked up
    in the inverted lists, where each posting meets ``met`` others.
    """

    def cost(limit: int) -> float:
        total = 0.0
        for n, count in sizes.items():
            p = int(_prefix(np.int64(n)))
            if 3 <= n <= limit:
                total += count * (p + 1) * p / 2
            if n >= 3 and 100 * n > PERCENT * limit:
                total += count * p * (1 + met)
        return total

    return min(range(LONGEST_SMALL + 1), key=cost)


def _postings(texts: DataFrame, frequent, small: int, table_path: str) -> None:
    """Writes key, sid, second, n, pos, many of the postings whose key another set of their task has as well.

    ``many`` is false where a key has two sets in all. Small sets post the pairs of their prefix, larger ones its elements; the sets near the boundary do both.
    A shingle with more postings than SPLIT is dealt over several tasks, which then pass all of it on.
    """
    spark, count = texts.sparkSession, B.partitions(texts)
    shared = spark.sparkContext.broadcast(frequent)

    def ranked(hashes, owner, counting):
        homes, keys = _spread(hashes, counting)
        codes = homes << 32 | keys.astype(np.int64)
        known = shared.value["codes"]
        counts = np.zeros(len(hashes), np.int64)
        if len(known):
            at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
            counts = np.where(known[at] == codes, shared.value["counts"][at], 0)
        order = np.lexsort((hashes, counts, owner))
        return hashes[order], counts[order]

    def post(hashes, firsts, sids):
        """Homes, keys, owners, places of the postings of some sets, and whether their key is dealt over tasks."""
        n = np.diff(firsts)
        hashes, counts = ranked(hashes, np.repeat(np.arange(len(n)), n), count)
        keys, owners, places, often = [], [], [], []
        single = np.flatnonzero((n >= 3) & (100 * n > PERCENT * small))
        p = _prefix(n[single])
        at = B.gather(firsts[:-1][single], p)
        keys.append(B.mixed(hashes[at]))
        owners.append(np.repeat(single, p))
        places.append(B.gather(np.zeros(len(p), np.int64), p))
        often.append(counts[at])
        for size in range(3, small + 1):
            own = np.flatnonzero(n == size)
            if not len(own):
                continue
            left, right = np.triu_indices(int(_prefix(np.int64(size))) + 1, 1)
            begin = firsts[:-1][own][:, None]
            keys.append(B.mixed(B.mixed(hashes[begin + left]) * np.uint64(3) + hashes[begin + right]).ravel())
            owners.append(np.repeat(own, len(left)))
            places.append(np.tile(left, len(own)))
            often.append(np.zeros(len(own) * len(left), np.int64))
        keys, owners, places, often = (np.concatenate(x) for x in (keys, owners, places, often))
        keys &= KEY
        salts = B.mixed(sids.view(np.uint64))[owners] % (1 + often // SPLIT).astype(np.uint64)
        homes = (B.mixed(keys + salts) % np.uint64(count)).astype(np.int32)
        return homes, keys, owners.astype(np.int32), places.astype(np.int32), often >= SPLIT

    def deal(posted, names):
        homes, keys, owners, places, spread = (np.concatenate(x) for x in zip(*posted, strict=True))
        sids, seconds, n = (np.concatenate(x) for x in zip(*names, strict=True))
        # In the order of their names, which are most of a parcel, so that these can be sent as differences.
        order = np.argsort(sids.view(np.uint64))
        sids, seconds, n = sids.view(np.uint64)[order], seconds[order], n[order]
        ranks = np.empty(len(order), np.int32)
        ranks[order] = np.arange(len(order), dtype=np.int32)
        owners = ranks[owners]
        order = np.lexsort((keys, homes))
        homes, keys, owners, places, spread = (x[order] for x in (homes, keys, owners, places, spread))
        bounds = np.searchsorted(homes, np.arange(count + 1))
        rows = []
        for home in np.flatnonzero(np.diff(bounds)).tolist():
            cut = slice(bounds[home], bounds[home + 1])
            used, local = np.unique(owners[cut], return_inverse=True)
            used = used.astype(np.int64)
            payload = B.pack(
                B.planes(np.diff(keys[cut], prepend=np.uint64(0))), B.planes(local), B.planes(places[cut]), np.packbits(spread[cut]).tobytes(),
                B.planes(np.diff(sids[used], prepend=np.uint64(0))), B.planes(seconds[used]), B.planes(n[used]),
            )
            rows.append((home, b"", 0, payload))
        return B.parcels(rows)

    def send(batches):
        posted, names, held, sets = [], [], 0, 0
        for hashes, firsts, sids, seconds in _sets(batches):
            homes, keys, owners, places, spread = post(hashes, firsts, sids)
            posted.append((homes, keys, owners + np.int32(sets), places, spread))
            names.append((sids, seconds, np.diff(firsts)))
            held, sets = held + len(keys), sets + len(sids)
            if held >= POSTINGS:
                yield deal(posted, names)
                posted, names, held, sets = [], [], 0, 0
        if posted:
            yield deal(posted, names)

    def meet(batches):
        columns = [[] for _ in range(6)]
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                keys, local, places, spread, sids, seconds, n = B.unpack(payload)
                keys, local = np.cumsum(B.from_planes(keys), dtype=np.uint64), B.from_planes(local).astype(np.int64)
                sids = np.cumsum(B.from_planes(sids), dtype=np.uint64).view(np.int64)
                seconds, n = B.from_planes(seconds).astype(np.int64), B.from_planes(n).astype(np.int32)
                spread = np.unpackbits(np.frombuffer(spread, np.uint8), count=len(keys)).astype(bool)
                parts = (keys, sids[local], seconds[local], n[local], B.from_planes(places).astype(np.int32), spread)
                for column, part in zip(columns, parts, strict=True):
                    column.append(part)
        if not columns[0]:
            return
        keys, sids, seconds, n, places, spread = (np.concatenate(c) for c in columns)
        del columns
        order = np.lexsort((seconds, sids, keys))
        keys, sids, seconds = keys[order], sids[order], seconds[order]
        fresh = np.ones(len(keys), dtype=bool)  # copies of one set, sent by several tasks, are one posting
        fresh[1:] = (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1]) | (seconds[1:] != seconds[:-1])
        keys, sids, seconds, order = keys[fresh], sids[fresh], seconds[fresh], order[fresh]
        lengths = np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])))
        size, spread = np.repeat(lengths, lengths), spread[order]
        keep, many = np.flatnonzero((size > 1) | spread), (size > 2) | spread
        for a in range(0, len(keep), 100_000):
            part = keep[a : a + 100_000]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[part].view(np.int64)), pa.array(sids[part]), pa.array(seconds[part]),
                    pa.array(n[order[part]]), pa.array(places[order[part]]), pa.array(many[part]),
                ],
                names=["key", "sid", "second", "n", "pos", "many"],
            )

    sent = B.deliver(texts.mapInArrow(send, B.PARCEL), count)
    sent.mapInArrow(meet, _POSTED).write.parquet(table_path)


def _may_link(a: str, b: str, first: bool = False):
    """What two postings of one key leave possible: sizes, and how much can lie before and after the key.

    With ``first``, nothing in common may lie before the key. Linked sets also meet in the key of their first
    common element, so this loses no link where all pairs of a list are tried.
    """
    na, nb, pa_, pb = (F.col(f"{x}.{y}").cast("long") for y in ("n", "pos") for x in (a, b))
    most = F.least(na - pa_, nb - pb) + (F.lit(0) if first else F.least(pa_, pb))
    return (100 * F.least(na, nb) >= PERCENT * F.greatest(na, nb)) & ((100 + PERCENT) * most >= PERCENT * (na + nb))


def _pairs(left, right):
    """Two nodes in a fixed order as the columns of a pair."""
    return F.array_sort(F.array(left, right))


def _verified(texts: DataFrame, named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of nodes whose sets are similar enough; each needed set is made again from one of its texts.

    The ids of the rows with these sets go to the scan, or bits for them where they are many, and only their texts are
    read as words. Texts are shuffled compressed, which takes less than their hashes, and cut again where pairs meet.
    """
    nodes = saved(pairs.select(F.explode("pair").alias("node")).distinct(), "candidates")
    of_node = named.groupBy(F.struct("sid", "second").alias("node")).agg(F.min("doc_id").alias("wanted"))
    wanted = of_node.join(nodes, "node", "left_semi").select("wanted").distinct()
    count, bits = nodes.count(), None
    if count <= SIDS:
        texts = texts.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
    else:
        bits = texts.sparkSession.sparkContext.broadcast(_id_bits(wanted, count))
        texts = texts.select("text", _id_place("doc_id", 8 * len(bits.value)).alias("place"))

    def make(batches):
        for batch in batches:
            if bits is not None:
                place = batch.column("place").to_numpy()
                batch = batch.filter(pa.array(bits.value[place >> 3] >> (place & 7).astype(np.uint8) & 1 > 0))
            for block in B.text_blocks([batch], "text", SET_BYTES):
                sids, seconds, bodies = _bodies(*B.text_bytes(block.column("text")))
                columns = [pa.array(sids), pa.array(seconds), pa.array(bodies, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["sid", "second", "body"])

    made = texts.mapInArrow(make, "sid long, second long, body binary")
    made = made.groupBy(F.struct("sid", "second").alias("node")).agg(F.first("body").alias("body"))
    made = saved(made.join(nodes, "node", "left_semi"), "candidate-sets")
    sides = pairs.select(F.col("pair")[0].alias("a"), F.col("pair")[1].alias("b"))
    sides = sides.join(made.select(F.col("node").alias("a"), F.col("body").alias("a_body")), "a")
    sides = sides.join(made.select(F.col("node").alias("b"), F.col("body").alias("b_body")), "b")

    def compare(batches):
        for batch in batches:
            links, some, held = [], [], 0
            for pair in zip(batch.column("a_body").to_pylist(), batch.column("b_body").to_pylist(), strict=True):
                some.append(pair)
                held += sum(map(_body_size, pair))
                if held >= SET_BYTES:
                    links += _similar(some)
                    some, held = [], 0
            kept = pa.array(links + _similar(some), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"]
            )

    node = "struct<sid:bigint,second:bigint>"
    return sides.select("a", "b", "a_body", "b_body").mapInArrow(compare, f"a {node}, b {node}")


def _id_place(doc_id: str, bits: int):
    """The bit that stands for an id."""
    return F.pmod(F.xxhash64(doc_id), F.lit(bits))


def _id_bits(wanted: DataFrame, count: int) -> np.ndarray:
    """Bits that are set for all ids of ``wanted``, and by chance for few others: 16 or more an id, or ID_BITS in all."""
    bits = min(ID_BITS, max(2**15, 1 << (16 * count - 1).bit_length()))
    place = _id_place("wanted", bits) + 1  # Spark counts bits from 1, and its buckets of them too
    parts = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part"))
    found = np.zeros((bits // 2**15, 2**12), np.uint8)
    for row in parts.toLocalIterator():
        found[row["bucket"] - 1] = np.frombuffer(row["part"], np.uint8)
    return found.ravel()


def _bodies(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """The names of distinct sets of some texts, and what they can be made from again.

    That is a compressed text, or the set itself if that is smaller or less than half as long as the text.
    """
    hashes, firsts = shingle_sets(data, offsets)
    sids, seconds = set_names(hashes, firsts)
    n = np.diff(firsts)
    keep = _first_of_equal(sids)
    keep = keep[n[keep] > 0]
    bodies, compressor = [], zstandard.ZstdCompressor(level=3)
    for i in keep.tolist():
        text = data[offsets[i] : offsets[i + 1]]
        body = compressor.compress(text.tobytes()) if len(text) <= 16 * n[i] else None
        if body is None or len(body) >= 8 * n[i]:
            bodies.append(hashes[firsts[i] : firsts[i + 1]].tobytes() + _SET)
        else:
            bodies.append(body + _TEXT)
    return sids[keep], seconds[keep], bodies


def _body_size(body: bytes) -> int:
    return zstandard.frame_content_size(body) if body[-1:] == _TEXT else len(body)


def _similar(pairs: list[tuple[bytes, bytes]]) -> list[bool]:
    """Whether the sets of two bodies link, for each pair."""
    sets = {body: np.frombuffer(body, np.uint64, len(body) // 8) for pair in pairs for body in pair if body[-1:] == _SET}
    bodies = list({body: None for pair in pairs for body in pair if body[-1:] == _TEXT})
    texts = [zstandard.ZstdDecompressor().decompress(memoryview(body)[:-1]) for body in bodies]
    hashes, firsts = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), B.offsets_of([len(x) for x in texts]))
    sets |= {body: hashes[firsts[i] : firsts[i + 1]] for i, body in enumerate(bodies)}
    links = []
    for left, right in pairs:
        x, y = sets[left], sets[right]
        both = len(np.intersect1d(x, y, assume_unique=True))
        links.append(100 * both >= PERCENT * (len(x) + len(y) - both))
    return links


def linked_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``.

    Two documents link when their sets of shingles have a Jaccard similarity of PERCENT or more; the component
    is the smallest doc_id that links lead to. A text without words, or null, has an empty set and links with
    nothing. Equal sets link at once, whatever their number, and stand as one set in the search. Rows with
    equal doc_id are documents that share their id; a null doc_id never names a component of others. Other
    columns are not read.

    Linked sets share an element among their first, and a pair of elements among one more, when all are
    ordered from the rarest shingle to the most frequent. Of each list of sets with a common key, all are
    compared with the one that has the key foremost. What is linked by then is not compared again: within
    a list only sets of different components remain, and all of these that may link are compared.
    """
    return _linked_rows(docs, doc_id, text, F.lit(None).cast("binary")).select("doc_id", "n_shingles", "component_id")


def _linked_rows(docs: DataFrame, doc_id: str, text: str, digest) -> DataFrame:
    """Rows as of ``linked_documents`` with ``digest`` and the label of their component; null for an empty set."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), digest.alias("digest"), F.col(text).alias("text"))
    named, frequent, met = _named_and_counted(texts)
    bodies = texts.select("text")
    sizes = dict(
        named.where(f"n between 1 and {2 * LONGEST_SMALL}").select("n", "sid", "second").distinct().groupBy("n").count().collect()
    )
    path = scratch_path(spark, "postings")
    _postings(bodies, frequent, boundary(sizes, met), path)
    postings = spark.read.schema(_POSTED).parquet(path)
    postings = postings.select("key", F.struct("sid", "second").alias("node"), "n", "pos", "many")

    lead = F.min(F.struct("pos", "n", "node")).alias("lead")
    leaders = postings.groupBy("key").agg(lead, F.count(F.lit(1)).alias("size")).where("size > 1").select(F.col("key").alias("k"), "lead")
    stars = (
        postings.alias("other")
        .join(leaders, F.col("key") == F.col("k"))
        .where((F.col("other.node") != F.col("lead.node")) & _may_link("other", "lead"))
        .select(_pairs(F.col("lead.node"), F.col("other.node")).alias("pair"))
        .distinct()
    )
    first = saved(stars, "first-pairs")
    links = saved(_verified(texts, named, first), "first-links")
    label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # The two sets of a shorter list have been compared, or may not link.
    held = postings.where("many").join(label.withColumnRenamed("id", "node"), "node", "left").select(
        "key", "node", "n", "pos", F.coalesce("label", "node").alias("label")
    )
    mixed = held.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low != high")
    held = saved(held.join(mixed.select("key"), "key", "left_semi"), "mixed-lists")
    one, two = held.alias("one"), held.alias("two")
    rest = (
        one.join(two, F.col("one.key") == F.col("two.key"))
        .where((F.col("one.node") < F.col("two.node")) & (F.col("one.label") != F.col("two.label")) & _may_link("one", "two", first=True))
        .select(_pairs(F.col("one.node"), F.col("two.node")).alias("pair"))
        .distinct()
        .join(first, "pair", "left_anti")
    )
    second = saved(rest, "second-pairs")
    if not second.isEmpty():
        links = links.unionByName(saved(_verified(texts, named, second), "second-links"))
        label = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    groups = named.where("n > 0").groupBy("sid", "second").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    groups = groups.select(F.struct("sid", "second").alias("node"), "least", "copies")
    groups = saved(groups.join(label.withColumnRenamed("id", "node"), "node", "left"), "labelled-sets")
    # A component of very many sets is one label: few labels go to the sets, else adaptive execution splits the sets.
    lowest = groups.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("least").alias("component_id"))
    linked = join_small(groups, lowest, "label").select("node", "copies", "label", "component_id")
    alone = groups.where(F.col("label").isNull())
    alone = alone.select("node", "copies", F.col("node").alias("label"), F.col("least").alias("component_id"))
    return _with_sets(named, saved(linked.unionByName(alone), "sets"))


def _with_sets(named: DataFrame, sets: DataFrame) -> DataFrame:
    """Each row with the label and component of its set.

    A set with more rows than an eighth (COMMON) of a partition's share is a hot key. There are fewer than COMMON of them
    a partition, whatever the input, so they go to the rows. Rows without words have no set to look up.
    """
    rows = named.select("doc_id", "n", "digest", F.struct("sid", "second").alias("node"))
    total = sets.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    common = F.col("copies") * (COMMON * B.partitions(named)) > total
    often, seldom = (sets.where(chosen).select("node", "label", "component_id") for chosen in (common, ~common))
    worded = rows.where("n > 0")
    parts = [
        worded.join(F.broadcast(often), "node"),
        worded.join(F.broadcast(often.select("node")), "node", "left_anti").join(seldom, "node"),
        rows.where("n = 0").withColumns({name: F.lit(None).cast(sets.schema[name].dataType) for name in ("label", "component_id")}),
    ]
    component = F.coalesce("component_id", "doc_id").alias("component_id")
    return reduce(DataFrame.unionByName, (x.select("doc_id", F.col("n").alias("n_shingles"), component, "digest", "label") for x in parts))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of linked documents: that with the smallest doc_id.

    A null doc_id is larger than all; of rows with equal doc_id that with the smallest digest of its text is kept, and of rows
    equal in both one. Every row without words stays.
    """
    digest = F.unhex(F.sha2(F.col(text), 256))
    rows = _linked_rows(docs, doc_id, text, digest).where(F.col("label").isNotNull())
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("least")
    zero = F.lit(0).cast("long")
    keys = ["none", "id", "digest"]  # the same for the join and the window, so that texts are shuffled once
    kept = rows.groupBy("label").agg(least).select("least.none", F.coalesce("least.doc_id", zero).alias("id"), "least.digest")
    worded = F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = docs[doc_id].cast("long")
    packed = docs.where(worded).select(
        F.struct(*[docs[name] for name in docs.columns]).alias("row"),
        own.isNull().alias("none"), F.coalesce(own, zero).alias("id"), digest.alias("digest"),
    )
    found = packed.join(kept, keys, "left_semi")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64("row")))
    found = found.withColumn("place", place).where("place = 1").select("row.*")
    return docs.where(~worded).unionByName(found)
