"""Removal of passages that occur in an earlier document, by sorting suffixes at chosen places."""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chalkline.llm import blocks as B

LENGTH = 50
SEED = 24  # bytes of an anchor; a passage has LENGTH - SEED + 1 places for one
BLOCK_BYTES = 4 * 1024 * 1024
SORT_BYTES = 4 * 1024 * 1024  # of passages that are sorted at a time, or one anchor's; that has at most MANY_SPANS spans

MANY_SPANS = 4096  # of an anchor, counted block by block, from which its passages are dealt out singly
DEALT = 24  # first bytes by which suffixes are dealt out before they are merged
_STEP = 1 << 15  # places whose hashes are worked out at a time, so that they stay in the processor's cache

_TEXT, _SHARED, _COVERED = 0, 1, 2
_NO_ID = np.int64(2**63 - 1)  # a null doc_id is smaller than none
_INVERSE = np.uint64(pow(int(B.BASE), -1, 2**64))


class PrefixHashes:
    """Polynomial hashes of all prefixes of some bytes, from which any slice's hash follows."""

    def __init__(self, data: np.ndarray):
        sums = np.cumsum(B.BYTE_CODE[data] * B.powers(len(data))[: len(data)], dtype=np.uint64)
        self.sums = np.concatenate([[np.uint64(0)], sums])
        factors = np.full(len(data) + 1, _INVERSE, dtype=np.uint64)
        factors[0] = 1
        self.inverse = np.cumprod(factors, dtype=np.uint64)

    def of(self, starts: np.ndarray, length) -> np.ndarray:
        return (self.sums[starts + length] - self.sums[starts]) * self.inverse[starts]


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash, as of ``PrefixHashes``, of ``width`` bytes from every place; windows of 1, 2, 4, ... bytes are joined."""
    part, whole, done, size = B.BYTE_CODE[data], None, 0, 1
    places = len(data) - width + 1
    while size <= width:
        if width & size:
            own = part[done : done + places]
            whole = own if whole is None else whole + own * np.uint64(pow(int(B.BASE), done, 2**64))
            done += size
        part = part[:-size] + part[size:] * np.uint64(pow(int(B.BASE), size, 2**64))
        size *= 2
    return whole


def _lowest(hashes: np.ndarray, width: int) -> np.ndarray:
    """The place of the lowest of each ``width`` adjoining hashes by their upper half, the leftmost of equal ones."""
    least = hashes & np.uint64(0xFFFFFFFF00000000) | np.arange(len(hashes), dtype=np.uint64)
    count, size = len(hashes) - width + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    return (np.minimum(least[:count], least[width - size : width - size + count]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def common_extension(hashes: PrefixHashes, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, up to ``depth``, by binary search."""
    common = np.zeros(len(a), np.int64)
    step = 1 << (depth.bit_length() - 1)
    while step:
        longer = common + step
        fits = np.flatnonzero(longer <= depth)
        same = hashes.of(a[fits], longer[fits]) == hashes.of(b[fits], longer[fits])
        common[fits[same]] = longer[fits[same]]
        step >>= 1
    return common


def _less(data, hashes, a, b, depth: int, or_equal: bool) -> np.ndarray:
    common = common_extension(hashes, a, b, depth)
    open_ = common < depth
    less = np.full(len(a), or_equal)
    less[open_] = data[a[open_] + common[open_]] < data[b[open_] + common[open_]]
    return less


def sorted_suffixes(data: np.ndarray, starts: np.ndarray, depth: int, hashes: PrefixHashes | None = None) -> np.ndarray:
    """``starts`` in the order of their suffixes' first ``depth`` bytes, all of which exist.

    Suffixes are first dealt out by their first DEALT bytes; where these are equal, runs of 1, 2, 4, ...
    are merged. In a merge each suffix finds its place in the other run by binary search, and each comparison
    finds the common extension by binary search over prefix hashes.
    """
    if not len(starts):
        return starts
    hashes = hashes or PrefixHashes(data)
    heads = []
    for a in range(0, min(DEALT, depth), 8):
        head = np.zeros(len(starts), np.uint64)
        for i in range(a, min(a + 8, depth)):
            head = head << np.uint64(8) | data[starts + i].astype(np.uint64)
        heads.append(head)
    order = np.lexsort(heads[::-1])
    starts = starts[order].copy()
    new = np.ones(len(starts), dtype=bool)
    new[1:] = np.logical_or.reduce([head[order][1:] != head[order][:-1] for head in heads])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(starts)))
    group_first, group_end = np.repeat(first, size), np.repeat(first + size, size)
    width = 1
    while width < size.max():
        at = np.flatnonzero(group_end - group_first > width)
        run = (at - group_first[at]) // width
        left = run % 2 == 0
        own = group_first[at] + run * width
        low = np.where(left, own + width, own - width)
        other = np.minimum(low, group_end[at])
        end = np.minimum(np.where(left, low + width, own), group_end[at])
        begin, stop = other.copy(), np.maximum(end, other)
        while True:
            open_ = np.flatnonzero(begin < stop)
            if not len(open_):
                break
            middle = (begin[open_] + stop[open_]) // 2
            mine, theirs = starts[at[open_]], starts[middle]
            before = np.empty(len(open_), dtype=bool)
            l = left[open_]  # equal suffixes keep the order of their runs
            before[l] = _less(data, hashes, theirs[l], mine[l], depth, False)
            before[~l] = _less(data, hashes, theirs[~l], mine[~l], depth, True)
            begin[open_[before]] = middle[before] + 1
            stop[open_[~before]] = middle[~before]
        place = np.where(left, own, low) + (at - own) + (begin - other)
        merged = starts.copy()
        merged[place] = starts[at]
        starts = merged
        width *= 2
    return starts


def least_owner(data: np.ndarray, starts: np.ndarray, owners: np.ndarray, depth: int) -> np.ndarray:
    """For each suffix the smallest owner of any with the same first ``depth`` bytes.

    Equal suffixes are neighbours once sorted; where hashes say that neighbours are equal, bytes are compared.
    """
    hashes = PrefixHashes(data)
    at = sorted_suffixes(data, starts, depth, hashes)
    index = np.empty(len(data) + 1, np.int64)
    index[starts] = np.arange(len(starts))
    order = index[at]
    equal = common_extension(hashes, at[1:], at[:-1], depth) == depth
    claimed = np.flatnonzero(equal)
    reach = np.arange(depth)
    for a in range(0, len(claimed), 200_000):
        part = claimed[a : a + 200_000]
        true = (data[at[part][:, None] + reach] == data[at[part + 1][:, None] + reach]).all(axis=1)
        equal[part[~true]] = False
    heads = np.flatnonzero(np.concatenate([[True], ~equal]))
    least = np.empty(len(starts), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(owners[order], heads), np.diff(np.append(heads, len(starts))))
    return least


class _Block:
    """The anchors of a block of texts and the passages each stands for.

    The anchor of a passage is the place in it whose next SEED bytes hash lowest, the leftmost of equal ones; so equal
    passages have equal anchors. Passages of one anchor begin next to each other, and the bytes from the
    first one's start to the last one's end are the anchor's span.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray):
        self.data, self.offsets, self.ids = data, offsets, ids
        self.first = self.last = self.anchor = np.zeros(0, np.int64)
        self.key, self.owner, self.span = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
        count = len(data) - LENGTH + 1
        if count <= 0:
            return
        wide = LENGTH - SEED + 1
        seed, anchor = np.empty(count + wide - 1, np.uint64), np.empty(count, np.int64)
        for a in range(0, count, _STEP):
            size = min(_STEP, count - a)
            part = B.mixed(window_hashes(data[a : a + size + LENGTH - 1], SEED))
            seed[a : a + len(part)] = part
            anchor[a : a + size] = a + _lowest(part, wide)
        change = np.zeros(count + 1, np.int8)
        long_ = np.diff(offsets) >= LENGTH
        change[offsets[:-1][long_]] += 1
        change[offsets[1:][long_] - LENGTH + 1] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8).view(bool)  # starts whose passage lies in one text
        same = anchor[1:] == anchor[:-1]
        same &= inside[1:]
        same &= inside[:-1]
        head, tail = inside.copy(), inside.copy()
        head[1:] &= ~same
        tail[:-1] &= ~same
        self.first, self.last = np.flatnonzero(head), np.flatnonzero(tail)
        if not len(self.first):
            return
        self.key = seed[anchor[self.first]]
        self.owner = np.repeat(ids, np.diff(np.searchsorted(self.first, offsets)))
        span = (self.last - self.first).astype(np.uint64)
        for at in (self.first, self.last):  # the first and the last passage make up the span
            for part in (0, SEED, LENGTH - SEED):
                span = B.mixed(span * B.BASE + seed[at + part])
        self.span = span

    def singled(self, keep: np.ndarray) -> _Block:
        """A block of the same texts in which some anchors' passages each are an anchor of their own.

        Its key is the hash of the whole passage, so that the passages of one anchor have homes of their own.
        """
        block = copy.copy(self)
        hot = np.zeros(len(self.key), dtype=bool)
        hot[keep] = True
        size = self.last[hot] - self.first[hot] + 1
        single = B.gather(self.first[hot], size)
        key = np.zeros(len(single), np.uint64)
        for a in range(0, LENGTH, SEED + 1):  # hashes of parts; LENGTH is a multiple of their size
            part = self.data[single[:, None] + np.arange(a, a + SEED + 1)]
            key = B.mixed(key * B.BASE + (B.BYTE_CODE[part] * B.powers(SEED + 1)).sum(axis=1, dtype=np.uint64))
        block.first, block.last = np.append(self.first[~hot], single), np.append(self.last[~hot], single)
        block.key, block.owner = np.append(self.key[~hot], key), np.append(self.owner[~hot], np.repeat(self.owner[hot], size))
        return block

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, whether each has several documents, the home of each, and each anchor's place among them."""
        order = np.argsort(self.key)
        key, owner = self.key[order], self.owner[order]
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        number = np.cumsum(new) - 1
        keys = key[new]
        several = np.zeros(len(keys), dtype=bool)
        several[number[1:][~new[1:] & (owner[1:] != owner[:-1])]] = True
        place = np.empty(len(key), np.int64)
        place[order] = number
        return keys, several, _homes(keys, count), place

    def span_counts(self, keys: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many distinct spans each of the distinct keys has."""
        counts = np.bincount(place, minlength=len(keys))
        often = np.flatnonzero(counts[place] > 1)
        pairs = often[np.unique(B.mixed(self.span[often]) ^ self.key[often], return_index=True)[1]]
        return np.where(counts > 1, np.bincount(place[pairs], minlength=len(keys)), counts)

    def spans(self, keep: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct spans of some anchors, the key and least owner of each, and each anchor's span."""
        first, size = self.first[keep], self.last[keep] - self.first[keep] + LENGTH
        found = B.slices(self.data[B.gather(first, size)], B.offsets_of(size)).dictionary_encode()
        codes = found.indices.to_numpy()
        least = np.full(len(found.dictionary), _NO_ID)
        np.minimum.at(least, codes, self.owner[keep])
        keys = np.zeros(len(found.dictionary), np.uint64)
        keys[codes] = self.key[keep]
        return found.dictionary, keys, least, codes


def _homes(keys: np.ndarray, count: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) % np.uint64(count)).astype(np.int64)


def _by_home(homes: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(homes, kind="stable")
    bounds = np.searchsorted(homes[order], np.arange(count + 1))
    for home in np.flatnonzero(np.diff(bounds)).tolist():
        yield home, order[bounds[home] : bounds[home + 1]]


def _blocks(batches) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Name, bytes, offsets and ids of each block of texts."""
    for batch in B.text_blocks(batches, "text", BLOCK_BYTES):
        data, offsets = B.text_bytes(batch.column("text"))
        ids = batch.column("doc_id").fill_null(int(_NO_ID)).to_numpy()
        name = hashlib.blake2b(np.ascontiguousarray(data), digest_size=12)
        name.update(ids.tobytes() + offsets.tobytes())
        yield name.digest(), data, offsets, ids


def _gathered(batches) -> Iterator[tuple[_Block, dict[int, bytes], dict[int, bytes]]]:
    """Each block that arrives, with its answers by home; equal blocks have equal answers."""

    def closed():
        for payload in texts:
            data, offsets, ids = B.unpack(payload)
            yield _Block(np.frombuffer(data, np.uint8), offsets, ids), shared, covered

    name, texts, shared, covered = None, [], {}, {}
    for batch in batches:
        for block, kind, payload in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "payload")), strict=True):
            if block != name:
                yield from closed()
                name, texts, shared, covered = block, [], {}, {}
            if kind == _TEXT:
                texts.append(payload)
            else:
                home, answer = B.unpack(payload)
                (shared if kind == _SHARED else covered)[home] = answer
    yield from closed()


def _shared_anchors(block: _Block, answers: dict[int, bytes], count: int) -> tuple[_Block, np.ndarray]:
    """The block, passages of anchors with many spans singled, and its anchors that other documents have, too."""
    keys, _, homes, at = block.of(count)
    shared, many = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    for home, own in _by_home(homes, count):
        bits = np.unpackbits(np.frombuffer(answers[home], np.uint8), count=2 * len(own)).astype(bool)
        shared[own], many[own] = bits[: len(own)], bits[len(own) :]
    keep, hot = shared[at], shared[at] & many[at]
    if not hot.any():
        return block, np.flatnonzero(keep)
    singled = block.singled(np.flatnonzero(hot))
    return singled, np.flatnonzero(np.append(keep[~hot], np.ones(len(singled.key) - np.count_nonzero(~hot), dtype=bool)))


def _home(block: bytes, count: int) -> int:
    return int.from_bytes(block[:4], "big") % count


def _covering(batches, count: int):
    """Answers each block's spans in one task's share of the keys: which passages occur in a smaller document."""
    here, parcels, texts, keys, owners, sizes = 0, [], [], [], [], []
    for batch in batches:
        here = batch.column("target")[0].as_py() if batch.num_rows else here
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
            data, lengths, key, least = B.unpack(payload)
            texts.append(B.slices(np.frombuffer(data, np.uint8), B.offsets_of(lengths)))
            keys.append(key)
            owners.append(least)
            parcels.append(block)
            sizes.append(len(key))
    if not parcels:
        return
    coded = pa.concat_arrays(texts).dictionary_encode()
    del texts
    codes, key, owner = coded.indices.to_numpy(), np.concatenate(keys), np.concatenate(owners)
    n = len(coded.dictionary)
    least = np.full(n, _NO_ID)
    np.minimum.at(least, codes, owner)
    span_key = np.zeros(n, np.uint64)
    span_key[codes] = key
    data, offsets = B.text_bytes(coded.dictionary)
    passages = np.diff(offsets) - LENGTH + 1
    begin = B.offsets_of(passages)
    found = np.repeat(least, passages)  # by passage; right where a key has a single span
    order = np.argsort(span_key, kind="stable")
    ordered = span_key[order]
    several = np.zeros(n, dtype=bool)
    same = ordered[1:] == ordered[:-1]
    several[1:] |= same
    several[:-1] |= same
    order, ordered = order[several], ordered[several]
    ends = np.cumsum(np.diff(offsets)[order])
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(order) else []
    bounds = [0]
    for head in heads:  # whole keys together, in parts of bounded size
        if head and ends[head - 1] - (ends[bounds[-1] - 1] if bounds[-1] else 0) > SORT_BYTES:
            bounds.append(int(head))
    bounds.append(len(order))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        own = order[a:b]
        if not len(own):
            continue
        length = np.diff(offsets)[own]
        part = data[B.gather(offsets[:-1][own], length)]
        starts = B.gather(B.offsets_of(length)[:-1], passages[own])
        result = least_owner(part, starts, np.repeat(least[own], passages[own]), LENGTH)
        found[B.gather(begin[:-1][own], passages[own])] = result
    at = 0
    for block, size in zip(parcels, sizes, strict=True):
        own = codes[at : at + size]
        earlier = found[B.gather(begin[:-1][own], passages[own])] < np.repeat(owner[at : at + size], passages[own])
        at += size
        payload = B.pack(here, np.packbits(earlier).tobytes())
        yield B.parcels([(_home(block, count), block, _COVERED, payload)])


def _cut(block: _Block, covered: dict[int, bytes], keep: np.ndarray, count: int) -> pa.RecordBatch:
    distinct, keys, least, codes = block.spans(keep)
    passages = np.diff(B.text_bytes(distinct)[1]) - LENGTH + 1
    begin = B.offsets_of(passages)
    earlier = np.zeros(begin[-1], dtype=bool)
    for home, own in _by_home(_homes(keys, count), count):
        cells = B.gather(begin[:-1][own], passages[own])
        earlier[cells] = np.unpackbits(np.frombuffer(covered[home], np.uint8), count=len(cells)).astype(bool)
    # An equal span of a smaller document in this block covers all of it.
    size = passages[codes]
    hit = earlier[B.gather(begin[:-1][codes], size)] | np.repeat(block.owner[keep] > least[codes], size)
    starts = B.gather(block.first[keep], size)[hit]
    change = np.bincount(starts, minlength=len(block.data) + 1) - np.bincount(starts + LENGTH, minlength=len(block.data) + 1)
    gone = np.cumsum(change[:-1]) > 0
    ends = np.cumsum(np.concatenate([[0], gone]))
    removed = ends[block.offsets[1:]] - ends[block.offsets[:-1]]
    head = gone.copy()
    head[1:] &= ~gone[:-1]
    inner = block.offsets[:-1][np.diff(block.offsets) > 0]
    head[inner] = gone[inner]
    heads = np.cumsum(np.concatenate([[0], head]))
    left = B.offsets_of(np.diff(block.offsets) - removed)
    view = memoryview(np.ascontiguousarray(block.data[~gone]))
    digests = [hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(left[:-1], left[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(block.ids, mask=block.ids == _NO_ID), pa.array(np.diff(block.offsets)), pa.array(removed),
            pa.array(heads[block.offsets[1:]] - heads[block.offsets[:-1]]), pa.array(digests),
            B.slices(block.data[~gone], left).cast(pa.binary()),
        ],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
    )


def drop_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row of ``docs``.

    Every byte that lies in a passage of LENGTH bytes which also begins in a document with a smaller doc_id is
    removed; ``kept`` holds the bytes left, which need not be whole characters. Null texts are empty. Rows with equal doc_id are one document
    as far as "smaller" goes, and a null doc_id is larger than all. Other columns are not read.

    Texts are read three times. First every anchor (see ``_Block``) goes to its task as 32 bits of hash, once per block,
    and those found in one document only are out. The spans of the others follow, each distinct one once per block; equal spans meet
    there, and where one anchor has several spans their passages are sorted as suffixes. An anchor with more than
    MANY_SPANS spans, as at the edge of a passage that many documents share, sends its passages one by one instead,
    each distinct one once per block, to the homes of their own hashes. Answers
    come back to the blocks as bits. The table should be a scan of files; if a second reading dealt rows
    to blocks otherwise, the job would fail.
    """
    count = B.partitions(docs)
    table = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def ask(batches):
        for name, *texts in _blocks(batches):
            block = _Block(*texts)
            keys, several, homes, place = block.of(count)
            spans = block.span_counts(keys, place)
            rows = []
            for home, own in _by_home(homes, count):
                bits = np.packbits(several[own]).tobytes()
                rows.append((home, name, 0, B.pack(B.planes(keys[own] & np.uint64(2**32 - 1)), bits, B.planes(spans[own]))))
            yield B.parcels(rows)

    def share(batches):
        here, parcels = 0, []
        for batch in batches:
            here = batch.column("target")[0].as_py() if batch.num_rows else here
            for name, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist()):
                planes, bits, spans = B.unpack(payload)
                keys = B.from_planes(planes).astype(np.uint32)
                bits = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(keys))
                parcels.append((name, keys, bits, B.from_planes(spans)))
        if not parcels:
            return
        keys, inverse = np.unique(np.concatenate([p[1] for p in parcels]), return_inverse=True)
        times = np.bincount(inverse, 1 + np.concatenate([p[2] for p in parcels]), len(keys))
        spans = np.bincount(inverse, np.concatenate([p[3] for p in parcels]), len(keys))
        shared, many, at = times[inverse] > 1, (spans > MANY_SPANS)[inverse], 0
        for name, own, _, _ in parcels:
            answer = np.packbits(np.append(shared[at : at + len(own)], many[at : at + len(own)])).tobytes()
            at += len(own)
            yield B.parcels([(_home(name, count), name, _SHARED, B.pack(here, answer))])

    def texts(batches):
        for name, data, offsets, ids in _blocks(batches):
            payload = B.pack(data.tobytes(), offsets, ids)
            yield B.parcels([(_home(name, count), name, _TEXT, payload)])

    def spans(batches):
        for block, shared, _ in _gathered(batches):
            block, keep = _shared_anchors(block, shared, count)
            distinct, keys, least, _ = block.spans(keep)
            name = hashlib.blake2b(np.ascontiguousarray(block.data), digest_size=12)
            name.update(block.ids.tobytes() + block.offsets.tobytes())
            rows = []
            for home, own in _by_home(_homes(keys, count), count):
                data, offsets = B.text_bytes(distinct.take(pa.array(own)))
                payload = B.pack(data.tobytes(), B.narrow(np.diff(offsets)), keys[own], least[own])
                rows.append((home, name.digest(), 0, payload))
            yield B.parcels(rows)

    def cut(batches):
        for block, shared, covered in _gathered(batches):
            block, keep = _shared_anchors(block, shared, count)
            yield _cut(block, covered, keep, count)

    def together(*parts: DataFrame) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionAll(part)
        return B.deliver(whole, count).sortWithinPartitions("block", "kind")

    shared = B.deliver(table.mapInArrow(ask, B.PARCEL), count).mapInArrow(share, B.PARCEL)
    bodies = table.mapInArrow(texts, B.PARCEL)
    sent = B.deliver(together(shared, bodies).mapInArrow(spans, B.PARCEL), count)
    covered = sent.mapInArrow(lambda batches: _covering(batches, count), B.PARCEL)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return together(shared, covered, bodies).mapInArrow(cut, schema)
