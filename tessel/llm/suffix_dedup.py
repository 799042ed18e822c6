"""Exact substring dedup with run-length indexes.

Every byte that a WIDTH-byte string covers which also starts earlier (smaller doc_id, or same document and earlier start) is marked.

1. Anchors. In each string of WIDTH bytes, the GRAM-byte substring with the smallest hash is its anchor, so equal strings have equal anchors
   at equal places. The window of an anchor spans the strings that have it. Windows go as (anchor hash, 128-bit window hash, document, place), packed
   in blobs, to buckets by anchor hash. Of equal windows only the first is new: all others are covered whole. That is done before the shuffle
   within each partition and again in the bucket, so a passage in a third of all documents sends one entry from each partition.
2. Windows. Anchors that are left with several different windows ask the documents for the windows' bytes.
3. Index. Windows of an anchor meet in one bucket and build run-length indexes of bounded size: suffix array, Burrows-Wheeler transform cut into runs,
   and samples at the run ends. Matching statistics are streamed from the samples alone: for text position i the nearest sample j <= i gives
   the length sample[j] - (i - j) and the place source[j] + (i - j) of a match. Chains of matches of at least WIDTH bytes are the classes of
   equal strings; all but the first of each class are marked.
4. Hot anchors. More than HOT different windows of one anchor (the edges of a passage in very many documents) are dealt to all buckets by document. What
   an index finds to be first among them is only the first there, so these strings go on by their own hashes, the first of each string
   in each partition, and the first of all is found where they meet.
5. Marks meet their documents and the covered bytes are dropped.

Buffers are bounded in bytes: texts are taken in slices, entries in lots of LOT, and buckets, of which a partition has BUCKETS, come one by one from
a sorted partition. Two windows, or two strings of hot anchors, count as equal if two independent 64-bit hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RollingHash, U, bounded_batches, by_first, lean, materialize, mix, named, slices, small_join, utf8

WIDTH, GRAM = 100, 24
#: Text bytes taken at once; a longer text is cut into pieces that overlap by WIDTH - 1 bytes.
SLICE = 1 << 18
#: Entries held by a worker before they are sent on.
LOT = 300_000
#: Window bytes held before they are sent on.
LOT_BYTES = 8 << 20
#: Buckets for each partition.
BUCKETS = 16
#: Window bytes that one index holds; windows of one anchor stay together unless the anchor is hot.
INDEX_BYTES = 60_000
#: An anchor with more different windows is hot.
HOT = 2000

#: Places in a slice take so many bits of a gram's hash, the lowest: of equal hashes the first counts.
_PLACE = 20
#: A window's place: its start above, its size in the low bits.
_SIZE = 16
_COVERED, _ASKED, _HOT = range(3)

Batches = Iterator[pa.RecordBatch]


def _slide(a: np.ndarray, width: int, f) -> np.ndarray:
    """f over every run of width values."""
    size = 1
    while size * 2 <= width:
        a = f(a[:-size], a[size:])
        size *= 2
    return f(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def anchors(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, three rows of hashes: anchor and twice window) of each anchor's window in at most 2^20 bytes."""
    n = len(data) - width + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty((3, 0), np.uint64)
    roll, other = RollingHash(data), RollingHash(data, 1)
    grams = roll.plain(gram)
    key = (grams >> U(_PLACE) << U(_PLACE)) | np.arange(len(grams), dtype=np.uint64)
    at = (_slide(key, width - gram + 1, np.minimum) & U((1 << _PLACE) - 1)).astype(np.int64)  # the anchor of the string at each place
    real = np.repeat(offsets[1:], np.diff(offsets))[:n] - np.arange(n) >= width  # strings within one document
    turn = np.ones(n + 1, bool)
    turn[1:n] = (at[1:] != at[:-1]) | ~real[1:] | ~real[:-1]
    left, last = np.flatnonzero(real & turn[:n]), np.flatnonzero(real & turn[1:])
    stop = last + width
    at = at[left]
    doc = np.searchsorted(offsets, left, "right") - 1
    hashes = np.stack([mix(grams[at]), roll.of(left, stop) ^ mix((at - left).astype(np.uint64) + U(1)), other.of(left, stop)])
    return doc, (left - offsets[doc]) << _SIZE | (stop - left), hashes


def _first_of(e: np.ndarray, hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns of e (rows: hashes, document, place) by hashes, document and place, each once; True for the first of equal hashes.

    Rows with the same key and text have the same entries: an entry is covered by one of another place only, never by its own repeat.
    """
    n = e.shape[1]
    order = np.argsort(e[1])
    w = e[1][order]
    tied = np.zeros(n, bool)
    tied[1:] = w[1:] == w[:-1]
    tied[:-1] |= tied[1:]
    rows = np.flatnonzero(tied)
    if len(rows):
        t = e[:, order[rows]]
        keys = [t[k].view(np.int64) for k in range(hashes, len(e))][::-1] + [t[k] for k in range(hashes) if k != 1] + [t[1]]
        order[rows] = order[rows][np.lexsort(keys)]
    e = e[:, order]
    new = np.ones(n, bool)
    new[1:] = (e[:hashes, 1:] != e[:hashes, :-1]).any(axis=0)
    once = new.copy()
    once[1:] |= (e[hashes:, 1:] != e[hashes:, :-1]).any(axis=0)
    return (e, new) if once.all() else (e[:, once], new[once])


def _pack(e: np.ndarray, hashes: int) -> bytes:
    """e as bytes: hashes as they are, the others byte by byte, as their high bytes are mostly equal and compress well."""
    return e[:hashes].tobytes() + np.ascontiguousarray(np.ascontiguousarray(e[hashes:]).view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(blob: pa.Scalar, rows: int, hashes: int) -> np.ndarray:
    raw = np.frombuffer(blob.as_buffer(), np.uint8)
    n = len(raw) // (8 * rows)
    out = np.empty((rows, n), np.uint64)
    out[:hashes] = raw[: hashes * n * 8].view(np.uint64).reshape(hashes, n)
    out[hashes:] = np.ascontiguousarray(raw[hashes * n * 8 :].reshape(8, -1).T).view(np.uint64).reshape(rows - hashes, n)
    return out


def _dealt(to: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its places in to) for each bucket that has any."""
    order = np.argsort(to.astype(np.uint16) if buckets <= 1 << 16 else to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
    for a, b in pairwise(edges.tolist()):
        yield int(to[order[a]]), order[a:b]


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with samples at run ends.

    symbols holds the texts' bytes plus one, each text closed by a zero; zeros are distinct terminators in text order.
    """

    def __init__(self, symbols: np.ndarray):
        n = self.size = len(symbols)
        ends = np.flatnonzero(symbols == 0)
        self.room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(n)  # symbols before the terminator
        sa, levels = self._suffixes(symbols)
        bwt = symbols[sa - 1].astype(np.int32)
        bwt[sa == 0] = -1
        zero = np.flatnonzero(bwt == 0)  # each terminator is a symbol of its own: runs end at them
        head = np.ones(n, bool)
        head[1:] = bwt[1:] != bwt[:-1]
        head[zero] = True
        after = zero + 1
        head[after[after < n]] = True
        self.runs = np.flatnonzero(head)
        self.heads = bwt[self.runs]
        # samples: the suffix at each run's first row, the one before it (end of the run before) and how long both agree
        first = sa[self.runs]
        before = np.where(self.runs > 0, sa[self.runs - 1], -1)
        order = np.argsort(first)
        self.sampled, self.source = first[order], before[order]
        self.common = self._agree(levels, self.sampled, self.source)

    def _after(self, a: np.ndarray, k: int) -> np.ndarray:
        """a of the place k further on, 0 beyond the terminator."""
        out = np.zeros_like(a)
        out[: max(0, self.size - k)] = a[k:]
        out[self.room < k] = 0
        return out

    def _suffixes(self, symbols: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
        """(suffix array, ranks of the prefixes of some widths). As many symbols, then ranks, as fit go into one word, which is ranked anew."""
        used = np.bincount(symbols, minlength=1) > 0
        rank = (np.cumsum(used) - 1)[symbols].astype(np.uint64)
        levels = [(1, rank)]
        width, longest = 1, int(self.room.max(initial=0))
        while True:
            bits = max(1, int(rank.max(initial=0)).bit_length())
            fit = min(64 // bits, longest // width + 1)
            key, held = rank, 1
            while held * 2 <= fit:
                key = key << U(held * bits) | self._after(key, held * width)
                held *= 2
            if (more := fit - held) > 0:
                key = key << U(more * bits) | self._after(key, held * width) >> U((held - more) * bits)
            width *= fit
            order = np.argsort(key)
            key = key[order]
            step = np.zeros(self.size, bool)
            step[1:] = key[1:] != key[:-1]
            rank = np.empty(self.size, np.uint64)
            rank[order] = np.cumsum(step)
            levels.append((width, rank))
            tied = ~step
            tied[:1] = False
            tied[:-1] |= tied[1:]
            if not (self.room[order[tied]] >= width).any():
                break
        # what is still tied ends at a terminator together; terminators are ordered by position
        return np.argsort(rank.astype(np.uint16) if self.size <= 1 << 16 else rank, kind="stable"), levels

    def _agree(self, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols agree, up to a terminator, from the places a and b on."""
        out = np.zeros(len(a), np.int64)
        limit = np.where(b >= 0, np.minimum(self.room[a], self.room[b]), 0)
        for width, rank in reversed(levels):
            live = np.arange(len(a))
            while len(live):
                x = out[live]
                fits = x + width <= limit[live]
                live, x = live[fits], x[fits]
                live = live[rank[a[live] + x] == rank[b[live] + x]]
                out[live] += width
        return out

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(length, source) for every text position, streamed from the samples."""
        here = np.zeros(self.size, np.int64)
        here[self.sampled] = 1
        j = np.cumsum(here) - 1
        ahead = np.arange(self.size) - self.sampled[j]
        return self.common[j] - ahead, self.source[j] + ahead


def repeated_starts(windows: list[bytes], firsts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(window, place) of every string of width bytes that has an equal one in an earlier place.

    firsts gives the order of windows: windows are already in the order of their documents and positions.
    """
    sizes = np.array([len(w) + 1 for w in windows], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    n = int(begin[-1])
    symbols = np.zeros(n, np.int16)
    body = np.ones(n, bool)
    body[begin[1:] - 1] = False
    symbols[body] = np.frombuffer(b"".join(windows), np.uint8).astype(np.int16) + 1
    length, source = RunLengthIndex(symbols).matching_statistics()
    chained = np.flatnonzero(length >= width)
    root = np.arange(n)
    root[chained] = source[chained]
    while True:
        up = root[root[chained]]
        if (up == root[chained]).all():
            break
        root[chained] = up
    owner = np.repeat(np.arange(len(windows)), sizes)
    place = np.arange(n) - begin[owner]
    time = firsts[owner] + place  # global order of the string's start
    earliest = time.copy()
    np.minimum.at(earliest, root[chained], time[chained])
    later = np.flatnonzero(earliest[root] < time)
    return owner[later], place[later]


def mark(docs: DataFrame, then: Callable[[Batches], Batches], schema: str, width: int = WIDTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """What then makes of docs (row_id long, text, and any rest column) with spans behind text: sorted disjoint pairs of int64 as bytes, null if there are none.

    Rows that repeat a row_id must have the same text.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = parts * BUCKETS

    def by_document(e: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
        """Rows (row_id, packed columns): e (first row: document) dealt by document."""
        order = np.argsort(e[0], kind="stable")
        who = e[0][order]
        rows = np.ascontiguousarray(e[1:, order].T)
        edges = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1], [True]]))
        for k in range(0, len(edges) - 1, 5000):
            own = edges[k : k + 5001].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(who[own[:-1]]), pa.array([rows[a:b].tobytes() for a, b in pairwise(own)], pa.binary())], names=["row_id", name])

    @lean
    def find(batches: Batches) -> Batches:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            e, new = _first_of(np.concatenate(held, axis=1), 3)
            held.clear()
            rows: list[tuple[int, bool, bytes]] = []
            for chunk, fresh in ((e[:, new], True), (e[:, ~new], False)):
                rows += [(b, fresh, _pack(chunk[:, own], 3)) for b, own in _dealt(((chunk[0] >> U(7)) % U(buckets)).astype(np.int64), buckets)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "fresh", "entries"])

        size = 0
        for batch in batches:
            ids = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs, SLICE):
                for a in range(offs[i], max(offs[i] + 1, offs[j] - width + 1), SLICE):
                    b = min(offs[j], a + SLICE + width - 1)
                    doc, place, hashes = anchors(data[a:b], np.clip(offs[i : j + 1], a, b) - a, width, gram)
                    place += (a - offs[i]) << _SIZE
                    held.append(np.concatenate([hashes, ids[i + doc].view(np.uint64)[None], place.view(np.uint64)[None]]))
                    size += len(doc)
                    if size > LOT:
                        yield flush()
                        size = 0
        if size:
            yield flush()

    @lean
    def meet(batches: Batches) -> Batches:
        """Rows (row_id, entries): of each entry its anchor and, four times its place, what is to be done with it."""
        held, size = [], 0
        for rows in by_first(batches):
            lots: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
            for batch in rows:
                for fresh, blob in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    lots[not fresh].append(_unpack(blob, 5, 3))
            e, new = _first_of(np.concatenate([np.empty((5, 0), np.uint64), *lots[0]], axis=1), 3)
            kept = e[:, new]
            kept = kept[:, np.argsort(kept[0])]
            edges = np.flatnonzero(np.concatenate([[True], kept[0][1:] != kept[0][:-1], [True]])) if kept.size else np.zeros(1, np.int64)
            many = np.repeat(np.diff(edges), np.diff(edges))
            covered = np.concatenate([e[:, ~new], *lots[1]], axis=1)
            for chunk, what in ((covered, _COVERED), (kept[:, (many > 1) & (many <= hot)], _ASKED), (kept[:, many > hot], _HOT)):
                if what == _COVERED:
                    chunk[0] = 0
                held.append(np.stack([chunk[3], chunk[0], chunk[4] << U(2) | U(what)]).view(np.int64))
                size += chunk.shape[1]
            if size > LOT:
                yield from by_document(np.concatenate(held, axis=1), "entries")
                held, size = [], 0
        if size:
            yield from by_document(np.concatenate(held, axis=1), "entries")

    def sorted_buckets(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "bucket").sortWithinPartitions("bucket")

    found = sorted_buckets(docs.select("row_id", "text").mapInArrow(find, "bucket int, fresh boolean, entries binary"))
    asked = materialize(found.mapInArrow(meet, "row_id long, entries binary"), "suffix-anchors")
    asked = asked.groupBy("row_id").agg(F.collect_list("entries").alias("entries"))

    def entries_of(blobs: list[bytes] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(anchor, start, size, what) of a document's entries."""
        e = np.frombuffer(b"".join(blobs or []), np.int64).reshape(-1, 2)
        place = e[:, 1] >> 2
        return e[:, 0], place >> _SIZE, place & ((1 << _SIZE) - 1), e[:, 1] & 3

    @lean
    def cut(batches: Batches) -> Batches:
        """The windows asked for, in blobs by bucket: of each its anchor, document, start, and twice its size (plus 1: hot), and their bytes."""
        heads, texts, held = [], [], 0

        def flush() -> pa.RecordBatch:
            head = np.concatenate(heads)
            to = head[:, 0].view(np.uint64) ^ np.where(head[:, 3] & 1, mix(head[:, 1].view(np.uint64)), U(0))
            rows = [(b, head[own].tobytes(), b"".join([texts[x] for x in own.tolist()])) for b, own in _dealt(((to >> U(7)) % U(buckets)).astype(np.int64), buckets)]
            heads.clear()
            texts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "head", "body"])

        for batch in batches:
            for row_id, text, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                anchor, left, size, what = entries_of(blobs.as_py())
                own = np.flatnonzero(what != _COVERED)
                if not len(own):
                    continue
                raw = memoryview(text.as_buffer())
                heads.append(np.column_stack([anchor[own], np.full(len(own), row_id), left[own], size[own] * 2 + (what[own] == _HOT)]))
                texts += [bytes(raw[a : a + k]) for a, k in zip(left[own].tolist(), size[own].tolist(), strict=True)]
                held += int(size[own].sum())
                if held > LOT_BYTES:
                    yield flush()
                    held = 0
        if heads:
            yield flush()

    def spans_of(starts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Rows (bucket, row_id, spans, strings) of the starts (rows: document, start) of marked strings."""
        e = np.concatenate(starts, axis=1)
        if not e.size:
            return
        e = e[:, np.lexsort((e[1], e[0]))]
        doc, start = e
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + width)
        heads = np.flatnonzero(new)
        tails = np.concatenate([heads[1:], [len(doc)]]) - 1
        for batch in by_document(np.stack([doc[heads], start[heads], start[tails] + width]), "spans"):
            n = len(batch)
            to = (mix(batch.column(0).to_numpy().view(np.uint64)) % U(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(to), *batch.columns, pa.nulls(n, pa.binary())], names=["bucket", "row_id", "spans", "strings"])

    def strings_of(lots: list[np.ndarray], marks: list[np.ndarray]) -> pa.RecordBatch:
        """The first of each string (rows: two hashes, document, start), in blobs by bucket; others are added to marks."""
        e, new = _first_of(np.concatenate(lots, axis=1), 2)
        marks.append(e[2:, ~new].view(np.int64))
        e = e[:, new]
        rows = [(b, _pack(e[:, own], 2)) for b, own in _dealt(((e[0] >> U(7)) % U(buckets)).astype(np.int64), buckets)]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.binary()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "row_id", "spans", "strings"])

    @lean
    def index(batches: Batches) -> Batches:
        marks: list[np.ndarray] = []
        strings: list[np.ndarray] = []
        for rows in by_first(batches):
            head = np.concatenate([np.frombuffer(h.as_buffer(), np.int64).reshape(-1, 4) for b in rows for h in b.column(1)])
            body = b"".join([x.as_buffer() for b in rows for x in b.column(2)])
            size, is_hot = head[:, 3] >> 1, head[:, 3] & 1
            begin = np.cumsum(size) - size
            order = np.lexsort((head[:, 2], head[:, 1], head[:, 0], is_hot))
            once = np.ones(len(order), bool)  # rows with the same key and text send the same windows
            once[1:] = (head[order[1:], :3] != head[order[:-1], :3]).any(axis=1)
            order = order[once]
            anchor = head[order, 0]
            edges = np.concatenate([np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (is_hot[order[1:]] > 0)])), [len(order)]])
            weight = np.concatenate([[0], np.cumsum(size[order])])[edges]
            k = 0
            while k < len(edges) - 1:
                m = max(k + 1, int(np.searchsorted(weight, weight[k] + INDEX_BYTES, "right")) - 1)
                own = order[edges[k] : edges[m]]
                own = own[np.lexsort((head[own, 2], head[own, 1]))]  # by document and position
                # starts of one document are compared by position, documents by id: a number that orders both
                doc, left = head[own, 1], head[own, 2]
                rank = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
                texts = [body[a : a + z] for a, z in zip(begin[own].tolist(), size[own].tolist(), strict=True)]
                owner, place = repeated_starts(texts, rank * (int(left.max()) + 2 * width + 1) + left, width)
                marks.append(np.stack([doc[owner], left[owner] + place]))
                if is_hot[own].any():
                    strings.append(_unmarked([texts[x] for x in np.flatnonzero(is_hot[own])], own, owner, place, is_hot[own] > 0, doc, left))
                    if sum(x.shape[1] for x in strings) > LOT:
                        yield strings_of(strings, marks)
                        strings = []
                k = m
            if sum(x.shape[1] for x in marks) > LOT:
                yield from spans_of(marks)
                marks = []
        if strings:
            yield strings_of(strings, marks)
        if marks:
            yield from spans_of(marks)

    def _unmarked(texts: list[bytes], own: np.ndarray, owner: np.ndarray, place: np.ndarray, chosen: np.ndarray, doc: np.ndarray, left: np.ndarray) -> np.ndarray:
        """(two hashes, document, start) of the strings of the chosen windows that no earlier one covers."""
        data = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts])
        many = size - width + 1
        who = np.repeat(np.flatnonzero(chosen), many)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(np.cumsum(size) - size, many) + at
        far = 1 << _SIZE
        free = ~np.isin(who * far + at, owner * far + place)
        who, at, begin = who[free], at[free], begin[free]
        one, two = RollingHash(data), RollingHash(data, 1)
        return np.stack([one.of(begin, begin + width), two.of(begin, begin + width), doc[who].view(np.uint64), (left[who] + at).view(np.uint64)])

    @lean
    def settle(batches: Batches) -> Batches:
        """Rows (row_id, spans): those that come, and those of strings of hot anchors that are not the first of their kind."""
        marks, size = [], 0
        for rows in by_first(batches):
            lots = []
            for batch in rows:
                ready = batch.filter(batch.column(2).is_valid())
                if len(ready):
                    yield pa.RecordBatch.from_arrays(ready.columns[1:3], names=["row_id", "spans"])
                lots += [_unpack(x, 4, 2) for x in batch.column(3) if x.is_valid]
            if lots:
                e, new = _first_of(np.concatenate(lots, axis=1), 2)
                marks.append(e[2:, ~new].view(np.int64))
                size += marks[-1].shape[1]
            if size > LOT:
                for batch in spans_of(marks):
                    yield pa.RecordBatch.from_arrays(batch.columns[1:3], names=["row_id", "spans"])
                marks, size = [], 0
        if size:
            for batch in spans_of(marks):
                yield pa.RecordBatch.from_arrays(batch.columns[1:3], names=["row_id", "spans"])

    rest = [c for c in docs.columns if c not in ("row_id", "text")]
    # the whole row goes along, so that the documents' exchange is the same here and below and runs once
    with_asked = docs.join(asked, "row_id").select("row_id", "text", "entries", *rest)
    windows = sorted_buckets(with_asked.mapInArrow(cut, "bucket int, head binary, body binary"))
    results = sorted_buckets(windows.mapInArrow(index, "bucket int, row_id long, spans binary, strings binary"))
    marked = results.mapInArrow(settle, "row_id long, spans binary").groupBy("row_id").agg(F.collect_list("spans").alias("spans"))
    joined = docs.join(asked, "row_id", "left").join(marked, "row_id", "left").select("row_id", "text", "entries", "spans", *rest)

    def merge(batches: Batches) -> Batches:
        for batch in batches:
            out = []
            for blobs, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                pairs = [np.frombuffer(s, np.int64).reshape(-1, 2) for s in spans or []]
                _, left, size, what = entries_of(blobs)
                own = what == _COVERED
                pairs.append(np.column_stack([left[own], left[own] + size[own]]))
                p = np.concatenate(pairs)
                if not len(p):
                    out.append(None)
                    continue
                p = p[np.argsort(p[:, 0], kind="stable")]
                top = np.maximum.accumulate(p[:, 1])
                heads = np.flatnonzero(np.concatenate([[True], p[1:, 0] > top[:-1]]))
                tails = np.concatenate([heads[1:], [len(p)]]) - 1
                out.append(np.column_stack([p[heads, 0], top[tails]]).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary()), *batch.columns[4:]], names=["row_id", "text", "spans", *rest])

    return joined.mapInArrow(lean(lambda batches: then(merge(batches))), schema)


def kept_bytes(raw: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, spans)."""
    if not spans:
        return raw, 0, 0
    p = np.frombuffer(spans, np.int64).reshape(-1, 2)
    out, at = [], 0
    for a, b in p.tolist():
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out), int((p[:, 1] - p[:, 0]).sum()), len(p)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """docs, all columns and rows, with the repeated bytes cut out of their texts; a character that a cut leaves in part goes too.

    Nulls, empty and very long texts and repeated ids are handled as dedup() does; a null text stays null.
    """
    others = [c for c in docs.columns if c != text_col]
    rest = F.struct(*[docs[c].alias(f"c{k}") for k, c in enumerate(others)]).alias("rest")
    base = docs.select(docs[id_col].cast("long").alias("row_id"), docs[text_col].alias("text"), rest)

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            texts = [None if t.as_buffer() is None else kept_bytes(bytes(t.as_buffer()), s)[0].decode(errors="ignore") for t, s in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column("rest")], names=["text", "rest"])

    out = _with_null_ids(base, cut, f"text string, rest {base.schema['rest'].dataType.simpleString()}", width, hot)
    back = {c: F.col(f"rest.c{k}") for k, c in enumerate(others)} | {text_col: F.col("text")}
    return out.select(*[back[c].alias(c) for c in docs.columns])


def _with_keys(known: DataFrame) -> DataFrame:
    """known with a row_id for each pair of id and text, in the order of ids and then of the texts' digests; the ids are in own_id."""
    known = known.withColumnRenamed("row_id", "own_id").withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    keys = known.select("own_id", "sha").distinct().orderBy("own_id", "sha").withColumn("row_id", F.monotonically_increasing_id())
    return small_join(known, materialize(keys, "suffix-keys"), ["own_id", "sha"], "inner").drop("sha")


def _with_null_ids(base: DataFrame, then: Callable[[Batches], Batches], schema: str, width: int, hot: int) -> DataFrame:
    """mark() for the rows with an id; those without keep all. Rows that repeat an id get keys of their own, their id is in own_id."""
    gram = max(4, min(GRAM, width // 4))
    known = base.where("row_id IS NOT NULL")
    if not known.groupBy("row_id").count().where("count > 1").isEmpty():
        known = _with_keys(known)
    others = [F.col(c) for c in base.columns if c not in ("row_id", "text")]
    without = base.where("row_id IS NULL").select("row_id", "text", F.lit(None).cast("binary").alias("spans"), *others)
    return mark(known, then, schema, width, gram, hot).unionByName(without.mapInArrow(lean(then), schema))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, hot: int = HOT) -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts shorter than width lose nothing; very long texts are read in overlapping pieces, with the same result. Ids must be integers: rows with a null id are left out of matching and keep all
    bytes. Rows that repeat an id with the same text are the same document (all keep and lose the same); with different texts they are documents of
    their own, in the order of the texts' SHA-256.
    """
    base = named(docs, row_id=id_col, text=text_col).select(F.col("row_id").cast("long").alias("row_id"), "text")

    def digest(batches: Batches) -> Batches:
        for batch in batches:
            n, removed, spans, sha = [], [], [], []
            for text, s in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                raw = bytes(text.as_buffer()) if text.as_buffer() else b""
                rest, r, k = kept_bytes(raw, s)
                n.append(len(raw))
                removed.append(r)
                spans.append(k)
                sha.append(hashlib.sha256(rest).hexdigest())
            key = batch.column("own_id" if "own_id" in batch.schema.names else "row_id")
            yield pa.RecordBatch.from_arrays([key, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string())], names=["row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_null_ids(base, digest, "row_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", width, hot).withColumnRenamed("row_id", id_col)
