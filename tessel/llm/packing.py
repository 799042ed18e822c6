"""Packing: Karmarkar-Karp multiway differencing of token pieces into near-equal windows.

Documents are tokenised once and dealt to groups by their ids and texts, so neither a repeated id nor a missing one gathers rows.
A document's full windows (4096 ids) are sequences of their own; what is left of it is cut into pieces of at most PIECE ids. Of a group's T ids
n = floor(T / 4096) windows take all but SLACK ids for each window, and what is beyond them goes to sequences whose lengths are powers of two, which take
no padding. Every piece starts as a partition of n sums (one piece, else empty), and the two partitions with the largest spread are merged again and
again, the largest sums of one meeting the smallest of the other. If a window comes out over capacity, pieces are halved, and where they are as
small as FINEST the number of windows rises by one, until none is. Neighbouring pieces of a document that meet in one window are joined again.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Memory, bounded_batches, lean, named, slices, utf8

CAPACITY = 4096
PIECE, FINEST = 1024, 16
#: Ids that a window is left short of its capacity, for sums that differ.
SLACK = 32
GROUP_DOCS = 256


def differencing(sizes: list[int], windows: int) -> np.ndarray:
    """The window of each size, by Karmarkar-Karp multiway differencing."""
    if windows <= 1 or not sizes:
        return np.zeros(len(sizes), np.int64)
    # a partition is kept without its smallest sum; its slots are groups in a union-find over pieces
    parent = list(range(len(sizes)))
    heap = []
    for k, s in sorted(enumerate(sizes), key=lambda x: (-x[1], x[0])):
        heap.append((-s, k, [(s, k)]))  # (negative spread, tie, sums in falling order with a piece of each; the rest is empty)
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        free = windows - len(a)
        merged = []
        # the smallest slots of a take the largest of b: first a's empty slots, then its sums from the smallest on
        take = len(b) - free
        if take <= 0:
            merged = a + b
        else:
            merged = a[: len(a) - take] + b[:free]
            for (s, x), (t, y) in zip(reversed(a[len(a) - take :]), b[free:], strict=True):
                parent[y] = x
                merged.append((s + t, x))
        merged.sort(key=lambda e: (-e[0], e[1]))
        if len(merged) == windows and (low := merged[-1][0]) > 0:
            merged = [(s - low, x) for s, x in merged]
        spread = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-spread, tie, merged))
        tie += 1
    root = list(range(len(sizes)))
    for k in range(len(sizes)):
        x = k
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        root[k] = x
    _, out = np.unique(np.array(root), return_inverse=True)
    return out.astype(np.int64)


def pack_group(lengths: list[int], capacity: int = CAPACITY, piece: int = PIECE, slack: int = SLACK) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of the documents of one group, in a fixed order.

    Zero lengths give no piece. Every id is in exactly one piece; sequences are gapless from offset 0.
    """
    out, seq = [], 0
    rest: list[tuple[int, int, int]] = []
    for d, n in enumerate(lengths):
        whole = n // capacity * capacity
        for at in range(0, whole, capacity):
            out.append((d, at, capacity, seq, 0))
            seq += 1
        if n > whole:
            rest.append((d, whole, n - whole))
    total = sum(n for _, _, n in rest)
    windows = total // capacity
    spare = total - windows * max(0, capacity - slack)
    while spare:  # sequences of a power of two each
        room = min(1 << spare.bit_length() - 1, 1 << capacity.bit_length() - 1)
        spare -= room
        offset = 0
        while room:
            d, at, n = rest.pop()
            take = min(n, room)
            out.append((d, at, take, seq, offset))
            offset, room = offset + take, room - take
            if take < n:
                rest.append((d, at + take, n - take))
        seq += 1
    while rest:
        cut = []
        for d, at, n in rest:
            parts = -(-n // piece)
            edges = [at + n * k // parts for k in range(parts + 1)]
            cut += [(d, a, b - a) for a, b in zip(edges, edges[1:], strict=False)]
        window = differencing([n for _, _, n in cut], windows)
        if np.bincount(window, [n for _, _, n in cut], windows).max() <= capacity:
            break
        if piece > FINEST:  # too coarse to be balanced: cut finer
            piece = max(FINEST, piece // 2)
        else:
            windows += 1
    filled: dict[int, int] = {}
    last: dict[int, tuple[int, int, int, int, int]] = {}
    for (d, at, n), w in zip(cut, window.tolist(), strict=True) if rest else ():
        o = filled.get(w, 0)
        filled[w] = o + n
        p = last.get(w)
        if p and p[0] == d and p[1] + p[2] == at:
            last[w] = (d, p[1], p[2] + n, p[3], p[4])
        else:
            if p:
                out.append(p)
            last[w] = (d, at, n, seq + w, o)
    return out + list(last.values())


PIECES = "length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, encoder: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]], id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, piece: int = PIECE, group_docs: int = GROUP_DOCS) -> DataFrame:
    """id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece.

    encoder() makes, on a worker, a function from an Arrow string array (null: empty) to all ids (uint32) and each
    text's first id position. A document of no tokens has no piece; rows that repeat a doc_id, and rows whose id is null, are packed each by itself;
    a very long text is tokenised whole and fills windows of its own. Only rows that agree in both id and text share a group for certain.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    groups = max(1, -(-docs.count() // group_docs))
    docs = named(docs, row_id=id_col, text=text_col).withColumn("grp", F.pmod(F.xxhash64("row_id", "text"), F.lit(groups)).cast("int"))
    kind = docs.schema["row_id"].dataType.simpleString()

    @lean
    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        for batch in batches:
            text = batch.column(1)
            _, offs = utf8(text)
            for i, j in slices(offs, 1 << 21):
                ids, first = encode(text.slice(i, j - i))
                data = np.ascontiguousarray(ids, np.uint32)
                blob = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((first * 4).astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), blob], names=["row_id", "grp", "ids"])

    def packed(table: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("ids")]
        names = table.column("row_id").to_pylist()
        order = sorted(range(len(ids)), key=lambda k: (names[k] is None, names[k] or 0, zlib.crc32(ids[k]), len(ids[k])))
        group = table.column("grp")[0].as_py()
        sizes = np.array([len(x) for x in ids], np.int64)
        at = np.array(order, np.int64)
        doc, start, length, seq, offset = np.array(pack_group(sizes[at].tolist(), capacity, piece), np.int64).reshape(-1, 5).T
        doc = at[doc]
        raw = [memoryview(x).cast("B") for x in ids]
        crc = [zlib.crc32(raw[d][a:b]) for d, a, b in zip(doc.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)]
        columns = [table.column("row_id").combine_chunks().take(pa.array(doc)), *map(pa.array, (start, length, np.array(crc, np.int64), sizes[doc], (group << 32) + seq, offset))]
        return pa.table(columns, names=["row_id", "start", *[c.split()[0] for c in PIECES.split(", ")]])

    coded = docs.mapInArrow(tokens, f"row_id {kind}, grp int, ids binary")
    return coded.groupBy("grp").applyInArrow(packed, f"row_id {kind}, start long, {PIECES}").withColumnRenamed("row_id", id_col)


_GAP, _LETTER, _DIGIT, _SIGN, _WIDE, _QUOTE = range(6)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[32, 9, 10]] = _GAP
_KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[128:] = _WIDE
_KIND[39] = _QUOTE
#: The sign that byte-level vocabularies write for a byte: bytes without a visible one take the signs from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
_BYTE_SIGNS = {b: chr(256 + k) for k, b in enumerate(_HIDDEN)}


class WordEncoder:
    """Ids of texts by a tokenizers file, with a last id after each, reusing the ids of pieces met before.

    For tokenizers that lower-case, drop white space and split at changes between letters, single digits and other signs, such as
    word_bpe_49k.json. Texts are cut where no token can cross: at blanks, tabs and line feeds, and inside ASCII between letters, digits and signs,
    but not at an apostrophe or a wide character, nor in a word with the beginning of a special token. Only new pieces go to the tokenizer: words of small
    Latin letters to its model, others joined by a sign that none of them has. At most KEEP pieces met before are remembered.
    """

    KEEP = 400_000

    def __init__(self, path: str, last: int | None = 2):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = last
        self.known = Memory(2, self.KEEP)  # of each piece: where its ids begin in flat, and their number
        self.flat = np.empty(0, np.uint32)
        self.plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
        self.joint = self.tokenizer.encode("\x01", add_special_tokens=False).ids

    def _encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (uint32) of each piece as bytes."""
        for _ in range(len(self.joint) == 1):
            text = b" \x01 ".join(pieces)
            if text.count(b"\x01") != len(pieces) - 1:
                break
            ids = np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(ids == self.joint[0])
            if len(cuts) != len(pieces) - 1:
                break
            raw = ids.tobytes()
            begin, end = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
            return [raw[a:b] for a, b in zip(begin, end, strict=True)]
        return [np.array(e.ids, np.uint32).tobytes() for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def _new(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, by the tokenizer."""
        # small Latin letters alone are one word of the tokenizer and go to its model at once
        tokenize, plain = self.tokenizer.model.tokenize, self.plain.fullmatch
        out: list[bytes] = []
        mixed = []
        for k, p in enumerate(pieces):
            if plain(p):
                sign = p.decode() if p.isascii() else p.decode("latin-1").translate(_BYTE_SIGNS)
                out.append(array("I", [t.id for t in tokenize(sign)]).tobytes())
            else:
                mixed.append(k)
                out.append(b"")
        for at in range(0, len(mixed), 20_000):
            part = mixed[at : at + 20_000]
            for k, v in zip(part, self._encode([pieces[k] for k in part]), strict=True):
                out[k] = v
        return out

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, their number for each piece)."""
        h, (begin, size), new = self.known.find(pieces)
        left = None
        if len(new):
            ids = self._new(pieces.take(pa.array(new)).to_pylist())
            size[new] = [len(v) // 4 for v in ids]
            begin[new] = len(self.flat) + np.cumsum(size[new]) - size[new]
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), np.uint32)])
            left = self.known.add(h[:, new], np.stack([begin[new], size[new]]))
        flat = _ranges(self.flat, begin, size)
        if left is not None:
            own = self.known.values
            self.flat = _ranges(self.flat, own[0], own[1])
            own[0] = np.cumsum(own[1]) - own[1]
        return flat, size

    def __call__(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each text's first position and the end)."""
        from .token_count import _words

        data, offs = utf8(text)
        starts, stops, data, per_doc = _pieces(data, offs)
        words = _words(data, starts, stops).dictionary_encode()
        ids, size = self._ids(words.dictionary)
        at = words.indices.to_numpy()
        if self.last is not None:  # one more word, that closes each text
            at = np.insert(at, per_doc[1:], np.int32(len(size)))
            ids, size = np.append(ids, np.uint32(self.last)), np.append(size, 1)
            per_doc = per_doc + np.arange(len(per_doc))
        lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(ids)).take(pa.array(at))
        return lists.values.to_numpy(), lists.offsets.to_numpy()[per_doc]


def _ranges(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The ranges of flat, one behind another."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop) of the pieces that no token crosses, the bytes with A-Z lower-cased, and the number of pieces before each text."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), data, np.zeros(len(offsets), np.int64)
    low = LOWER[data]
    kind = _KIND[low]
    special = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # the beginning of a special token: its word stays as it is
    if len(special):
        gaps = np.flatnonzero(kind == _GAP)
        left = np.concatenate([[0], gaps + 1])[np.searchsorted(gaps, special)]
        right = np.concatenate([gaps, [n]])[np.searchsorted(gaps, special)]
        for a, b in zip(left.tolist(), right.tolist(), strict=True):
            low[a:b] = data[a:b]
            kind[a:b] = _WIDE
    cut = np.empty(n + 1, bool)
    cut[0] = cut[n] = True
    a, b = kind[:-1], kind[1:]
    cut[1:n] = ((a != b) | (a == _DIGIT)) & (a < _WIDE) & (b < _WIDE) | (a == _GAP) | (b == _GAP)
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, stops = edges[:-1], edges[1:]
    real = kind[starts] != _GAP
    starts, stops = starts[real], stops[real]
    return starts, stops, low, np.searchsorted(starts, offsets)
