"""Token counts by a linear longest-match automaton.

A vocabulary of byte strings becomes a trie. Each node has a failure link (the node reached after emitting the longest
vocabulary entries that cover its string and continuing with what is left) and the number of pieces popped on the way, both
computed once. Counting the pieces of a word is then one pass over its bytes: follow an edge, or fail, add the popped count
and try again. No piece is built, and every byte costs amortised constant time. Long words are run in parts side by side: each part
first from the root, then again from where the part before it really ends, until both runs are at the same node, from where on they agree.

Words are runs of bytes other than white space; they are cut greedily, longest entry first, from the left. Single
bytes are always entries, so every word can be cut. Of a byte-level vocabulary the entries with white space in them take no part, also those that
begin with the blank before a word: counts are those of greedy cutting of bare words and not of the vocabulary's own tokenizer.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Memory, bounded_batches, lean, named, slices, utf8, word_bounds

#: Words whose counts a worker remembers.
KEEP = 400_000


def byte_vocabulary(path: str) -> list[bytes]:
    """The entries of a byte-level vocabulary file (tokenizers JSON) as byte strings, without special tokens and without blanks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}
    model = json.load(open(path, encoding="utf-8"))
    special = {x["content"] for x in model.get("added_tokens", [])}
    entries = {bytes(of[c] for c in t) for t in model["model"]["vocab"] if t not in special and all(c in of for c in t)}
    return sorted(e for e in entries if e and not set(e) & {32, *range(9, 14)})


class LongestMatch:
    """The automaton: goto table, failure links and popped counts as numpy arrays."""

    def __init__(self, vocabulary: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        final, depth = [False], [0]
        for entry in [*(bytes([b]) for b in range(256)), *vocabulary]:
            node = 0
            for b in entry:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    final.append(False)
                    depth.append(depth[node] + 1)
                node = children[node][b]
            final[node] = True
        n = len(children)
        fail, pops = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        queue = deque([0])
        while queue:
            u = queue.popleft()
            for b, v in children[u].items():
                queue.append(v)
                if final[v]:
                    fail[v], pops[v] = 0, 1
                else:
                    z, popped = fail[u], pops[u]
                    while z >= 0 and b not in children[z]:
                        popped, z = popped + pops[z], fail[z]
                    if z >= 0:
                        fail[v], pops[v] = children[z][b], popped
        self.fail, self.pops, self.depth = fail, pops, np.array(depth, np.int32)
        # edges sorted by node and byte; the root has its own table as it has all bytes
        keys = np.array([u << 8 | b for u in range(n) for b in children[u]], np.int64)
        targets = np.array([v for u in range(n) for v in children[u].values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], targets[order]

    def step(self, nodes: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where there is no edge."""
        want = nodes.astype(np.int64) << 8 | bytes_
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.targets[at], -1)

    def _advance(self, node: np.ndarray, total: np.ndarray, todo: np.ndarray, bytes_: np.ndarray) -> None:
        """Move node[todo] on by a byte each, adding popped pieces to total."""
        b = bytes_
        while len(todo):
            nxt = self.step(node[todo], b)
            hit = nxt >= 0
            node[todo[hit]] = nxt[hit]
            todo, b = todo[~hit], b[~hit]
            total[todo] += self.pops[node[todo]]
            node[todo] = self.fail[node[todo]]

    def counts(self, words: list[bytes], part: int = 256) -> np.ndarray:
        """Pieces of each word: all parts of all words move on by one byte at a time."""
        lengths = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        parts = -(-lengths // part)
        word = np.repeat(np.arange(len(words)), parts)
        nth = np.arange(len(word)) - np.repeat(np.cumsum(parts) - parts, parts)
        begin = (np.cumsum(lengths) - lengths)[word] + nth * part
        sizes = np.minimum(part, lengths[word] - nth * part)
        node, total = np.zeros(len(word), np.int32), np.zeros(len(word), np.int64)
        later = np.flatnonzero(nth)  # parts that follow another one: their runs are kept
        nodes, totals = np.zeros((part if len(later) else 0, len(later)), np.int32), np.zeros((part if len(later) else 0, len(later)), np.int32)
        order = np.argsort(-sizes, kind="stable")
        falling = -sizes[order]
        for k in range(int(sizes.max(initial=0))):
            live = order[: np.searchsorted(falling, -k, "left")]  # parts longer than k
            self._advance(node, total, live, data[begin[live] + k])
            if len(later):
                nodes[k], totals[k] = node[later], total[later]
        if len(later):
            self._again(data, begin, sizes, later, node, total, nodes, totals)
        ends = np.cumsum(parts)[parts > 0] - 1
        while (rest := ends[node[ends] > 0]).size:  # what is left at the words' ends
            total[rest] += self.pops[node[rest]]
            node[rest] = self.fail[node[rest]]
        return np.bincount(word, total, len(words)).astype(np.int64)

    def _again(self, data: np.ndarray, begin: np.ndarray, sizes: np.ndarray, later: np.ndarray, node: np.ndarray, total: np.ndarray, nodes: np.ndarray, totals: np.ndarray) -> None:
        """Run the later parts from the nodes at which the parts before them end, and put their nodes and totals right."""
        own_total = total[later].copy()
        begun = np.zeros(len(later), np.int32)  # from the root at first
        while (k_of := np.flatnonzero(node[later - 1] != begun)).size:
            begun[k_of] = node[later[k_of] - 1]
            now, popped = begun.copy(), np.zeros(len(later), np.int64)
            live = k_of
            for k in range(int(sizes[later[k_of]].max())):
                over = sizes[later[live]] <= k  # at its end without having met the first run
                stop = live[over]
                node[later[stop]], total[later[stop]] = now[stop], popped[stop]
                live = live[~over]
                if not len(live):
                    break
                self._advance(now, popped, live, data[begin[later[live]] + k])
                met = now[live] == nodes[k, live]
                stop = live[met]
                size = sizes[later[stop]]
                node[later[stop]] = nodes[size - 1, stop]
                total[later[stop]] = own_total[stop] + popped[stop] - totals[k, stop]
                live = live[~met]
            node[later[live]], total[later[live]] = now[live], popped[live]


def count_tokens(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """n_words, n_tokens and n_bytes of every whole text; null and empty texts have 0 of each, repeated rows stay; very long texts and words are counted whole.

    The file is read on the driver; the automaton goes to the workers with the function (a few MB, fixed by the vocabulary).
    Each batch looks up only its distinct words, and a worker remembers the counts of KEEP words between batches.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = named(docs, row_id=id_col, text=text_col)
    kind = docs.schema["row_id"].dataType.simpleString()
    automaton = spark.sparkContext.broadcast(LongestMatch(byte_vocabulary(vocabulary_path)))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Memory(1, KEEP)
        machine = automaton.value
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for i, j in slices(offs, 1 << 20):
                part, o = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts, stops, per_doc = word_bounds(part, o)
                counts = np.zeros(len(starts) + 1, np.int64)
                if len(starts):
                    words = _words(part, starts, stops).dictionary_encode()
                    h, each, new = known.find(words.dictionary)
                    if len(new):
                        each[0, new] = machine.counts(words.dictionary.take(pa.array(new)).to_pylist())
                        known.add(h[:, new], each[:, new])
                    np.cumsum(each[0, words.indices.to_numpy()], out=counts[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(np.diff(per_doc)), pa.array(np.diff(counts[per_doc])), pa.array(np.diff(o))], names=["row_id", "n_words", "n_tokens", "n_bytes"]
                )

    return docs.mapInArrow(run, f"row_id {kind}, n_words long, n_tokens long, n_bytes long").withColumnRenamed("row_id", id_col)


def _words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The words as an Arrow binary array without a Python object for each."""
    sizes = stops - starts
    ends = np.cumsum(sizes)
    at = np.arange(ends[-1]) + np.repeat(starts - (ends - sizes), sizes)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])
