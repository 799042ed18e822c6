import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from tessel.llm import near_dup, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sets_of(corpus, width):
    out = {}
    for i, t, _ in corpus:
        w = WORD.findall(lower(t))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def components(sets, percent=80):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("width", [4, 5])
def test_near_duplicates_agree_with_brute_force(docs, corpus, width):
    sets = sets_of(corpus, width)
    expected = components(sets)
    got = near_dup.near_duplicates(docs, width=width).collect()
    assert len(got) == len(corpus) and len(set(expected.values())) < len(expected) - 20
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), expected[r["doc_id"]], expected[r["doc_id"]] == r["doc_id"])


def test_links_without_a_shared_centre(spark):
    """Chains and variants of which the bucket's smallest document is no neighbour."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(300)]
    rows, i = [], 0
    for group in range(5):
        words = [f"g{group}{w}" for w in base]
        for step in range(12):
            for _ in range(2):
                at = rng.integers(0, 300)
                words[at] = f"n{group}-{step}-{at}"
            rows.append((i, " ".join(words), "s"))
            i += 1
    sets = sets_of(rows, 4)
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, s string"), width=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(sets)


def test_centre_of_many_unlinked_members(spark):
    """Texts of all sizes that share a passage, and with it buckets, but are no near-duplicates, among groups that are."""
    rng = np.random.default_rng(5)
    shared = [f"s{k}" for k in range(40)]
    rows = []
    for i in range(400):
        own = [f"d{i // 2 if i % 20 == 0 else i}-{k}" for k in range(int(rng.integers(5, 120)))]
        rows.append((i, " ".join(shared + own), "s"))
        if i % 25 == 0:
            rows.append((1000 + i, " ".join(shared + own + ["more"]), "s"))
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, s string"), width=4)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(sets_of(rows, 4))


def test_near_duplicates_of_repeated_ids_with_other_texts(spark):
    """An id with several texts is one document: the text with the smallest set stands for it, in whatever order rows come."""
    rows = [(5, "a b c d e f g h"), (5, "q r s t u"), (6, "q r s t u"), (7, "a b c d e f g h"), (5, None)]
    for k in range(3):
        got = near_dup.near_duplicates(spark.createDataFrame(rows[k:] + rows[:k], "doc_id long, text string").repartition(2), width=5)
        assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == [(5, 0, 5), (5, 1, 5), (5, 4, 5), (6, 1, 5), (7, 4, 7)]


def test_near_duplicates_odd_tables(spark, docs, no_docs):
    assert near_dup.near_duplicates(no_docs).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (None, None), (3, None)]
    got = sorted(map(tuple, near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (None, 2, None, True), (None, 0, None, True), (3, 0, 3, True)], key=str)
    with pytest.raises(ValueError):
        near_dup.near_duplicates(docs, percent=50)


def test_odd_sketch_estimates_differences():
    rng = np.random.default_rng(0)
    sets = np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    for share in (0.9, 0.8):
        other = np.sort(np.concatenate([sets[: int(2000 * share / (1 + share))], rng.integers(0, 2**63, 1000 - int(2000 * share / (1 + share)), dtype=np.uint64)]))
        samples, words = near_dup.signatures(np.concatenate([sets, other]), np.array([0, 1000, 2000]))
        differ = int((samples[0] != samples[1]).sum())
        xor = sum(int(x).bit_count() for x in (words[0] ^ words[1]).view(np.uint64))
        assert abs(near_dup.differing(xor) - differ) < 8 and xor <= near_dup.GATE and abs(differ - 128 * (1 - share)) < 20
    far, words = near_dup.signatures(rng.integers(0, 2**63, 2000, dtype=np.uint64), np.array([0, 1000, 2000]))
    assert sum(int(x).bit_count() for x in (words[0] ^ words[1]).view(np.uint64)) > near_dup.GATE


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(20, 60)] + [(5, 7), (7, 9), (9, 5), (3, 3), (100, 101), (101, 20)]
    got = {r["id"]: r["component"] for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys([*range(20, 61), 100, 101], 20), 5: 5, 7: 5, 9: 5}


def brute_spans(rows, width):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        mark = np.zeros(len(raw) + 1, int)
        for k in range(len(raw) - width + 1):
            s = raw[k : k + width]
            if s in seen:
                mark[k] += 1
                mark[k + width] -= 1
            seen.add(s)
        out[i] = np.cumsum(mark)[: len(raw)] > 0
    return out


@pytest.mark.parametrize("width", [100, 40])
def test_suffix_dedup_agrees_with_brute_force(docs, corpus, width):
    expected = brute_spans(corpus, width)
    got = suffix_dedup.dedup(docs, width=width).collect()
    assert len(got) == len(corpus) and sum(r["n_removed"] for r in got) > 5000
    texts = {i: (t or "").encode() for i, t, _ in corpus}
    for r in got:
        gone, raw = expected[r["doc_id"]], texts[r["doc_id"]]
        rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(raw), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()), r["doc_id"]


def test_suffix_dedup_of_hot_anchors(spark):
    """Windows dealt by document because an anchor is hot give the same as windows of one bucket."""
    rng = np.random.default_rng(6)
    make = lambda n: "".join(map(chr, rng.integers(97, 101, n)))
    passage = make(400)
    rows = [(k, make(rng.integers(0, 300)) + passage[rng.integers(0, 150) : 400 - rng.integers(0, 150)] + make(200)) for k in range(60)]
    expected = brute_spans(rows, 100)
    for hot in (1, 5, 2000):
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), hot=hot).collect()
        assert {r["doc_id"]: r["n_removed"] for r in got} == {i: int(m.sum()) for i, m in expected.items()}


def test_suffix_dedup_of_texts_longer_than_a_slice(spark):
    rng = np.random.default_rng(7)
    long = "".join(map(chr, rng.integers(97, 123, 3 * suffix_dedup.SLICE)))
    edge = suffix_dedup.SLICE
    rows = [(1, long), (2, "-" + long[edge - 150 : edge + 150] + "+" + long[-120:]), (3, long + long[:100])]
    got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["n_spans"]) for r in got) == [(1, 0, 0), (2, 420, 2), (3, len(long) + 100, 1)]


def test_without_repeats_keeps_rows_and_columns(docs, corpus):
    expected = brute_spans(corpus, 100)
    got = suffix_dedup.without_repeats(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    rows = {r["doc_id"]: r for r in got.collect()}
    for i, t, s in corpus:
        rest = None if t is None else np.frombuffer(t.encode(), np.uint8)[~expected[i]].tobytes().decode(errors="ignore")
        assert rows[i]["text"] == rest and rows[i]["source"] == s and rows[i]["row_id"] == 1


def test_suffix_dedup_odd_tables(spark, no_docs):
    assert suffix_dedup.dedup(no_docs).count() == 0
    t = "".join(chr(97 + k % 23) + chr(97 + k % 19) for k in range(150))
    got = suffix_dedup.dedup(spark.createDataFrame([(None, t), (7, t), (8, t), (9, "short")], "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in got) == [("7", 0), ("8", 300), ("9", 0), ("None", 0)]


def test_suffix_dedup_repeated_ids(spark):
    """Of rows with the same id and text each keeps what the document keeps; with different texts they are documents of their own."""
    from corpus_pipeline import suffix_stage

    rng = np.random.default_rng(8)
    shared, own, far = ("".join(map(chr, rng.integers(97, 123, n))) for n in (150, 250, 300))
    t, u = shared + own, own[:120] + "-" + shared + "+" + far
    for rows in ([(7, t), (7, t)], [(7, t), (7, u)], [(3, far), (7, t), (7, u), (7, t), (7, None), (7, ""), (8, u), (8, u), (None, t)]):
        texts = sorted({(i, x or "") for i, x in rows if i is not None}, key=lambda r: (r[0], hashlib.sha256(r[1].encode()).digest()))
        gone = brute_spans([(k, x) for k, (_, x) in enumerate(texts)], 100)
        rest = {r: np.frombuffer(r[1].encode(), np.uint8)[~gone[k]].tobytes().decode() for k, r in enumerate(texts)}
        rest[None, t] = t
        left = [rest[i, x or ""] for i, x in rows]
        got = suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["kept_sha256"]) for r in got) == sorted(
            (str(i), len(x or ""), len(x or "") - len(y), hashlib.sha256(y.encode()).hexdigest()) for (i, x), y in zip(rows, left, strict=True)
        )
        docs = spark.createDataFrame([(i, x, k, len(x or "")) for k, (i, x) in enumerate(rows)], "doc_id long, text string, k int, n_chars long")
        out = suffix_stage(spark, docs, "")
        assert out.schema == docs.schema
        assert sorted((r["k"], r["doc_id"], r["text"], r["n_chars"]) for r in out.collect()) == [(k, i, None if x is None else y, None if x is None else len(y)) for k, ((i, x), y) in enumerate(zip(rows, left, strict=True))]


def test_run_length_index_samples():
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (40, 60, 35)]
    texts += [texts[0], texts[1][:30] + texts[0][5:25], texts[1]]
    symbols = np.concatenate([np.concatenate([np.frombuffer(t, np.uint8).astype(np.int16) + 1, [0]]) for t in texts]).astype(np.int16)
    index = suffix_dedup.RunLengthIndex(symbols)
    length, source = index.matching_statistics()
    assert len(index.runs) < len(symbols)
    ends = np.flatnonzero(symbols == 0)
    suffix = lambda i: tuple(symbols[i : ends[np.searchsorted(ends, i)]]) + (-1000 + int(np.searchsorted(ends, i)),)
    order = sorted(range(len(symbols)), key=suffix)
    for before, i in zip(order, order[1:], strict=False):
        a, b = suffix(before)[:-1], suffix(i)[:-1]
        agree = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert (source[i], max(length[i], 0)) == (before, agree)


def test_repeated_starts_counts_every_copy():
    base = bytes(range(32, 200))
    owner, place = suffix_dedup.repeated_starts([base, base[10:], base], np.array([0, 1000, 2000]), 100)
    got = defaultdict(set)
    for o, p in zip(owner.tolist(), place.tolist(), strict=True):
        got[o].add(p)
    assert got == {1: set(range(59)), 2: set(range(69))}
