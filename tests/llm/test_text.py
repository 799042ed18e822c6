import hashlib
import random
import re
import struct
import zlib
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from tessel.llm import license_scan, mpeg_audio, packing, queries, token_count, toxicity

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


# ---- token counts --------------------------------------------------------------------------------------------------------------------


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if k == 1 or word[at : at + k] in vocabulary)
        n += 1
    return n


def test_automaton_agrees_with_greedy_cutting():
    rng = random.Random(0)
    vocabulary = {bytes(rng.choice(b"abc") for _ in range(rng.randrange(2, 7))) for _ in range(60)}
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randrange(0, 40))) for _ in range(500)] + [b"a" * 3000]
    got = token_count.LongestMatch(vocabulary).counts(words)
    assert got.tolist() == [greedy(w, vocabulary, 7) for w in words]


def test_long_words_are_counted_in_parts():
    """Parts give the whole word's count, also where runs never meet: (ab)* and (ba)* cut the same text at other places."""
    rng = random.Random(1)
    vocabulary = {b"ab", b"ba", b"abab", b"cc", b"ccc", b"abcabc", b"bca"}
    words = [b"ab" * 700, b"a" + b"ba" * 501, b"c" * 1001, b"abc" * 333, b"", b"x"] + [bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 900))) for _ in range(40)]
    machine = token_count.LongestMatch(vocabulary)
    want = [greedy(w, vocabulary, 7) for w in words]
    for part in (1, 2, 7, 64, 255, 10_000):
        assert machine.counts(words, part).tolist() == want, part
    assert machine.counts([]).tolist() == []


def test_token_counts(docs, corpus, no_docs):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    vocabulary = set(token_count.byte_vocabulary(path))
    longest = max(map(len, vocabulary))
    got = {r["doc_id"]: r for r in token_count.count_tokens(docs, path).collect()}
    for i, t, _ in corpus:
        words = WORD.findall((t or "").encode())
        assert (got[i]["n_words"], got[i]["n_bytes"]) == (len(words), len((t or "").encode()))
        if i < 100:
            assert got[i]["n_tokens"] == sum(greedy(w, vocabulary, longest) for w in words)
    assert token_count.count_tokens(no_docs, path).count() == 0
    assert token_count.count_tokens(docs.union(docs), path).count() == 2 * len(corpus)


# ---- packing -------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("lengths", [[], [0, 0], [1], [4096], [4095], [4097, 3], [10] * 30, [9000, 1, 1, 5000], [100_000], [700] * 200, list(range(1, 400, 3))])
def test_pack_group(lengths):
    rows = packing.pack_group(lengths)
    held = [np.zeros(n, int) for n in lengths]
    sequences = {}
    for d, start, length, seq, offset in rows:
        assert length > 0
        held[d][start : start + length] += 1
        sequences.setdefault(seq, []).append((offset, length))
    assert all((h == 1).all() for h in held)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding <= 0.05 * sum(lengths)


def test_differencing_is_near_equal():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 1000) for _ in range(600)]
    window = packing.differencing(sizes, 40)
    sums = np.bincount(window, sizes, 40)
    assert len(sums) == 40 and sums.max() - sums.min() <= 12
    assert packing.differencing([8, 7, 6, 5, 4], 2).tolist().count(0) in (2, 3)


def test_pack_agrees_with_tokenizer(docs, corpus, no_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    ids = {i: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for i, x, _ in corpus}
    held = {i: np.zeros(len(v), int) for i, v in ids.items()}
    rows = packing.pack(docs, lambda: packing.WordEncoder(path, 2)).collect()
    for r in rows:
        own = ids[r["doc_id"]]
        held[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(own), zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()))
    assert all((h == 1).all() for h in held.values())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pack(docs.repartition(3), lambda: packing.WordEncoder(path, 2)).collect()))
    assert packing.pack(no_docs, lambda: packing.WordEncoder(path, 2)).count() == 0
    twice = packing.pack(docs.union(docs), lambda: packing.WordEncoder(path, 2)).agg({"length": "sum"}).first()[0]
    assert twice == 2 * sum(map(len, ids.values()))


def test_word_encoder_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    texts = ["it's  A\u00a0b\u2003c<|endoftext|>d \x0b e\x0c\r\nf", "ΣΑΣ e\u0301 e\n\u0301", "", None, "1234 don't!!! 東京", "\x00 \x1f a\x85b"]
    e = packing.WordEncoder(path, None)
    for _ in range(2):
        ids, first = e(pa.array(texts))
        for k, x in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == t.encode(x or "", add_special_tokens=False).ids, x


# ---- MPEG audio ------------------------------------------------------------------------------------------------------------------------


def test_media_roundtrip(docs, corpus, no_docs):
    got = {r["doc_id"]: r for r in mpeg_audio.media(docs).collect()}
    for i, t, _ in corpus:
        raw = (t or "").encode()
        padded = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        assert r["frames"] == r["table_frames"] == len(r["seek_offsets"]) == len(padded) // 192 and r["crc_bad"] == 0 and r["skipped"] == 0
        assert all(r["media"][o : o + 2] == b"\xff\xfa" for o in r["seek_offsets"][:50])
        assert r["duration_num"] * 48000 == r["duration_den"] * 1152 * r["frames"]
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    assert mpeg_audio.media(no_docs).count() == 0 and "media" not in mpeg_audio.media(docs, keep_media=False).columns


def test_parse_damaged_streams():
    payload = bytes(range(256)) * 6
    good = mpeg_audio.encode(payload)
    p = mpeg_audio.parse(good)
    assert mpeg_audio.payload_of(good, p) == payload and p.tag == "id3v2.4" and p.table_bytes == len(good) - (p.table_at or 0)
    junk = b"\xff\xfa\x00junk\xff" + good[p.table_at :] + b"TAG" + bytes(125)
    q = mpeg_audio.parse(junk)
    assert mpeg_audio.payload_of(junk, q) == payload and q.tag == "id3v1" and q.skipped == 8
    bad = bytearray(good)
    bad[p.offsets[2] + 8] ^= 1
    assert mpeg_audio.parse(bytes(bad)).crc_bad == 1
    cut = good[: p.offsets[3]] + b"\x00" * 7 + good[p.offsets[3] :]
    r = mpeg_audio.parse(cut)
    assert len(r.offsets) == len(p.offsets) and r.skipped == 7
    short = mpeg_audio.parse(good[:-10])
    assert len(short.offsets) == len(p.offsets) - 1 and short.skipped == 230
    assert len(mpeg_audio.parse(b"").offsets) == 0 and mpeg_audio.parse(b"\xff" * 50).duration == (0, 1)
    with pytest.raises(ValueError):
        mpeg_audio.encode(b"")


def test_parse_resynchronises_after_every_gap():
    good = mpeg_audio.encode(bytes(k % 200 for k in range(192 * 6)))
    p = mpeg_audio.parse(good)
    lone = good[p.offsets[0] : p.offsets[0] + 4]
    for junk in (b"junk bytes" + lone + b"more junk here.", lone + b"junk behind a lone header", b"\xff" * 9 + lone + b"x" * 16):
        for k in (1, 3, 5):
            q = mpeg_audio.parse(good[: p.offsets[k]] + junk + good[p.offsets[k] :])
            assert (len(q.offsets), q.skipped, q.crc_bad, q.duration) == (6, len(junk), 0, p.duration)
            assert mpeg_audio.payload_of(good[: p.offsets[k]] + junk + good[p.offsets[k] :], q) == mpeg_audio.payload_of(good, p)
    # a frame that lost bytes goes, those behind it stay
    q = mpeg_audio.parse(good[: p.offsets[2] + 100] + good[p.offsets[3] :])
    assert len(q.offsets) == 5 and q.skipped == 100


def frames_of(h: bytes, n: int) -> bytes:
    size = mpeg_audio.header(h, (1, 2, 3))[0]
    return (h + bytes(size - 4)) * n


def test_parse_layers_rates_and_tables():
    one, two, three = b"\xff\xff\x90\xc0", b"\xff\xfd\x90\xc0", b"\xff\xfb\x94\xc0"
    assert mpeg_audio.header(one, (1, 2, 3)) == (312, 384, 44100, False, 0) and mpeg_audio.header(two, (1, 2, 3)) == (522, 1152, 44100, False, 0)
    for h, per, rate in ((one, 384, 44100), (two, 1152, 44100), (three, 1152, 48000), (b"\xff\xf5\x80\xc0", 1152, 22050), (b"\xff\xe3\x80\xc0", 576, 11025)):
        q = mpeg_audio.parse(frames_of(h, 7))
        assert len(q.offsets) == 7 and q.samples == {rate: 7 * per} and q.skipped == 0 and q.crc_checked == 0
    q = mpeg_audio.parse(frames_of(b"\xff\xfb\x90\xc0", 3) + frames_of(three, 5))
    assert q.duration == (Fraction(3 * 1152, 44100) + Fraction(5 * 1152, 48000)).as_integer_ratio()
    table = bytearray(frames_of(three, 1))
    table[36 : 36 + 26] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 0, 9000, 10, 3, 2, 2, 4)
    table[62:68] = struct.pack(">HHH", 100, 200, 300)
    q = mpeg_audio.parse(bytes(table) + frames_of(three, 10))
    assert (q.table_frames, q.table_bytes, q.table_at, len(q.offsets)) == (10, 9000, 0, 10) and q.seek_points == [0, 200, 600, 1200]
    p = mpeg_audio.parse(mpeg_audio.encode(bytes(192 * 50)))
    assert len(p.seek_points) == 100 and p.seek_points[0] == p.table_at and p.seek_points == sorted(p.seek_points) and p.seek_points[-1] < p.offsets[-1] + 240


def test_headers():
    assert mpeg_audio.header(b"\xff\xfb\x90\x00") == (417, 1152, 44100, False, 32)
    assert mpeg_audio.header(b"\xff\xfb\x92\x00")[0] == 418
    assert mpeg_audio.header(b"\xff\xf3\x80\xc0")[1:] == (576, 22050, False, 9)
    for h in (b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xfd\x90\x00", b"\xff\xeb\x90\x00", b"\xfe\xfb\x90\x00", b"\xff"):
        assert mpeg_audio.header(h) is None


# ---- licences ---------------------------------------------------------------------------------------------------------------------------


def test_license_scan(spark, docs, corpus, no_docs):
    mit = license_scan.KNOWN["MIT"]
    rows = [(0, mit, "MIT"), (1, "Copyright (c) 2020 Someone\n\n" + mit.replace("\n", "\n\n").upper(), "MIT"), (2, mit.replace("sublicense", "sub-licence").replace('"', "'"), "MIT"), (3, mit + " Really.", None),
            (4, "see " + mit, None), (5, None, None), (6, "", None), (7, "Released under the MIT Licence", "MIT-notice"), (7, "Released under the MIT Licence", "MIT-notice"), (8, "© 2021 X\n(c) Y\n", None)]
    got = license_scan.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["license"] or "") for r in got) == sorted((i, x or "") for i, _, x in rows)
    assert [r["digest"] is None for r in got if r["doc_id"] in (5, 6, 8)] == [True] * 3
    assert license_scan.scan(docs).where("license IS NOT NULL").count() == 0 and license_scan.scan(docs).count() == len(corpus) and license_scan.scan(no_docs).count() == 0
    table = spark.createDataFrame([("B", license_scan.digest("one")), ("A", license_scan.digest("ONE!")), ("C", None)], "license string, digest string")
    assert {r["doc_id"] for r in license_scan.scan(docs, table).where("license = 'A'").collect()} == {3, 4}


def test_license_scan_knows_whole_texts(spark):
    folder = Path(license_scan.__file__).parent / "licenses"
    texts = {p.stem: p.read_text() for p in sorted(folder.glob("*.txt"))}
    assert {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(texts)
    mit = license_scan.KNOWN["MIT"]
    bsd = texts["BSD-3-Clause"].replace("the copyright holder nor", "Foo, Inc. nor")
    rows = [(t, n.removesuffix(".regents")) for n, t in texts.items()] + [(" ".join(t.split()), n.removesuffix(".regents")) for n, t in texts.items()]
    rows += [(texts[n].split("END OF TERMS")[0], n) for n in ("Apache-2.0", "GPL-2.0", "GPL-3.0")]
    for mark in ("Copyright (c) 2020 X.", "Copyright 2019-2021 J. Doe and Foo, Inc.", "MIT License Copyright (c) 2020 Jane Doe", "The MIT License (MIT)\n\nCopyright (c) 2014, 2016 A. B. All rights reserved.", "© 2020 X"):
        rows += [(f"{mark} {mit}", "MIT"), (f"{mark} {' '.join(mit.split())}", "MIT"), (f"{mark}\n\n{mit}", "MIT"), (f"{mark} It is a novel. {mit}", None)]
    rows += [("BSD 3-Clause License\n\nCopyright (c) 2020, Foo, Inc.\nAll rights reserved.\n\n" + bsd, "BSD-3-Clause"), (bsd.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* "), "BSD-3-Clause")]
    rows += [(mit + "\nCopyright 2020 X. Another text stands here.", None), (texts["Apache-2.0"] + "\nReally.", None)]
    got = license_scan.scan(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["license"] for r in got} == {i: n for i, (_, n) in enumerate(rows)}


# ---- toxicity ----------------------------------------------------------------------------------------------------------------------------


def labelled(n, seed=0):
    rng = random.Random(seed)
    plain = "the of and to in is for with on as are be at by this or from an it that was".split()
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(plain) + rng.choice(["", "x", "yz", "er"]) for _ in range(rng.randrange(5, 200))]
        toxic = i % 8 == 0
        if toxic:
            for _ in range(rng.randrange(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "grubzol" + rng.choice(["en", "s", "ra"])]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark):
    rows, labels = labelled(2000)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    g = toxicity.fit(docs, lab)
    assert any(s.startswith("grub") or "grubzol".startswith(s) for s in g.insults)
    got = toxicity.score(docs, g).withColumn("h", toxicity.held_out("doc_id")).join(lab, "doc_id").where("h").collect()
    right = sum(r["predicted"] == r["toxic"] for r in got)
    assert right >= 0.98 * len(got) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert {r["doc_id"] for r in got} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    # held-out labels do not matter
    flipped = spark.createDataFrame([(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels], "doc_id long, toxic int")
    assert toxicity.fit(docs, flipped) == g
    kept = toxicity.without_toxic(docs, g)
    assert kept.schema == docs.schema and kept.count() == toxicity.score(docs, g).where("predicted = 0").count()


def test_grammar_composition():
    g = toxicity.Grammar(toxicity._seed(["idiot*"], 2.0), toxicity._seed(["kill*"], 1.0))
    a = g.automaton()
    cost = lambda t: sum(g.clauses(t, a))
    assert cost("An idiot.") == 2.0 and cost("an IDIOTS!") == 2.0 and cost("myidiot") == 0 and cost("") == 0
    assert cost("you idiot") == 3.0 and cost("you. idiot") == 2.0
    assert cost("not an idiot") == 1.0 and cost("not one two three idiot") == 2.0
    assert cost("she wrote idiot") < cost("she and idiot")
    assert cost("kill that idiot") == 4.0 and len(g.clauses("idiot. fine. idiot; kill", a)) == 3
    assert g.score(None, a) == g.score("fine", a) < g.score("idiot", a) < g.score("you idiot, kill", a)


def naive(g, text):
    """The grammar's clause costs again, by rules on lists of words instead of tables."""
    costs = []
    for clause in re.split(r"[.!?;\n]", text.lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        kinds, cost, hits = set(), 0.0, 0
        somebody = any(w in toxicity.TARGETS and not lookup(g, w)[0] for w in words)
        for k, w in enumerate(words):
            kind, weight = lookup(g, w)
            if not kind:
                continue
            negated = any(v in toxicity.NEGATIONS and not lookup(g, v)[0] for v in words[max(0, k - 3) : k])
            reported = any(v in toxicity.REPORTS and v not in toxicity.NEGATIONS | toxicity.TARGETS and not lookup(g, v)[0] for v in words[max(0, k - 6) : k])
            cost += weight * g.weights[toxicity.ARCS.index((kind, int(negated), int(reported), int(somebody)))]
            kinds.add(kind)
            hits += 1
        if hits:
            costs.append(cost + (g.weights[toxicity.BOTH] if len(kinds) == 2 else 0.0))
    return costs


def lookup(g, word):
    best = (None, 0.0)
    for kind, table in (("insult", g.insults), ("threat", g.threats)):
        for stem, (weight, whole) in table.items():
            if (word == stem if whole else word.startswith(stem)) and weight > best[1]:
                best = (kind, weight)
    return best


def test_composed_machine_agrees_with_rules():
    rng = random.Random(11)
    g = toxicity.Grammar(toxicity._seed(["idiot*", "clown", "foo*"], 2.0) | toxicity._seed(["id*"], 0.3), toxicity._seed(["kill*", "burn"], 1.1))
    g.weights = [round(rng.random() * 2, 3) for _ in g.weights]
    a = g.automaton()
    words = "idiot idiots clown clowns foolish kill killing burn burned you they not never said wrote the and don't isn't a . ; ! \n".split(" ")
    for _ in range(1500):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
        assert g.clauses(text, a) == pytest.approx(naive(g, text)), text
    c = toxicity.compose()
    assert len(c.next) == len(c.arcs) == len(c.ends) > 100 and all(0 <= n < len(c.next) for row in c.next for n in row)


def test_arc_weights_follow_the_labels(spark):
    """Negated insults that are clean in the labels end up cheaper than plain ones, and a verb aimed at people becomes a threat."""
    rng = random.Random(4)
    plain = "the of and to in is for with on as are be at by this or from an it that was".split()
    rows, labels = [], []
    for i in range(3000):
        w = [rng.choice(plain) for _ in range(rng.randrange(10, 60))]
        kind = i % 6
        if kind == 0:
            w[5:5] = ["idiot"]
        if kind == 1:
            w[5:5] = ["not", "an", "idiot"]
        if kind == 2:
            w[5:5] = ["grolk", "you"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(kind in (0, 2))))
    g = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    weight = dict(zip(toxicity.ARCS, g.weights, strict=False))
    assert weight["insult", 1, 0, 0] < 0.25 < 0.8 < weight["insult", 0, 0, 0]
    assert any("grolk".startswith(s) for s in g.threats) and not any("grolk".startswith(s) for s in g.insults)


def test_toxicity_odd_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    g = toxicity.fit(docs, none)
    got = toxicity.score(docs, g).collect()
    assert all(r["predicted"] == 0 for r in got) and len(got) == docs.count()
    assert toxicity.score(no_docs, g).count() == 0 and toxicity.without_toxic(docs, g).count() == docs.count()
    one = spark.createDataFrame([(3, 1), (4, 1), (None, 1), (5, None)], "doc_id long, toxic int")
    toxicity.fit(docs, one)
    toxicity.fit(no_docs, spark.createDataFrame([(k, k % 2) for k in range(9)], "doc_id long, toxic int"))
