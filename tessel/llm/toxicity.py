"""Toxicity by a weighted finite-state pattern grammar over clauses.

Five small transducers read a clause's words as symbols (insult, threat, target, negation, report, other). INSULT and THREAT emit a hit for their
symbol, NEGATION and REPORT mark hits in the scope of a negation or behind reported speech, TARGET closes a clause that speaks of somebody. compose()
builds their product once: one table of states and symbols, with the marks that each arc and each final state emits. A clause is one walk through
that table. Each emitted arc (kind, negated, reported, with a target in the clause) has a weight; a hit costs its word's weight times the arc's, and a
clause with both a threat and an insult has a weight of its own. A document's score is a logistic function of the sum and number of its matched clauses
and of the text's length.

The symbols insult and threat come from a prefix automaton of weighted stems: a stem is a word's beginning, so inflected and compounded forms match; a
seed is a whole word or a stem marked with '*'. Stems, arc weights and logistic coefficients are learned from labelled rows, starting from the seeds.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Hashable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, lean, materialize, named

#: Labelled rows used for fitting, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: Lengths of the word beginnings that are tried as stems; whole words are tried whatever their length.
PREFIXES = range(3, 32)
#: What a stem's evidence (a log-likelihood ratio) and its log odds must be at least.
EVIDENCE, ODDS = 12.0, 1.8

INSULTS = "idiot* moron* stupid* loser* scum* trash pathetic* worthless* disgusting* clown* imbecile* dumbass* bastard* bitch* asshole* retard* vermin* parasite* degenerate* filth* cretin* lowlife* jerk jerks".split()
THREATS = "kill* murder* strangle* shoot stab* destroy* hurt beat burn hang* drown* slaughter* exterminate*".split()
TARGETS = frozenset("you your yours yourself u ur he him his she her they them their these those people everyone".split())
NEGATIONS = frozenset("not no never none neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot nicht kein keine pas jamais nunca".split())
REPORTS = frozenset("said says say wrote claimed claims called calls reported alleged quoted according allegedly".split())

_TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE_END = ".!?;\n"
#: Words that a negation, and reported speech, reach.
SCOPE = 3

# ---- transducers ----------------------------------------------------------------------------------------------------------------------

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = SYMBOLS = range(6)


@dataclass(frozen=True)
class Machine:
    """A transducer: the next state and the mark emitted for (state, symbol), and the mark of a state in which a clause ends. State 0 is the start."""

    next: Mapping[tuple[Hashable, int], Hashable]
    emits: Mapping[tuple[Hashable, int], str]
    final: Mapping[Hashable, str]


def seen(symbol: int, mark: str | None, final: str | None) -> Machine:
    """Whether a symbol has been read; emits mark for each one."""
    step = {(s, a): 1 if a == symbol else s for s in (0, 1) for a in SYMBOLS}
    return Machine(step, {(s, symbol): mark for s in (0, 1)} if mark else {}, {1: final} if final else {})


def within(symbol: int, scope: int, mark: str) -> Machine:
    """Marks hits among the next words behind a symbol; the state is the number of words still in its scope."""
    step = {(s, a): scope if a == symbol else max(0, s - 1) for s in range(scope + 1) for a in SYMBOLS}
    return Machine(step, {(s, a): mark for s in range(1, scope + 1) for a in (INSULT, THREAT)}, {})


MACHINES = (seen(INSULT, "insult", "insult"), seen(THREAT, "threat", "threat"), seen(TARGET, None, "target"), within(NEGATION, SCOPE, "negated"), within(REPORT, 2 * SCOPE, "reported"))


@dataclass(frozen=True)
class Composed:
    """The product of machines: next[state][symbol], arcs[state][symbol] and ends[state], the last two sets of marks."""

    next: list[list[int]]
    arcs: list[list[frozenset[str]]]
    ends: list[frozenset[str]]


def compose(machines: tuple[Machine, ...] = MACHINES) -> Composed:
    """All states that the machines reach together from their starts."""
    start = (0,) * len(machines)
    number, queue = {start: 0}, [start]
    out = Composed([], [], [])
    for state in queue:  # grows while it is walked
        row = []
        for a in SYMBOLS:
            to = tuple(m.next[s, a] for m, s in zip(machines, state, strict=True))
            if to not in number:
                number[to] = len(number)
                queue.append(to)
            row.append(number[to])
        out.next.append(row)
        out.arcs.append([frozenset(m.emits[s, a] for m, s in zip(machines, state, strict=True) if (s, a) in m.emits) for a in SYMBOLS])
        out.ends.append(frozenset(m.final[s] for m, s in zip(machines, state, strict=True) if s in m.final))
    return out


#: Weighted arcs: a hit of a kind, negated, reported, in a clause with a target; last a clause with hits of both kinds.
ARCS = [(kind, negated, reported, target) for target in (0, 1) for kind in ("insult", "threat") for negated in (0, 1) for reported in (0, 1)]
BOTH = len(ARCS)


def prior_weights() -> list[float]:
    """Half the weight under a negation or in reported speech, half as much again with a target; 1 for both kinds together."""
    return [0.5 ** (negated + reported) * (1.5 if target else 1.0) for _, negated, reported, target in ARCS] + [1.0]


@dataclass
class Grammar:
    """Weights of stems (True: whole word only), of the composed arcs, and the logistic's coefficients."""

    insults: dict[str, tuple[float, bool]]
    threats: dict[str, tuple[float, bool]]
    weights: list[float] = field(default_factory=prior_weights)
    coef: list[float] = field(default_factory=lambda: [-3.0, 3.0, 0.0, 0.0])

    @cached_property
    def machine(self) -> tuple[list[list[int]], list[list[int]], list[tuple[bool, bool]]]:
        """The composed table: next state, arc number without target (-1: none), and (target, both kinds) of each state a clause may end in."""
        c = compose()
        number = {(kind, "negated" in m, "reported" in m): ARCS.index((kind, int("negated" in m), int("reported" in m), 0)) for row in c.arcs for m in row for kind in m & {"insult", "threat"}}
        arcs = [[next((number[k, "negated" in m, "reported" in m] for k in m & {"insult", "threat"}), -1) for m in row] for row in c.arcs]
        return c.next, arcs, [("target" in m, {"insult", "threat"} <= m) for m in c.ends]

    def automaton(self):
        """Aho-Corasick automaton of the stems of both hit classes."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for kind, table in ((INSULT, self.insults), (THREAT, self.threats)):
            for stem, (weight, whole) in table.items():
                if stem not in a or a.get(stem)[1] < weight:
                    a.add_word(stem, (kind, weight, whole, len(stem)))
        if len(a):
            a.make_automaton()
        return a

    def matched(self, text: str, automaton) -> list[dict[int, float]]:
        """For each clause that has a hit, the sum of its hits' word weights by arc (and 1 for BOTH)."""
        low = text.lower()
        if not len(automaton):
            return []
        hits: dict[int, tuple[int, float]] = {}
        for end, (kind, weight, whole, n) in automaton.iter(low):
            start = end - n + 1
            if start and low[start - 1].isalpha() or whole and end + 1 < len(low) and low[end + 1].isalpha():
                continue
            if start not in hits or hits[start][1] < weight:
                hits[start] = (kind, weight)
        out = []
        places = sorted(hits)
        k = 0
        while k < len(places):
            left = max(low.rfind(c, 0, places[k]) for c in _CLAUSE_END) + 1
            right = min((x for x in (low.find(c, places[k]) for c in _CLAUSE_END) if x >= 0), default=len(low))
            own = [p for p in places[k:] if p < right]
            out.append(self.walk(low, left, right, {p: hits[p] for p in own}))
            k += len(own)
        return out

    def walk(self, low: str, left: int, right: int, hits: Mapping[int, tuple[int, float]]) -> dict[int, float]:
        """One clause through the composed table."""
        step, arcs, ends = self.machine
        state, sums = 0, {}
        for m in _TOKEN.finditer(low, left, right):
            symbol, weight = hits.get(m.start(), (None, 0.0))
            if symbol is None:
                w = m.group()
                symbol = TARGET if w in TARGETS else NEGATION if w in NEGATIONS else REPORT if w in REPORTS else OTHER
            elif (arc := arcs[state][symbol]) >= 0:
                sums[arc] = sums.get(arc, 0.0) + weight
            state = step[state][symbol]
        target, both = ends[state]
        if target:
            sums = {arc + BOTH // 2: x for arc, x in sums.items()}
        return sums | {BOTH: 1.0} if both else sums

    def clauses(self, text: str, automaton) -> list[float]:
        """The cost of each clause that has a hit."""
        return [sum(self.weights[arc] * x for arc, x in sums.items()) for sums in self.matched(text, automaton)]

    def features(self, text: str | None, automaton) -> list[float]:
        costs = self.clauses(text, automaton) if text else []
        return [1.0, math.log1p(sum(costs)), math.log1p(len(costs)), math.log1p(len(text or "") / 500)]

    def score(self, text: str | None, automaton) -> float:
        z = sum(c * f for c, f in zip(self.coef, self.features(text, automaton), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def _seed(words: list[str], weight: float) -> dict[str, tuple[float, bool]]:
    return {w.rstrip("*"): (weight, not w.endswith("*")) for w in words}


# ---- learning -------------------------------------------------------------------------------------------------------------------------


def held_out(id_col: str) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


_COUNTS = "stem string, t long, c long, before long, behind long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (toxic t, clean c) of each stem, and toxic ones in which a target stands within SCOPE words before, or behind, a word with it."""
    names = [x.split()[0] for x in _COUNTS.split(", ")]

    def stems(words: set[str]) -> set[str]:
        return {w[:n] for w in words for n in PREFIXES if n < len(w)} | words

    def rows() -> pa.RecordBatch:
        every = list(toxic | clean)
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([c[s] for s in every], pa.int64()) for c in (toxic, clean, before, behind)]], names=names)

    toxic, clean, before, behind = (Counter() for _ in range(4))
    texts = 0
    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1), strict=True):
            words = _TOKEN.findall((text.as_py() or "").lower())
            (toxic if label.as_py() else clean).update(stems(set(words)))
            if label.as_py():
                at = [k for k, w in enumerate(words) if w in TARGETS]
                before.update(stems({w for k in at for w in words[k + 1 : k + 1 + SCOPE]}))
                behind.update(stems({w for k in at for w in words[max(0, k - SCOPE) : k]}))
            texts += 1
            if texts % 200 == 0:
                yield rows()
                toxic, clean, before, behind = (Counter() for _ in range(4))
    yield rows()


def _evidence(toxic: int, clean: int, p: float) -> float:
    """The log-likelihood ratio of the labels of a stem's texts."""
    n = toxic + clean
    return sum(k * math.log(k / n / q) for k, q in ((toxic, p), (clean, 1 - p)) if k)


def _places(batches: Iterator[pa.RecordBatch], stems: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """The words around each word that begins with one of the stems."""
    sizes = sorted({len(s) for s in stems})
    for batch in batches:
        out = set()
        for text in batch.column(0):
            words = ["", *_TOKEN.findall((text.as_py() or "").lower()), ""]
            out |= {(w[:n], f"{words[k]} {words[k + 2]}") for k, w in enumerate(words[1:-1]) for n in sizes if n <= len(w) and w[:n] in stems}
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.string()), pa.array([x for _, x in out], pa.string())], names=["stem", "place"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS) -> Grammar:
    """Learn stems, arc weights and coefficients from at most train_rows labelled rows that are not held out.

    The labelled texts are joined out of docs once and stored; stems are counted over that table's partitions, and those much more frequent in toxic
    texts than chance allows come to the driver (each is in several of the bounded number of texts), then the arc sums of each training row. A
    learned stem is a threat where it belongs to a seeded one or where targets follow it far more often than they precede it, else an insult.
    Without labels of both kinds the seeds stand alone. Null and empty texts count as texts without a stem; of rows that repeat an id one counts,
    the first by text; very long texts are read whole; an empty table gives the seeds.
    """
    grammar = Grammar(_seed(INSULTS, 2.0), _seed(THREATS, 0.4))
    lab = named(labels, row_id=id_col, label=label_col).where(F.col("row_id").isNotNull() & F.col("label").isin(0, 1))
    lab = lab.groupBy("row_id").agg(F.max("label").cast("int").alias("label")).where(~held_out("row_id"))
    lab = lab.orderBy(F.xxhash64("row_id"), "row_id").limit(train_rows)
    picked = lab.collect()  # bounded by train_rows: two integers a row
    n_toxic = sum(r["label"] for r in picked)
    n_clean = len(picked) - n_toxic
    if not n_toxic or not n_clean:
        return grammar
    bounded_batches(docs.sparkSession)
    lab = F.broadcast(docs.sparkSession.createDataFrame([(r["row_id"], r["label"]) for r in picked], lab.schema))
    rows = named(docs, row_id=id_col, text=text_col).join(lab, "row_id").groupBy("row_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.first("label").alias("label"))
    rows = materialize(rows.select("text", "label"), "toxicity-rows")
    summed = [F.sum(c).alias(c) for c in ("t", "c", "before", "behind")]
    counts = materialize(rows.mapInArrow(lean(_counted), _COUNTS).groupBy("stem").agg(*summed), "toxicity-stems")
    # a stem's log odds, and how much likelier its labels are with a share of their own than with everybody's: chance must not do it among millions of stems
    p = n_toxic / len(picked)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("c") + 0.5) / (n_clean + 1.0))
    t, c = F.col("t"), F.col("c")
    share = lambda k, q: F.when(k > 0, k * F.log(k / (t + c) / q)).otherwise(0.0)
    found = counts.withColumn("odds", odds).where((share(t, p) + share(c, 1 - p) > EVIDENCE) & (F.col("odds") > ODDS)).collect()
    # copies of one toxic text repeat all its words: only places with other words around them count as evidence
    tried = frozenset(r["stem"] for r in found)
    places = rows.where("label = 1").mapInArrow(lean(lambda batches: _places(batches, tried)), "stem string, place string")
    places = {r["stem"]: r["n"] for r in places.groupBy("stem").agg(F.countDistinct("place").alias("n")).collect()}
    found = [r for r in found if _evidence(min(r["t"], places.get(r["stem"], 0)), r["c"], p) > EVIDENCE]
    texts = {r["stem"]: r["t"] for r in found}
    longer = {s[:n] for s, t in texts.items() for n in range(3, len(s)) if t >= 0.9 * texts.get(s[:n], math.inf)}
    kept: dict[str, tuple[int, int]] = {}
    for r in sorted(found, key=lambda r: (len(r["stem"]), r["stem"])):
        # of stems with the same texts the longest says most; beyond a kept shorter one a longer one needs as much evidence again
        s, toxic, clean = r["stem"], min(r["t"], places[r["stem"]]), r["c"]
        base = next((kept[s[:n]] for n in range(len(s) - 1, 2, -1) if s[:n] in kept), None)
        if s not in longer and (base is None or toxic * base[1] > clean * base[0] and _evidence(toxic, clean, base[0] / sum(base)) > EVIDENCE):
            kept[s] = (toxic, clean)
    threatening = [t.rstrip("*") for t in THREATS]
    for r in found:
        if (s := r["stem"]) in kept:
            threat = any(s.startswith(t) or t.startswith(s) for t in threatening) or r["behind"] > 3 + 2 * r["before"]
            (grammar.threats if threat else grammar.insults)[s] = (min(3.0, r["odds"] / 3), False)
    # seeds that labelled clean texts use as well lose weight
    seen_ = {r["stem"]: (r["t"], r["c"]) for r in counts.where(F.col("stem").isin([*grammar.insults, *grammar.threats])).collect()}
    for table in (grammar.insults, grammar.threats):
        for s, (w, whole) in list(table.items()):
            t, c = seen_.get(s, (0, 0))
            if c > 3 and s not in kept:
                table[s] = (w * max(0.02, min(1.0, (t / n_toxic) / (c / n_clean) / 20)), whole)
    lexicon = Grammar(grammar.insults, grammar.threats)

    @lean
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in batches:
            clauses = [lexicon.matched(t.as_py(), machine) for t in batch.column(0)]
            sums = [[sum(c.get(arc, 0.0) for c in x) for arc in range(BOTH + 1)] for x in clauses]
            sizes = [len(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.list_(pa.float64())), pa.array([len(x) for x in clauses], pa.int64()), pa.array(sizes, pa.int64()), batch.column(1)], names=["sums", "n", "size", "label"])

    got = rows.mapInArrow(measure, "sums array<double>, n long, size long, label int").toPandas()  # at most train_rows
    x = np.column_stack([np.array(got["sums"].tolist()).reshape(len(got), BOTH + 1), got[["n", "size", "label"]].to_numpy(float)])
    x = x[np.lexsort(x.T)]  # in an order that does not depend on partitions
    grammar.weights, grammar.coef = _fitted(x[:, : BOTH + 1], *x[:, BOTH + 1 :].T)
    return grammar


def _fitted(sums: np.ndarray, clauses: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Arc weights and coefficients that fit the labels best: Gauss-Newton steps, halved until the loss falls; weights are held near their prior.

    Neither weights nor the coefficients of clauses fall below zero; that of the text's length may.
    """
    prior = np.concatenate([np.zeros(4), prior_weights()])
    hold = np.concatenate([[1e-3, 1e-2, 1e-2, 1e-2], np.full(BOTH + 1, 5.0)])
    size = np.log1p(sizes / 500)
    free = np.isin(np.arange(len(prior)), (0, 3))

    def at(p: np.ndarray) -> tuple[np.ndarray, float]:
        """(logits, loss)"""
        z = p[0] + p[1] * np.log1p(sums @ p[4:]) + p[2] * np.log1p(clauses) + p[3] * size
        return z, float(np.logaddexp(0, z).sum() - y @ z + hold @ (p - prior) ** 2 / 2)

    p = np.concatenate([[-3.0, 3.0, 0.5, 0.0], prior_weights()])
    z, loss = at(p)
    for _ in range(200):
        s = sums @ p[4:]
        x = np.column_stack([np.ones(len(y)), np.log1p(s), np.log1p(clauses), size, p[1] * sums / (1 + s)[:, None]])
        q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(hold), x.T @ (y - q) - hold * (p - prior))
        for _ in range(30):
            new = np.where(free, p + step, np.maximum(p + step, 0.0))
            new_z, new_loss = at(new)
            if new_loss < loss:
                break
            step /= 2
        else:
            break
        fell, p, z, loss = loss - new_loss, new, new_z, new_loss
        if fell < 1e-9:
            break
    return [float(v) for v in p[4:]], [float(v) for v in p[:4]]


# ---- use ------------------------------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id_col, score, clauses (with a hit), predicted for every row; null and empty texts score as texts without a hit, repeated rows alike, very long texts whole."""
    bounded_batches(docs.sparkSession)
    docs = named(docs, row_id=id_col, text=text_col)
    kind = docs.schema["row_id"].dataType.simpleString()

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar.automaton()
        for batch in batches:
            f = [grammar.features(t.as_py(), machine) for t in batch.column(1)]
            z = np.array(f).reshape(len(f), len(grammar.coef)) @ np.array(grammar.coef)
            s = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array([round(math.expm1(x[2])) for x in f], pa.int32()), pa.array((s >= threshold).astype(np.int32))], names=["row_id", "score", "clauses", "predicted"])

    return docs.mapInArrow(run, f"row_id {kind}, score double, clauses int, predicted int").withColumnRenamed("row_id", id_col)


def without_toxic(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; no shuffle."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = grammar.automaton()
        for batch in batches:
            keep = [grammar.score(t.as_py(), machine) < threshold for t in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
