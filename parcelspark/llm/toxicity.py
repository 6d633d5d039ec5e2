"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, modal, target, negation, report, other. Sequential transducers over symbols
mark insults and threats that are negated or reported, and note whether a target was named; they are composed
into one machine, which reads clauses and adds up the weights of what it writes: a negated or reported insult or threat
writes a small part of a plain one's weight, so no fit can turn a mark's sense. A document's score is logistic in what its
matched clauses write, with weights that are never below zero.

The insult lexicon (words and word beginnings) and the weights of the sums are learned from labelled rows; the small word
lists of the other symbols are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import DOCUMENT_COLUMNS, remainder, sliced, table
from .labelled import MOST_LABELLED, labelled_sample

INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER = "I", "T", "M", "P", "N", "R", "O"
#: Function words of the grammar in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy murder shoot stab strangle smash töten umbringen erschießen verprügeln tuer frapper détruire matar golpear destruir".split(),
    MODAL: "will shall gonna must werde wirst werden vais vas voy vamos".split(),
    TARGET: "you your yours yourself u he him she her they them du dich dir dein deine euch ihr tu te toi ton ta vous votre usted ustedes tú ti vosotros".split(),
    NEGATION: "not never no without nicht kein keine keinen nie niemals pas jamais aucun sans nunca jamás sin ningún".split(),
    REPORT: "said says called quoted wrote claimed according sagte sagt nannte schrieb laut dit disait écrit selon dijo dice llamó escribió según".split(),
}
KINDS = ("insult", "insult_negated", "insult_reported", "threat", "threat_negated", "threat_reported", "targeted")
#: What is left of an insult's or threat's weight where it is negated or reported.
NEGATED, REPORTED = 0.2, 0.1
#: What a score is made of, with the prior means of their weights; data moves them. The best clause's insults, threats and
#: target; the sums of insults and threats over all clauses; the text's length; and the insults in ten words.
PRIOR = {"bias": -4.0, "insult": 3.0, "threat": 4.5, "targeted": 1.0, "insults": 1.0, "threats": 1.0, "length": 0.0, "share": 0.5}
#: The common prior variance; the most that one clause counts for a kind; the most of the share of insults.
VARIANCE, MOST_IN_CLAUSE, MOST_SHARE = 4.0, 4.0, 3.0
BEGINNINGS = (4, 5, 6)
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]")
LETTERS = re.compile(r"[^\W\d_]{2,}")
#: What ends a clause; a text without any is one clause.
CLAUSE_ENDS = ".!?;:\n"
CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass
class Transducer:
    """Sequential: a state and a symbol give the next state and the symbol written."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol))


def compose(first: Transducer, second: Transducer, symbols: tuple[str, ...]) -> Transducer:
    """The transducer that reads what `first` reads and writes what `second` makes of its output."""
    out = Transducer((first.start, second.start))
    todo, seen = [out.start], {out.start}
    while todo:
        a, b = state = todo.pop()
        for s in symbols:
            a2, middle = first.step(a, s)
            b2, written = second.step(b, middle)
            out.arcs[state, s] = ((a2, b2), written)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


def negation(span: int = 3) -> Transducer:
    """Marks an insult or threat within `span` symbols after a negation."""
    t = Transducer(0)
    for left in range(span + 1):
        for s in (INSULT, THREAT, MODAL, TARGET, REPORT, OTHER):
            t.arcs[left, s] = (max(left - 1, 0), s + "-" if left and s in (INSULT, THREAT) else s)
        t.arcs[left, NEGATION] = (span, NEGATION)
    return t


def reported() -> Transducer:
    """Marks an insult or threat after a verb of saying or a quotation mark in the clause; such a mark wins over negation."""
    t = Transducer(False)
    for s in (INSULT, THREAT):
        for mark in ("", "-"):
            t.arcs[True, s + mark] = (True, s + '"')
    t.arcs[False, REPORT] = (True, REPORT)
    return t


def threatening() -> Transducer:
    """A verb of harm is a threat where a modal came before it; else it is just a word."""
    t = Transducer(False)
    t.arcs[False, MODAL] = (True, MODAL)
    for mark in ("", "-", '"'):
        t.arcs[False, THREAT + mark] = (False, OTHER)
    return t


def targeted() -> Transducer:
    """Remembers whether a target was named anywhere in the clause."""
    return Transducer(False, {(False, TARGET): (True, TARGET)})


def grammar() -> Transducer:
    symbols = (INSULT, THREAT, MODAL, TARGET, NEGATION, REPORT, OTHER)
    machine = compose(negation(), reported(), symbols)
    machine = compose(machine, threatening(), symbols)
    return compose(machine, targeted(), symbols)


WRITTEN = {INSULT: 0, INSULT + "-": 1, INSULT + '"': 2, THREAT: 3, THREAT + "-": 4, THREAT + '"': 5}


class Model:
    """What scoring needs: lexicon {word or beginning*: log-odds}, bias and clause weights. Small: bounded by the fit's sample."""

    def __init__(self, lexicon: dict[str, float], weights: tuple[float, ...] = tuple(PRIOR.values())):
        self.lexicon, self.weights = lexicon, tuple(weights)
        self._ready = None

    def __getstate__(self):
        return {"lexicon": self.lexicon, "weights": self.weights, "_ready": None}

    def prepare(self):
        if self._ready is None:
            import ahocorasick

            seeds = ahocorasick.Automaton()
            for x in {*(k.rstrip("*") for k in self.lexicon), *WORDS[THREAT]}:
                seeds.add_word(x, x)
            if len(seeds):
                seeds.make_automaton()
            fixed = {w: s for s, words in WORDS.items() for w in words}
            self._ready = (seeds if len(seeds) else None, fixed, grammar())
        return self._ready

    def symbol(self, word: str, fixed: dict[str, str]) -> tuple[str, float]:
        best = self.lexicon.get(word, 0.0)
        for n in BEGINNINGS:
            if len(word) >= n:
                best = max(best, self.lexicon.get(word[:n] + "*", 0.0))
        if best > 0:
            return INSULT, best
        if word in fixed:
            return fixed[word], 0.0
        if word.endswith(("n't", "n’t")):
            return NEGATION, 0.0
        return (REPORT, 0.0) if word in '"“”«»' else (OTHER, 0.0)

    def clauses(self, text: str) -> list[tuple[int, int, list[float]]]:
        """Start, end, and a value for each of KINDS of each clause that the grammar matches."""
        seeds, fixed, machine = self.prepare()
        low = text.lower()
        if len(low) != len(text):  # keep positions
            low = "".join(c if len(c.lower()) > 1 else c.lower() for c in text)
        out, last = [], -1
        for at in sorted({e - len(x) + 1 for e, x in seeds.iter(low)}) if seeds else ():
            if at < last:
                continue
            start = max(last, *(low.rfind(c, max(last, 0), at) + 1 for c in CLAUSE_ENDS))
            stop = CLAUSE_END.search(low, at)
            last = end = stop.start() if stop else len(low)
            state, values = machine.start, [0.0] * len(KINDS)
            for m in TOKEN.finditer(low, start, end):
                symbol, weight = self.symbol(m[0], fixed)
                state, written = machine.arcs[state, symbol]
                if written in WRITTEN:
                    values[WRITTEN[written]] += weight / 3 if symbol == INSULT else 1.0
            if any(values):
                values = [min(v, MOST_IN_CLAUSE) for v in values]
                values[-1] = max(values[0], values[3]) if state[1] else 0.0
                out.append((start, end, values))
        return out

    def features(self, text: str, found: list | None = None) -> list[float]:
        """The values that PRIOR names, but the bias: all but the length come from matched clauses."""
        found = self.clauses(text) if found is None else found
        words = text.count(" ") + 1
        insults = [v[0] + NEGATED * v[1] + REPORTED * v[2] for _, _, v in found]
        threats = [v[3] + NEGATED * v[4] + REPORTED * v[5] for _, _, v in found]
        targets = [v[6] for _, _, v in found]
        best = [max(x, default=0.0) for x in (insults, threats, targets)]
        return [*best, math.log1p(sum(insults)), math.log1p(sum(threats)), math.log(words) / 5, min(10 * sum(insults) / words, MOST_SHARE)]

    def score(self, features: list[float]) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], features))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _lexicon(sample: DataFrame, least: int = 3, odds: float = 1.5) -> dict[str, float]:
    """Words and word beginnings whose documents are toxic far more often than chance allows, with their log-odds."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for b in sliced(batches):
            for text, label in zip(b["text"].to_pylist(), b["label"].to_pylist(), strict=True):
                words = set(LETTERS.findall(text.lower()))
                words |= {w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n}
                (toxic if label > 0 else clean).update(words)
        keys = list(toxic.keys() | clean.keys())
        for at in range(0, len(keys), 50_000):
            part = keys[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([toxic[k] for k in part], pa.int64()), pa.array([clean[k] for k in part], pa.int64())], ["feature", "toxic", "clean"])

    sums = sample.mapInArrow(counts, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    some = sums.where(F.col("toxic") >= least).persist()  # read twice: how many were tested, and which hold
    share = sample.agg(F.avg("label"), F.count("*")).first()
    p = share[0] or 0.0
    if not 0 < p < 1:
        return {}
    t, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    # log-likelihood ratio against the share of toxic documents
    ratio = 2 * (t * F.log(t / n / p) + F.when(n > t, (n - t) * F.log((n - t) / n / (1 - p))).otherwise(0.0))
    tested = some.count()
    rows = some.where((F.log((t + 0.5) / (n - t + 0.5)) - math.log(p / (1 - p)) >= odds) & (ratio >= 2 * math.log(max(tested, 1)) + 2)).select("feature", (F.log((t + 0.5) / (n - t + 0.5)) - math.log(p / (1 - p))).alias("weight")).collect()  # bounded by the sample
    some.unpersist()
    return {r["feature"]: r["weight"] for r in rows}


def _weights(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic weights by projected Newton steps under the Gaussian prior; those of clauses are zero or more."""
    a = np.hstack([np.ones((len(x), 1)), x])
    m = np.asarray([*PRIOR.values()])
    least = np.asarray([0.0 if k not in ("bias", "length") else -np.inf for k in PRIOR])
    w = m.copy()

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + ((w - m) ** 2).sum() / (2 * VARIANCE))

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (y - p) - (w - m) / VARIANCE  # uphill
        h = (a * (p * (1 - p))[:, None]).T @ a + np.eye(len(m)) / VARIANCE
        free = (w > least) | (g > 0)
        d = np.zeros(len(w))
        d[free] = np.linalg.solve(h[np.ix_(free, free)], g[free])
        now, part = loss(w), 1.0
        while part > 1e-6 and loss(np.maximum(w + part * d, least)) > now - 1e-4 * (g @ (np.maximum(w + part * d, least) - w)):
            part /= 2
        before, w = w, np.maximum(w + part * d, least)
        if np.abs(w - before).max() < 1e-8:
            break
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model from at most about `most` labelled rows. Without toxic and clean labels the lexicon is empty and the prior weights hold."""
    sample = labelled_sample(docs, labels, "toxic", most).persist()
    model = Model(_lexicon(sample))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [model.features(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), b["label"]], ["x", "y"])

    rows = sample.mapInArrow(features, "x array<double>, y double").collect()  # a few numbers for each sampled row
    sample.unpersist()
    if rows:
        model.weights = _weights(np.asarray([r[0] for r in rows], float), np.asarray([r[1] for r in rows]))
    return model


SCORED = "doc_id long, score double, clauses array<struct<start:int,end:int,kinds:array<double>>>"


def score(docs: DataFrame, model: Model, with_clauses: bool = True) -> DataFrame:
    """doc_id, score, clauses: score in 0..1, clauses the matched spans with a value for each of KINDS.

    Empty and null texts have no clauses and the score of the bias alone. Repeated rows are scored each. One pass
    over the texts, no shuffle; the model is as small as its sample and travels with the task.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts = [t or "" for t in b["text"].to_pylist()]
            found = [model.clauses(t) for t in texts]
            scores = [model.score(model.features(t, f)) for t, f in zip(texts, found)]
            spans = pa.array([[{"start": s, "end": e, "kinds": v} for s, e, v in f] for f in found] if with_clauses else [None] * len(found), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.list_(pa.float64()))])))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(scores, pa.float64()), spans], ["doc_id", "score", "clauses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, SCORED)


def without_toxic(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """documents whose score is under a half, with their own columns."""
    model = fit(docs, labels, most)
    d = docs.select(*DOCUMENT_COLUMNS)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield b.filter(pa.array([model.score(model.features(t or "")) < 0.5 for t in b["text"].to_pylist()], pa.bool_()))

    return d.mapInArrow(kept, d.schema)


def op1_toxicity_grammar(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 5) != 0))
    s = score(docs, model, with_clauses=False)
    return s.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
