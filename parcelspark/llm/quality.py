"""Quality classifier as a sparse rule ensemble.

Statistics of whole texts feed a small random forest; every path from a root to a node is a rule, a conjunction of
threshold tests; a logistic model with an L1 penalty gives the rules weights, most of them zero; the rest is compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import DOCUMENT_COLUMNS, bytes_of, remainder, sliced, table
from .labelled import MOST_LABELLED, labelled_sample

STATISTICS = (
    "words", "word_length", "distinct", "least_distinct", "repeats", "longest_repeat", "lines", "duplicate_lines",
    "upper", "symbols", "bangs", "pipes", "digits", "stops", "foreign",
    "most_upper", "most_symbols", "most_bangs", "most_pipes", "most_digits",
)
#: Classes of bytes: 1 A-Z, 2 symbols, 3 !, 4 |, 5 digits, 6 stops, 7 above ASCII, 0 others.
_CLASS = np.zeros(256, np.uint8)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#*$%&<>@~^_{}[]=+\\", b"!", b"|", b"0123456789", b".,;:?"), 1):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 7
WINDOW, WORD_WINDOW = 256, 64
#: Partitions of the bounded sample's statistics, on which the fit runs many small jobs.
PARTS = 6


def statistics(text: bytes) -> list[float]:
    """STATISTICS of a whole text: shares of words or bytes, and their extremes over windows. All 0 for an empty one."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    same = list(map(eq, words, words[1:]))
    longest = run = 0
    if any(same):
        for s in same:
            run = run + 1 if s else 0
            longest = run if run > longest else longest
    lines = [x for x in text.split(b"\n") if x.strip()]
    parts = [words[i : i + WORD_WINDOW] for i in range(0, n, WORD_WINDOW)]
    least = min(len(set(p)) / len(p) for p in parts if len(p) == WORD_WINDOW or len(parts) == 1)
    kinds = _CLASS[np.frombuffer(text, np.uint8)]
    share = np.bincount(kinds, minlength=8) / len(kinds)
    whole = len(kinds) // WINDOW * WINDOW
    windows = kinds[:whole].reshape(-1, WINDOW) if whole else kinds.reshape(1, -1)
    most = [float((windows == k).mean(axis=1).max()) for k in (1, 2, 3, 4, 5)]
    own = [math.log1p(n), sum(map(len, words)) / n, len(set(words)) / n, least, sum(same) / n, float(longest), len(lines) / n, 1 - len(set(lines)) / len(lines)]
    return own + [float(share[k]) for k in range(1, 8)] + most


def with_statistics(docs: DataFrame) -> DataFrame:
    """docs plus a column for each of STATISTICS; docs must have text, and no columns named like STATISTICS."""
    names = docs.columns

    def computed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = np.asarray([statistics(t) for t in bytes_of(b["text"])], float).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b[c] for c in names] + [pa.array(np.ascontiguousarray(x)) for x in rows.T], [*names, *STATISTICS])

    return docs.mapInArrow(computed, T.StructType([*docs.schema.fields, *(T.StructField(s, T.DoubleType()) for s in STATISTICS)]))


Test = tuple[str, str, float]  # statistic, "<=" or ">", threshold


class RuleModel:
    """Rules as tuples of tests, their weights, and a bias."""

    def __init__(self, rules: list[tuple[Test, ...]], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def column(self) -> Column:
        """The score, from the statistics columns."""
        z = F.lit(self.bias)
        for rule, w in zip(self.rules, self.weights):
            z = z + F.when(holds(rule), F.lit(w)).otherwise(0.0)
        return 1 / (1 + F.exp(-z))

    def score(self, stats: dict[str, float]) -> float:
        """The same for one text, for tests."""
        z = self.bias + sum(w for r, w in zip(self.rules, self.weights) if all(stats[s] <= t if op == "<=" else stats[s] > t for s, op, t in r))
        return 1 / (1 + math.exp(-z))


def holds(rule: tuple[Test, ...]) -> Column:
    out = F.lit(True)
    for s, op, t in rule:
        out = out & ((F.col(s) <= t) if op == "<=" else (F.col(s) > t))
    return out


def tree_rules(root) -> set[tuple[Test, ...]]:
    """The conjunctions of all paths in a fitted tree; of several tests on one statistic and side the tightest stays."""
    rules, todo = set(), [(root, {})]
    while todo:
        node, tests = todo.pop()
        if tests:
            rules.add(tuple(sorted((s, op, t) for (s, op), t in tests.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            s, t = STATISTICS[split.featureIndex()], float(split.threshold())
            todo.append((node.leftChild(), tests | {(s, "<="): min(t, tests.get((s, "<="), math.inf))}))
            todo.append((node.rightChild(), tests | {(s, ">"): max(t, tests.get((s, ">"), -math.inf))}))
    return rules


def lasso(hits: np.ndarray, y: np.ndarray, penalty: float, steps: int = 40, sweeps: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the mean logistic loss plus penalty times the weights' absolute sum.

    Rows with the same hits are added up first; then Newton steps, each solved by coordinate descent, with halved steps
    where the loss would rise.
    """
    patterns, of = np.unique(hits, axis=0, return_inverse=True)
    n = np.bincount(of.ravel(), minlength=len(patterns)).astype(float)
    ones = np.bincount(of.ravel(), weights=y, minlength=len(patterns))
    a, total = np.hstack([np.ones((len(patterns), 1)), patterns.astype(float)]), n.sum()
    cost = np.full(a.shape[1], penalty)
    cost[0] = 0.0

    def loss(x: np.ndarray) -> float:
        z = a @ x
        return float((n @ np.logaddexp(0, z) - ones @ z) / total + cost @ np.abs(x))

    x = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ x, -30, 30)))
        g = a.T @ (n * p - ones) / total
        h = (a * (n * np.maximum(p * (1 - p), 1e-6) / total)[:, None]).T @ a
        goal, slope, curve = x.copy(), g.copy(), np.diag(h)
        for _ in range(sweeps):
            most = 0.0
            for j in np.flatnonzero(curve > 1e-12).tolist():
                v = goal[j] - slope[j] / curve[j]
                new = np.sign(v) * max(abs(v) - cost[j] / curve[j], 0.0)
                if new != goal[j]:
                    most = max(most, abs(new - goal[j]))
                    slope += h[:, j] * (new - goal[j])
                    goal[j] = new
            if most < 1e-6:
                break
        part, before = 1.0, loss(x)
        while part > 1e-4 and loss(x + part * (goal - x)) > before:
            part /= 2
        x = x + part * (goal - x)
        if before - loss(x) < 1e-9:
            break
    return x[1:], float(x[0])


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, trees: int = 12, depth: int = 4, penalty: float = 0.0008, seed: int = 5) -> RuleModel:
    """A rule ensemble from at most about `most` labelled rows; with one class only, or none, a constant.

    The forest is grown by Spark; the weights are found from the sample's statistics, a few numbers for each of its rows.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    sample = with_statistics(labelled_sample(docs, labels, "quality", most)).drop("text").repartition(PARTS).persist()  # small rows: many tasks would only cost their start
    rows = np.asarray(sample.select("label", *STATISTICS).collect(), float).reshape(-1, 1 + len(STATISTICS))  # bounded by `most`
    y, n, ones = rows[:, 0], len(rows), float(rows[:, 0].sum())
    constant = RuleModel([], [], math.log((ones + 1) / (n - ones + 1)))
    if ones in (0, n):
        sample.unpersist()
        return constant
    features = array_to_vector(F.array(*STATISTICS)).alias("features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, maxBins=64, seed=seed, featureSubsetStrategy="onethird").fit(sample.select("label", features))
    sample.unpersist()
    rules = sorted(set().union(*(tree_rules(t._call_java("rootNode")) for t in forest.trees)))
    if not rules:
        return constant
    values = dict(zip(STATISTICS, rows[:, 1:].T))
    hits = np.stack([np.all([values[s] <= t if op == "<=" else values[s] > t for s, op, t in r], axis=0) for r in rules], axis=1)
    weights, bias = lasso(hits, y, penalty)
    kept = [(r, float(w)) for r, w in zip(rules, weights) if abs(w) > 1e-6]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], bias)


def score(docs: DataFrame, model: RuleModel) -> DataFrame:
    """doc_id, score (that quality is 1), and the statistics. Null and empty texts have statistics 0. Repeated rows are scored each."""
    return with_statistics(docs.select("doc_id", "text")).select("doc_id", model.column().alias("score"), *STATISTICS)


def of_quality(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """documents whose score is at least a half, with their own columns."""
    model = fit(docs, labels, most)
    return with_statistics(docs.select(*DOCUMENT_COLUMNS)).where(model.column() >= 0.5).select(*DOCUMENT_COLUMNS)


def op2_rule_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(remainder("doc_id", 3) != 1))
    s = score(docs, model)
    return s.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
