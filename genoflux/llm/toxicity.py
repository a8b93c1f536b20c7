"""Operator 5: toxic spans by a linear-chain conditional random field.

Tokens are words; a token's features are its plain form in lower case and the form's first 4, 5 and 6 letters.  Features that
mark toxic documents are chosen by counting over a bounded sample of labelled rows.  Only documents have labels, so those of
tokens are inferred: the sample has two halves, and a token of a toxic document is toxic if one of its features marks
toxic documents in the other half.  What a document alone has doesn't count that way.  The field is trained on stretches of
tokens with these labels, by L-BFGS.  Scoring runs forward-backward over the whole text: only words with a feature need a step of
their own, since what lies between them is a power of one 2 x 2 matrix.  The marginals give offending spans; a logistic curve,
fitted on the sample, turns the total of their evidence into a document's score.

Learning: at most ``SAMPLE`` rows of each label (those with the smallest hashes of doc_id), ``FEATURES`` features (those in most toxic
documents, then in alphabetical order) and ``STRETCHES`` different stretches (by hash; equal ones are one with a weight); all three are
parameters of ``learn``.  Labels are joined by doc_id; several labels of one are the largest, null ones are left out.

Defined cases: a null or empty text gets the score of a text without any feature; without both labels every score is 0;
repeated rows are scored each for itself; equal texts have equal scores, and there is no order to break ties in; an empty table
gives no row.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, slices, stash, table

SAMPLE, FEATURES, STRETCHES = 6000, 4096, 20_000
#: Documents of the sample that a feature has to be in, at least and as a share of the toxic ones, and its odds there.
LEAST, SHARE, ODDS = 3, 0.004, 20.0
PREFIXES = (4, 5, 6)
#: Of squared weights, against the likelihood of a stretch.
PENALTY = 1e-5
#: Words of a stretch that is trained on.
STRETCH = 48
WORDS = 200_000
COUNTS = ("clean0", "toxic0", "clean1", "toxic1")

_PLAIN = re.compile(r"^[\W_]+|[\W_]+$")


def features(word: str) -> list[str]:
    plain = _PLAIN.sub("", word).lower()
    return [f"={plain}", *(f"^{plain[:k]}" for k in PREFIXES if len(plain) > k)] if plain else []


@dataclass
class Field:
    """Weights of toxic tokens' features, the weight of being toxic at all, and those of the step to each state, from each."""

    weights: dict[str, float]
    bias: float
    steps: np.ndarray
    curve: tuple[float, float]


class Scorer(dict):
    """Marginals of whole texts; the dict holds the evidence of words."""

    def __init__(self, field: Field) -> None:
        self.field = field
        self.step = np.exp(field.steps)
        self.between = self.step * np.array([1.0, math.exp(field.bias)])
        self.powers: dict[int, np.ndarray] = {}

    def __missing__(self, word: str) -> float:
        w = self.field.weights
        found = [w[f] for f in features(word) if f in w]
        if len(self) >= WORDS:
            self.clear()
        self[word] = out = sum(found) + self.field.bias if found else 0.0
        return out

    def _run(self, n: int) -> np.ndarray:
        """What n words without a feature do, up to a factor."""
        if n not in self.powers:
            if len(self.powers) > 50_000:
                self.powers.clear()
            m, k, out = self.between, n, np.eye(2)
            while k:
                if k & 1:
                    out = out @ m
                    out /= out.sum()
                m = m @ m
                m /= m.sum()
                k >>= 1
            self.powers[n] = out
        return self.powers[n]

    def marginals(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of words with a feature, and their probability of being toxic."""
        evidence = np.fromiter(map(self.__getitem__, words), float, len(words))
        at = np.flatnonzero(evidence)
        if not len(at):
            return at, np.zeros(0)
        gaps = np.diff(np.r_[-1, at, len(words)]) - 1
        forward, out = [], np.empty(len(at))
        f = np.array([1.0, 0.0])
        for g, e in zip(gaps.tolist(), evidence[at].tolist()):
            f = f @ self._run(g) @ self.step * np.array([1.0, math.exp(min(e, 50.0))])
            f /= f.sum()
            forward.append(f)
        b = self._run(int(gaps[-1])) @ np.ones(2)
        for i in range(len(at) - 1, -1, -1):
            p = forward[i] * b
            out[i] = p[1] / p.sum()
            if i:
                b = self._run(int(gaps[i])) @ self.step @ (np.array([1.0, math.exp(min(evidence[at[i]], 50.0))]) * b)
                b /= b.sum()
        return at, out

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Score of a text, and (start, stop, probability) of its toxic spans."""
        words = (text or "").split()
        at, p = self.marginals(words)
        spans: list[tuple[int, int, float]] = []
        if (bad := {int(i): float(x) for i, x in zip(at, p) if x >= 0.5}) and text:
            last = -2
            for i, m in enumerate(re.finditer(r"\S+", text)) if len(bad) else ():
                if i in bad:
                    if last == i - 1:
                        spans[-1] = (spans[-1][0], m.end(), max(spans[-1][2], bad[i]))
                    else:
                        spans.append((*m.span(), bad[i]))
                    last = i
        return self.curve(evidence_of(p)), spans

    def curve(self, x: float) -> float:
        a, b = self.field.curve
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x))))


def evidence_of(p: np.ndarray) -> float:
    """Total of marginals: what a document has against it if words were independent, on a log scale."""
    return float(np.log1p(-np.log1p(-np.minimum(p, 1 - 1e-9)).sum()))


def minimum(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, small: float = 1e-5) -> np.ndarray:
    """Where a smooth function, which returns its value and gradient, is least, by limited-memory BFGS from x."""
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < small:
            break
        d, taken = -g, []
        for s, y in reversed(past):
            taken.append(a := (s @ d) / (s @ y))
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        else:
            d = d / max(1.0, np.abs(d).max())
        for (s, y), a in zip(past, reversed(taken)):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step = g @ d, 1.0
        while True:
            new_f, new_g = value(x + step * d)
            if new_f <= f + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-6:
                return x
        s, y = step * d, new_g - g
        past = [*past, (s, y)][-8:] if s @ y > 1e-12 else past
        done = f - new_f < small * small
        x, f, g = x + s, new_f, new_g
        if done:
            break
    return x


class Stretches:
    """Stretches to train on: (tokens (place, features, whether it is bad), length, whether toxic, weight)."""

    def __init__(self, k: int, rows: list[tuple]) -> None:
        self.k, self.n = k, len(rows)
        tokens = [(s, *t) for s, (found, _, _, _) in enumerate(rows) for t in found]
        self.s_of, self.t_of, self.f_of = (np.array(x, np.int64) for x in zip(*((s, t, f) for s, t, fs, _ in tokens for f in fs)))
        self.length, self.toxic, self.weight = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
        self.inside = np.arange(STRETCH)[:, None] < self.length
        gold = np.zeros((STRETCH, self.n), np.int64)
        for s, t, _, bad in tokens:
            gold[t, s] = bad and self.toxic[s]
        before, w = np.vstack([np.zeros((1, self.n), np.int64), gold[:-1]]), self.weight
        self.gold = np.zeros(k + 5)
        np.add.at(self.gold, self.f_of, gold[self.t_of, self.s_of] * w[self.s_of])
        self.gold[k] = (gold * w).sum()
        for i in range(4):
            self.gold[k + 1 + i] = (((before == i // 2) & (gold == i % 2) & self.inside) * w).sum()

    def loss(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Negative likelihood for each stretch with a small penalty, and its gradient.  theta: features, bias, four steps."""
        value, expected = self.sweep(theta)
        total = self.weight.sum()
        return (value - theta @ self.gold) / total + PENALTY / 2 * theta @ theta, (expected - self.gold) / total + PENALTY * theta

    def sweep(self, theta: np.ndarray) -> tuple[float, np.ndarray]:
        """Log partition and expected counts, by forward and backward steps over all stretches."""
        n, k, w = self.n, self.k, self.weight
        emit = np.full((STRETCH, n), theta[k])
        np.add.at(emit, (self.t_of, self.s_of), theta[self.f_of])
        most = np.maximum(emit, 0.0)  # both states' weights are less by this factor
        e = np.exp(np.stack([-most, emit - most], axis=2))
        step = np.exp(theta[k + 1 :].reshape(2, 2))
        f, fs, value = np.tile([1.0, 0.0], (n, 1)), [], (w * most * self.inside).sum()
        for t in range(STRETCH):
            g = (f @ step) * e[t]
            size = g.sum(axis=1)
            value += (w * np.where(self.inside[t], np.log(size), 0.0)).sum()
            f = np.where(self.inside[t][:, None], g / size[:, None], f)
            fs.append(f)
        b, expected, marginal = np.ones((n, 2)), np.zeros(k + 5), np.zeros((STRETCH, n))
        for t in range(STRETCH - 1, -1, -1):
            ahead = e[t] * b
            prev = fs[t - 1] if t else np.tile([1.0, 0.0], (n, 1))
            pair = prev[:, :, None] * step[None] * ahead[:, None, :]
            pair *= (self.inside[t] / pair.sum(axis=(1, 2)))[:, None, None]
            marginal[t] = pair[:, :, 1].sum(axis=1)
            expected[k + 1 :] += (pair * w[:, None, None]).sum(axis=0).ravel()
            back = ahead @ step.T
            b = np.where(self.inside[t][:, None], back / back.sum(axis=1, keepdims=True), b)
        np.add.at(expected, self.f_of, marginal[self.t_of, self.s_of] * w[self.s_of])
        expected[k] = (marginal * w).sum()
        return value, expected


def _fit_field(words: list[str], rows: list[tuple], rounds: int = 60) -> Field:
    """Maximum likelihood of the labels."""
    k = len(words)
    theta = np.zeros(k + 5)
    theta[k] = -3.0
    if k:
        theta = minimum(Stretches(k, rows).loss, theta, rounds)
    return Field(dict(zip(words, theta[:k].tolist())), float(theta[k]), theta[k + 1 :].reshape(2, 2), (0.0, 1.0))


def _fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one measure, by Newton's method."""
    a = np.array([0.0, 1.0])
    z = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        a = a + np.clip(np.linalg.solve(h, z.T @ (y - p) - 1e-3 * a), -2, 2)
    return float(a[0]), float(max(0.0, a[1]))


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """Rows (toxic, text) of at most so many labelled documents of each label, without equal texts."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    drawn = [known.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    few = drawn[0].union(drawn[1])
    # 12 bytes for each of 2 * most rows
    joined = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.length("text") > 0).join(F.broadcast(few), "doc_id")
    return joined.groupBy(F.xxhash64("text").alias("h"), "toxic").agg(F.first("text").alias("text")).select("toxic", "text")


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, features_most: int = FEATURES, stretches_most: int = STRETCHES) -> Field | None:
    rows = stash(sample(docs, labels, most).withColumn("half", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")), "labelled")
    sizes = {(r["half"], r["toxic"]): r["count"] for r in rows.groupBy("half", "toxic").count().collect()}
    clean, toxic = (sum(n for (_, y), n in sizes.items() if y == label) for label in (0, 1))
    if not clean or not toxic:
        return None

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for b in slices(batches):
            held = tuple(Counter() for _ in range(4))
            for label, half, text in zip(*(b.column(x).to_pylist() for x in ("toxic", "half", "text"))):
                words = set(text.split())
                for w in words.difference(known):
                    known[w] = features(w)
                held[2 * half + label].update({f for w in words for f in known[w]})
            if len(known) > WORDS:
                known.clear()
            names = list(set().union(*held))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([h[x] for x in names], pa.int64()) for h in held)], names=["feature", *COUNTS])

    counted = rows.mapInArrow(count, "feature string, " + ", ".join(f"{x} bigint" for x in COUNTS)).groupBy("feature").agg(*(F.sum(x).alias(x) for x in COUNTS))

    def marks(there: Column, n: int, elsewhere: Column, m: int) -> Column:
        odds = there / max(1, n) / ((elsewhere + 0.5) / max(1, m))
        return (there >= max(LEAST, SHARE * n)) & (odds >= ODDS)

    in_toxic = F.col("toxic0") + F.col("toxic1")
    by_half = [marks(F.col(f"toxic{h}"), sizes.get((h, 1), 0), F.col(f"clean{h}"), sizes.get((h, 0), 0)).alias(f"marks{h}") for h in (0, 1)]
    chosen = counted.where(marks(in_toxic, toxic, F.col("clean0") + F.col("clean1"), clean)).orderBy(in_toxic.desc(), "feature").limit(features_most)
    found = chosen.select("feature", *by_half).collect()
    names = [r["feature"] for r in found]
    # the number of a feature, and whether it marks toxic documents in the half that a text of half 0 or 1 isn't in
    index = {r["feature"]: (i, r["marks1"], r["marks0"]) for i, r in enumerate(found)}

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for label, half, text in zip(*(b.column(x).to_pylist() for x in ("toxic", "half", "text"))):
                words = text.split()
                tokens = [(t, own) for t, w in enumerate(words) if (own := [index[f] for f in features(w) if f in index])]
                starts = list(dict.fromkeys(t // STRETCH * STRETCH for t, _ in tokens)) or ([0] if words else [])
                for lo in starts:
                    part = [{"at": t - lo, "features": [x[0] for x in own], "bad": any(x[1 + half] for x in own)} for t, own in tokens if lo <= t < lo + STRETCH]
                    out.append((part, min(STRETCH, len(words) - lo), bool(label)))
            kinds = (pa.list_(pa.struct([("at", pa.int64()), ("features", pa.list_(pa.int64())), ("bad", pa.bool_())])), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, kinds)], names=["tokens", "length", "toxic"])

    stretches = rows.mapInArrow(cut, "tokens array<struct<at: bigint, features: array<bigint>, bad: boolean>>, length bigint, toxic boolean")
    stretches = stretches.groupBy("tokens", "length", "toxic").agg(F.count("*").alias("weight"))
    # which of them is decided by content, not by where they lie
    drawn = stretches.orderBy(F.xxhash64("tokens", "length", "toxic"), "length").limit(stretches_most).collect()
    field = _fit_field(names, [([(t["at"], t["features"], t["bad"]) for t in r["tokens"]], r["length"], r["toxic"], r["weight"]) for r in drawn])

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(field)
        for b in slices(batches):
            x = [evidence_of(scorer.marginals(t.split())[1]) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(x, pa.float64())], names=["toxic", "x"])

    seen = rows.mapInArrow(measure, "toxic int, x double").toPandas()  # two numbers for each row of the sample
    field.curve = _fit_curve(seen["x"].to_numpy(), seen["toxic"].to_numpy(float))
    return field


def score(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id, score and spans (start, stop, probability) of documents."""
    told = docs.sparkSession.sparkContext.broadcast(field)  # at most FEATURES weights

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(told.value) if told.value is not None else None
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))
        for b in slices(batches):
            found = [scorer.score(x) if scorer is not None else (0.0, []) for x in b.column("text").to_pylist()]
            spans = pa.array([[dict(zip(("start", "stop", "probability"), s)) for s in x] for _, x in found], kind)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in found], pa.float64()), spans], names=["doc_id", "score", "spans"])

    read = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return read.mapInArrow(task, f"doc_id {dict(read.dtypes)['doc_id']}, score double, spans array<struct<start: bigint, stop: bigint, probability: double>>")


def held_out(doc_id: Column) -> Column:
    """Documents whose labels are never learnt from."""
    return crc_mod(doc_id, 3) == 1


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
