"""Toxicity scores: boosted trees over dense features of the text, with isotonic calibration.

Features: densities of a fixed and of a learned lexicon, their nearness to words
of the second person, capitals, punctuation, and rates of obfuscated spelling.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.llm.common import arrow_columns, bounded_sample

#: Fixed word lists: insults, and words of the second person in English, German, French and Spanish.
INSULTS = frozenset("idiot moron clown trash stupid pathetic disgusting worthless scum loser dumb fool imbecile jerk filthy garbage".split())
SECOND = frozenset("you your yours yourself ya u du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tus".split())
#: Letters that digits and signs stand for in obfuscated words.
STAND_INS = str.maketrans("013457@$!", "oieastasi")
OBFUSCATED = re.compile(r"[^\W\d_]+[0-9@$!*]+[^\W\d_]+[\w@$!*]*")
WORD = re.compile(r"\w+")
NAMES = (
    "log_words", "insults", "insult_density", "learned", "learned_density", "learned_most", "learned_sum", "near_second",
    "capitals", "punctuation", "exclamation", "obfuscated", "uncovered", "repeated",
)


def features(text: str, learned: dict[str, float]) -> list[float]:
    """The features NAMES of one text; an empty text has zeros throughout."""
    raw = np.frombuffer(text.encode(), np.uint8)
    count = np.bincount(raw, minlength=256)
    letters = count[65:91].sum() + count[97:123].sum()
    words = WORD.findall(text.lower())
    n = max(1, len(words))
    fixed = [i for i, w in enumerate(words) if w in INSULTS]
    hits = [(i, learned[w]) for i, w in enumerate(words) if w in learned] if learned else []
    near = 0
    for i in {*fixed, *(i for i, _ in hits)}:
        near += any(w in SECOND for w in words[max(0, i - 4) : i + 5])
    odd = OBFUSCATED.findall(text) if count[48:58].sum() + count[[33, 36, 42, 64]].sum() else []
    plain = [w.lower().replace("*", "").translate(STAND_INS) for w in odd]
    punctuation = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    same = int(((raw[2:] == raw[1:-1]) & (raw[1:-1] == raw[:-2]) & (raw[2:] > 64)).sum()) if len(raw) > 2 else 0
    weights = [w for _, w in hits]
    return [
        float(np.log1p(len(words))), float(len(fixed)), 1000 * len(fixed) / n, float(len(hits)), 1000 * len(hits) / n,
        max(weights, default=0.0), sum(weights), float(near), count[65:91].sum() / max(1, letters), punctuation / max(1, len(raw)),
        1000 * count[33] / n, 1000 * len(odd) / n, float(sum(w in INSULTS or w in learned for w in plain)), 1000 * same / n,
    ]


@dataclass
class Trees:
    """Boosted regression trees on log-odds; each tree as arrays of feature, cut, left, right and value."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := feature[node] >= 0).any():
                at = node[inner]
                go_left = x[inner, feature[at]] <= cut[at]
                node[inner] = np.where(go_left, left[at], right[at])
            out += value[node]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 3.0) -> Trees:
    """Second-order boosting on the logistic loss over quantile bins; one leaf holds ``least`` of Hessian at least."""
    p = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
    model = Trees(float(np.log(p / (1 - p))))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    codes = [np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)]  # code k: x <= cuts[k]
    margin = np.full(len(x), model.base)
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-margin))
        grad, hess = prob - y, prob * (1 - prob)
        nodes: list[list] = []  # feature, cut, left, right, value

        def grow(rows: np.ndarray, level: int, grad=grad, hess=hess, nodes=nodes) -> int:
            me, g, h = len(nodes), grad[rows].sum(), hess[rows].sum()
            nodes.append([-1, 0.0, 0, 0, -rate * g / (h + 1.0)])
            best = (1e-6, -1, 0)
            for j, c in enumerate(cuts if level < depth and h >= 2 * least * 0.01 else []):
                gs = np.cumsum(np.bincount(codes[j][rows], grad[rows], len(c) + 1))[:-1]
                hs = np.cumsum(np.bincount(codes[j][rows], hess[rows], len(c) + 1))[:-1]
                gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
                gain[(hs < least * 0.01) | (h - hs < least * 0.01)] = -1
                if len(gain) and gain.max() > best[0]:
                    best = (float(gain.max()), j, int(gain.argmax()))
            if best[1] >= 0:
                _, j, k = best
                is_left = codes[j][rows] <= k
                left, right = grow(rows[is_left], level + 1), grow(rows[~is_left], level + 1)
                nodes[me][:4] = [j, float(cuts[j][k]), left, right]
            return me

        grow(np.arange(len(x)), 0)
        tree = tuple(np.array([n[i] for n in nodes], t) for i, t in enumerate((np.int64, float, np.int64, np.int64, float)))
        model.trees.append(tree)
        margin += Trees(0.0, [tree]).margin(x)
    return model


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: rising knots of score and the share of ones there."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, weight, sum of scores
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            a = pools.pop()
            pools[-1] = [u + w for u, w in zip(pools[-1], a, strict=True)]
    return np.array([p[2] / p[1] for p in pools]), np.array([p[0] / p[1] for p in pools])


@dataclass
class ToxicityModel:
    learned: dict[str, float]
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t or "", self.learned) for t in texts]).reshape(-1, len(NAMES))
        return self.calibrated(self.trees.margin(x))

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        """The isotonic share of ones, with a hundredth of the plain probability so that order within a step is kept."""
        step = np.interp(margin, *self.knots) if len(self.knots[0]) else 0.0
        return np.clip(0.99 * step + 0.01 / (1 + np.exp(-margin)), 0, 1)


def _word_counts(rows: DataFrame) -> DataFrame:
    """Words of labelled texts with the numbers of toxic and other texts that hold them, by half of the sample."""
    out = T.StructType([T.StructField("words", T.ArrayType(T.StringType()))])
    words = arrow_columns(rows, ["text"], out, lambda: lambda t: [[sorted(set(WORD.findall((x or "").lower()))) for x in t.to_pylist()]], keep=["toxic", "half"])
    return words.select("toxic", "half", F.explode("words").alias("word")).groupBy("word").agg(
        *[F.count_if((F.col("half") == h) & (F.col("toxic") == t)).alias(f"n{h}{t}") for h in (0, 1) for t in (0, 1)]
    )


def _lexicon(pos: np.ndarray, neg: np.ndarray, words: np.ndarray, total: tuple[int, int], least: float, most: int) -> dict[str, float]:
    """Words that mark toxic texts: log-likelihood ratio of at least ``least``; weight: log odds ratio, 6 at most."""
    n1, n0 = total
    if not n1 or not n0:
        return {}
    both, share = pos + neg, n1 / (n1 + n0)
    with np.errstate(divide="ignore", invalid="ignore"):
        g2 = 2 * (np.where(pos > 0, pos * np.log(pos / (both * share)), 0) + np.where(neg > 0, neg * np.log(neg / (both * (1 - share))), 0))
    odds = np.log((pos + 0.5) / (n1 + 1)) - np.log((neg + 0.5) / (n0 + 1))
    keep = np.flatnonzero((g2 >= least) & (odds > 1))
    keep = keep[np.lexsort((words[keep], -g2[keep]))][:most]
    return {str(words[i]): float(min(odds[i], 6.0)) for i in keep}


def train(labelled: DataFrame, rows: int = 20_000, lexicon: int = 4_000) -> ToxicityModel:
    """A model from labelled texts (doc_id, text, toxic 0 or 1).

    The fit uses a sample of about ``rows`` rows, by the hash of doc_id: that many feature
    rows reach the driver, and of their words only those in at least 4 toxic texts.
    The learned lexicon has ``lexicon`` words at most.  Each half of the sample is
    given features by the lexicon learned from the other, so that trees see the
    lexicon as new texts will; a quarter of the rows calibrates and grows no tree.
    Rows with a null label are left out.  Without rows of both labels the score is
    the share of ones, or 0 without any row.
    """
    some = labelled.where(F.col("toxic").isin(0, 1)).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    some = bounded_sample(some, "doc_id", rows)
    some = some.withColumn("half", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))).cast("int"))
    counts = _word_counts(some).where("n01 + n11 >= 4").toPandas()
    sizes = {(r["half"], r["toxic"]): r["count"] for r in some.groupBy("half", "toxic").count().collect()}
    n = {k: sizes.get(k, 0) for k in ((0, 0), (0, 1), (1, 0), (1, 1))}
    total = sum(n.values())
    ones = n[0, 1] + n[1, 1]
    if not ones or ones == total:
        rate = ones / total if total else 0.0
        return ToxicityModel({}, Trees(), (np.array([0.0]), np.array([rate])))
    words = counts["word"].to_numpy().astype(str)
    c = {k: counts[f"n{k[0]}{k[1]}"].to_numpy(float) for k in n}
    halves = [_lexicon(c[h, 1], c[h, 0], words, (n[h, 1], n[h, 0]), 15.0, lexicon) for h in (0, 1)]
    whole = _lexicon(c[0, 1] + c[1, 1], c[0, 0] + c[1, 0], words, (ones, total - ones), 20.0, lexicon)

    def make():
        return lambda texts, half: [[features(t, halves[1 - h]) for t, h in zip(texts.to_pylist(), half.to_pylist(), strict=True)]]

    out = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType()))])
    got = arrow_columns(some, ["text", "half"], out, make, keep=["doc_id", "toxic"]).toPandas().sort_values("doc_id", kind="stable")
    x, y = np.array(got["x"].tolist()), got["toxic"].to_numpy(float)
    held = np.random.default_rng(5).permutation(len(y)) % 4 == 3
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held[:] = False
    trees = boost(x[~held], y[~held])
    use = held if held.any() else ~held
    return ToxicityModel(whole, trees, isotonic(trees.margin(x[use]), y[use]))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with toxicity (double, 0 to 1) of each whole text; null and empty texts get the score of no features."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    make = lambda: lambda texts: [pa.array(sent.value.scores(texts.to_pylist()))]
    return arrow_columns(docs, [text_col], T.StructType([T.StructField("toxicity", T.DoubleType())]), make, keep, rows=1000)
