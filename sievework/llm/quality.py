"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text train a scorer f by the non-negative unbiased risk
    prior * E_pos[l(f, +)] + max(0, E_unl[l(f, -)] - prior * E_pos[l(f, -)])
with the logistic loss; when the bracket falls below zero, a step climbs back along its gradient,
as the published method does. No negative label enters the risk or the prior, which is estimated
from the same two samples: a scorer fitted on half of the positives orders the other half and the
unlabelled rows, and the least ratio of unlabelled to positive rows above a score, allowing for
sampling, is the share of positives among the unlabelled. Only under 40 positives the labelled
share of 1 stands in for it.

Features come from the whole text and nothing else. They are taken once, over all rows; the fit
sees a bounded sample (max_positives, max_unlabelled, chosen by a hash of the id, so that reruns
agree), and every row is scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sievework.llm.common import documents, id_bucket, labels, map_texts
from sievework.plans.staging import materialise

NAMES = (
    "log_chars", "log_words", "mean_word", "upper", "digit", "symbol", "non_ascii", "space", "top_word", "distinct_words", "same_next", "line_repeat",
    "short_lines", "ends_plain", "pipes", "bangs", "marked_words", "long_words", "sentence_words", "pair_repeat", "upper_words", "comma",
)
_KINDS = np.zeros(256, dtype=np.int8)
for _i in range(256):
    _c = chr(_i)
    _KINDS[_i] = 5 if _i >= 128 else 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if _c.isdigit() else 3 if _c in " \t\r\n\v\f" else 4
_ENDS = (b".", b"!", b"?", b":", b";", b'"', b")")
_MARKED = re.compile(rb"[^\w\s.,;:!?'\"()-]{2,}(?:\s|$)")


def features(text: str) -> list[float]:
    """One value per name in NAMES; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return [0.0] * len(NAMES)
    n = len(data)
    lower, upper, digit, space, symbol, high = (np.bincount(_KINDS[np.frombuffer(data, dtype=np.uint8)], minlength=6) / n).tolist()
    words = data.split()
    k = max(1, len(words))
    count = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    pairs = len(set(zip(words, words[1:]))) if k > 1 else 0
    letters = max(1e-9, lower + upper)
    return [
        math.log1p(n), math.log1p(len(words)), (n - space * n) / k, upper / letters, digit, symbol, high, space, max(count.values(), default=0) / k, len(count) / k,
        sum(a == b for a, b in zip(words, words[1:])) / k, 1 - len(set(lines)) / m, sum(len(x) < 30 for x in lines) / m, sum(not x.rstrip().endswith(_ENDS) for x in lines) / m,
        words.count(b"|") / k, data.count(b"!!") / k, len(_MARKED.findall(data)) / k, sum(len(w) > 18 for w in words) / k, math.log1p(k / (1 + data.count(b". ") + data.count(b".\n"))),
        1 - pairs / max(1, k - 1), sum(w.isupper() for w in words) / k, data.count(b",") / k,
    ]


def text_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x array<float>), one row per row; a null text counts as empty."""

    def make():
        def fn(ids, texts):
            flat = np.array([features(t) for t in texts], dtype=np.float32)
            offsets = np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())).cast(kind)]

        return fn

    kind = pa.list_(pa.field("element", pa.float32()))
    return map_texts(df, make, id_col, text_col, f"id {dict(df.dtypes)[id_col]}, x array<float>", ["id", "x"], [kind])


class Scorer:
    """Additive model over quantile bands of each feature, fitted by the non-negative risk."""

    def __init__(self, bands: int = 12, rounds: int = 300, rate: float = 0.05, penalty: float = 1e-4):
        self.bands, self.rounds, self.rate, self.penalty = bands, rounds, rate, penalty

    def _rows(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([z, *((z[:, [j]] > c[None, :]) for j, c in enumerate(self.cuts)), np.ones((len(z), 1))]).astype(np.float32)

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> "Scorer":
        both = np.vstack([positive, unlabelled]).astype(np.float64)
        self.mean, self.scale = both.mean(axis=0), both.std(axis=0) + 1e-9
        z = np.clip((both - self.mean) / self.scale, -6, 6)
        q = np.linspace(0, 1, self.bands + 1)[1:-1]
        self.cuts = [np.unique(np.concatenate([np.quantile(z[:, j], q), np.quantile(z[:, j], [0.01, 0.03, 0.97, 0.99])])) for j in range(z.shape[1])]
        p, u = self._rows(positive.astype(np.float64)), self._rows(unlabelled.astype(np.float64))
        w, m, v = (np.zeros(p.shape[1], dtype=np.float32) for _ in range(3))
        sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -30, 30)))
        for step in range(1, self.rounds + 1):
            fp, fu = p @ w, u @ w
            risk_neg = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            g_pos = -prior * (p.T @ sig(-fp)) / len(p)
            g_neg = (u.T @ sig(fu)) / len(u) - prior * (p.T @ sig(fp)) / len(p)
            g = (g_pos + g_neg if risk_neg >= 0 else -g_neg) + self.penalty * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - self.rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.w = w
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self._rows(x.astype(np.float64)) @ self.w).astype(np.float64), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """The share of positives among the unlabelled rows, from these two samples alone."""
    half = len(positive) // 2
    scorer = Scorer().fit(positive[:half], unlabelled, 0.5)
    p, u = (np.sort(-scorer.score(x)) for x in (positive[half:], unlabelled))
    top = np.arange(max(1, len(p) // 10), len(p) + 1)
    above_p, above_u = top / len(p), np.searchsorted(u, p[top - 1], side="right") / len(u)
    slack = sum(math.sqrt(math.log(4 / doubt) / (2 * n)) for n in (len(p), len(u)))
    best = int(np.argmin((above_u + slack) / above_p))
    return float(min(1.0, above_u[best] / above_p[best]))


def fit_scorer(feats: DataFrame, marks: DataFrame, max_positives: int = 6_000, max_unlabelled: int = 12_000) -> tuple[Scorer | None, float]:
    """(scorer, prior) from features (id, x) and marks (id, label 0 or 1).

    Repeated marks of an id: it is trusted only if all are 1. Unlabelled text is drawn from all
    rows, trusted ones too, so that it holds positives at the prior's rate. With no positive there
    is no scorer, and the prior (1 where there are no marks) stands for every score.
    """
    one = marks.where("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("label"))
    prior = one.agg(F.avg("label")).first()[0]
    prior = 1.0 if prior is None else float(prior)
    known = feats.join(one.where("label = 1"), "id", "left")
    draw = F.shiftrightunsigned(F.xxhash64(F.col("id").cast("string")), 11)
    n = known.agg(F.count("label").alias("p"), F.count("*").alias("u")).first()

    def take(rows: DataFrame, of: int, most: int) -> list:
        """The first rows by the hash; of all rows only some twice as many are ordered."""
        near = rows.where(draw < int(min(1.0, (2 * most + 100) / max(1, of)) * (1 << 53)))
        return near.select("x", draw.alias("__draw"), "id").orderBy("__draw", "id").limit(most).select("x").toPandas()["x"].tolist()

    pos, unl = take(known.where("label = 1"), n["p"], max_positives), take(known, n["u"], max_unlabelled)
    if not pos or not unl:
        return None, prior
    pos, unl = (np.array([*map(np.asarray, x)]) for x in (pos, unl))
    if len(pos) >= 40:
        prior = estimate_prior(pos, unl)
    return Scorer().fit(pos, unl, min(max(prior, 0.01), 0.99)), prior


def score_rows(feats: DataFrame, scorer: Scorer | None, prior: float) -> DataFrame:
    """(id, score double): for every row of feats."""
    kind = dict(feats.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            s = scorer.score(x) if scorer is not None and b.num_rows else np.full(b.num_rows, prior)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s)], names=["id", "score"])

    return feats.select("id", "x").mapInArrow(run, f"id {kind}, score double")


def score_quality(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): marks are (id, label); label 1 likelier with a higher score. Null texts are empty."""
    feats = materialise(text_features(docs, id_col, text_col), "features")
    return score_rows(feats, *fit_scorer(feats, marks))


def training_marks(spark, sf_dir: str) -> DataFrame:
    """labels.quality of the rows that may be learned from."""
    return labels(spark, sf_dir).where(id_bucket("doc_id", 5) != 0).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


#: A document below this score is rejected.
THRESHOLD = 0.3


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's score by its text alone; null and empty texts are scored too."""
    scored = score_quality(documents(spark, sf_dir), training_marks(spark, sf_dir))
    return scored.select(F.col("id").alias("doc_id"), (id_bucket("id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
