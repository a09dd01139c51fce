"""Language identification with language-bitmask n-gram filters.

A Bloom filter per language, kept bit-sliced: one table of slots, each a mask with a bit per
language. An n-gram probes its slots once, and the AND of their masks names all languages whose
filter holds it. Counts of set bits over a text, each corrected for its filter's measured rate of
false positives, decide.

An n-gram enters a language's filter if the training texts of that language hold it at least
min_count times and at no less than min_share of the highest rate any language has, so that a
foreign passage inside a training text fills no filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from sievework.llm.common import documents, id_bucket, release

UNKNOWN = "und"
_GRAM = 4
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
#: Code points whose letters are looked up at once.
_TABLE = 1 << 16


@lru_cache
def _letters() -> np.ndarray:
    """Per code point below 2^16: itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(_TABLE)], dtype=np.uint32)


def grams(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the 4-grams of the lower-cased text, runs of non-letters being one space; and
    whether it has a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if points.size and points.max() >= _TABLE:
        c = points.copy()
        low = c < _TABLE
        c[low] = _letters()[c[low]]
        c[~low] = [x if chr(x).isalpha() else 32 for x in c[~low].tolist()]
    else:
        c = _letters()[points]
    blank = c == 32
    if blank.all():
        return np.empty(0, dtype=np.uint64), False
    keep = ~(blank & np.concatenate([[True], blank[:-1]]))
    c = np.concatenate([[32], c[keep], [32]]).astype(np.uint64)
    if len(c) < _GRAM:
        c = np.concatenate([c, np.full(_GRAM - len(c), 32, dtype=np.uint64)])
    h = c[: len(c) - _GRAM + 1].copy()
    for i in range(1, _GRAM):
        h = h * np.uint64(0x100000001B3) + c[i : len(c) - _GRAM + 1 + i] * np.uint64(0x9E3779B1)
    h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9), True


class Filters:
    """Bit-sliced filters; any number of languages, 64 to a slice."""

    def __init__(self, per_key: int = 16, hashes: int = 3, min_count: int = 2, min_share: float = 0.1):
        self.per_key, self.hashes, self.min_count, self.min_share = per_key, hashes, min_count, min_share

    def fit(self, texts: dict[str, list[str]]) -> "Filters":
        self.languages = sorted(texts)
        keys, lang, rate, times = [], [], [], []
        for j, name in enumerate(self.languages):
            parts = [g for g in (grams(t)[0] for t in texts[name]) if g.size]
            if parts:
                k, n = np.unique(np.concatenate(parts), return_counts=True)
                keys.append(k), lang.append(np.full(len(k), j)), rate.append(n / n.sum()), times.append(n)
        width = max(1, -(-len(self.languages) // 64))
        if not keys:
            self.slots = np.zeros((1, width), dtype=np.uint64)
        else:
            k, j, r, n = map(np.concatenate, (keys, lang, rate, times))
            ids, at = np.unique(k, return_inverse=True)
            top = np.zeros(len(ids))
            np.maximum.at(top, at, r)
            in_filter = (n >= self.min_count) & (r >= self.min_share * top[at])
            k, j = k[in_filter], j[in_filter]
            most = np.bincount(j, minlength=1).max() if len(j) else 1
            self.slots = np.zeros((1 << int(np.ceil(np.log2(max(64, most * self.per_key)))), width), dtype=np.uint64)
            for p in self._probe(k):
                np.bitwise_or.at(self.slots, (p, j // 64), np.uint64(1) << (j % 64).astype(np.uint64))
        fill = np.array([((self.slots[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))])
        self.false_rate = fill**self.hashes
        if len(self.languages) <= 8:
            self.slots = self.slots.astype(np.uint8)
        return self

    def _probe(self, h: np.ndarray) -> list[np.ndarray]:
        shift = np.uint64(64 - int(np.log2(len(self.slots)))) if len(self.slots) > 1 else np.uint64(63)
        return [((h * s) >> shift).astype(np.int64) if len(self.slots) > 1 else np.zeros(len(h), dtype=np.int64) for s in _SEEDS[: self.hashes]]

    def containing(self, h: np.ndarray) -> np.ndarray:
        """A mask row per n-gram: the languages whose filter holds it."""
        p = self._probe(h)
        masks = self.slots[p[0]]
        for q in p[1:]:
            masks = masks & self.slots[q]
        return masks

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score): the largest corrected share, and its part of all of them."""
        h, has_letter = grams(text or "")
        if not has_letter or not self.languages:
            return UNKNOWN, 0.0
        counts = np.zeros(len(self.languages))
        for s in range(0, len(h), 1 << 16):
            masks = self.containing(h[s : s + (1 << 16)])
            one = masks.dtype.type(1)
            counts += [int(((masks[:, i // 64] >> masks.dtype.type(i % 64)) & one).sum(dtype=np.int64)) for i in range(len(self.languages))]
        share = np.clip((counts / len(h) - self.false_rate) / (1 - self.false_rate), 0, 1)
        best = int(share.argmax())
        return self.languages[best], float(share[best] ** 2 / max(1e-12, (share**2).sum()))


def fit_filters(training: DataFrame, per_language: int = 1_000) -> Filters:
    """Filters from (id, text, lang). Null ids, langs and texts teach nothing.

    The fit sees at most per_language whole texts of each language, the first by a hash of the id;
    they are what the driver holds. Each language's count tells below which hash these lie, so only
    some twice as many texts move. Everything else covers all rows.
    """

    known = training.where("id is not null and lang is not null and text is not null")
    draw = F.xxhash64(F.col("id").cast("string"))
    each = known.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    share = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    some = known.join(F.broadcast(each), "lang").where(share * F.col("n") < 2 * per_language + 100).select("id", "lang", "text")
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(draw, 11), "id", "text")
    drawn = some.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_language)
    texts: dict[str, list[str]] = {}
    for lang, text in drawn.select("lang", "text").toLocalIterator():
        texts.setdefault(lang, []).append(text)
    return Filters().fit(texts)


def predict_language(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): 'und' with score 0 for a text that is null or has no letter."""
    shared = df.sparkSession.sparkContext.broadcast(filters)  # bounded: per_language texts a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        for b in batches:
            out = [f.predict(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in out], type=pa.string()), pa.array([x[1] for x in out], type=pa.float64())], names=["id", "lang_pred", "score"])
        release()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {dict(df.dtypes)[id_col]}, lang_pred string, score double")


def op9_language(spark, sf_dir: str) -> DataFrame:
    """Every document's language by its text; null texts and those without a letter are 'und'."""
    docs = documents(spark, sf_dir)
    filters = fit_filters(docs.where(id_bucket("doc_id", 4) != 2).select(F.col("doc_id").alias("id"), "text", "lang"))
    return predict_language(docs, filters).select(F.col("id").alias("doc_id"), (id_bucket("id", 4) == 2).alias("held_out"), "lang_pred", "score")
