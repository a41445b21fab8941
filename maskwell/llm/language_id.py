"""Language identification with interpolated Kneser-Ney character models."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm.textvec import blocks, mix
from maskwell.shipping import map_arrow
from maskwell.sources.tables import read_table

ORDER = 4
#: About so many distinct labelled texts of a language are learned from, dealt by a hash; a tenth of them calibrate.
DOCS_PER_LANGUAGE = 1000
#: Share of a language's own texts that its limit may reject, and the limit in standard deviations that it has at least: few texts don't show so small a share.
REJECTED, LEAST_DEVIATIONS = 0.001, 4.0
#: Held-out texts calibrate whole and by their first so many characters, as short texts vary more.
CUTS = (15, 40, 120, 400)
_U = np.uint64
_SEED = _U(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    """Which code points are letters (or marks, which belong to letters)."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def letters_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, row, counted) of the texts in lower case, where each run of other characters is one space.

    Three spaces stand before each text, so that no n-gram reaches into another text; they aren't counted.
    """
    joined = "".join("\x00\x00\x00" + t.replace("\x00", " ").lower() for t in texts)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = codes == 0
    letter = _letters()[codes]
    before = np.zeros(len(codes), bool)
    before[1:] = letter[:-1]
    keep = letter | edge | before
    row = np.cumsum(edge)[keep] // 3 - (np.cumsum(edge)[keep] % 3 == 0)
    counted = ~edge[keep]
    return np.where(letter, codes, 32)[keep].astype(np.uint64), np.where(counted, row, -1), counted


def grams(codes: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
    """Hash of the n codes that end at each of the places, or at all; before the first code stand spaces."""
    padded = np.concatenate([np.full(n, 32, np.uint64), codes])
    h = np.zeros(len(codes) if places is None else len(places), np.uint64)
    for back in range(n - 1, -1, -1):
        h = h * _SEED + (padded[n - back : len(padded) - back] if places is None else padded[places + (n - back)]) + _U(1)
    return mix(h + _U(n))


class KneserNey:
    """One language: for each order a sorted array of gram hashes with discounted probabilities, and one of context
    hashes with interpolation weights."""

    def __init__(self, texts: list[str], order: int = ORDER, floor: float = 1e-6):
        codes, _, counted = letters_of(texts)
        at = np.flatnonzero(counted)
        self.order, self.floor = order, floor
        self.probability, self.weight = [], []
        hashes = {n: grams(codes, n) for n in range(1, order + 1)}
        # The distinct grams of each order with their context and count; below the top order a gram counts once for each different code before it.
        for n in range(1, order + 1):
            if n == order:
                key, first, count = np.unique(hashes[n][at], return_index=True, return_counts=True)
            else:
                _, longer = np.unique(hashes[n + 1][at], return_index=True)
                key, first, count = np.unique(hashes[n][at[longer]], return_index=True, return_counts=True)
                first = longer[first]
            if not len(key):
                self.probability.append((key, np.zeros(0)))
                self.weight.append((key, np.zeros(0)))
                continue
            place = at[first]
            context = hashes[n - 1][np.maximum(place - 1, 0)] if n > 1 else np.zeros(len(key), np.uint64)
            ones, twos = int((count == 1).sum()), int((count == 2).sum())
            discount = min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            heads, which = np.unique(context, return_inverse=True)
            total = np.bincount(which, count)
            kinds = np.bincount(which)
            self.probability.append((key, np.maximum(count - discount, 0) / total[which]))
            self.weight.append((heads, discount * kinds / total))

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        have, values = table
        if not len(have):
            return np.full(len(keys), missing)
        at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
        return np.where(have[at] == keys, values[at], missing)

    def log_probability(self, keys: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Natural logarithm for grams given by their hashes in each order; ``contexts[n]`` is the n-code context."""
        p = np.full(len(keys[0]), self.floor)
        for n in range(1, self.order + 1):
            p = self._find(self.probability[n - 1], keys[n - 1], 0.0) + self._find(self.weight[n - 1], contexts[n - 1], 1.0) * p
        return np.log(p)


class Merged:
    """One table of several models: the keys that any of them has, sorted, and for each the models that have it with their values."""

    def __init__(self, tables: list[tuple[np.ndarray, np.ndarray]], missing: float):
        self.n, self.missing = len(tables), missing
        keys = np.concatenate([k for k, _ in tables])
        order = np.argsort(keys, kind="stable")
        self.keys, begin = np.unique(keys[order], return_index=True)
        self.begin = np.append(begin, len(keys))
        self.model = np.repeat(np.arange(self.n), [len(k) for k, _ in tables])[order]
        self.value = np.concatenate([v for _, v in tables])[order]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """[key, model]: values, ``missing`` where a model does not have the key."""
        out = np.full((len(keys), self.n), self.missing)
        if not len(self.keys):
            return out
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        row = np.flatnonzero(self.keys[at] == keys)
        begin, count = self.begin[at[row]], self.begin[at[row] + 1] - self.begin[at[row]]
        # Places begin, begin + 1, ... of each key, one after the other.
        flat = np.arange(int(count.sum())) + np.repeat(begin - (np.cumsum(count) - count), count)
        out[np.repeat(row, count), self.model[flat]] = self.value[flat]
        return out


class Limit:
    """What entropies a language's own texts have: mean and variance by length, and how many deviations above the mean are too many."""

    def __init__(self, entropy: np.ndarray, n: np.ndarray):
        # Mean and variance of a text of n codes are a + b / n.
        self.mean = _line(n, entropy)
        self.variance = _line(n, (entropy - self._at(self.mean, n)) ** 2)
        self.most = max(LEAST_DEVIATIONS, float(np.quantile(self.deviations(entropy, n), 1 - REJECTED)))

    @staticmethod
    def _at(line: tuple[float, float], n: np.ndarray) -> np.ndarray:
        return line[0] + line[1] / np.maximum(n, 1)

    def deviations(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (entropy - self._at(self.mean, n)) / np.sqrt(np.maximum(self._at(self.variance, n), 1e-4))

    def accepted(self, entropy: np.ndarray, n: np.ndarray) -> np.ndarray:
        """1 for the language's own texts, a half at the limit, 0 far beyond it."""
        return 1 / (1 + np.exp(np.clip(2 * (self.deviations(entropy, n) - self.most), -50, 50)))


def _line(n: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a and b, not below 0, of the least squares a + b / n."""
    x = 1 / np.maximum(n, 1)
    spread = float(((x - x.mean()) ** 2).sum())
    b = max(0.0, float(((x - x.mean()) * (y - y.mean())).sum()) / spread) if spread > 0 else 0.0
    return max(0.0, float(y.mean()) - b * float(x.mean())), b


class LanguageModels:
    """All languages, with the temperature and the limits that calibration found."""

    def __init__(self, texts: dict[str, list[str]], held: dict[str, list[str]], order: int = ORDER):
        self.names = sorted(texts)
        self.order = order
        models = [KneserNey(texts[k], order) for k in self.names]
        self.floor = models[0].floor if models else 0.0
        self.probability = [Merged([m.probability[n] for m in models], 0.0) for n in range(order)] if models else []
        self.weight = [Merged([m.weight[n] for m in models], 1.0) for n in range(order)] if models else []
        self.temperature, self.limits = 10.0, [None] * len(self.names)
        scored, truth = [], []
        for k, name in enumerate(self.names):
            if held.get(name):
                whole = len(held[name])
                entropy, n = self.entropies([*held[name], *(t[:c] for c in CUTS for t in held[name] if len(t) > c)])
                own = n > 0
                if own.any():
                    self.limits[k] = Limit(entropy[own, k], n[own])
                own[whole:] = False
                scored.append(entropy[own])
                truth += [k] * int(own.sum())
        if truth:
            entropy, truth = np.concatenate(scored), np.asarray(truth)
            grid = [1, 2, 3, 5, 8, 12, 20, 30, 50, 80]
            loss = [float(np.mean(np.log(np.maximum(self.confidence(entropy, t)[np.arange(len(truth)), truth], 1e-12)))) for t in grid]
            self.temperature = float(grid[int(np.argmax(loss))])

    def judge(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the best language, score, its entropy, rejected, known) of each text. The score is the calibrated share of the language among all, times how well the
        text fits the language at all."""
        entropy, n = self.entropies(texts)
        each, best = np.arange(len(texts)), entropy.argmin(axis=1)
        sure, lowest, known = self.confidence(entropy)[each, best], entropy[each, best], n > 0
        fits = np.ones(len(texts))
        for k, limit in enumerate(self.limits):
            if limit is not None:
                fits[best == k] = limit.accepted(lowest[best == k], n[best == k])
        return best, np.where(known, sure * fits, 0.0), np.where(known, lowest, 0.0), ~known | (fits < 0.5), known

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(nats per code in each language, codes) of each text. Each distinct gram is looked up once."""
        codes, row, counted = letters_of(texts)
        at = np.flatnonzero(counted)
        row = row[at]
        number, distinct = pd.factorize(grams(codes, self.order)[at])
        # Of several places that are written to one number the last write stays, so in reverse order the first place does.
        first = np.empty(len(distinct), np.int64)
        first[number[::-1]] = np.arange(len(at))[::-1]
        place = at[first]
        hashes = {n: grams(codes, n, place) for n in range(1, self.order + 1)}
        before = {0: np.zeros(len(place), np.uint64)} | {n: grams(codes, n, np.maximum(place - 1, 0)) for n in range(1, self.order)}
        n_codes = np.bincount(row, minlength=len(texts)).astype(np.int64)
        letters = np.bincount(row, (codes[at] != 32).astype(float), minlength=len(texts))
        out = np.zeros((len(texts), len(self.names)))
        p = np.full((len(place), len(self.names)), self.floor)
        for n in range(self.order):
            p = self.probability[n].find(hashes[n + 1]) + self.weight[n].find(before[n]) * p
        values = np.log(p)
        for k in range(len(self.names)):
            out[:, k] = -np.bincount(row, values[number, k], minlength=len(texts)) / np.maximum(n_codes, 1)
        return out, np.where(letters > 0, n_codes, 0)

    def confidence(self, entropy: np.ndarray, temperature: float | None = None) -> np.ndarray:
        t = self.temperature if temperature is None else temperature
        x = np.exp(-t * (entropy - entropy.min(axis=1, keepdims=True)))
        return x / x.sum(axis=1, keepdims=True)


def fold(doc_id, n: int):
    """crc32 of the id's decimal digits, modulo n; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")), F.lit(n))


def learn(labelled: DataFrame, per_language: int = DOCS_PER_LANGUAGE, order: int = ORDER) -> LanguageModels:
    """Models from rows with text and lang, neither null.

    About ``per_language`` distinct texts of each language are taken by a hash of the text (all of a language with fewer), read
    whole. The languages' counts and these texts come to the driver; copies of a text count once, so they thin nothing out.
    """
    rows = labelled.select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("_h", F.xxhash64("text", F.lit("language")))
    counts = {r["lang"]: r["n"] for r in rows.select("lang", "_h").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return LanguageModels({}, {}, order)
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, per_language / n))]), F.col("lang"))
    sample = rows.filter(F.pmod("_h", F.lit(1 << 30)) < share * F.lit(1 << 30)).dropDuplicates(["lang", "_h"]).toArrow().to_pylist()
    texts: dict[str, list[str]] = {k: [] for k in counts}
    held: dict[str, list[str]] = {k: [] for k in counts}
    for r in sorted(sample, key=lambda r: (r["lang"], r["_h"])):
        (held if r["_h"] % 10 == 0 and texts[r["lang"]] else texts)[r["lang"]].append(r["text"])
    return LanguageModels({k: v for k, v in texts.items() if v}, held, order)


def identify(docs: DataFrame, models: LanguageModels) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: the calibrated share of the best language, times how well the text fits it), entropy (nats per code) and ``rejected``
    (the text is not like the best language's own texts of its length; its score is low) for each whole text.

    A text that is null or has no letter, or any text if no language was learned, is ``und`` with score 0. Texts that fit two languages alike get the
    first by name. Repeated rows and rows without an id are judged like others; very long texts are read whole, in memory by themselves. Other columns are
    not read. An empty table gives an empty result. The models go to every executor: some megabytes a language, however much is labelled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for rows, data, offsets in blocks(batches, limit=1 << 20):
            raw = data.tobytes()
            texts = [raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace") for i in range(rows.num_rows)]
            if m.names:
                best, score, entropy, rejected, known = m.judge(texts)
                columns = [m.names[b] if k else "und" for b, k in zip(best, known, strict=True)], score, entropy, rejected
            else:
                columns = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts)), np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, columns)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those outside the fifth fold."""
    docs = read_table(spark, sf_dir, "documents")
    models = learn(docs.filter(fold(F.col("doc_id"), 5) != 0))
    out = identify(docs, models)
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")
