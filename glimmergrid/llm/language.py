"""Language identification by interpolated Kneser-Ney character models.

One model of letter trigrams per language. Counts of the highest order are
gathered in Spark over all rows that may be learned from; what the lower orders
need (how many different letters stand before a sequence) follows from them. The
interpolated probabilities of all languages lie in one sorted array of hashed
trigrams, next to arrays of the contexts and pairs that unseen trigrams fall
back on. A sequence holds a value for each language that has it, and none for the
others. A text's language is the one with the lowest cross-entropy per letter.

Rejection is calibrated: a text is accepted if its cross-entropy is within
``deviations`` standard deviations of what the language's own texts have, and the
temperature that turns cross-entropies into a probability is the one that makes
the labelled texts likeliest. Both are measured on all texts that were learned from.

No trigram is left out, however rare. The model grows with the number of different
(language, trigram) pairs, and the driver and each Python worker hold it whole: 8
bytes a different trigram and 12 a pair, and less for the lower orders. Calibration
is one pass over the whole texts that were learned from, scoring one over all.

Defined results: null texts, and texts without a letter, are ``und`` with score
0; if nothing can be learned all texts are ``und``; null languages are not
learned from, and languages that have only null texts get no model; rows that repeat an id count as separate texts; an empty table
gives an empty result.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import held_out, materialize, spread, table

UNKNOWN = "und"
SPACE = np.uint64(32)
WIDTH = np.uint64(21)
MIX = np.uint64(0x9E3779B97F4A7C15)
CHUNK = 1 << 20
#: Temperatures that calibration tries.
TEMPERATURES = [float(2**k) for k in np.arange(0, 9, 0.5)]

_letters: list[np.ndarray] = []


def symbols(text: str) -> np.ndarray:
    """Lower-case letters of a text as code points; anything between them is one space, as at both ends."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() and not 0xD800 <= c < 0xE000 for c in range(0x10000)] + [False]))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters[0][np.minimum(codes, 0x10000)]
    if (high := codes > 0xFFFF).any():
        found, back = np.unique(codes[high], return_inverse=True)
        letter[high] = np.array([chr(c).isalpha() for c in found])[back]
    codes = np.where(letter, codes, 32).astype(np.uint64)
    codes = np.concatenate(([SPACE], codes, [SPACE]))
    gap = codes == SPACE
    return np.concatenate(([SPACE], codes[~gap | np.concatenate(([True], ~gap[:-1]))]))


def trigrams(s: np.ndarray) -> np.ndarray:
    """The exact codes of all trigrams: three code points of 21 bits."""
    return (((s[:-2] << WIDTH) | s[1:-1]) << WIDTH) | s[2:]


def hashed(codes: np.ndarray) -> np.ndarray:
    """A one-to-one hash, so equal hashes are equal trigrams."""
    x = codes * MIX
    return x ^ (x >> np.uint64(32))


def count_trigrams(docs: DataFrame) -> DataFrame:
    """``lang``, ``code`` and ``n`` for all trigrams of ``docs`` (``lang``, ``text``)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        waiting: dict[str, list[np.ndarray]] = defaultdict(list)
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str) -> None:
            codes, n = np.unique(np.concatenate(waiting.pop(lang)), return_counts=True)
            if lang in sums:
                codes, back = np.unique(np.concatenate((sums[lang][0], codes)), return_inverse=True)
                n = np.bincount(back, np.concatenate((sums[lang][1], n))).astype(np.int64)
            sums[lang] = codes, n

        sizes: dict[str, int] = defaultdict(int)
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                codes = trigrams(symbols(text))
                waiting[lang].append(codes)
                sizes[lang] += len(codes)
                if sizes[lang] > CHUNK:
                    add(lang)
                    sizes[lang] = 0
        for lang in list(waiting):
            add(lang)
        for lang, (codes, n) in sums.items():
            yield pd.DataFrame({"lang": lang, "code": codes.astype(np.int64), "n": n})

    found = spread(docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")).mapInPandas(count, "lang string, code long, n long")
    return found.groupBy("lang", "code").agg(F.sum("n").alias("n"))


@dataclass
class Logs:
    """Log probabilities of sequences, each with the languages that have it."""

    #: Sorted hashes, and where the values of each begin (and the last ones end).
    keys: np.ndarray
    starts: np.ndarray
    languages: np.ndarray
    values: np.ndarray

    def put(self, codes: np.ndarray, out: np.ndarray) -> None:
        """Writes the values of the codes into ``out``, a row per code; where a language lacks one, ``out`` stays."""
        at, seen = find(self.keys, codes)
        rows, at = np.flatnonzero(seen), at[seen]
        n = self.starts[at + 1] - self.starts[at]
        places = np.arange(n.sum()) + np.repeat(self.starts[at] - np.cumsum(n) + n, n)
        out[np.repeat(rows, n), self.languages[places]] = self.values[places]


def gathered(parts: list[tuple[np.ndarray, np.ndarray]]) -> Logs:
    """The codes and values of each language as one table."""
    keys = np.concatenate([hashed(codes) for codes, _ in parts])
    languages = np.repeat(np.arange(len(parts), dtype=np.int32), [len(codes) for codes, _ in parts])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return Logs(keys[first], np.append(first, len(keys)), languages[order], np.concatenate([v.astype(np.float32) for _, v in parts])[order])


@dataclass
class LanguageModel:
    languages: list[str]
    trigrams: Logs | None = None
    #: The weights of contexts (two letters), and pairs.
    contexts: Logs | None = None
    pairs: Logs | None = None
    #: The weights of one letter as a context, and single letters.
    heads: Logs | None = None
    singles: Logs | None = None
    unseen: np.ndarray | None = None
    temperature: float = 20.0
    #: Per language, the highest cross-entropy that is accepted.
    limits: np.ndarray | None = None

    def log_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """A row per trigram with its log probability in each language."""
        codes, back = np.unique(codes, return_inverse=True)
        low, last = np.uint64((1 << 42) - 1), np.uint64((1 << 21) - 1)

        def weights(logs: Logs, wanted: np.ndarray) -> np.ndarray:
            found = np.zeros((len(codes), len(self.languages)), np.float32)
            logs.put(wanted, found)
            return found

        # From the lowest order up, each order replaces the value of those that it has.
        out = np.tile(self.unseen, (len(codes), 1))
        self.singles.put(codes & last, out)
        out += weights(self.heads, (codes >> WIDTH) & last)
        self.pairs.put(codes & low, out)
        out += weights(self.contexts, codes >> WIDTH)
        self.trigrams.put(codes, out)
        return out[back]

    def cross_entropies(self, texts: list[str | None]) -> np.ndarray:
        """A row per text with its cross-entropy per letter in each language; NaN for texts without a letter."""
        out = np.full((len(texts), len(self.languages)), np.nan)
        batch, held = [], 0

        def flush() -> None:
            starts = np.cumsum([0, *(len(c) for _, c in batch)])[:-1]
            logs = self.log_probabilities(np.concatenate([c for _, c in batch]))
            sums = np.add.reduceat(logs, starts, axis=0, dtype=np.float64)
            out[[i for i, _ in batch]] = -sums / np.array([[len(c)] for _, c in batch])

        for i, text in enumerate(texts):
            codes = trigrams(symbols(text or ""))
            # A text is its letters between spaces; without letters only the ends are left.
            total = None
            for k in range(0, len(codes) if len(codes) > 1 or (text and any(map(str.isalpha, text))) else 0, CHUNK):
                part = codes[k : k + CHUNK]
                if len(codes) <= CHUNK:
                    batch.append((i, part))
                    held += len(part)
                else:
                    sums = self.log_probabilities(part).sum(axis=0, dtype=np.float64)
                    total = sums if total is None else total + sums
            if total is not None:
                out[i] = -total / len(codes)
            if held > CHUNK // 2:
                flush()
                batch, held = [], 0
        if batch:
            flush()
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, probability and acceptance of each text."""
        h = self.cross_entropies(texts) if self.languages else np.full((len(texts), 1), np.nan)
        known = ~np.isnan(h).any(axis=1)
        best, score, accepted = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        if known.any():
            p = softmax(-h[known] * self.temperature)
            top = h[known].argmin(axis=1)
            score[known] = p[np.arange(len(top)), top]
            accepted[known] = h[known].min(axis=1) <= (self.limits[top] if self.limits is not None else np.inf)
            for i, k in zip(np.flatnonzero(known), top):
                best[i] = self.languages[k]
        return best, score, accepted


def find(keys: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the codes in a sorted hash array, and whether they are there."""
    wanted = hashed(codes)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def discount(counts: np.ndarray) -> float:
    """The absolute discount that the numbers of ones and twos suggest."""
    ones, twos = (counts == 1).sum(), (counts == 2).sum()
    return float(min(0.95, max(0.1, ones / (ones + 2 * twos)))) if ones else 0.5


def kneser_ney(by_language: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModel:
    """The models of all languages from their trigram codes and counts."""
    low, last = np.uint64((1 << 42) - 1), np.uint64((1 << 21) - 1)
    languages = sorted(by_language)
    size = len(np.unique(np.concatenate([np.unique(by_language[g][0] & last) for g in languages]))) + 1
    parts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
    unseens = []
    for g in languages:
        codes, n = by_language[g]
        d3 = discount(n)
        contexts, at = np.unique(codes >> WIDTH, return_inverse=True)
        context_n, context_types = np.bincount(at, n), np.bincount(at)
        pairs, pair_at, pair_n = np.unique(codes & low, return_inverse=True, return_counts=True)
        d2 = discount(pair_n)
        heads, head_at = np.unique(pairs >> WIDTH, return_inverse=True)
        head_n, head_types = np.bincount(head_at, pair_n), np.bincount(head_at)
        singles, single_at, single_n = np.unique(pairs & last, return_inverse=True, return_counts=True)
        single_p = (single_n + 0.5) / (single_n.sum() + 0.5 * size)
        head_weight, context_weight = d2 * head_types / head_n, d3 * context_types / context_n
        pair_p = (pair_n - d2) / head_n[head_at] + head_weight[head_at] * single_p[single_at]
        tri_p = (n - d3) / context_n[at] + context_weight[at] * pair_p[pair_at]
        parts["trigrams"].append((codes, np.log(tri_p)))
        parts["contexts"].append((contexts, np.log(np.maximum(context_weight, 1e-12))))
        parts["pairs"].append((pairs, np.log(pair_p)))
        parts["heads"].append((heads, np.log(np.maximum(head_weight, 1e-12))))
        parts["singles"].append((singles, np.log(single_p)))
        unseens.append(math.log(0.5 / (single_n.sum() + 0.5 * size)))
    return LanguageModel(languages, unseen=np.array(unseens, np.float32), **{k: gathered(v) for k, v in parts.items()})


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hold_out=held_out, deviations: float = 4.0) -> LanguageModel:
    """Learns from all rows that ``hold_out`` leaves, and calibrates on all of them."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter(~hold_out(F.col("id")) & F.col("lang").isNotNull())
    counts = materialize(count_trigrams(rows), "trigrams")
    languages = [r["lang"] for r in counts.select("lang").distinct().collect()]
    if not languages:
        return LanguageModel([])
    # Numbers instead of names, so that a row is three numbers on the driver.
    number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")).cast("int")
    got = counts.select(number.alias("lang"), "code", "n").toPandas()
    by_language = {}
    for k, part in got.groupby("lang"):
        codes, n = part["code"].to_numpy().astype(np.uint64), part["n"].to_numpy()
        order = np.argsort(codes)
        by_language[languages[k - 1]] = codes[order], n[order]
    del got
    model = kneser_ney(by_language)
    calibrate(model, rows, deviations)
    return model


def calibrate(model: LanguageModel, rows: DataFrame, deviations: float) -> None:
    """Sets temperature and limits from all texts of ``rows`` (``lang``, ``text``); a row a language reaches the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {g: k for k, g in enumerate(sent.value.languages)}
        for b in batches:
            h = sent.value.cross_entropies(list(b["text"]))
            good = ~np.isnan(h).any(axis=1)
            h, lang = h[good], b["lang"][good]
            own = np.array([number[g] for g in lang], int)
            at = np.arange(len(h))
            fits = np.stack([np.log(np.maximum(softmax(-h * t)[at, own], 1e-6)) for t in TEMPERATURES], axis=1)
            yield pd.DataFrame({"lang": lang.to_numpy(), "own": h[at, own], "fits": list(fits)})

    texts = rows.filter(F.col("lang").isin(model.languages)).select("lang", "text")
    measured = spread(texts).mapInPandas(measure, "lang string, own double, fits array<double>")
    fits = F.array(*(F.sum(F.col("fits")[i]) for i in range(len(TEMPERATURES))))
    told = {r["lang"]: r for r in measured.groupBy("lang").agg(F.avg("own").alias("mean"), F.stddev_pop("own").alias("std"), fits.alias("fits")).collect()}
    if told:
        total = np.sum([told[g]["fits"] for g in sorted(told)], axis=0)
        model.temperature = TEMPERATURES[int(np.argmax(total))]
    model.limits = np.array([told[g]["mean"] + deviations * max(told[g]["std"], 0.05) if g in told else np.inf for g in model.languages])


def identify(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (probability) and ``accepted`` (the calibrated rejection) to ``id_col`` and ``keep``."""
    schema = docs.select(id_col, *keep).schema
    names = schema.fieldNames()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best, score, accepted = sent.value.predict(list(b["__text"]))
            yield b[names].assign(lang_pred=best, score=score, accepted=accepted)

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", lang_pred string, score double, accepted boolean"
    return spread(docs.select(id_col, *keep, F.col(text_col).alias("__text"))).mapInPandas(predicted, out)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    told = identify(docs, fit_languages(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")
