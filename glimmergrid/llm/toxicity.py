"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned: words, and word beginnings, that stand in toxic documents
and hardly in others. They form a trie. Each token of a text runs through the
product of that trie and the Levenshtein automaton of its entries, which finds
entries within the edit bound and so also misspelled ones. The product is made
deterministic as states are met and kept for the next token. Words that single
digits or marks cut ("id1ot", "i.d.i.o.t") run through it whole and without them,
too.

A hit counts by the log odds of its entry and edit distance. An entry that the
sample hardly shows misspelled backs off to how toxic its exact hits are. A window of tokens
around each hit separates quotation (quotation marks around it) from abuse; the
two sums, and a constant, go through a fitted logistic function.

The model is fitted on a bounded sample of labelled rows: at most
``rows_per_class`` of each label, chosen by hash of the id. Words are counted in
Spark; the driver gets only lexicon candidates, those of each toxic sample row, and
three numbers a sample row.
Scoring is one pass over the rows, without a shuffle.

Defined results: null and empty texts have no hits and get the score of a text
without hits; rows that repeat an id are scored alike by their own texts; with
no labelled rows of one kind the score is constant; an empty table gives an
empty result.
"""

from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmergrid.llm.common import held_out, materialize, spread, table

WORD = re.compile(r"[^\W\d_]+")
# Marks that open or close a quotation.
QUOTES = "\"“”„«»‹›"
#: Words with a digit or mark between each two of them, and these digits and marks.
JOINED = re.compile(rf"(?<![^\W\d_])[^\W\d_]++(?:(?:[^\w\s{QUOTES}]|[\d_])[^\W\d_]++)+")
BETWEEN = re.compile(r"[\W\d_]")
#: Hits with an edit from which on an entry's own are enough, and how many of its exact ones make up for fewer.
ENOUGH = 3
#: What is quoted doesn't speak for or against a word when the lexicon is learned.
QUOTED = f"[{QUOTES}][^{QUOTES}\n]+[{QUOTES}]"
#: What an automaton keeps at most before it forgets everything and starts anew: results of tokens, states, moves.
KNOWN, STATES, MOVES = 200_000, 20_000, 400_000


@dataclass
class Entry:
    """A word of the lexicon, or the beginning of words if ``stem``."""

    text: str
    stem: bool
    #: Log odds of an exact hit and of one with an edit.
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0])


class Automaton:
    """The trie of all entries, intersected with their Levenshtein automata."""

    def __init__(self, entries: list[Entry], edits: int = 1, least: int = 5):
        self.edits, self.entries = edits, entries
        #: Entries that are too short to be recognised with an edit allow none.
        self.allowed = [edits if len(e.text) >= least else 0 for e in entries]
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        for k, e in enumerate(entries):
            node = 0
            for c in e.text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                node = self.children[node][c]
            self.ends[node].append(k)
        self._forget()

    def _forget(self) -> None:
        """Drops all that was kept, so that a task's memory doesn't grow with its texts; results stay the same."""
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.seen: list[tuple[dict[int, int], dict[int, int]]] = []
        self.known: dict[str, tuple] = {}
        self.made = 0
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The state for trie nodes with their least edits; skipped letters of an entry count as edits."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if e < self.edits and nodes.get(node) == e:
                for child in self.children[node].values():
                    if nodes.get(child, self.edits + 1) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            found: tuple[dict[int, int], dict[int, int]] = ({}, {})
            for node, e in key:
                for k in self.ends[node]:
                    if e <= self.allowed[k]:
                        part = found[self.entries[k].stem]
                        part[k] = min(e, part.get(k, e))
            self.seen.append(found)
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.edits and e < nodes.get(node, self.edits + 1):
                nodes[node] = e

        for node, e in self.sets[state]:
            reach(node, e + 1)
            for letter, child in self.children[node].items():
                reach(child, e + (letter != c))
        self.moves[state][c] = got = self._state(nodes) if nodes else -1
        self.made += 1
        return got

    def hits(self, token: str) -> tuple[tuple[int, int], ...]:
        """The entries that ``token`` is within the bound of, with their edits."""
        found = self.known.get(token)
        if found is None:
            found = self.known[token] = self._run(token)
        return found

    def _run(self, token: str) -> tuple[tuple[int, int], ...]:
        if len(self.sets) > STATES or self.made > MOVES or len(self.known) > KNOWN:
            self._forget()
        state, best = self.start, {}
        for c in token:
            move = self.moves[state].get(c)
            state = self._move(state, c) if move is None else move
            if state < 0:
                break
            for k, e in self.seen[state][1].items():
                best[k] = min(e, best.get(k, e))
        if state >= 0:
            best |= self.seen[state][0]
        return tuple(sorted(best.items()))

    def joined_hits(self, token: str) -> tuple[tuple[int, int], ...]:
        """The entries that words joined by digits or marks spell together, and none of them alone."""
        found = self.known.get(token)
        if found is None:
            alone = {k for word in WORD.findall(token) for k, _ in self.hits(word)}
            best = dict(self._run(token))
            # Without what cuts it the word is misspelled all the same.
            for k, e in self._run(BETWEEN.sub("", token)):
                if self.allowed[k]:
                    best[k] = min(max(e, 1), best.get(k, self.edits))
            found = self.known[token] = tuple(sorted((k, e) for k, e in best.items() if k not in alone))
        return found


    def chunk_hits(self, chunk: str) -> tuple[tuple[int, int], ...]:
        """The entries that the words between two white spaces hit, alone or joined."""
        if chunk.isalpha():
            return self.hits(chunk)
        key = f" {chunk}"
        found = self.known.get(key)
        if found is None:
            alone = [h for word in WORD.findall(chunk) for h in self.hits(word)]
            joined = [h for word in JOINED.findall(chunk) for h in self.joined_hits(word)]
            found = self.known[key] = tuple(dict.fromkeys(alone + joined))
        return found


@dataclass
class ToxicityModel:
    entries: list[Entry]
    #: Constant, factor of abuse, factor of quotation.
    factors: tuple[float, float, float]
    window: int = 6


def text_hits(automaton: Automaton, text: str, window: int) -> list[tuple[int, int, bool]]:
    """(entry, edits, quoted) for the hits of a text; without quotation marks, each word of it counts once."""
    lower = text.lower()
    hit = sorted(c for c in set(lower.split()) if automaton.chunk_hits(c))
    if not hit or not any(q in lower for q in QUOTES):
        return [(k, e, False) for c in hit for k, e in automaton.chunk_hits(c)]
    tokens = list(WORD.finditer(lower))
    found = []

    def add(got: tuple[tuple[int, int], ...], first: int, last: int) -> None:
        before = lower[tokens[max(0, first - window)].start() : tokens[first].start()]
        after = lower[tokens[last].end() : tokens[min(len(tokens) - 1, last + window)].end()]
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        found.extend((k, e, quoted) for k, e in got)

    for i, m in enumerate(tokens):
        if got := automaton.hits(m.group()):
            add(got, i, i)
    starts = None
    for m in JOINED.finditer(lower):
        if got := automaton.joined_hits(m.group()):
            starts = starts or [t.start() for t in tokens]
            add(got, bisect_left(starts, m.start()), bisect_left(starts, m.end()) - 1)
    return found


def sums(model: ToxicityModel, hits: list[tuple[int, int, bool]]) -> tuple[float, float]:
    """Log odds of abuse and of quotation: each entry counts once, with its best hit."""
    best: dict[tuple[int, bool], float] = {}
    for k, e, quoted in hits:
        key = (k, quoted)
        best[key] = max(best.get(key, 0.0), model.entries[k].weights[e])
    return sum(w for (_, q), w in best.items() if not q), sum(w for (_, q), w in best.items() if q)


def logistic(features: np.ndarray, labels: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Coefficients of a ridge logistic regression, by Newton steps."""
    beta = np.zeros(features.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(features @ beta, -30, 30)))
        slope = features.T @ (labels - p) - ridge * beta
        step = np.linalg.solve((features * (p * (1 - p))[:, None]).T @ features + ridge * np.eye(len(beta)), slope)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return beta


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int, id_col: str, text_col: str, hold_out) -> DataFrame:
    """At most about ``rows_per_class`` rows of each label, by hash of the id: ``id``, ``text``, ``label``. Of rows that repeat an id one is taken."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("label")).filter(F.col("label").isin(0, 1)).groupBy("id").agg(F.max("label").alias("label"))
    marks = marks.filter(~hold_out(F.col("id")))
    held = {r["label"]: r["n"] for r in marks.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("label") == 1, rows_per_class / max(1, held.get(1, 0))).otherwise(rows_per_class / max(1, held.get(0, 0)))
    chosen = marks.filter(F.pmod(F.xxhash64("id", F.lit(29)), F.lit(1_000_000)) < share * 1_000_000)
    # The sample's ids number about twice ``rows_per_class``, whatever the corpus; so they go to the texts.
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    # Of rows that repeat an id one is enough; they are combined before they move, so the sample stays as small as its ids are.
    rows = rows.groupBy("id", "label").agg(F.min_by(F.struct("text"), F.xxhash64("text")).alias("row"))
    return materialize(rows.select("id", "row.text", "label"), "sample")


def fit_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    hold_out=held_out,
    rows_per_class: int = 10_000,
    least_documents: int = 5,
    stems: tuple[int, ...] = (4, 5, 6, 7, 8),
    edits: int = 1,
    window: int = 6,
) -> ToxicityModel:
    """Learns lexicon, weights and factors from a bounded sample of labelled rows."""
    sample = labelled_sample(docs, labels, label, rows_per_class, id_col, text_col, hold_out)
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        constant = math.log((toxic + 0.5) / (clean + 0.5))
        return ToxicityModel([], (constant, 0.0, 0.0), window)
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(F.lower("text"), QUOTED, " "), F.lit(r"(\p{L}+)")))
    terms = F.array_distinct(F.concat(words, *[F.transform(F.filter(words, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.concat(F.left(w, F.lit(n)), F.lit("*"))) for n in stems]))
    per_text = sample.select("id", "label", F.md5("text").alias("same"), terms.alias("terms")).dropDuplicates(["same"])
    exploded = per_text.select("id", "label", F.explode("terms").alias("term"))
    counts = exploded.groupBy("term").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    strong = counts.filter(F.col("toxic") >= least_documents).withColumn("odds", odds).filter("odds > 3")
    strong = materialize(strong, "lexicon")
    held = exploded.filter("label = 1").join(F.broadcast(strong.select("term")), "term").groupBy("id").agg(F.collect_list("term").alias("terms")).collect()
    entries = cover([r["terms"] for r in held], {r["term"]: r["odds"] for r in strong.collect()}, least_documents)
    return weigh(sample, entries, toxic, clean, edits, window)


def cover(documents: list[list[str]], odds: dict[str, float], least: int, times: int = 6) -> list[Entry]:
    """Entries in the order of how many documents they explain that ``times`` earlier ones don't.

    Words of documents that are copies of each other come in bundles. What
    already explains such documents leaves no gain to the rest of the bundle.
    A word and the beginnings of it are one explanation of a document.
    """
    members: dict[str, set[int]] = {}
    for i, terms in enumerate(documents):
        for t in terms:
            members.setdefault(t, set()).add(i)
    explained: list[list[str]] = [[] for _ in documents]
    needs = [times] * len(documents)
    chosen: list[Entry] = []
    # Gains only fall, so the first term whose gain is still what it was is the best; equal gains go to the later term.
    rank = {t: -n for n, t in enumerate(sorted(members))}
    best = [(-len(m) * odds[t], rank[t], t) for t, m in members.items()]
    heapq.heapify(best)
    while best:
        was, _, term = heapq.heappop(best)
        gained = {i for i in members[term] if needs[i]}
        if len(gained) < least:
            continue
        if -len(gained) * odds[term] > was:
            members[term] = gained
            heapq.heappush(best, (-len(gained) * odds[term], rank[term], term))
            continue
        chosen.append(Entry(term.rstrip("*"), term.endswith("*"), [odds[term], 0.0]))
        for i in gained:
            if not any(begins(term, t) or begins(t, term) for t in explained[i]):
                needs[i] -= 1
            explained[i].append(term)
    return chosen


def begins(term: str, other: str) -> bool:
    """Whether a term is a beginning of words, and of this other term."""
    return term.endswith("*") and other.startswith(term[:-1])


def weights(exact: tuple[int, int] | None, misspelled: tuple[int, int], toxic: int, clean: int, learned: float) -> list[float]:
    """Log odds of exact and misspelled hits from their toxic and clean rows.

    With few misspelled hits, as many are added as are lacking, toxic and clean as
    the exact ones are. ``learned`` are the odds of an entry without exact hits
    outside quotations.
    """

    def odds(t: float, c: float) -> float:
        return max(0.0, math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1)))

    if exact is None:
        ratio = math.exp(learned) * (toxic + 1) / (clean + 1)
        share = ratio / (1 + ratio)
    else:
        share = (exact[0] + 0.5) / (sum(exact) + 1)
    lacking = max(0, ENOUGH - sum(misspelled))
    first = learned if exact is None else odds(*exact) if sum(exact) >= 3 else 0.0
    return [first, odds(misspelled[0] + lacking * share, misspelled[1] + lacking * (1 - share))]


def weigh(sample: DataFrame, entries: list[Entry], toxic: int, clean: int, edits: int, window: int) -> ToxicityModel:
    """Log odds of exact and misspelled hits, then the factors of the logistic function."""
    model = ToxicityModel(entries, (0.0, 1.0, 1.0), window)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(entries, edits)
        for b in batches:
            hits = [sorted({(k, e) for k, e, quoted in text_hits(automaton, t or "", window) if not quoted}) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "hits": [[k * 2 + e for k, e in h] for h in hits]})

    hits = sample.select("text", "label").mapInPandas(found, "label int, hits array<int>").select("label", F.explode("hits").alias("hit"))
    counts = {r["hit"]: (r["toxic"], r["clean"]) for r in hits.groupBy("hit").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).collect()}
    for k, entry in enumerate(entries):
        entry.weights = weights(counts.get(2 * k), counts.get(2 * k + 1, (0, 0)), toxic, clean, entry.weights[0])

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(model.entries, edits)
        for b in batches:
            pairs = [sums(model, text_hits(automaton, t or "", window)) for t in b["text"]]
            yield pd.DataFrame({"label": b["label"], "abuse": [p[0] for p in pairs], "quoted": [p[1] for p in pairs]})

    got = sample.select("text", "label").mapInPandas(features, "label int, abuse double, quoted double").toPandas()
    x = np.column_stack([np.ones(len(got)), got["abuse"], got["quoted"]])
    model.factors = tuple(float(b) for b in logistic(x, got["label"].to_numpy(float)))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), edits: int = 1) -> DataFrame:
    """Adds to ``id_col`` and ``keep``: ``score`` (0 to 1), ``abuse``, ``quoted`` (log odds) and ``terms`` (entries hit).

    Only the text goes to Python, and only the result comes back; other columns stay with Spark.
    """

    @F.pandas_udf("score double, abuse double, quoted double, terms array<string>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = Automaton(model.entries, edits)
        a, b, c = model.factors
        for texts in parts:
            hits = [text_hits(automaton, t or "", model.window) for t in texts]
            pairs = np.array([sums(model, h) for h in hits], float).reshape(-1, 2)
            z = a + b * pairs[:, 0] + c * pairs[:, 1]
            terms = [sorted({model.entries[k].text for k, _, _ in h}) for h in hits]
            yield pd.DataFrame({"score": 1 / (1 + np.exp(-np.clip(z, -30, 30))), "abuse": pairs[:, 0], "quoted": pairs[:, 1], "terms": terms})

    rows = spread(docs.select(*dict.fromkeys([id_col, *keep, text_col])))
    # Said to be non-deterministic, as a filter on the score would else run it a second time.
    told = rows.select(id_col, *keep, scored.asNondeterministic()(text_col).alias("__told"))
    return told.select(id_col, *keep, "__told.*")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    told = score_toxicity(docs, model)
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "terms")
