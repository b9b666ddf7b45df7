"""Toxicity: a lexicon learned from labels, misspellings by Levenshtein automata over its trie, and context windows.

*Lexicon.*  From labelled training rows: all words, and stems of three to eight letters, that far more toxic than clean rows
hold (smoothed log odds of their row frequencies, and a likelihood ratio that chance alone exceeds once in 370,000 terms).
*Automaton.*  All words of the lexicon that may have an edit form a trie; a state is the set of
(trie node, edits so far), the product of the trie with the Levenshtein automata of all its words, and its transitions are
made when they are first needed and kept.  A word that can reach no term dies after a few letters.  Words of 4 to 7
letters may have one edit, longer ones two.  A word that clean training rows hold twice or more is a word of its own and no misspelling.
*Context.*  Each hit is looked at in a window of ``CONTEXT`` words on either
side: between quotation marks that open before and close after it, it counts as quotation, else as abuse.  A logistic
regression over these sums, fitted on a part of the training rows that the lexicon hasn't seen, gives the score.  Each of
those rows is fitted twice, as it is and with its hits taken for misspelled ones, since misspellings are rare among labelled
rows; no weight is below 0.  Quoted hits enter only the sum of their own, which has no weight where no labelled row quotes.

Fitting takes at most ``TRAIN_ROWS`` labelled rows of either class, those with the smallest hashes of their ids (a
documented bound; it doesn't depend on the order of rows).  All rows are scored, over whole texts.

A row whose label is null, or with several labels that differ, is no training row.  Null and empty texts have no hits and
get the score of a text without hits.  Without training rows of both classes the score is 0.  A null id is held out.
Only id and text of the scored table are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import table

TRAIN_ROWS, LEAST_TOXIC, LEAST_ODDS, LEAST_RATIO, CONTEXT, PREDICT = 8_000, 4, 2.5, 22.0, 8, 0.7
STEMS = range(3, 9)
_OPEN, _CLOSE, _EVEN = "“«‘„‹", "”»’“›", "\"'"
_STRIP = "".join(chr(c) for c in range(128) if not chr(c).isalnum()) + _OPEN + _CLOSE + "…–—¿¡"
FEATURES = ("abuse", "best", "misspelled", "quoted", "share", "terms")
KEPT_WORDS = 300_000


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def bare(word: str) -> str:
    return word.strip(_STRIP).lower()


def allowed(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 8 else 2


class Automaton:
    """The product of a trie of terms with their Levenshtein automata, determinised as far as words lead."""

    def __init__(self, terms: dict[str, float], kept: int = 50_000):
        self.children: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        for t in terms:
            node = 0
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                node = self.children[node][ch]
            self.term[node] = t
        self.most = [0] * len(self.children)  # edits that some term below a node may still have
        for n in reversed(range(len(self.children))):
            self.most[n] = max([allowed(self.term[n]) if self.term[n] else 0, *(self.most[c] for c in self.children[n].values())])
        self.weights, self.kept = terms, kept
        self.start = self._close({0: 0})
        self.moves: dict[tuple, dict[str, tuple]] = {}

    def _close(self, state: dict[int, int]) -> tuple:
        todo = list(state.items())
        while todo:  # a letter of the term that the word lacks
            n, e = todo.pop()
            for c in self.children[n].values():
                if e + 1 <= self.most[c] and state.get(c, 99) > e + 1:
                    state[c] = e + 1
                    todo.append((c, e + 1))
        return tuple(sorted(state.items()))

    def _move(self, state: tuple, ch: str) -> tuple:
        out: dict[int, int] = {}

        def reach(n: int, e: int) -> None:
            if e <= self.most[n] and out.get(n, 99) > e:
                out[n] = e

        for n, e in state:
            reach(n, e + 1)  # a letter too many
            for x, c in self.children[n].items():
                reach(c, e + (x != ch))
        return self._close(out)

    def match(self, word: str) -> tuple[float, int]:
        """(weight, edits) of the best term within its number of edits of the word, fewest edits first; (0, 0) if none."""
        state = self.start
        for ch in word:
            moves = self.moves.get(state)
            if moves is None:
                if len(self.moves) > self.kept:
                    self.moves.clear()
                moves = self.moves[state] = {}
            to = moves.get(ch)
            if to is None:
                to = moves[ch] = self._move(state, ch)
            if not to:
                return 0.0, 0
            state = to
        ends = [(e, -self.weights[t]) for n, e in state if (t := self.term[n]) and e <= allowed(t)]
        if not ends:
            return 0.0, 0
        e, w = min(ends)
        return -w, e


class Scorer:
    """Features of texts under a lexicon of weights: "fuzzy" terms, exact "words", "stems", and "ordinary" words that are no misspellings."""

    def __init__(self, lexicon: dict[str, dict[str, float]]):
        self.automaton, self.exact, self.stems, self.seen = Automaton(lexicon["fuzzy"]), lexicon["words"], lexicon["stems"], {}
        self.ordinary = lexicon.get("ordinary", {})

    def word(self, raw: str) -> tuple[str, float, int] | None:
        """(what is matched, weight, edits) or None."""
        w = bare(raw)
        if len(w) < 3:
            return None
        if w in self.exact:
            return w, self.exact[w], 0
        stems = [(self.stems[w[:k]], w[:k]) for k in STEMS if w[:k] in self.stems]
        if stems:
            s, stem = max(stems)
            return stem, s, 0
        if w in self.ordinary:
            return None
        weight, edits = self.automaton.match(w)
        return (w, weight, edits) if weight else None

    def features(self, text: str, misspelled: bool = False) -> list[float]:
        """With ``misspelled``, all hits of four or more letters count as misspelled."""
        words, seen = text.split(), self.seen
        if len(seen) > KEPT_WORDS:
            seen.clear()
        for w in set(words):
            if w not in seen:
                seen[w] = self.word(w)
        hits = [i for i, w in enumerate(words) if seen[w]]
        abuse = wrong = quoted = best = 0.0
        terms, said = set(), 0
        for i in hits:
            term, weight, edits = seen[words[i]]
            if is_quoted(words, i):
                quoted += weight
                continue
            said += 1
            if edits or misspelled and allowed(term):
                wrong += weight
            else:
                abuse += weight
                best = max(best, weight)
                terms.add(term)
        return [math.log1p(abuse), best, math.log1p(wrong), math.log1p(quoted), math.log1p(100 * said / max(1, len(words))), math.log1p(len(terms))]


def is_quoted(words: list[str], i: int) -> bool:
    """Whether quotation marks open in the window before (or at the start of) word i and close after (or at its end)."""
    before = [*words[max(0, i - CONTEXT) : i], words[i]]
    after = words[i : i + 1 + CONTEXT]
    opened = False
    for k, w in enumerate(before):
        if w[0] in _OPEN or w[0] in _EVEN:
            opened = True
        if k < len(before) - 1 and len(w.rstrip(".,;:!?")) > 1 and w.rstrip(".,;:!?")[-1] in _CLOSE + _EVEN:
            opened = False
    return opened and any(len(x := w.rstrip(".,;:!?")) > 1 and x[-1] in _CLOSE + _EVEN for w in after)


def training(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic, part) of at most ``rows`` labelled training rows of either class; part 0 is for the lexicon, 1 for the fit."""
    one = labels.filter("toxic IN (0, 1)").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("__most")).filter("toxic = __most AND doc_id IS NOT NULL").drop("__most")
    one = one.withColumn("__fold", fold(F.col("doc_id"))).filter("__fold <> 1")
    order = F.xxhash64("doc_id")
    taken = [one.filter(F.col("toxic") == t).orderBy(order, "doc_id").limit(rows) for t in (0, 1)]
    ids = taken[0].unionByName(taken[1]).select("doc_id", "toxic", (F.col("__fold") == 2).cast("int").alias("part"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "toxic", "part")  # at most 2 * rows


def learn_lexicon(rows: DataFrame) -> dict[str, dict[str, float]]:
    """The terms that tell toxic rows from clean ones, and the words of clean rows that lie within a misspelling of a term; both
    are collected, bounded by the words of the sample."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: tuple[Counter, Counter] = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w for w in map(bare, set(text.split())) if len(w) > 2 and w.isalpha()}
                both[toxic].update(words)
                both[toxic].update({w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
                both[toxic][""] += 1
            terms = list(both[0].keys() | both[1].keys())
            yield pa.RecordBatch.from_pydict({"term": terms, "clean": pa.array([both[0][t] for t in terms], pa.int64()), "toxic": pa.array([both[1][t] for t in terms], pa.int64())})

    n = rows.select("text", "toxic").mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).persist()
    whole = n.filter("term = ''").first()
    out: dict[str, dict[str, float]] = {"fuzzy": {}, "words": {}, "stems": {}, "ordinary": {}}
    if whole and whole["c"] and whole["t"]:
        odds = F.log((F.col("t") + 0.5) / (whole["t"] + 1)) - F.log((F.col("c") + 0.5) / (whole["c"] + 1))
        # likelihood ratio of the term's rows being toxic more often than all rows are
        p = whole["t"] / (whole["t"] + whole["c"])
        part = lambda k, q: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (F.col("t") + F.col("c")) / q)).otherwise(0.0)
        rated = n.filter("term <> ''").withColumn("w", odds)
        best = rated.filter((F.col("t") >= LEAST_TOXIC) & (F.col("w") >= LEAST_ODDS) & (2 * (part("t", p) + part("c", 1 - p)) >= LEAST_RATIO))
        out = choose({r["term"]: (r["t"], r["w"]) for r in best.collect()})
        if out["fuzzy"]:
            terms = out["fuzzy"]

            def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                automaton = Automaton(terms)
                for batch in batches:
                    yield pa.RecordBatch.from_pydict({"term": pa.array([w for w in batch.column(0).to_pylist() if automaton.match(w)[0]], pa.string())})

            plain = rated.filter(~F.col("term").endswith("*") & (F.col("c") >= 2) & (F.col("w") < LEAST_ODDS)).select("term")
            out["ordinary"] = {r["term"]: 0.0 for r in plain.mapInArrow(near, "term string").collect()}
    n.unpersist()
    return out


def choose(found: dict[str, tuple[int, float]]) -> dict[str, dict[str, float]]:
    """A stem stays unless one word makes up half of its rows; a word is matched by itself unless it has a stem that stays.
    The automaton has the words with and without such a stem: a misspelling may break the stem too."""
    words = {t: x for t, x in found.items() if not t.endswith("*")}
    stems = {t[:-1]: x for t, x in found.items() if t.endswith("*")}
    most: dict[str, int] = {}
    for w, (t, _) in words.items():
        for k in STEMS:
            if len(w) >= k:
                most[w[:k]] = max(most.get(w[:k], 0), t)
    kept = {s: w for s, (t, w) in stems.items() if 2 * most.get(s, 0) < t}
    alone = {w: x for w, x in words.items() if not any(w[:k] in kept for k in STEMS)}
    return {"fuzzy": {w: x for w, (_, x) in words.items() if allowed(w)}, "words": {w: x for w, (_, x) in alone.items()}, "stems": kept}


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression with no weight below 0, by Newton steps on the weights that are free: (mean, scale, weights with the intercept last)."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    free = np.ones(z.shape[1], bool)
    keep = np.append(np.full(x.shape[1], ridge), 0.01)
    for _ in range(2 * len(free)):
        w, own = np.zeros(len(free)), z[:, free]
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(own @ w[free], -30, 30)))
            step = np.linalg.solve(own.T @ (own * (p * (1 - p))[:, None]) + np.diag(keep[free]), own.T @ (y - p) - keep[free] * w[free])
            w[free] += step
            if np.abs(step).max() < 1e-8:
                break
        below = np.flatnonzero(w[:-1] < 0)
        if not len(below):
            break
        free[below[np.argmin(w[below])]] = False  # one at a time: without it, others may be positive
    return mean, scale, np.where(free, w, 0.0)


_SCORERS: dict[str, Scorer] = {}


def scorer_of(lexicon: dict) -> Scorer:
    """The process's scorer for a lexicon; its automaton and word table outlive the tasks of a worker."""
    key = repr(lexicon)
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(lexicon)
    return _SCORERS[key]


def _features(lexicon: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(lexicon)
        for batch in batches:
            x = [scorer.features(t, wrong) for t in batch.column(0).to_pylist() for wrong in (False, True)]
            keys = pa.array(np.repeat(batch.column(1).to_numpy(), 2))
            yield pa.RecordBatch.from_arrays([keys, pa.array(x, pa.list_(pa.float64()))], names=["key", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> dict | None:
    """{"lexicon", "mean", "scale", "weights"}, or None without rows of both classes."""
    sample = training(docs, labels, rows).persist()
    try:
        lexicon = learn_lexicon(sample.filter("part = 0"))
        got = sample.filter("part = 1").select("text", F.col("toxic").cast("long")).mapInArrow(_features(lexicon), "key long, x array<double>").collect()  # at most 4 * rows
    finally:
        sample.unpersist()
    y = np.array([r["key"] for r in got], float)
    if not len(y) or y.min() == y.max():
        return None
    mean, scale, weights = fit(np.array([r["x"] for r in got]), y)
    return {"lexicon": lexicon, "mean": mean, "scale": scale, "weights": weights}


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score, n_hits_share) with the score of every row."""
    source = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(id_col).cast("long").alias("key"))
    if model is None:
        return source.select(F.col("key").alias("doc_id"), F.lit(0.0).alias("score"), F.lit(0.0).alias("abuse"), F.lit(0.0).alias("misspelled"), F.lit(0.0).alias("quoted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, w = scorer_of(model["lexicon"]), model["weights"]
        for batch in batches:
            x = np.array([scorer.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(FEATURES))
            z = (x - model["mean"]) / model["scale"] @ w[:-1] + w[-1]
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, (1 / (1 + np.exp(-np.clip(z, -30, 30))), x[:, 0], x[:, 2], x[:, 3]))], names=["doc_id", "score", "abuse", "misspelled", "quoted"])

    return source.mapInArrow(run, "doc_id long, score double, abuse double, misspelled double, quoted double")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(True)).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "abuse", "misspelled", "quoted")


QUERIES = {"op2_toxicity": op2_toxicity}
SQL: dict[str, str] = {}
