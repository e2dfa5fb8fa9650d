"""Toxicity of chat messages.

Method: a trie of lexicon terms and stems is intersected with Levenshtein automata.  A state holds the trie nodes still
reachable and the least edits for each; states are built when first met and then kept, so a word costs one step per
letter and most words die after a few.  Terms found, spelled right or not, are weighed by the words around them: marks
of quotation and reporting verbs speak for a quotation, address speaks for abuse.  A logistic model turns the counts of
a message into a score.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from parcelgrid.llm.batches import keyed, map_rows
from parcelgrid.session import cut_lineage

#: Messages of each class that the lexicon and the weights are fitted on, at most.
FIT_ROWS = 2_000
MOST_TERMS, MOST_BEGINNINGS, LONGEST_STEM, LEAST_LIFT = 300, 5_000, 12, 8
WINDOW = 5
KEPT_STATES, KEPT_WORDS = 200_000, 300_000
_WORD = re.compile(r"[^\W_]+(?:[*@$!0-9]+[^\W_]+)*")
_QUOTES = re.compile("[\"“”„«»‘’]")
REPORTING = frozenset(
    "said says say called calls wrote writes quoted quote quotes word term sagte schrieb nannte zitat dit écrit appelé "
    "citation dijo escribió llamó cita".split()
)
ADDRESS = frozenset("you your youre u ur du dich dein ihr sie tu te toi ton vous usted tú tus eres es bist are".split())
FEATURES = 5


class Lexicon:
    """Trie of terms and the automaton over it: terms of eight letters may have two edits, of four one, shorter none.

    An edit is a letter inserted, left out or replaced.  A stem stands for every word that starts with it as it is
    spelled.
    """

    def __init__(self, terms: Iterable[str], stems: Iterable[str] = ()):
        self.terms = sorted(set(terms))
        self.stems = frozenset(stems)
        self.stem_sizes = sorted({len(s) for s in self.stems})
        self.next: list[dict[str, int]] = [{}]
        self.budget, self.final = [-1], [-1]
        for k, term in enumerate(self.terms):
            node, allowed = 0, (len(term) >= 4) + (len(term) >= 8)
            self.budget[0] = max(self.budget[0], allowed)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.budget.append(-1)
                    self.final.append(-1)
                node = self.next[node][c]
                # most edits that any term below a node allows
                self.budget[node] = max(self.budget[node], allowed)
            self.final[node] = k
        self.allowed = [(len(t) >= 4) + (len(t) >= 8) for t in self.terms]
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple[tuple[int, int], ...], int] = {}
        self.sets: list[tuple[tuple[int, int], ...]] = []
        self.steps: list[dict[str, int]] = []
        self.words: dict[str, int] = {}
        self.start = self._state({0: 0}) if self.terms else -1

    def _state(self, reach: dict[int, int]) -> int:
        """Number of the state with these nodes and edits, after adding letters of terms that a word may leave out."""
        queue = list(reach)
        while queue:
            node = queue.pop()
            for child in self.next[node].values():
                edits = reach[node] + 1
                if edits <= self.budget[child] and edits < reach.get(child, 99):
                    reach[child] = edits
                    queue.append(child)
        key = tuple(sorted(reach.items()))
        if not key:
            return -1
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        reach: dict[int, int] = {}
        for node, edits in self.sets[state]:
            if edits < self.budget[node]:
                reach[node] = min(edits + 1, reach.get(node, 99))
            for letter, child in self.next[node].items():
                cost = edits + (letter != c)
                if cost <= self.budget[child]:
                    reach[child] = min(cost, reach.get(child, 99))
        self.steps[state][c] = new = self._state(reach)
        return new

    def match(self, word: str) -> int:
        """Least edits to a term within its allowance, or -1."""
        known = self.words.get(word)
        if known is not None:
            return known
        if len(self.words) > KEPT_WORDS or len(self.sets) > KEPT_STATES:
            self._reset()
        state = self.start
        for c in word:
            if state < 0:
                break
            step = self.steps[state].get(c)
            state = self._step(state, c) if step is None else step
        best = -1
        if state >= 0:
            ends = [e for node, e in self.sets[state] if (k := self.final[node]) >= 0 and e <= self.allowed[k]]
            best = min(ends, default=-1)
        if best != 0 and self._stem_of(word):
            best = 0
        self.words[word] = best
        return best

    def _stem_of(self, word: str) -> bool:
        return any(word[:n] in self.stems for n in self.stem_sizes)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Terms met exactly and with edits, both outside quotations; terms in quotations; address; density."""
    match = lexicon.match
    hits = {w: e for w in set(words_of(text)) if (e := match(w)) >= 0}
    if not hits:
        return [0.0] * FEATURES
    low = text.lower()
    spans = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(low)]
    exact = fuzzy = quoted = address = 0.0
    for i, (start, end, word) in enumerate(spans):
        edits = hits.get(word, -1)
        if edits < 0:
            continue
        left, right = max(0, i - WINDOW), min(len(spans), i + WINDOW + 1)
        near = {w for _, _, w in spans[left:right]} - {word}
        marks = _QUOTES.search(low, spans[left][0], start) and _QUOTES.search(low, end, spans[right - 1][1] + 1)
        if marks or near & REPORTING:
            quoted += 1
        elif edits == 0:
            exact += 1
        else:
            fuzzy += 1
        address += bool(near & ADDRESS)
    met = exact + fuzzy + quoted
    return [min(exact, 4.0), min(fuzzy, 4.0), min(quoted, 4.0), min(address, 4.0), float(np.sqrt(met / len(spans)))]


@dataclass(frozen=True)
class ToxicityModel:
    terms: tuple[str, ...]
    stems: tuple[str, ...]
    weights: np.ndarray
    bias: float


def fit_toxicity(
    messages: DataFrame, labels: DataFrame, message_id: str = "message_id", content: str = "content",
    toxic: str = "toxic", fit_rows: int = FIT_ROWS,
) -> ToxicityModel:
    """Lexicon and weights from labelled messages; ``labels`` has the ids and 0 or 1.

    At most ``fit_rows`` labels of each class are used, those first in the order of a hash of the id, and one message
    for each.  This bounds what is broadcast, what is read again, and what reaches the driver (five numbers per
    message, and the beginnings of words that are candidates).  Terms and stems come from the beginnings of words, see
    ``pick_terms``; at most ``MOST_TERMS`` are kept.  Without labelled messages there are none, and every score is
    that of no evidence.
    """
    marks = labels.select(F.col(message_id).alias("key"), F.col(toxic).alias("toxic")).filter("key IS NOT NULL")
    parts = [
        marks.filter(F.col("toxic") == k).distinct().orderBy(F.xxhash64("key"), "key").limit(fit_rows) for k in (0, 1)
    ]
    chosen = cut_lineage(parts[0].unionByName(parts[1]))
    rows = keyed(messages, message_id, content=content).filter("content IS NOT NULL")
    # the ids are bounded by fit_rows; repeated ids keep one message
    sample = cut_lineage(rows.join(F.broadcast(chosen), "key").dropDuplicates(["key", "toxic"]))
    sizes = dict(sample.groupBy("toxic").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)

    def beginnings(batches):
        for batch in batches:
            seen, whole, label = [], [], []
            for text, t in zip(batch.column("content").to_pylist(), batch.column("toxic").to_pylist()):
                words = set(words_of(text))
                own = {w[:n] for w in words for n in range(3, min(len(w), LONGEST_STEM) + 1)}
                seen += own
                whole += [w in words for w in own]
                label += [t] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(seen, pa.string()), pa.array(whole, pa.bool_()), pa.array(label, pa.int32())],
                ["word", "whole", "toxic"],
            )

    typed = sample.select("content", F.col("toxic").cast("int").alias("toxic"))
    counted = typed.mapInArrow(beginnings, "word string, whole boolean, toxic int").groupBy("word").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"),
        F.sum(F.col("toxic") * F.col("whole").cast("int")).alias("whole"),
    )
    lift = (F.col("bad") / max(n1, 1)) / ((F.col("good") + 1) / max(n0, 1))
    strong = counted.filter((F.col("bad") >= 3) & (F.col("bad") >= 0.01 * n1) & (lift >= LEAST_LIFT))
    best = strong.orderBy(F.col("bad").desc(), "word").limit(MOST_BEGINNINGS).collect()
    terms, stems = pick_terms({r.word: (r.bad, r.whole) for r in best})

    def measure(batches):
        lexicon = Lexicon(terms, stems)
        for batch in batches:
            x = [features(t, lexicon) for t in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("toxic")], ["x", "toxic"])

    got = typed.mapInArrow(measure, "x array<double>, toxic int").collect()
    weights, bias = fit_logistic(np.array([r.x for r in got]).reshape(-1, FEATURES), np.array([r.toxic for r in got], float))
    return ToxicityModel(terms, stems, weights, bias)


def pick_terms(found: dict[str, tuple[int, int]]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Terms and stems from the beginnings of words that mark toxic messages.

    ``found`` gives for each beginning the toxic messages it is in, and those where it is a whole word.  From each
    shortest beginning the longest one is taken that keeps nine tenths of its messages.  It is a term if it mostly is
    a whole word, otherwise a stem.
    """
    terms, stems = [], []
    longer: dict[str, list[str]] = {}
    for word in found:
        longer.setdefault(word[:-1], []).append(word)
    for root in sorted(w for w in found if not any(w[:n] in found for n in range(1, len(w)))):
        word = root
        while nexts := [w for w in longer.get(word, ()) if found[w][0] >= 0.9 * found[root][0]]:
            word = max(nexts, key=lambda w: (found[w][0], w))
        bad, whole = found[word]
        (terms if whole >= 0.5 * bad else stems).append(word)
    strongest = sorted(terms + stems, key=lambda w: (-found[w][0], w))[:MOST_TERMS]
    return tuple(w for w in terms if w in strongest), tuple(w for w in stems if w in strongest)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias by Newton's method."""
    if not len(y):
        return np.zeros(FEATURES), -2.0
    a = np.column_stack((x, np.ones(len(y))))
    w = np.zeros(a.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def score_toxicity(
    messages: DataFrame, model: ToxicityModel, message_id: str = "message_id", content: str = "content"
) -> DataFrame:
    """Score of every chat message from 0 to 1: ``message_id, score``, one row per input row.

    Whole texts are read.  Null and empty contents score as messages without evidence; a null id stays null; extra
    columns are ignored.  The model is a few hundred terms.  No shuffle.
    """

    def make():
        lexicon = Lexicon(model.terms, model.stems)

        def work(part: pa.RecordBatch):
            x = np.array([features(t or "", lexicon) for t in part.column("content").to_pylist()])
            z = x.reshape(-1, FEATURES) @ model.weights + model.bias
            return [pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())]

        return work

    return map_rows(keyed(messages, message_id, content=content), "content", make, "score double", message_id)
