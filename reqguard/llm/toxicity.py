"""Toxicity by a lexicon trie met with Levenshtein automata, and the context of what they find.

The lexicon is learned from labelled rows: words, and stems that several such words share, which
stand in toxic texts far more often than chance allows.  Its words make a trie; the automaton of all
strings within an edit or two of any of them is intersected with the trie and made deterministic as
far as tokens walk it, so a token costs one table lookup per letter, and most are dead after three.
All tokens of a batch take their steps together.

A found term is then looked at in its window: between quotation marks or after a reporting word it
counts as quoted, near a second-person word as aimed at somebody.  A logistic regression weighs the
counts.  It sees nothing but the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .words import slices

# Labelled rows used for fitting: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
THRESHOLD = 0.3
WINDOW = 60
STEM_LENGTHS = (4, 5, 6, 7)

# STEMMED is added to EXACT or NEAR where the token also begins with a stem.
NONE, EXACT, NEAR, STEM, STEMMED = 0, 1, 2, 3, 4
# --- Fixed values: words and marks that tell how a term is used ----------------------------------
QUOTES = "\"“”„«»‟"
REPORTING = re.compile(
    r"\b(?:said|says|wrote|writes|called|calls|quote[sd]?|word|term|dit|écrit|appelé|sagte|schrieb|nannte|wort|dijo|escribió|llamó|palabra)\b"
)
SECOND_PERSON = re.compile(r"\b(?:you|your|you're|u|ur|du|dich|dir|dein\w*|ihr|euch|tu|te|toi|ton|vous|tú|ti|usted|vosotros)\b")
# --- end of fixed values -------------------------------------------------------------------------
FEATURES = 11


def edits_allowed(word: str) -> int:
    """Short words have too many neighbours."""
    return 0 if len(word) < 5 else 1 if len(word) < 9 else 2


# States kept from one batch to the next; a batch that begins with more starts from none.
MAX_STATES = 1 << 16


class Automaton:
    """The words within their allowed edits, and everything else that begins with a stem.

    A position is (trie node, edits so far), or (-1, 0) once a stem has been passed; a state is a set
    of positions without those that another one of the same node makes needless.  State 0 is dead,
    1 the start.  States and steps are worked out when a token first asks for them, so memory follows
    the tokens met and is bounded by ``MAX_STATES`` and a batch, and only the lexicon is ever sent.
    A word found, exact or near, is told as such also where a stem has been passed.
    """

    def __init__(self, words: tuple[str, ...], stems: tuple[str, ...]) -> None:
        self.words, self.stems = words, stems
        self._children: list[dict[str, int]] = [{}]
        self._budget, self._ends, self._stem_end = [0], [-1], [False]
        for w in words:
            node = self._insert(w, edits_allowed(w))
            self._ends[node] = max(self._ends[node], edits_allowed(w))
        for s in stems:
            self._stem_end[self._insert(s, 0)] = True
        self._alphabet = sorted({c for node in self._children for c in node})
        self.letters = {c: k + 1 for k, c in enumerate(self._alphabet)}
        # Letter class of every code point of the basic plane: 0 unknown to the lexicon.
        self.classes = np.zeros(0x10000, np.int32)
        for letter, k in self.letters.items():
            if ord(letter) < 0x10000:
                self.classes[ord(letter)] = k
        self._restart()

    def __reduce__(self):
        return build, (self.words, self.stems)

    def _insert(self, term: str, allowed: int) -> int:
        node = 0
        self._budget[0] = max(self._budget[0], allowed)
        for c in term:
            if c not in self._children[node]:
                self._children[node][c] = len(self._children)
                self._children.append({})
                self._budget.append(0)
                self._ends.append(-1)
                self._stem_end.append(False)
            node = self._children[node][c]
            self._budget[node] = max(self._budget[node], allowed)
        return node

    def _restart(self) -> None:
        # One object for each position, whatever the number of states that have it.
        self._known: dict[tuple[int, int], tuple[int, int]] = {}
        self._numbers: dict[frozenset[tuple[int, int]], int] = {}
        self._states: list[frozenset[tuple[int, int]]] = []
        self.step = np.full((64, len(self._alphabet) + 1), -1, np.int32)
        self.result = np.zeros(64, np.int8)
        for state in (frozenset(), self._closed({(0, 0)}), frozenset({(-1, 0)})):
            self._number(state)
        self.step[0], self.step[2] = 0, 2

    def _closed(
        self, positions: Iterable[tuple[int, int]], base: Iterable[tuple[int, int]] = ()
    ) -> frozenset[tuple[int, int]]:
        """The state of ``positions``, and of those of ``base``, which is a state."""
        todo, best = list(positions), dict(base)
        while todo:
            node, e = todo.pop()
            if node < 0:
                best[node] = e
                continue
            if e > self._budget[node] or best.get(node, 99) <= e:
                continue
            best[node] = e
            if e < self._budget[node]:
                todo += [(child, e + 1) for child in self._children[node].values()]
        return frozenset(self._known.setdefault(p, p) for p in best.items())

    def _told(self, state: frozenset[tuple[int, int]]) -> int:
        hits = [e for node, e in state if node >= 0 and e <= self._ends[node]]
        if hits:
            return (EXACT if min(hits) == 0 else NEAR) + STEMMED * ((-1, 0) in state)
        return STEM if (-1, 0) in state else NONE

    def _number(self, state: frozenset[tuple[int, int]]) -> int:
        k = self._numbers.setdefault(state, len(self._states))
        if k == len(self._states):
            self._states.append(state)
            if k == len(self.step):
                self.step = np.concatenate([self.step, np.full_like(self.step, -1)])
                self.result = np.concatenate([self.result, np.zeros_like(self.result)])
            self.result[k] = self._told(state)
        return k

    def _work_out(self, k: int, kind: int) -> None:
        """The step from state ``k`` by a letter class, and by all that lead where an unknown letter does."""
        state = self._states[k]
        if self.step[k, 0] < 0:
            # Whatever the letter: it is one too many, or stands for another.
            edited = {p for p in state if p[0] < 0}
            other = np.ones(self.step.shape[1], bool)
            for node, e in state - edited:
                children = self._children[node]
                if e < self._budget[node]:
                    edited.add((node, e + 1))
                    edited.update((x, e + 1) for x in children.values())
                other[[self.letters[c] for c in children]] = False
            target = self._number(self._closed(edited))
            self.step[k, other] = target
        if self.step[k, kind] < 0:
            c = self._alphabet[kind - 1]
            found = [(self._children[node][c], e) for node, e in state if node >= 0 and c in self._children[node]]
            if any(self._stem_end[child] and e == 0 for child, e in found):
                found.append((-1, 0))
            target = self._number(self._closed(found, self._states[self.step[k, 0]]))
            self.step[k, kind] = target

    def fresh(self) -> None:
        """Before a batch, whose tokens hold state numbers until its end."""
        if len(self._states) > MAX_STATES:
            self._restart()

    def follow(self, state: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The next state of each token."""
        to = self.step[state, kind]
        asked = to < 0
        if asked.any():
            width = self.step.shape[1]
            for pair in np.unique(state[asked].astype(np.int64) * width + kind[asked]).tolist():
                k, letter = divmod(pair, width)
                if self.step[k, letter] < 0:
                    self._work_out(k, letter)
            to = self.step[state, kind]
        return to


@lru_cache(maxsize=2)
def _built(words: tuple[str, ...], stems: tuple[str, ...]) -> Automaton:
    return Automaton(words, stems)


def build(words: Iterable[str], stems: Iterable[str]) -> Automaton:
    """The automaton of a lexicon; a worker keeps its last ones, with what they have worked out."""
    return _built(tuple(words), tuple(stems))


_WORD_CHAR: np.ndarray | None = None


def _word_chars() -> np.ndarray:
    global _WORD_CHAR
    if _WORD_CHAR is None:
        _WORD_CHAR = np.array([chr(c).isalnum() for c in range(0x10000)])
    return _WORD_CHAR


def find(automaton: Automaton, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms found in lower-cased texts: text number, start and end in it, result; and words per text.

    A token is a run of letters and digits, with ``@ $ *`` in its midst.
    """
    joined = "\n".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    low = np.minimum(points, 0xFFFF)
    inside = _word_chars()[low] | (points > 0xFFFF)
    if len(points) > 2:
        mark = (points == 0x40) | (points == 0x24) | (points == 0x2A)
        mark[1:-1] &= inside[:-2] & inside[2:]
        mark[[0, -1]] = False
        inside |= mark
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    words = np.diff(np.searchsorted(start, begin))
    automaton.fresh()
    kind = automaton.classes[low]
    state = np.ones(len(start), np.int32)
    alive = np.arange(len(start))
    found_at, found = [], []
    at = start.copy()
    while len(alive):
        state = automaton.follow(state, kind[at])
        at = at + 1
        done = at == end[alive]
        if done.any():
            r = automaton.result[state[done]]
            found_at.append(alive[done][r > 0])
            found.append(r[r > 0])
        go = ~done & (state != 0)
        alive, state, at = alive[go], state[go], at[go]
    which = np.concatenate(found_at) if found_at else np.zeros(0, np.int64)
    result = np.concatenate(found) if found else np.zeros(0, np.int8)
    order = np.argsort(which, kind="stable")
    which, result = which[order], result[order]
    owner = np.searchsorted(begin, start[which], side="right") - 1
    return owner, start[which] - begin[owner], end[which] - begin[owner], result, words


class Lines:
    """The line that each term of a text stands in, for terms in ascending order: one pass over the text."""

    __slots__ = ("text", "begin", "marks", "_at")

    def __init__(self, text: str) -> None:
        self.text, self.begin, self.marks, self._at = text, 0, 0, 0

    def reach(self, start: int) -> None:
        """``begin`` is where the line around ``start`` begins, ``marks`` its quotation marks before ``start``."""
        newline = self.text.rfind("\n", self._at, start)
        if newline >= 0:
            self.begin = self._at = newline + 1
            self.marks = 0
        self.marks += sum(self.text.count(q, self._at, start) for q in QUOTES)
        self._at = start


def context(lines: Lines, start: int, end: int) -> tuple[bool, bool]:
    """Whether a term is quoted, and whether it is aimed at somebody, from its window."""
    lines.reach(start)
    before = lines.text[max(lines.begin, start - WINDOW) : start]
    after = lines.text[end : end + WINDOW].partition("\n")[0]
    # An odd number of marks before it in its line, and another one after it.
    quoted = lines.marks % 2 == 1 and any(q in after for q in QUOTES)
    quoted = quoted or REPORTING.search(before[-30:]) is not None
    aimed = SECOND_PERSON.search(before) is not None or SECOND_PERSON.search(after) is not None
    return quoted, aimed and not quoted


def features(automaton: Automaton, texts: list[str]) -> np.ndarray:
    """A row for each text: (plain, quoted) counts of exact, stem and near terms, aimed, share, any exact, stems."""
    lowered = [t.lower() for t in texts]
    owner, start, end, result, words = find(automaton, lowered)
    counts = np.zeros((len(texts), 7))
    strong = np.zeros(len(texts))
    of, lines = -1, Lines("")
    for i, s, e, r in zip(owner.tolist(), start.tolist(), end.tolist(), result.tolist(), strict=True):
        if i != of:
            of, lines = i, Lines(lowered[i])
        quoted, aimed = context(lines, s, e)
        kind = r & 3
        counts[i, 2 * ({EXACT: 0, STEM: 1, NEAR: 2}[kind]) + quoted] += 1
        # That it begins with a stem tells something of a word, too.
        counts[i, 2 + quoted] += r > STEMMED
        strong[i] += not quoted and (r > STEMMED or kind != NEAR)
        counts[i, 6] += aimed
    out = np.zeros((len(texts), FEATURES))
    out[:, :7] = np.log1p(counts)
    out[:, 7] = np.minimum(100 * strong / np.maximum(words, 20), 10) / 10
    stemmed = counts[:, 2] + counts[:, 3]
    out[:, 8] = counts[:, 0] + counts[:, 1] > 0
    out[:, 9] = stemmed > 0
    out[:, 10] = stemmed > 1
    return out


def held_out(doc_id: Column) -> Column:
    """Rows never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """(text, toxic) of at most about ``bound`` labelled rows that are not held out.

    A row is in iff the hash of its id is among the ``bound`` smallest of the labelled ids, so only
    its text moves.  Ids with several labels count as toxic if one says so; null labels and null ids
    teach nothing.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("doc_id"))
    cut = known.select("_h").orderBy("_h").limit(bound).agg(F.max("_h").alias("cut")).first()["cut"]
    if cut is None:
        cut = -(1 << 63)
    few = docs.select("doc_id", "text").where(F.xxhash64("doc_id") <= cut)
    return stored(few.join(known.where(F.col("_h") <= cut), "doc_id").select("doc_id", "text", "toxic"))


def learn_lexicon(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems whose share of toxic texts is beyond chance, for all that were looked at."""
    tokens = F.array_distinct(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}]+"))
    long = F.filter(tokens, lambda w: F.length(w) >= STEM_LENGTHS[0])
    rows = sample.select("toxic", long.alias("words"))
    totals = rows.agg(F.count_if(F.col("toxic") == 1), F.count(F.lit(1))).first()
    n_toxic, n = int(totals[0]), int(totals[1])
    if not 0 < n_toxic < n:
        return [], []
    base = n_toxic / n

    def counted(items: Column) -> DataFrame:
        exploded = rows.select("toxic", F.explode(items).alias("term"))
        return exploded.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count(F.lit(1)).alias("n"))

    def beyond_chance(by_term: DataFrame, purity: float) -> DataFrame:
        looked_at = max(2, by_term.count())
        evidence = F.col("t") * F.log(F.col("t") / F.col("n") / base)
        sure = by_term.where((F.col("t") >= 3) & (F.col("t") >= purity * F.col("n")))
        return sure.where(evidence > float(np.log(looked_at)) + 1.0)

    def starts(words: Column) -> Column:
        return F.flatten(
            F.transform(words, lambda w: F.transform(F.array(*map(F.lit, STEM_LENGTHS)), lambda k: F.substring(w, F.lit(1), k)))
        )

    by_word = stored(counted(F.col("words")))
    # What comes to the driver is bounded by the sample.
    words = [r["term"] for r in beyond_chance(by_word, max(0.5, min(3 * base, 0.9))).select("term").collect()]
    # A stem stands for words that share it, each perhaps too rare to be learned.
    families = by_word.select("term", F.explode(F.array_distinct(starts(F.array("term")))).alias("stem"))
    families = families.groupBy("stem").agg(F.count(F.lit(1)).alias("family")).where("family >= 3")
    # Clean texts have single words of such a family too; how many a text has is for the weights.
    sure = beyond_chance(stored(counted(F.array_distinct(starts(F.col("words"))))), 0.3)
    found = sure.join(families, F.col("term") == F.col("stem")).select("term", "t", "n").collect()
    stems: list[str] = []
    for r in sorted(found, key=lambda r: (-r["t"] * np.log(r["t"] / r["n"] / base), len(r["term"]), r["term"])):
        if not any(r["term"].startswith(s) or s.startswith(r["term"]) for s in stems):
            stems.append(r["term"])
    return sorted(words), sorted(stems)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression (the last is the constant), by Newton steps."""
    design = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(design.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + penalty * w
        curve = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class Model:
    automaton: Automaton
    weights: np.ndarray

    def score(self, texts: list[str]) -> np.ndarray:
        x = features(self.automaton, texts)
        z = x @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(0)):
            texts = pc.fill_null(batch.column(0).slice(lo, hi - lo), "").to_pylist()
            x = features(automaton, texts)
            flat = pa.array(x.reshape(-1))
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * FEATURES)
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(offsets, flat), batch.column(1).slice(lo, hi - lo).cast(pa.int32())], ["x", "toxic"]
            )


def train(docs: DataFrame, labels: DataFrame, bound: int = MAX_LABELLED) -> Model:
    """Lexicon and weights from at most ``bound`` labelled rows; without any, a model that says no."""
    sample = labelled_sample(docs, labels, bound)
    words, stems = learn_lexicon(sample)
    automaton = build(words, stems)
    rows = (
        sample.select("text", F.col("toxic").cast("int").alias("toxic"))
        .mapInArrow(lambda batches: _featured(batches, automaton), "x array<double>, toxic int")
        .toPandas()
    )
    y = rows["toxic"].to_numpy(dtype=float)
    if not len(y) or y.min() == y.max():
        return Model(automaton, np.concatenate([np.zeros(FEATURES), [-5.0]]))
    return Model(automaton, fit(np.vstack(rows["x"].to_list()), (y > 0).astype(float)))


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in slices(batch.column(1)):
            texts = pc.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array(model.score(texts))], ["doc_id", "score"]
            )


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``; a narrow pass.

    A null or empty text has no term and gets the score of such texts.  Ids may be null (not held
    out) or repeated; an empty table gives no rows; other columns are not read.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = slim.mapInArrow(lambda batches: _scored(batches, model), "doc_id bigint, score double")
    return rows.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _verdicts(texts: Iterator[pa.Array], model: Model) -> Iterator[pa.Array]:
    for column in texts:
        parts = [model.score(pc.fill_null(column.slice(lo, hi - lo), "").to_pylist()) for lo, hi in slices(column)]
        yield pa.array(np.concatenate(parts) if parts else np.zeros(0))


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns.

    A null text scores as an empty one.  A score depends on the text alone, so equal texts stay or
    go together, and repeated rows and clashing names are of no matter.  An empty table gives no rows.
    """

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from _verdicts(texts, model)

    score.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    column = F.arrow_udf(score, "double")
    return docs.where(column(F.col(text)) < threshold)
