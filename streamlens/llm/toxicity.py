"""Toxicity by weak supervision: lexicon and pattern voters, a generative model of their votes, a linear classifier on its posteriors.

Voters are the words of a small lexicon of common insults, words and word beginnings mined from a bounded sample of labelled
training rows, and surface patterns. Each votes toxic, votes clean or abstains. Expectation maximisation over the votes alone
estimates every voter's accuracy and, from the correlation of votes that the class does not explain, how much of its vote repeats
other voters'. A logistic model over words and word beginnings learns the posteriors and scores every text; labels take part only in
choosing voters and in the class prior.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import hash_bucket, id_text, map_slices
from .quality import labelled_sample

#: Most labelled rows of each label that the voters and the classifier are fitted on.
SAMPLE = 2500
#: Most voters mined from the sample, beside the lexicon and the patterns.
MINED = 400
#: Most terms (words and word beginnings) that the classifier weighs.
TERMS = 1000
FOLDS, HELD_OUT = 3, 1
#: How many times likelier a vote makes its class before anything is estimated, and what is added to counted votes.
FIRST_RATIO, SMOOTHING = 60.0, 0.05
THRESHOLD = 0.7
LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "filth", "vermin", "jerk", "hate you", "shut up", "kill yourself")
BEGINNINGS = (4, 5, 6)
_EDGE = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|/\\*#$%&@+=_~^`-«»“”‘’…¿¡"
_INSULT = r"(?:idiot|moron|fool|liar|loser|pig|rat|dog|coward|clown|freak|creep|brat|swine|scum|trash|filth|parasite|vermin|imbecile|disgrace|joke)s?"
_PATTERNS = {
    name: re.compile(pattern, re.I if fold else 0)
    for name, pattern, fold in (
        ("second-person insult", r"\byou(?:'re| are) (?:a |an |such |nothing but )?\w+!", True),
        ("insult noun", rf"\b{_INSULT}\b", True),
        ("you and an insult", rf"\byou\b[^.!?\n]{{0,40}}\b{_INSULT}\b", True),
        ("all of you", r"\b(?:all of you|you people|your kind|people like you|you lot)\b", True),
        ("telling to go", r"\b(?:get lost|go away|shut up|go to hell|drop dead|get out of here)\b", True),
        ("wish of harm", r"\b(?:hope|wish) (?:you|they|he|she) (?:die|rot|suffer|burn|choke)\b", True),
        ("threat", r"\b(?:i|we)(?:'ll| will| am going to) (?:hurt|kill|find|destroy|break|beat) (?:you|them|him|her)\b", True),
        ("nobody likes you", r"\b(?:nobody|no one|everyone) (?:likes|wants|hates|loves|needs) (?:you|them)\b", True),
        ("so stupid", r"\b(?:so|too|how|such|really) (?:stupid|dumb|pathetic|ugly|worthless|disgusting)\b", True),
        ("hate", r"\b(?:hate|despise|loathe) (?:you|them|him|her|those|these)\b", True),
        ("masked word", r"\b\w\*{2,}\w?\b", True),
        ("masked by signs", r"\b\w+[@#$%&]{2,}\w*\b", True),
        ("shouted word and marks", r"\b[A-Z]{4,}\b!{1,}", False),
        ("marks without end", r"!{3,}|\?!{1,}\?", False),
        ("German insult", r"\b(?:du|ihr|sie) (?:bist|seid|sind) (?:ein|eine|so|nur)? ?\w+!", True),
        ("German noun", r"\b(?:idiot|trottel|dummkopf|abschaum|versager|arsch\w*|schwein\w*)\b", True),
        ("Spanish insult", r"\b(?:eres|sois|son) (?:un |una |unos |tan )?\w+!", True),
        ("Spanish noun", r"\b(?:idiota|imb[eé]cil|est[uú]pid[oa]|basura|escoria|payaso|in[uú]til)e?s?\b", True),
        ("French insult", r"\b(?:tu es|vous [eê]tes) (?:un |une |des |si )?\w+ ?!", True),
        ("French noun", r"\b(?:imb[eé]cile|cr[eé]tin|connard|ordure|minable|abruti)e?s?\b", True),
    )
}


def words_of(text: str) -> set[str]:
    """The distinct words of a whole text, lower-cased, without punctuation at their ends."""
    found = {w.strip(_EDGE) for w in set(text.lower().split())}
    found.discard("")
    return found


_PHRASES = tuple(p for p in LEXICON if " " in p)


def phrases_of(text: str) -> set[str]:
    """The lexicon's phrases that a text has."""
    low = text.lower()
    return {p for p in _PHRASES if p in low}


def terms_of(word: str) -> list[str]:
    """The word and, marked by an ending *, its beginnings."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


@dataclass
class Detector:
    weights: dict[str, float]
    bias: float
    accuracies: dict[str, float] = field(default_factory=dict)
    correlations: dict[str, float] = field(default_factory=dict)
    _known: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def score(self, text: str) -> float:
        known, weights, found = self._known, self.weights, set()
        for w in set(text.lower().split()):
            got = known.get(w)
            if got is None:
                bare = w.strip(_EDGE)
                got = tuple(t for t in terms_of(bare) if t in weights) if bare else ()
                if len(known) < 200_000:  # a cache: beyond it words are looked up anew
                    known[w] = got
            found.update(got)
        for p in phrases_of(text):
            found.update(t for t in terms_of(p) if t in weights)
        total = self.bias + sum(weights[t] for t in sorted(found))  # each term once, as in training
        return float(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}


def label_model(votes: np.ndarray, prior: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic per row, accuracy per voter, weight per voter) of votes (rows x voters: 1 toxic, -1 clean, 0 abstains).

    The generative model: a row's class is drawn with the prior, and given the class each voter votes toxic, votes clean or abstains
    with chances of its own. Expectation maximisation estimates these from the votes and the prior; no label is seen. A voter's weight
    is one over one plus the sum of its strong correlations, within the classes, with other voters of the same votes, so that voters that repeat each
    other count as one. The accuracy of a voter is how often its votes are right."""
    n, m = votes.shape
    if not n or not m:
        return np.full(n, prior), np.zeros(m), np.ones(m)
    kinds = [(votes == v).astype(np.float64) for v in (1, -1, 0)]
    odds, weight = np.log(prior / (1 - prior)), np.ones(m)
    # At first each vote multiplies the odds of its class by FIRST_RATIO.
    posterior = 1 / (1 + np.exp(-np.clip(odds + votes.sum(1, dtype=np.float64) * np.log(FIRST_RATIO), -30, 30)))
    for k in range(rounds):
        if k % 10 == 0:
            # What the class leaves unexplained, of votes for the same class: a vote less the mean vote of its row's class.
            correlation = np.zeros((m, m))
            for kind in kinds[:2]:
                left = kind.copy()
                for belongs in (posterior, 1 - posterior):
                    left -= np.outer(belongs, belongs @ kind / max(belongs.sum(), 1e-9))
                spread = np.sqrt((left**2).sum(0))
                correlation = np.maximum(correlation, (left.T @ left) / np.maximum(np.outer(spread, spread), 1e-9))
            np.fill_diagonal(correlation, 0)
            correlation[correlation < 0.5] = 0
            weight = 1 / (1 + correlation.sum(0))
        told = np.full(n, odds)
        for kind in kinds:
            chance = [(belongs @ kind + SMOOTHING) / (belongs.sum() + 3 * SMOOTHING) for belongs in (posterior, 1 - posterior)]
            told += kind @ (weight * np.log(chance[0] / chance[1]))
        new = 1 / (1 + np.exp(-np.clip(told, -30, 30)))
        moved, posterior = np.abs(new - posterior).max(), new
        if moved < 1e-6 and k % 10:
            break
    return posterior, (posterior @ kinds[0] + (1 - posterior) @ kinds[1]) / np.maximum(kinds[0].sum(0) + kinds[1].sum(0), 1), weight


def _distinct(ids: list[int], names: list[str], rows: dict[int, np.ndarray], toxic: np.ndarray) -> list[int]:
    """ids of terms without those that an earlier term with the same first letters makes superfluous: it is in nine tenths of the toxic
    rows that they are in, at least, and in no clean row that they are not in. A word and its beginning would vote the same twice.
    rows: each term's rows; toxic: the rows' labels."""
    out: list[int] = []
    seen: dict[str, list[int]] = {}
    for k in dict.fromkeys(ids):
        same = seen.setdefault(names[k].rstrip("*")[: BEGINNINGS[0]], [])
        bad = rows[k][toxic[rows[k]]]

        def covers(j: int) -> bool:
            clean = rows[j][~toxic[rows[j]]]
            return np.isin(bad, rows[j]).sum() >= 0.9 * len(bad) and bool(np.isin(clean, rows[k]).all())  # noqa: B023

        if not any(covers(j) for j in same):
            same.append(k)
            out.append(k)
    return out


def _rows_of(ids: list[int], row: np.ndarray, col: np.ndarray) -> dict[int, np.ndarray]:
    """The rows of each of ids."""
    at = np.full(int(col.max()) + 1, -1)
    at[ids] = np.arange(len(ids))
    pick = at[col] >= 0
    which, where = at[col[pick]], row[pick]
    order = np.argsort(which, kind="stable")
    cuts = np.searchsorted(which[order], np.arange(len(ids) + 1))
    return {k: where[order[cuts[n] : cuts[n + 1]]] for n, k in enumerate(ids)}


def fit(rows: Iterable[tuple[Iterable[str], Iterable[str], int]]) -> Detector:
    """A detector from (words, patterns matched, label) of sampled rows; from none, one that weighs the lexicon alone. Terms are held as numbers, each text of them once."""
    number: dict[str, int] = {}
    held, labels, patterns = [], [], []
    for words, matched, label in rows:
        held.append(np.unique(np.fromiter((number.setdefault(t, len(number)) for w in words for t in terms_of(w)), np.int32)))
        patterns.append([name in matched for name in _PATTERNS])
        labels.append(label)
    if not held:
        return Detector({w: 6.0 for w in LEXICON}, -4.0)
    y, names = np.array(labels), list(number)
    row, col = np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held]), np.concatenate(held)
    toxic, every = (np.bincount(col[pick], minlength=len(names)) for pick in (y[row] == 1, slice(None)))
    clean = every - toxic
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    # Mined voters: at least four toxic rows, and thirty times as common among toxic rows as among clean ones.
    ratio = (toxic / n1) / ((clean + 0.5) / n0)
    mined = sorted(np.flatnonzero((toxic >= 4) & (ratio >= 30)).tolist(), key=lambda k: (-toxic[k] * min(ratio[k], 1000), names[k]))[: 4 * MINED]
    ids = list(dict.fromkeys([*(number[w] for w in LEXICON if w in number), *mined]))
    voters = _distinct(ids, names, _rows_of(ids, row, col), y == 1)[:MINED]
    # Patterns vote if they are five times as common among toxic rows.
    matched = np.array(patterns, bool)
    heard = [p for p in range(len(_PATTERNS)) if matched[y == 1, p].mean() >= 5 * (matched[y == 0, p].sum() + 0.5) / n0] if n1 and (y == 1).any() else []
    at = np.full(len(names), -1)
    at[voters] = np.arange(len(voters))
    votes = np.zeros((len(held), len(voters) + len(heard) + 1), np.int8)
    hit = at[col] >= 0
    votes[row[hit], at[col[hit]]] = 1
    votes[:, len(voters) : -1] = matched[:, heard]
    votes[:, -1] = np.where((votes[:, :-1] > 0).any(1), 0, -1)  # the voter for clean: no term and no pattern at all
    prior = float(np.clip(y.mean(), 0.02, 0.98))
    posterior, accuracy, weight = label_model(votes, prior)

    # The classifier's terms: the voters, and others that the posterior makes at least fifty times as common among toxic rows.
    mass = np.bincount(col, posterior[row], len(names))
    ratio = (mass / max(posterior.sum(), 1e-9)) / ((every - mass + 0.5) / max((1 - posterior).sum(), 1e-9))
    more = sorted(np.flatnonzero((every >= 5) & (ratio >= 50)).tolist(), key=lambda k: (-ratio[k] * mass[k], names[k]))
    more = list(dict.fromkeys([*voters, *more]))[: 4 * TERMS]
    chosen = _distinct(more, names, _rows_of(more, row, col), y == 1)[:TERMS]
    at = np.full(len(names), -1)
    at[chosen] = np.arange(len(chosen))
    hit = at[col] >= 0
    weights, bias = _logistic(row[hit], at[col[hit]], len(chosen), posterior)
    kept = {names[k]: float(w) for k, w in zip(chosen, weights, strict=True) if abs(w) > 1e-4}
    told = [*(names[k] for k in voters), *(list(_PATTERNS)[p] for p in heard), "no term"]
    return Detector(kept, bias, dict(zip(told, accuracy.tolist(), strict=True)), dict(zip(told, (1 / weight - 1).tolist(), strict=True)))


def _logistic(row: np.ndarray, col: np.ndarray, m: int, target: np.ndarray, ridge: float = 0.0005, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic model of soft targets with a ridge on the weights, by damped Newton steps."""
    x = np.zeros((len(target), m + 1))
    x[row, col], x[:, m] = 1, 1
    penalty = np.full(m + 1, ridge)
    penalty[m] = 1e-6
    w = np.zeros(m + 1)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((np.logaddexp(0, z) - target * z).sum() + (penalty * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (p - target) + penalty * w
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * move) > now:
            size /= 2
        w = w - size * move
        before, now = now, loss(w)
        if before - now < 1e-7 * max(1.0, before):
            break
    return w[:m], float(w[m])


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Detector:
    """A detector from rows whose fold is not HELD_OUT; the driver gets the sample's distinct words only."""
    sample = labelled_sample(docs, labels, "toxic", hash_bucket(FOLDS) != HELD_OUT, most)

    def seen(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        words = [sorted(words_of(t) | phrases_of(t)) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(["\n".join(w) for w in words]), pa.array(["\n".join(n for n, p in _PATTERNS.items() if p.search(t)) for t in texts])], ["doc_id", "y", "words", "patterns"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    found = map_slices(sample.select("doc_id", "text", "y"), seen, f"doc_id {kind}, y int, words string, patterns string").toPandas().sort_values("doc_id")  # an id once: 2 * most rows at most
    return fit((w.split("\n"), p.split("\n"), int(y)) for w, p, y in zip(found["words"], found["patterns"], found["y"], strict=True))


def score(docs: DataFrame, detector: Detector, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; a null text scores as an empty one. An empty table gives none; other columns are ignored."""
    rows = id_text(docs, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast(detector)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        one = held.value.score
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(t or "") for t in batch.column(1).to_pylist()], pa.float64())], ["doc_id", "score"])

    return map_slices(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, columns unchanged, that score below threshold. Texts are scored where they lie: no join, no shuffle.

    A null text scores as an empty one; a null id and repeated rows are rows like any other; a score of just threshold goes; an empty
    table gives none; without labels the lexicon alone scores."""
    held = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    names = docs.columns

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                one = held.value.score
                yield part.filter(pa.array([one(t or "") < threshold for t in part.column(names.index("text")).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
