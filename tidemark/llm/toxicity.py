"""Abusive, hateful or sexual content: a subsequence string kernel with Nystroem landmarks and a support vector machine.

Texts are cut into sentences and their spelling is evened out (accents, look-alike letters, digits for letters, invisible
characters, stretched and spaced-out words). The kernel of two sentences counts the character subsequences of lengths 3 to 5 they share, with any gaps within a span of
six characters or with one character skipped after every letter, each skip discounted, over the roots of their lengths: an insult with characters masked or put in
still shares most of its subsequences. The kernel against bounded landmarks, whitened, gives the coordinates in which the machine is trained. As the kernel is an inner
product of (hashed) subsequence counts, the trained machine is one weight per subsequence: scoring costs the same however many landmarks there are.

Labels are per document. The sentences of good documents are good; of a bad document, only those that score highest are
bad, found in turns: train, pick, train again. Bad documents without any such sentence and good ones with a very high one are
taken for wrong ratings and left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import combinations, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, hinted, ship
from . import seeds

#: Labelled documents that the machine is fitted on at most; of more, those of the smallest hash of doc_id.
LABELLED = 20_000
#: Characters they have together at most; documents beyond it, in the same order, are not fitted on.
LABELLED_CHARS = 40_000_000
#: Documents without a label that the fit sees at most, those of the smallest hash of doc_id, and their characters together.
BACKGROUND, BACKGROUND_CHARS = 3000, 6_000_000
#: Deals of the documents into folds whose machines are averaged.
DEALS = 3
#: Sentences of good documents that take part in the training at most, landmarks, and hashed subsequences.
GOOD_SENTENCES, LANDMARKS, FEATURES = 60_000, 300, 1 << 16
#: Folds and turns of picking (up to twice as many while wrong ratings come to light); sentences picked from bad documents, and hard good ones kept per turn, at most.
FOLDS, TURNS, BAD_SENTENCES, HARD = 3, 4, 3000, 1500
#: A bad document's worst sentence is accepted from ACCEPT on, further ones from SURE; good ones from DOUBT on are taken for wrong ratings.
ACCEPT, SURE, DOUBT = -0.5, 0.3, 0.8
#: The share of good sentences that a sentence's log odds must exceed to be picked at any rate, and the occurrences that stand against chance.
EVIDENCE, PRIOR = 0.998, 20.0
#: A sentence is usual if its share among good documents is this part of that among bad ones or more.
USUAL = 0.25
#: Bounds of the threshold, and by how many bad documents' worth F1 must differ to matter: labels are not all right.
CUT, SAME = (0.0, 0.6), 2
#: Good documents that the fit needs at least: where fewer have a label, documents without one fill them up.
GOOD_DOCUMENTS = 1000
#: A kind of sentence is doubted if it has so many times more documents without a label, for each bad one, than the seed sentences have on the whole, and SLACK more.
TIMES, SLACK = 2.0, 1
#: A picked sentence of one bad document alone is doubted from more than LONE documents without a label on, unless it scored SUPPORT before it was picked.
LONE, SUPPORT = 2, -0.2
#: Weight of the machine's regularisation.
RIDGE = 1.0
#: The lengths of subsequences, the furthest that their last character may lie from their first, and the weight of each character skipped.
LENGTHS, SPAN, DECAY = (3, 4, 5), 5, 0.6
#: The places of their characters: all within the span, and those with a character skipped after every letter.
_PLACES = (
    *((0, *rest) for n in LENGTHS for rest in combinations(range(1, SPAN + 1), n - 1)),
    *(tuple(range(0, 2 * n, 2)) for n in LENGTHS if 2 * n - 2 > SPAN),
)
#: The furthest place: so many empty characters part the sentences.
_REACH = max(p[-1] for p in _PLACES)
#: Sentences are at most this long; longer stretches are cut into pieces that overlap by half.
SENTENCE = 160

# Letters of other scripts that look like Latin ones.
_ALIKE = str.maketrans("авекмнорстухіјѕԁԛԝгпьαβεικνορτυχ", "abekmhopctyxijsdqwrnbabeikvoptux")
# Digits and signs that stand for letters inside words.
_LEET = str.maketrans("013457@$!|", "oieastasil")
_ODD_SPACE = re.compile(r"[^\S\n]+")
_WORDISH = re.compile(r"[\w@$!|*]+")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_PARTED = re.compile(r"(?<!\w)[^\W_]([^\w\s])[^\W_](?:\1[^\W_])+(?!\w)")
_SPACED = re.compile(r"(?<!\w)(?:[^\W\d_] ){2,}[^\W\d_](?!\w)")
_NUMBER = re.compile(r"\d+")
_END = re.compile(r"(?<=[.!?;:])\s+|\n+")


def even(text: str) -> str:
    """The text in plain spelling: lower case, no accents or invisible characters, look-alikes and digits in words as letters,
    stretched letters once, words with a space or the same sign between all letters closed, numbers as 0."""
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not (unicodedata.combining(c) or unicodedata.category(c) == "Cf"))
    text = text.casefold()
    if not text.isascii():
        text = text.translate(_ALIKE)
    text = _PARTED.sub(lambda m: m[0].replace(m[1], ""), text)
    text = _WORDISH.sub(_letters, text)
    text = _STRETCH.sub(r"\1", text)
    text = _ODD_SPACE.sub(" ", text)
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return _NUMBER.sub("0", text)


def _letters(m: re.Match) -> str:
    word = m[0]
    if word.isalpha() or word.isdigit() or "_" in word:
        return word
    core = word.rstrip("!|")  # signs at the end close a sentence
    letters = sum(c.isalpha() for c in core)
    if letters and (len(core) - letters) <= 2 * letters + 2:
        return core.translate(_LEET) + word[len(core) :]
    return word


def sentences(text: str | None) -> list[str]:
    """The evened-out sentences of a whole text; long stretches in overlapping pieces, pieces without a letter left out."""
    if not text:
        return []
    found = []
    for part in _END.split(even(text)):
        part = part.strip()
        if len(part) <= SENTENCE:
            if len(part) > 2:
                found.append(part)
        else:
            found += [part[i : i + SENTENCE] for i in range(0, len(part) - SENTENCE // 2, SENTENCE // 2)]
    return found


class Subsequences:
    """Hashed subsequences of many sentences: for each, rows (sentence, feature, weight) on demand, kind by kind."""

    def __init__(self, units: Sequence[str]):
        # a space at either end, so that words at the edges look like words inside
        text = "".join(f" {u} " + "\0" * _REACH for u in units)
        self.codes = np.frombuffer(text.encode("utf-32-le"), dtype="uint32").astype("uint64") * np.uint64(0x9E3779B97F4A7C15)
        self.empty = np.frombuffer(text.encode("utf-32-le"), dtype="uint32") == 0
        lengths = np.array([len(u) + 2 + _REACH for u in units], dtype="int64")
        self.starts = np.cumsum(lengths) - lengths
        self.unit = np.repeat(np.arange(len(units)), lengths)
        self.norm = 1 / np.sqrt(np.maximum(lengths - _REACH, 8))

    def kinds(self) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
        """(places, features, weight) of each kind of subsequence."""
        n = len(self.codes) - _REACH
        for places in _PLACES:
            h = np.full(n, np.uint64(len(places)), dtype="uint64")
            good = ~self.empty[:n]
            for p in places:
                h ^= self.codes[p : p + n]
                h *= np.uint64(0xD6E8FEB86659FD93)
                h ^= h >> np.uint64(29)
            good &= ~self.empty[places[-1] : places[-1] + n]
            yield good, (h >> np.uint64(48)).astype("int64") & (FEATURES - 1), DECAY ** (places[-1] + 1 - len(places))

    def score(self, weights: np.ndarray) -> np.ndarray:
        """Each sentence's weighted subsequences times ``weights``, over the root of its length."""
        if not len(self.starts):
            return np.zeros(0, dtype="float32")
        total = np.zeros(len(self.codes), dtype="float32")
        for good, feature, weight in self.kinds():
            total[: len(good)] += np.where(good, weights[feature], 0) * np.float32(weight)
        return np.add.reduceat(total, self.starts) * self.norm

    def dense(self) -> np.ndarray:
        """The sentences' weighted subsequence counts over the root of their length, one row each; only for few."""
        n, at, weights = len(self.starts), [], []
        for good, feature, weight in self.kinds():
            at.append(self.unit[: len(good)][good] * FEATURES + feature[good])
            weights.append(np.full(len(at[-1]), weight))
        found = np.bincount(np.concatenate(at), weights=np.concatenate(weights), minlength=n * FEATURES)
        return (found.reshape(n, FEATURES) * self.norm[:, None]).astype("float32")


def chunks(units: Sequence[str], size: int = 64) -> Iterator[Sequence[str]]:
    for i in range(0, len(units), size):
        yield units[i : i + size]


def kernel(units: Sequence[str], landmarks: np.ndarray) -> np.ndarray:
    """The kernel of sentences against landmarks given as dense rows."""
    parts = [Subsequences(c).dense() @ landmarks.T for c in chunks(units)]
    return np.concatenate(parts) if parts else np.zeros((0, len(landmarks)), dtype="float32")


def svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float, turns: int = 30) -> np.ndarray:
    """Linear support vector machine with squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([z, np.ones((len(z), 1))]).astype("float64")
    w, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    support = np.zeros(len(x), dtype=bool)
    for _ in range(turns):
        now = y * (x @ w) < 1
        if (now == support).all():
            break
        support = now
        xs, cs = x[support], cost[support]
        w = np.linalg.solve(penalty + xs.T @ (xs * cs[:, None]), xs.T @ (cs * y[support]))
    return w


@dataclass(frozen=True)
class Machine:
    """One weight per hashed subsequence, a bias, and the score from which a document counts as bad."""

    weights: np.ndarray
    bias: float
    threshold: float = 0.0

    def scores(self, units: Sequence[str]) -> np.ndarray:
        return Subsequences(units).score(self.weights) + self.bias

    def worst(self, texts: Sequence[str | None]) -> tuple[np.ndarray, list[str]]:
        """The highest score of each text's sentences (-inf without any) and that sentence."""
        return self.tops([sentences(t) for t in texts])

    def tops(self, split: Sequence[Sequence[str]]) -> tuple[np.ndarray, list[str]]:
        """The same for texts that are sentences already."""
        best, which = np.full(len(split), -np.inf), [""] * len(split)
        for low in range(0, len(split), 500):
            part = split[low : low + 500]
            scores, at = self.scores([u for units in part for u in units]), 0
            for i, units in enumerate(part, start=low):
                if units:
                    own = scores[at : at + len(units)]
                    k = int(np.argmax(own))
                    best[i], which[i] = own[k], units[k]
                    at += len(units)
        return best, which


def _train(bad: Sequence[str], good: Sequence[str], times: Counter, rng: np.random.Generator) -> Machine:
    half = LANDMARKS // 2
    chosen = _some(bad, half, rng) + _some(good, LANDMARKS - min(half, len(bad)), rng)
    rows = np.concatenate([Subsequences(c).dense() for c in chunks(chosen)])
    units = [*bad, *good]
    k = kernel(units, rows)
    values, vectors = np.linalg.eigh((rows @ rows.T).astype("float64"))
    keep = values > 1e-3 * values[-1]
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    often = np.power([max(1, times[u]) for u in good], 0.75)  # a sentence that many good documents have weighs more
    cost = np.concatenate([np.full(len(bad), np.sqrt(len(good) / max(1, len(bad)))), often])
    w = svm(k @ whiten, y, cost, RIDGE)
    return Machine((rows.T.astype("float64") @ (whiten @ w[:-1])).astype("float32"), float(w[-1]))


def _some(units: Sequence[str], n: int, rng: np.random.Generator) -> list[str]:
    if len(units) <= n:
        return list(units)
    return [units[i] for i in np.sort(rng.choice(len(units), n, replace=False))]


def _odds(bad: Sequence[str], good: Sequence[str]) -> np.ndarray:
    """Log odds of each subsequence among the sentences of bad against those of good documents; 0 without evidence."""

    def counts(units: Sequence[str]) -> np.ndarray:
        total = np.zeros(FEATURES)
        for c in chunks(units, 2000):
            for ok, feature, weight in Subsequences(c).kinds():
                total += weight * np.bincount(feature[ok], minlength=FEATURES)
        return total

    a, b = counts(bad), counts(good)
    share = a.sum() / max(1.0, a.sum() + b.sum())
    return (np.log((a + PRIOR * share + 1e-9) / (b + PRIOR * (1 - share) + 1e-9)) - np.log((share + 1e-9) / (1 - share + 1e-9))).astype("float32")


def _mean(units: Sequence[str], weights: np.ndarray) -> np.ndarray:
    """The mean weight of each sentence's subsequences."""
    found = Subsequences(units)
    return found.score(weights) / np.maximum(found.score(np.ones(FEATURES, dtype="float32")), 1e-9)


def fit(labelled: Sequence[tuple[bool, str | None]], background: Sequence[str | None] = (), spark: SparkSession | None = None, seed: int = 7) -> Machine:
    """The machine fitted on labelled documents (bad or not, text), documents without a label and the seed sentences; no labels leave the seeds.

    It is the mean over DEALS deals of the documents into folds, as what a single deal lets in weighs much where labels are few; its threshold is the one of best F1
    over the mean held-out scores. With a session the deals are tasks of the cluster.
    """
    seeds_of_deals = [seed + i for i in range(DEALS)]
    if spark is None:
        found = [_deal(labelled, background, s) for s in seeds_of_deals]
    else:
        ship(spark)
        sent = spark.sparkContext.broadcast((labelled, background))  # bounded by LABELLED_CHARS and BACKGROUND_CHARS

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for s in batch.column(0).to_pylist():
                    machine, held_out = _deal(*sent.value, s)
                    yield pa.RecordBatch.from_pydict({"weights": [machine.weights.astype("float32").tobytes()], "bias": [machine.bias], "held_out": [held_out.astype("float64").tobytes()]})

        rows = spark.range(seed, seed + DEALS, numPartitions=DEALS).mapInArrow(run, "weights binary, bias double, held_out binary").collect()
        found = [(Machine(np.frombuffer(r["weights"], "float32"), r["bias"]), np.frombuffer(r["held_out"], "float64")) for r in rows]
    whole = _averaged([machine for machine, _ in found])
    held_out = np.mean([x for _, x in found], axis=0) if labelled else np.zeros(0)
    return Machine(whole.weights, whole.bias, _threshold(held_out, np.array([bad for bad, _ in labelled], dtype=bool)))


def _deal(labelled: Sequence[tuple[bool, str | None]], background: Sequence[str | None], seed: int) -> tuple[Machine, np.ndarray]:
    """The machine of one deal, and the held-out score of each labelled document.

    In each turn, a fold's bad documents get their worst sentences picked, and its good sentences
    their doubts, by a machine that did not see them: what only one document says is not learnt from that document. Good sentences enter as a bounded
    random sample and those that score highest. Documents without a label serve twice: they fill up the good ones where these are few, and
    a picked sentence that many of them are like, but few labelled ones, is held to be innocent and its document to be wrongly rated.
    """
    rng = np.random.default_rng(seed)
    docs = [(bad, list(dict.fromkeys(sentences(text)))) for bad, text in labelled]
    n_labelled, n_bad = len(docs), sum(bad for bad, _ in docs)
    others = [list(dict.fromkeys(sentences(text))) for text in background]
    docs += [(False, units) for units in others[: max(0, GOOD_DOCUMENTS - (n_labelled - n_bad))]]
    n_good = len(docs) - n_bad
    in_good, in_bad = Counter(u for bad, units in docs if not bad for u in units), Counter(u for bad, units in docs if bad for u in units)
    known_good = {u for bad, units in docs[:n_labelled] if not bad for u in units}
    # what good documents say about as often is no sign of a bad one
    usual = {u for u in in_bad if in_good[u] / max(1, n_good) > USUAL * in_bad[u] / max(1, n_bad)}
    fold = rng.permutation(len(docs)) % FOLDS
    bad_docs = [(k, [u for u in docs[k][1] if u not in usual]) for k in range(n_labelled) if docs[k][0]]
    pool = {f: _some(sorted({u for k, (bad, units) in enumerate(docs) if not bad and fold[k] == f for u in units}), GOOD_SENTENCES // FOLDS, rng) for f in range(FOLDS)}
    seeds_bad, seeds_good = sorted({even(x) for x in seeds.bad()}), sorted({even(x) for x in seeds.good()})
    plain = [u for f in pool for u in _some(pool[f], HARD // FOLDS, rng)]
    start = _train(seeds_bad, sorted({*seeds_good, *plain}), in_good, rng)
    machines = dict.fromkeys(range(FOLDS), start)
    hard: dict[int, set[str]] = {f: set() for f in range(FOLDS)}
    picked: dict[int, list[str]] = {f: [] for f in range(FOLDS)}

    # sentences that other folds' bad documents say far more often than good ones do, more than hardly any good sentence: always picked
    telling: dict[int, set[str]] = {}
    for f in range(FOLDS):
        odds = _odds([u for k, units in bad_docs if fold[k] != f for u in units], [u for g in pool if g != f for u in pool[g]])
        own = sorted({u for k, units in bad_docs if fold[k] == f for u in units})
        least = np.quantile(_mean(pool[f], odds), EVIDENCE) if pool[f] else np.inf
        telling[f] = {u for u, x in zip(own, _mean(own, odds)) if x > least}

    def pick(turn: int) -> None:
        for f in range(FOLDS):
            own = [(k, units) for k, units in bad_docs if fold[k] == f and units]
            scores = machines[f].scores([u for _, units in own for u in units])
            scores = np.maximum(scores, [0.0 if u in telling[f] else -np.inf for _, units in own for u in units])
            tops, at = [], 0
            for _, units in own:
                s = scores[at : at + len(units)]
                at += len(units)
                order = np.argsort(-s)
                tops.append((float(s[order[0]]), units[order[0]]))
                if turn:
                    tops += [(float(s[i]), units[i]) for i in order[1:] if s[i] > SURE]
            for x, u in tops:
                first[u] = max(x, first.get(u, -np.inf))
            picked[f] = _some(sorted({u for x, u in tops if x >= ACCEPT} - cleared), BAD_SENTENCES // FOLDS, rng)
            if turn:
                s = machines[f].scores(pool[f])
                doubtful = (pool[f][i] for i in np.argsort(-s) if s[i] < DOUBT)
                hard[f] |= set(islice((u for u in doubtful if u in known_good), HARD // FOLDS))
            else:
                hard[f] = set(_some(pool[f], HARD // FOLDS, rng))

    def doubt() -> bool:
        """Whether anything new is cleared: sentences nearest to a picked or seed sentence that many documents without a label are like and hardly any bad one, and the picked
        sentence with them. Raters mark bad documents far more often than others, so such a kind of sentence is none of the bad ones."""
        before = len(cleared)
        machine = _averaged([*machines.values()])
        chosen = sorted({u for f in picked for u in picked[f]})
        known = [*chosen, *seeds_bad]
        # of documents without a label, and of bad ones: the worst sentences, if bad
        near = [[u for x, u in zip(*machine.tops(group)) if x >= 0] for group in (others, [units for _, units in bad_docs])]
        nearest = [_nearest(units, known) for units in near]
        seen = [Counter(x) for x in nearest]
        rate = sum(n for i, n in seen[0].items() if i >= len(chosen)) / max(1, sum(n for i, n in seen[1].items() if i >= len(chosen)))
        doubted = {i for i, n in seen[0].items() if n > TIMES * rate * max(1, seen[1][i]) + SLACK}
        doubted |= {i for i, n in seen[0].items() if i < len(chosen) and n > LONE and seen[1][i] <= 1 and first[chosen[i]] < SUPPORT}
        cleared.update(chosen[i] for i in doubted if i < len(chosen))
        cleared.update(u for u, i in zip(near[0], nearest[0]) if i in doubted)
        bad_docs[:] = [(k, units) for k, units in bad_docs if cleared.isdisjoint(units)]  # they were rated wrongly
        return len(cleared) > before

    cleared: set[str] = set()
    first: dict[str, float] = {}  # the best score of a sentence before it was picked by the machine that scored it
    for turn in range(2 * TURNS):
        pick(turn)
        for f in range(FOLDS):
            rest = [g for g in range(FOLDS) if g != f]
            bad = sorted({*seeds_bad, *(u for g in rest for u in picked[g])})
            good = sorted({*seeds_good, *cleared, *(u for g in rest for u in hard[g])} - set(bad))
            machines[f] = _train(bad, good, in_good, rng)
        if not doubt() and turn >= TURNS - 1:  # further turns only while they clear something
            break
    bad = sorted({*seeds_bad, *(u for f in picked for u in picked[f])})
    final = _train(bad, sorted({*seeds_good, *cleared, *(u for f in hard for u in hard[f])} - set(bad)), in_good, rng)
    best = np.full(n_labelled, -np.inf)
    for f in range(FOLDS):
        own = [k for k in range(n_labelled) if fold[k] == f]
        best[own] = machines[f].tops([docs[k][1] for k in own])[0]
    # the mean of the last machines: what a single deal of the folds let in weighs less
    return _averaged([final, *machines.values()]), best


def _averaged(machines: Sequence[Machine]) -> Machine:
    return Machine(np.mean([m.weights for m in machines], axis=0), float(np.mean([m.bias for m in machines])))


def _nearest(units: Sequence[str], known: Sequence[str]) -> list[int]:
    """For each sentence which of the known ones it shares most subsequences with, by a signed sketch of their counts."""

    def sketch(part: Sequence[str]) -> np.ndarray:
        found, size = Subsequences(part), 2048
        total = np.zeros(len(part) * size)
        for good, feature, weight in found.kinds():
            own = feature[good]
            sign = np.where((own * 40503 >> 7) & 1, weight, -weight)
            total += np.bincount(found.unit[: len(good)][good] * size + own % size, weights=sign, minlength=len(total))
        rows = total.reshape(len(part), size)
        return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype("float32")

    if not units or not known:
        return []
    all_known = np.concatenate([sketch(c) for c in chunks(known, 500)])
    return [int(i) for c in chunks(units, 500) for i in (sketch(c) @ all_known.T).argmax(axis=1)]


def _threshold(scores: np.ndarray, bad: np.ndarray) -> float:
    """The score nearest to 0, the machine's own border, whose F1 is as good as the best; 0 without bad documents."""
    if not bad.any():
        return 0.0
    grid = np.linspace(*CUT, 41)
    f1 = []
    for t in grid:
        hit = scores >= t
        f1.append(2 * (hit & bad).sum() / max(1, hit.sum() + bad.sum()))
    f1 = np.array(f1)
    good = np.flatnonzero(f1 >= f1.max() - SAME / bad.sum())
    return float(grid[good[np.argmin(np.abs(grid[good]))]])


def _bounded(rows: DataFrame, most: int, chars: int) -> DataFrame:
    """At most so many rows of (doc, _text, ...) with so many characters together, in the order of a hash of doc."""
    rows = rows.withColumn("_order", F.xxhash64("_doc")).orderBy("_order").limit(most)
    rows = rows.withColumn("_chars", F.sum(F.coalesce(F.length("_text"), F.lit(0)).cast("bigint")).over(Window.orderBy("_order")))  # of ``most`` rows
    return rows.where(F.col("_chars") <= chars)


def labelled(documents: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[tuple[bool, str | None]], list[str | None]]:
    """(bad or not, text) of the labelled documents for the fit, LABELLED and LABELLED_CHARS at most, and texts without a label, BACKGROUND and BACKGROUND_CHARS at most.

    Several ratings of a document are settled by the majority; ties, null ratings and labels of documents that do not exist are left out. Which
    documents stand for those without a label is decided by their ids alone, before any text is read.
    """
    rated = labels.where(F.col(label).isNotNull() & F.col(doc).isNotNull()).groupBy(F.col(doc).alias("_doc")).agg(F.avg(F.col(label).cast("double")).alias("_vote"))
    votes = cut(rated)
    texts = documents.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text"))
    known = texts.join(hinted(votes.where("_vote <> 0.5")), "_doc").withColumn("_bad", F.col("_vote") > 0.5)
    found = [(r["_bad"], r["_text"]) for r in _bounded(known, LABELLED, LABELLED_CHARS).select("_bad", "_text").collect()]
    least = texts.select("_doc").where("_doc IS NOT NULL").join(hinted(votes.select("_doc")), "_doc", "left_anti").withColumn("_order", F.xxhash64("_doc")).orderBy("_order").limit(BACKGROUND).select("_doc").distinct()
    rest = _bounded(texts.join(F.broadcast(least), "_doc", "left_semi"), BACKGROUND, BACKGROUND_CHARS)  # at most BACKGROUND ids
    return found, [r["_text"] for r in rest.select("_text").collect()]


def score(documents: DataFrame, machine: Machine, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score, flagged, worst): the score of each document's worst sentence, whether it reaches the threshold, and that sentence.

    Every row is scored over its whole text, without a shuffle. Null texts and texts without a word of three letters have a null score and are
    not flagged; repeated rows are scored each. Further columns are not read.
    """
    ship(documents.sparkSession)
    known = documents.sparkSession.sparkContext.broadcast(machine)  # one float per hashed subsequence: 256 KB

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        machine = known.value
        for batch in batches:
            for start in range(0, len(batch), 500):
                part = batch.slice(start, 500)
                best, worst = machine.worst(part.column(1).to_pylist())
                none = np.isneginf(best)
                columns = [part.column(0), pa.array(best.astype("float64"), mask=none), pa.array(best >= machine.threshold), pa.array(worst, mask=none)]
                yield pa.RecordBatch.from_arrays(columns, [doc, "score", "flagged", "worst"])

    kind = documents.schema[doc].dataType.simpleString()
    return documents.select(doc, F.col(text).cast("string")).mapInArrow(run, f"`{doc}` {kind}, score double, flagged boolean, worst string")


def rates(documents: DataFrame, scored: DataFrame, source: str = "source", doc: str = "doc_id") -> DataFrame:
    """(source, n_docs, n_flagged, rate): flagged documents per source; a null source is a group of its own."""
    flags = scored.where("flagged").select(doc).distinct().withColumn("_bad", F.lit(1))
    found = documents.select(doc, source).join(flags, doc, "left").groupBy(source).agg(F.count("*").alias("n_docs"), F.count("_bad").alias("n_flagged"))
    return found.withColumn("rate", F.col("n_flagged") / F.col("n_docs"))
