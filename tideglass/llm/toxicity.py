"""Toxicity by a subsequence string-kernel support vector machine with Nystrom landmarks.

Kernel.  A unit (the letters and digits of a white-space token, or of tokens read together) is read
between end marks; k(s, t) sums, over the character subsequences of length 4 that s and t share
and that span at most 7 characters, the product of DECAY ** span of both occurrences, and is
normalised by sqrt(k(s, s) k(t, t)).  Gaps are thus allowed inside a match: "idxiot" shares most of the
subsequences of "idiot".  Wider gaps and white space are beyond the span, so marks inside a token do not
count ("i.d.i.o.t", "i--d--i--o--t"), and runs of tokens of one or two characters ("i  d  i  o  t",
"i di ot") and neighbours of JOINED characters at most ("id iot") are read together as well.  A unit
is a window of at most PIECE characters; longer words give several that overlap by half.

Training.  A bounded sample of labelled rows (SAMPLE rows of each class, texts up to
SAMPLE_CHARS characters, taken in the order of a hash of the id) is gathered in one task, which returns
the machine; nothing else of it reaches the driver.  A label says that some unit of the text is toxic, so
each positive text is stood for by units: first those of high log odds, then, for ROUNDS rounds, those
that the machine itself picks; negatives are units of clean texts, with the worst scored ones added each
round.  Both classes also enter with gaps and inserted characters.  The machine is linear (squared hinge,
Newton steps) in the Nystrom features K_mm**-1/2 k(., landmarks); a logistic curve
over the texts' greatest values, centred where fewest sampled texts fall on the wrong side, turns the decision into
a probability.

Scoring.  A text's value is the greatest over its units.  As the decision is linear in the
landmarks, sum_j b_j k(u, l_j) collapses into one weight per subsequence of the landmarks:
the expansion is evaluated exactly by adding the weights that a unit's subsequences meet.

Cases: null and empty texts, and texts without a letter or digit, have no unit and get the score of a unit
without any match; very long texts are scored whole, in all their units, but those over SAMPLE_CHARS are not
trained on; repeated rows are scored alike; ties of scores are left as they are; labels that are null or whose
document is missing are not used; a document with several labels counts as toxic if one says so; rows that
repeat a labelled doc_id all count; without labels of both classes every score is 0; an empty table gives an
empty result; further columns are carried along, but for input columns score and predicted, which are replaced.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.hashing import slices
from tideglass.llm.shared import SLICE, batched, crc_mod, fresh, keep, lean, small_batches

ORDER, SPAN, DECAY = 4, 7, 0.85
SAMPLE, SAMPLE_CHARS = 2500, 12_000
LANDMARKS, ROUNDS = 320, 3
#: Characters of a unit, between the least that hold more than one subsequence with the end marks, and PIECE; longer words are read in windows that overlap by half.
LEAST, PIECE = 3, 32
#: Values a worker remembers, in each of two generations.
_CACHE = 250_000
#: Patterns of equal letters whose norms it remembers.
_PATTERN_CACHE = 60_000
_MARK = re.compile(r"[^\w\s]+|_+")
#: Two neighbouring words are read together, too, if they have so many characters.
LEAST_JOINED, JOINED = 4, 8
#: one odd number for each place of a subsequence, and one for the table's slots
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
#: offsets of the second to fourth character of each pattern
_PATTERNS = [(i, j, k) for k in range(3, SPAN) for j in range(2, k) for i in range(1, j)]


def units(text: str | None) -> set[str]:
    """The distinct units of a whole text: its words without marks, runs of words of at most 1 or 2 characters, short neighbours."""
    if not text:
        return set()
    ws = _MARK.sub("", text.lower()).split()
    n = np.fromiter(map(len, ws), np.int32, len(ws))
    out = {w for w in set(ws) if len(w) >= LEAST}
    both = n[:-1] + n[1:]
    out.update([ws[i] + ws[i + 1] for i in np.flatnonzero((both >= LEAST_JOINED) & (both <= JOINED)).tolist()])
    runs: list[str] = []
    for most in (1, 2):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], n <= most, [False])).view(np.int8)))
        runs += ["".join(ws[a:b]) for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()) if b - a > 2]
    out.update(runs)
    if n.max(initial=0) > PIECE or runs and max(map(len, runs)) > PIECE:
        for w in [w for w in out if len(w) > PIECE]:
            out.remove(w)
            out.update(w[at : at + PIECE] for at in range(0, len(w) - PIECE // 2, PIECE // 2))
    return out


def _laid(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(letters of all words with their end marks, word of each)."""
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    return codes, np.repeat(np.arange(len(words)), np.fromiter((len(w) + 2 for w in words), np.int64, len(words)))


def _keys(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(span - 1, key at each first letter) for each pattern; some of them reach into the next word."""
    n = len(codes)
    one, *others = (codes * a for a in _A[:ORDER])
    for i in range(1, SPAN - 2):
        two = one[: max(0, n - i)] + others[0][i:]
        for j in range(i + 1, SPAN - 1):
            three = two[: max(0, n - j)] + others[1][j:]
            for k in range(j + 1, SPAN):
                yield k, three[: max(0, n - k)] + others[2][k:]


def occurrences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per pattern (row of words, subsequence key, weight) of every occurrence."""
    codes, own = _laid(words)
    inside = {k: np.flatnonzero(own[: max(0, len(own) - k)] == own[k:]) for k in range(3, SPAN)}
    for k, key in _keys(codes):
        yield own[inside[k]], key[inside[k]], DECAY ** (k + 1)


def _raw(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse feature vectors: (row, key, value), one entry per row and key, sorted."""
    parts = list(occurrences(words))
    row, key = (np.concatenate([p[i] for p in parts]) for i in range(2))
    w = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
    order = np.lexsort((key, row))
    row, key, w = row[order], key[order], w[order]
    at = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))) if len(row) else np.zeros(0, np.int64)
    return row[at], key[at], np.add.reduceat(w, at) if len(at) else w


_NORMS: dict[bytes, float] = {}


def norms(words: list[str]) -> np.ndarray:
    """sqrt(k(w, w)) of each word before normalisation.

    It depends only on which of a word's letters are equal, so words of one pattern share it.
    """
    of = [bytes(map(w.find, w)) for w in words]
    new = {p: w for p, w in zip(of, words) if p not in _NORMS}
    if len(_NORMS) > _PATTERN_CACHE:
        _NORMS.clear()
        new = dict(zip(of, words))
    some = list(new.items())
    for a in range(0, len(some), 500):
        part = some[a : a + 500]
        row, _, v = _raw([w for _, w in part])
        square = np.bincount(row, v * v, len(part))
        _NORMS.update(zip([p for p, _ in part], np.sqrt(np.maximum(square, 1e-12)).tolist()))
    return np.fromiter(map(_NORMS.__getitem__, of), float, len(of))


class Machine:
    """Weights of subsequences, bias and the logistic curve; picklable and small."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.bits = 20
        self.bias, self.slope, self.offset = bias, slope, offset
        order = np.argsort(self._slots(keys), kind="stable")
        self.keys, self.weights = keys[order], weights[order].astype(np.float64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _A[-1]) >> np.uint64(64 - self.bits)).view(np.int64)

    def dots(self, words: list[str]) -> np.ndarray:
        """Decision value of each unit before its norm and the bias."""
        if not hasattr(self, "_first"):
            # the keys are sorted by slot, so those of one slot follow each other
            slot = self._slots(self.keys)
            self._some = np.zeros(1 << self.bits, bool)
            self._some[slot] = True
            self._first = np.zeros(1 << self.bits, np.int32)
            self._first[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
            self._most = int(np.bincount(slot).max(initial=0))
        codes, own = _laid(words)
        dot = np.zeros(len(words))
        for k, key in _keys(codes):
            slot = self._slots(key)
            hit = np.flatnonzero(self._some.take(slot))
            hit = hit[own[hit] == own[hit + k]]
            key, first, row = key[hit], self._first[slot[hit]], own[hit]
            for o in range(self._most):
                at = np.minimum(first + o, len(self.keys) - 1)
                good = np.flatnonzero(self.keys[at] == key)
                dot += np.bincount(row[good], self.weights[at[good]], len(words)) * DECAY ** (k + 1)
        return dot

    def values(self, words: list[str], above: bool = False) -> np.ndarray:
        """Decision value of each unit; with `above`, minus infinity for those at the bias and below."""
        dot = self.dots(words)
        if not above:
            return dot / norms(words) + self.bias
        out, at = np.full(len(words), -np.inf), np.flatnonzero(dot > 0)
        out[at] = dot[at] / norms([words[i] for i in at.tolist()]) + self.bias
        return out

    def every(self, words: list[str], above: bool = False) -> np.ndarray:
        """values() in bounded memory."""
        return np.concatenate([np.zeros(0), *(self.values(words[a : a + 2000], above) for a in range(0, len(words), 2000))])

    def probability(self, value):
        return 1 / (1 + np.exp(-np.clip(self.slope * np.asarray(value) + self.offset, -60, 60)))


def _explicit(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse normalised feature vectors: (row, key, value), one entry per row and key, sorted."""
    row, key, v = _raw(words)
    return row, key, v / norms(words)[row]


def _gram(words: list[str], vocabulary: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """k(words, landmarks); vocabulary and dense hold the landmarks' keys and (keys x landmarks) values."""
    out = np.zeros((len(words), dense.shape[1]), np.float32)
    for a in range(0, len(words), 40):
        row, key, v = _explicit(words[a : a + 40])
        at = np.minimum(np.searchsorted(vocabulary, key), len(vocabulary) - 1)
        ok = vocabulary[at] == key
        row, at, v = row[ok], at[ok], v[ok]
        if len(row):
            new = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            out[a + row[new]] = np.add.reduceat(dense[at] * v[:, None].astype(np.float32), new, axis=0)
    return out


def _noised(words: list[str], rng: np.random.RandomState) -> list[str]:
    """The words with a mark between all letters, or with one character inserted or doubled."""
    out = []
    marks = ".-_*+~"
    for i, w in enumerate(words):
        m = marks[rng.randint(len(marks))]
        if i % 2 or len(w) < 3:
            out.append(m.join(w))
        else:
            at = rng.randint(1, len(w))
            out.append(w[:at] + (m if rng.randint(2) else w[at - 1]) + w[at:])
    return out


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 2.0) -> np.ndarray:
    """Primal squared-hinge machine with a bias (last entry) by Newton steps."""
    x = np.hstack((x, np.ones((len(x), 1), x.dtype)))
    w = np.zeros(x.shape[1])
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(40):
        slack = 1 - y * (x @ w)
        a = slack > 0
        xa = x[a] * (c * weight[a])[:, None]
        new = np.linalg.solve(np.diag(ridge) + xa.T @ x[a], xa.T @ y[a])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _curve(value: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic slope and offset: 1/2 lies where fewest texts fall on the wrong side, classes weighed alike."""
    order = np.argsort(value, kind="stable")
    v, toxic = value[order], y[order] > 0
    # wrong[i]: error of a cut below the i-th value
    wrong = np.concatenate(([0], np.cumsum(toxic))) / max(1, toxic.sum()) + np.concatenate((np.cumsum(~toxic[::-1])[::-1], [0])) / max(1, (~toxic).sum())
    low, high = np.concatenate(([v[0] - 1], v)), np.concatenate((v, [v[-1] + 1]))
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    i = best[(high - low)[best].argmax()]
    cut = (low[i] + high[i]) / 2
    above, below = np.median(v[toxic]), np.median(v[~toxic])
    slope = 8 / max(above - below, 1e-3)
    return float(slope), float(-slope * cut)


class _Bags:
    """The sample: forms by number, and each text's forms as sorted numbers."""

    def __init__(self, texts: list[tuple[str, int]]):
        self.place: dict[str, int] = {}
        rows = []
        for text, y in texts:
            own = {self.place.setdefault(f, len(self.place)) for f in sorted(units(text))}
            if own:
                rows.append((np.array(sorted(own), np.int32), y))
        self.words = list(self.place)
        rows = self._distinct(rows)
        self.pos, self.neg = ([u for u, k in rows if k == y] for y in (1, 0))

    def _distinct(self, rows: list[tuple[np.ndarray, int]]) -> list[tuple[np.ndarray, int]]:
        """The rows but those that share three quarters of their units with an earlier one, so that a copied text counts once."""
        hashes = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in self.words), np.int64, len(self.words))
        out: list[tuple[np.ndarray, int]] = []
        seen: dict[tuple, list[int]] = {}
        for u, y in rows:
            h = hashes[u]
            least = [int(((h * m + 12345) % 4294967291).min()) for m in (1, 2654435, 40503, 69069, 1664525, 22695477, 48271, 16807)]
            keys = [(i, least[2 * i], least[2 * i + 1]) for i in range(4)]
            near = {k for key in keys for k in seen.get(key, ())}
            if any(len(np.intersect1d(u, out[k][0], assume_unique=True)) * 7 >= 3 * (len(u) + len(out[k][0])) for k in near):
                continue
            for key in keys:
                seen.setdefault(key, []).append(len(out))
            out.append((u, y))
        return out

    def counts(self, bags: list[np.ndarray]) -> np.ndarray:
        return np.bincount(np.concatenate([np.zeros(0, np.int32), *bags]), minlength=len(self.words))

    def evidence(self) -> np.ndarray:
        """Of each form: the greatest log likelihood ratio of its heads (inflected insults share one), 0 if clean texts hold them."""
        place: dict[str, int] = {}
        heads = [[place.setdefault(h, len(place)) for h in (*(w[:k] for k in range(3, min(len(w), 7) + 1)), "^" + w)] for w in self.words]
        size = np.fromiter(map(len, heads), np.int64, len(heads))
        flat = np.fromiter((h for hs in heads for h in hs), np.int32, int(size.sum()))
        start = np.cumsum(size) - size
        del heads

        def texts_with(bags: list[np.ndarray]) -> np.ndarray:
            out = np.zeros(len(place))
            for u in bags:
                n = size[u]
                out[np.unique(flat[np.repeat(start[u] - (np.cumsum(n) - n), n) + np.arange(n.sum())])] += 1
            return out

        hp, hn = texts_with(self.pos), texts_with(self.neg)
        n_pos, n_neg = len(self.pos), len(self.neg)
        share, p = n_pos / (n_pos + n_neg), hp / np.maximum(hp + hn, 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            odds = hp * np.log(p / share) + np.where(hn > 0, hn * np.log((1 - p) / (1 - share)), 0.0)
        odds[(hp <= 2) | (hn * n_pos * 12 >= hp * n_neg)] = 0
        self.chance = float(np.log(max(2, (hp > 0).sum())) + 2)
        return np.maximum(np.maximum.reduceat(odds[flat], start), 0)


def train(texts: list[tuple[str, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Machine | None:
    """Fit the machine on (text, label) rows; None without both classes."""
    bags = _Bags(texts)
    pos, neg, words = bags.pos, bags.neg, bags.words
    if not pos or not neg:
        return None
    rng = np.random.RandomState(11)
    n_pos, n_neg = len(pos), len(neg)
    dp, dn = bags.counts(pos), bags.counts(neg)
    odds = bags.evidence()
    best_of = lambda value, u: int(u[value[u].argmax()])  # noqa: E731  the first of equals
    # to begin with: more than chance would give the best of so many heads, and never in a clean text
    first = np.flatnonzero((dn == 0) & (odds > bags.chance))
    witness = np.unique([best_of(odds, u) for u in pos])
    chosen = first if len(first) else witness
    common = np.argsort(-dn, kind="stable")[:3000]
    common = common[dn[common] > 0]
    other = np.array([k for k in np.flatnonzero(dn).tolist() if len(words[k]) > 2], np.int64)
    negatives = list(dict.fromkeys([*common.tolist(), *other[rng.permutation(len(other))[:4000]].tolist()]))
    for r in range(rounds):
        plus = chosen[np.lexsort((chosen, -dp[chosen]))][:1500].tolist()
        few = [negatives[i] for i in rng.permutation(len(negatives))[: landmarks // 4]]
        text = lambda ks: [words[k] for k in ks]
        lead = text(plus[: landmarks // 4])
        marks = list(dict.fromkeys(lead + _noised(lead, rng) + text(negatives[: landmarks // 4]) + text(few)))
        row, key, v = _explicit(marks)
        vocabulary = np.unique(key)
        dense = np.zeros((len(vocabulary), len(marks)), np.float32)
        dense[np.searchsorted(vocabulary, key), row] = v
        lam, vec = np.linalg.eigh((dense.T @ dense).astype(np.float64))
        good = lam > 1e-4 * lam[-1]
        half = vec[:, good] / np.sqrt(lam[good])
        some = text(plus) + _noised(text(plus), rng) + text(negatives) + _noised(text(negatives[:3000]), rng)
        y = np.where(np.arange(len(some)) < 2 * len(plus), 1.0, -1.0)
        # a unit counts by the texts it decides
        often = np.sqrt(np.minimum(dp[plus], 100)) + 3
        rare = np.sqrt(np.clip(dn[negatives], 1, 100)) + 0.5
        weight = np.concatenate((often, often, rare, 0.5 * rare[:3000]))
        w = _svm(_gram(some, vocabulary, dense) @ half.astype(np.float32), y, weight)
        machine = Machine(vocabulary, dense @ (half @ w[:-1]), float(w[-1]), 1.0, 0.0)
        of = machine.every(words)
        best, worst = ([best_of(of, u) for u in side] for side in (pos, neg))
        if r < rounds - 1:
            # the machine's own choice stands for the positive texts if clean texts hardly hold it
            chosen = np.flatnonzero((dp > 0) & (of > 0.3) & (dn * n_pos * 8 < dp * n_neg))
            chosen = chosen if len(chosen) else witness
            hard, n = np.unique(worst, return_counts=True)
            taken = set(chosen.tolist())
            hard = [k for k in hard[np.lexsort((hard, -n))].tolist() if of[k] > -0.95 and k not in taken]
            negatives = list(dict.fromkeys(hard + negatives))
    values = of[np.array(best + worst)]
    machine.slope, machine.offset = _curve(values, np.array([1.0] * len(best) + [-1.0] * len(worst)))
    return machine


def sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> DataFrame:
    """(doc_id, text, toxic): at most `rows` labelled documents of each class whose crc32(doc_id) mod 5 is not 0."""
    seen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    seen = seen.where("doc_id is not null and toxic in (0, 1)").where(crc_mod("doc_id", 5) != 0)
    seen = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [seen.where(F.col("toxic") == y).orderBy(*order).limit(rows) for y in (0, 1)]
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") <= chars)
    # ids: at most 2 * rows
    return text.join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Machine | None:
    """Train on the bounded sample, in one task; only the machine comes to the driver."""

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for b in it for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")))]
        machine = train([(text, y) for _, text, y in sorted(got)])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])

    with batched(docs.sparkSession):
        found = sample(docs, labels, rows, chars).repartition(1).mapInArrow(run, "machine binary").collect()
    return pickle.loads(found[0].machine) if found else None


class _Scorer:
    """A worker's machine with the values it remembers."""

    def __init__(self, machine: Machine | None):
        self.machine, self.known, self.old = machine, {}, {}

    def scores(self, texts: list[str | None]) -> np.ndarray:
        m = self.machine
        if m is None:
            return np.zeros(len(texts))
        of = [units(t) for t in texts]
        if len(self.known) > _CACHE:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        new = set().union(*of).difference(known)
        again = new.intersection(old)
        known.update((w, old[w]) for w in again)
        new = list(new.difference(again))
        # what lies at the bias or below matters only to texts that have nothing above
        known.update(zip(new, m.every(new, above=True).tolist()))
        best = np.array([max(map(known.__getitem__, u), default=m.bias) for u in of] or np.zeros(0))
        for i in np.flatnonzero(np.isneginf(best)):
            best[i] = m.every(sorted(of[i])).max()
        return m.probability(best)


def _scored(docs: DataFrame, machine: Machine | None) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(machine)
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")

    @lean
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(held.value)
        for batch in small_batches(it):
            parts = slices(batch.column("text").to_pylist(), lambda t: len(t or ""), SLICE)
            p = np.concatenate([np.zeros(0), *map(scorer.scores, parts)])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*names, "score", "predicted"])

    return docs.select(*names).mapInArrow(run, schema)


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs with score (double) and predicted (int) added, other columns as they are; written in the shared folder."""
    return keep(_scored(docs, machine), "scored", 500)


def scores(docs: DataFrame, machine: Machine | None, key: str = "doc_id") -> DataFrame:
    """(key, score, predicted) per row of docs: score() without the texts."""
    return keep(_scored(docs.select(key, "text"), machine).select(key, "score", "predicted"), "scores", 500)


def clean(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """docs without those that the machine rejects; all columns stay as they are."""
    names = docs.columns
    new = dict(zip(names, fresh([*names, "score", "predicted"], *names)))
    plain = docs.withColumnsRenamed({c: new[c] for c in names if c.lower() in ("score", "predicted")})
    kept = _scored(plain, machine).where("predicted = 0").drop("score", "predicted")
    return keep(kept.withColumnsRenamed({v: k for k, v in new.items()}).select(*names), "not-toxic", 500)
