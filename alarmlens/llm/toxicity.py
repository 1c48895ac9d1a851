"""Toxicity by a support vector machine on a subsequence string kernel with Nyström landmarks.

Kernel: two strings share the subsequences of three characters that span at most ``SPAN`` characters; each counts
``DECAY`` to the power of its span, so that gaps and inserted characters weaken a match and do not end it.  Strings are
scaled by their length.

Sentences: a text's sentences are cut into units: each run without white space, each two and each three neighbours that
follow each other in the sentence, and each run of single letters.  A unit is the string of its letters and digits alone,
between two edge marks: stars, dots, hyphens and, in the units of several runs, spaces are gaps that count nothing.  A
sentence is worth what its worst unit is, a text what its worst sentence is; a logistic curve fitted on the training rows
makes it a score from 0 to 1.  Runs of more than ``LONGEST`` letters are read in windows of their letters, without marks.

Training has only documents' labels: all sentences of documents labelled 0 are clean; of a document labelled 1 the sentence
with the worst unit is toxic, and its worst run is the witness.  Witnesses are chosen anew after each round, and the units of
clean sentences that look worst join the clean side.  Witnesses that several documents have are also learnt with characters
inserted, left out, doubled and replaced, so that the margin leaves room for these.

Because the machine is linear in kernel values, its landmarks fold into one table of weights by subsequence.  A text is then
scored without any string being made: weights of all subsequences are summed along the text, and a unit's value is a
difference of these sums, less what reaches beyond its end.

Defined results: null and empty texts have the score of a text without any bad word; whole texts are read, whatever
their length; repeated rows get equal scores; an id that repeats among training rows counts once, with its least text;
without labelled rows of both kinds every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import boxed, fitted_in_a_task, text_chunks

SPAN, DECAY, CODES = 6, 0.8, 64
SHORTEST, LONGEST, WINDOW = 3, 24, 12
#: Edge marks of a run, and those of several runs read as one.
START, END = 60, 61
JOINED_START, JOINED_END = 62, 63
#: Labelled rows of each class that the machine is fitted on, at most.
PER_CLASS = 2500
#: Units of clean sentences that a round of training holds, at most: a quarter those of least hash, the others those that
#: looked worst in this round or an earlier one.
CLEAN_UNITS = 12_000
#: A witness is also learnt disturbed if this share of the toxic texts has it, and five at least; so many of them at most.
OFTEN, DISTURBED_WITNESSES = 0.03, 100
#: Weight of all disturbed witnesses against one a text.
DISTURBED = 4.0
#: Value of a text without any unit, and the least of any.
FLOOR = -3.0
_KNOWN = 0x3000
_MARKED = [b"%b", bytes([START]) + b"%b" + bytes([END]), *[bytes([JOINED_START]) + b"%b" + bytes([JOINED_END])] * 2]


def _codes() -> np.ndarray:
    """1 to 26 letters a to z, 27 digits, 28 to 59 other letters by their number, 0 what is not read."""
    table = np.array([28 + c % 32 if chr(c).isalpha() else 27 if chr(c).isdigit() else 0 for c in range(_KNOWN)], np.int32)
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return table


_TABLE = _codes()
_SPACE = np.array([chr(c).isspace() for c in range(_KNOWN)])
_patterns: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}


def _norm(letters: int) -> float:
    """Length of the vector of a string of so many letters between marks, each subsequence counted for itself."""
    return float(np.sqrt((_subsequences(letters + 2, True)[1] ** 2).sum()))


def _subsequences(length: int, marks: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the subsequences of a string of ``length`` codes; none holds both marks."""
    if (length, marks) not in _patterns:
        at = [(i, j, k) for i in range(length) for j in range(i + 1, length) for k in range(j + 1, min(length, i + SPAN)) if not (marks and i == 0 and k == length - 1)]
        places = np.array(at, np.int64).reshape(-1, 3)
        _patterns[length, marks] = places, DECAY ** (places[:, 2] - places[:, 0] + 1.0)
    return _patterns[length, marks]


def _features(units: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: indices in ``units`` (bytes of codes, with their marks), ids of their subsequences, scaled weights."""
    by: dict[tuple[int, bool], list[int]] = {}
    for n, u in enumerate(units):
        by.setdefault((len(u), u[0] >= START), []).append(n)
    for (length, marks), at in by.items():
        codes = np.frombuffer(b"".join([units[n] for n in at]), np.uint8).reshape(len(at), length).astype(np.int32)
        places, weight = _subsequences(length, marks)
        ids = (codes[:, places[:, 0]] * CODES + codes[:, places[:, 1]]) * CODES + codes[:, places[:, 2]]
        yield np.array(at), ids, weight / _norm(length - 2 if marks else length)


def _kernel(units: list[bytes], landmarks: list[bytes], strip: int = 256) -> np.ndarray:
    """Kernel values, units by landmarks; a strip of landmarks at a time, to bound memory."""
    out = np.zeros((len(units), len(landmarks)), np.float32)
    features = list(_features(units))
    for left in range(0, len(landmarks), strip):
        marks = list(_features(landmarks[left : left + strip]))
        known = np.unique(np.concatenate([ids.ravel() for _, ids, _ in marks]))
        row = np.full(CODES**3, len(known), np.int32)  # the last row is that of all other subsequences
        row[known] = np.arange(len(known))
        dense = np.zeros((len(known) + 1, min(strip, len(landmarks) - left)), np.float32)
        for at, ids, weight in marks:
            np.add.at(dense, (row[ids], np.broadcast_to(at[:, None], ids.shape)), np.broadcast_to(weight, ids.shape))
        for at, ids, weight in features:
            for lo in range(0, len(at), 100):
                out[at[lo : lo + 100], left : left + strip] = np.einsum("ncl,c->nl", dense[row[ids[lo : lo + 100]]], weight)
    return out


class Sentences:
    """The letters of some texts, end to end, and the units of their sentences."""

    def __init__(self, texts: list[object]):
        low = [t.lower() if isinstance(t, str) else "" for t in texts]
        sizes = np.array([len(t) + 1 for t in low], np.int64)
        cp = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        simple = np.minimum(cp, _KNOWN - 1)
        codes = np.where(cp < _KNOWN, _TABLE[simple], 28 + (cp % 32).astype(np.int32)).astype(np.int32)
        space = _SPACE[simple] & (cp < _KNOWN)
        ends = (cp == 10) | (((cp == 46) | (cp == 33) | (cp == 63)) & np.append(space[1:], True))
        at = np.flatnonzero(codes)
        self.letters = codes[at].astype(np.uint8).tobytes()
        run, sentence = np.cumsum(space)[at], np.cumsum(ends)[at]
        new = np.ones(len(at), bool)
        new[1:] = run[1:] != run[:-1]
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(at)))
        of = sentence[start]
        # neighbours of one letter each are read as one run
        joined = np.zeros(len(start), bool)
        joined[1:] = (length[1:] == 1) & (length[:-1] == 1) & (of[1:] == of[:-1])
        start, of = start[~joined], of[~joined]
        length = np.diff(np.append(start, len(at)))
        doc = np.searchsorted(np.cumsum(sizes), at[start], "right") if len(start) else start
        units = []
        for m in (1, 2, 3):
            n = len(start) - m + 1
            if n <= 0:
                break
            whole = length[:n].copy()
            for k in range(1, m):
                whole += length[k : n + k]
            ok = (whole >= SHORTEST) & (whole <= LONGEST) & (of[:n] == of[m - 1 :])
            units.append((doc[:n][ok], start[:n][ok], whole[ok], np.full(ok.sum(), m, np.int8)))
        long = np.flatnonzero(length > LONGEST)
        count = (length[long] - WINDOW) // (WINDOW // 2) + 1
        first = np.repeat(start[long], count) + (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)) * (WINDOW // 2)
        # the last window ends where the run ends
        last = start[long] + length[long] - WINDOW
        first, owner = np.concatenate([first, last]), np.concatenate([np.repeat(doc[long], count), doc[long]])
        units.append((owner, first, np.full(len(first), WINDOW), np.zeros(len(first), np.int8)))
        #: text, place of the first letter, letters, runs (0: a window without marks)
        self.doc, self.first, self.size, self.runs = (np.concatenate(x).astype(kind) for x, kind in zip(zip(*units, strict=True), (np.int32, np.int32, np.int8, np.int8), strict=True))

    def unit(self, k: int) -> bytes:
        letters = self.letters[self.first[k] : self.first[k] + self.size[k]]
        return _MARKED[self.runs[k]] % letters

    def values(self, weights: np.ndarray) -> np.ndarray:
        """Sum of the weights of each unit's subsequences, scaled."""
        n = len(self.letters)
        c = np.zeros(n + SPAN, np.int32)
        c[:n] = np.frombuffer(self.letters, np.uint8)
        high, mid = c * (CODES * CODES), c * CODES
        decay = [np.float32(DECAY ** (q + 1)) for q in range(SPAN)]
        by_span = {}
        for q in range(2, SPAN):  # subsequences from each letter to the q-th after it
            total = np.zeros(n, np.float32)
            for p in range(1, q):
                total += weights.take(high[:n] + mid[p : n + p] + c[q : n + q])
            by_span[q] = total * decay[q]
        sums = np.zeros(n + 1)
        np.cumsum(sum(by_span.values()), out=sums[1:], dtype=np.float64)
        last = self.first + self.size.astype(np.int32) - 1
        out = sums[last + 1] - sums[self.first]
        for j in range(SPAN - 1):  # less those that reach beyond the last letter
            inside = self.size > j
            reach = sum(by_span[q] for q in by_span if q > j)
            out[inside] -= reach[last[inside] - j]
        marked = self.runs > 0
        a, b, size = self.first[marked], last[marked], self.size[marked]
        start = np.where(self.runs[marked] > 1, JOINED_START, START).astype(np.int32) * (CODES * CODES)
        end = np.where(self.runs[marked] > 1, JOINED_END, END).astype(np.int32)
        edge = np.zeros(len(a), np.float32)
        for q in range(2, SPAN):
            for p in range(1, q):
                front = weights.take(start + mid[a + p - 1] + c[np.minimum(a + q - 1, n)])
                back = weights.take(high[np.maximum(b - q + 1, 0)] + mid[b - p + 1] + end)
                edge += np.where(size >= q, (front + back) * decay[q], np.float32(0))
        out[marked] += edge
        norms = np.array([_norm(k) for k in range(SHORTEST, LONGEST + 1)])
        return (out / norms[self.size - SHORTEST]).astype(np.float32)


class Corpus:
    """The sentences of many texts, in parts of bounded size."""

    def __init__(self, texts: list[object], most: int = 1 << 19):
        cuts = np.cumsum([len(t) if isinstance(t, str) else 0 for t in texts]) // most
        starts = np.flatnonzero(np.diff(cuts, prepend=-1)).tolist()
        self.parts = [Sentences(texts[a:b]) for a, b in zip(starts, [*starts[1:], len(texts)], strict=True)]
        self.doc = np.concatenate([p.doc + np.int32(a) for p, a in zip(self.parts, starts, strict=True)])
        self.runs = np.concatenate([p.runs for p in self.parts])
        self.ends = np.cumsum([len(p.doc) for p in self.parts])

    def unit(self, k: int) -> bytes:
        part = int(np.searchsorted(self.ends, k, "right"))
        return self.parts[part].unit(k - (int(self.ends[part - 1]) if part else 0))

    def units(self, at: np.ndarray) -> list[bytes]:
        """Distinct units at these places, in order."""
        return list(dict.fromkeys(map(self.unit, at.tolist())))

    def names(self) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places of single runs, the number of each one's name, and the names."""
        index: dict[bytes, int] = {}
        at, name, before = [], [], 0
        for p in self.parts:
            own = np.flatnonzero(p.runs == 1)
            name.append(np.array([index.setdefault(p.unit(k), len(index)) for k in own.tolist()], np.int32))
            at.append(own + before)
            before += len(p.doc)
        return np.concatenate(at), np.concatenate(name), list(index)

    def values(self, weights: np.ndarray) -> np.ndarray:
        return np.concatenate([p.values(weights) for p in self.parts])


@dataclass
class ToxicityModel:
    weights: np.ndarray  # by subsequence id
    bias: float = 0.0
    curve: tuple[float, float] = (0.0, 0.0)
    landmarks: list[bytes] = field(default_factory=list)

    def text_values(self, texts: list[object]) -> np.ndarray:
        out = np.full(len(texts), FLOOR)
        s = Sentences(texts)
        if len(s.doc):
            np.maximum.at(out, s.doc, s.values(self.weights) + self.bias)
        return out

    def score(self, value: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-(a * np.clip(value, FLOOR, -FLOOR) + b)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 10, block: int = 2000) -> np.ndarray:
    """Squared hinge loss with an unpenalised bias (last), by Newton steps; rows are taken a block at a time."""
    width = x.shape[1] + 1
    w = np.zeros(width)
    keep = np.eye(width) * ridge
    keep[-1, -1] = 1e-9
    share = (weight / weight.sum()).astype(np.float32)
    for _ in range(rounds):
        live = np.flatnonzero(y * (x @ w[:-1].astype(np.float32) + np.float32(w[-1])) < 1)
        left, right = keep.copy(), np.zeros(width)
        for lo in range(0, len(live), block):
            at = live[lo : lo + block]
            part = np.hstack([x[at], np.ones((len(at), 1), np.float32)])
            scaled = part * share[at, None]
            left += scaled.T @ part
            right += scaled.T @ y[at].astype(np.float32)
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-3 * max(1.0, np.abs(new).max()):
            break
        w = new
    return w


def _logistic(v: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept, by Newton steps with a small ridge; both labels weigh the same, and targets are drawn in a
    little, as Platt does."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    share = np.where(y > 0, 0.5 / n1, 0.5 / n0) * len(y)
    x, w = np.stack([np.clip(v, FLOOR, -FLOOR), np.ones(len(v))], 1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (share * p * (1 - p))[:, None]).T @ x + np.eye(2) * 1e-3
        step = np.linalg.solve(h, x.T @ (share * (p - target)) + 1e-3 * w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def _joined(unit: bytes) -> bytes:
    return _MARKED[2] % unit[1:-1]


def _disturbed(unit: bytes, rng: np.random.Generator) -> list[bytes]:
    """A unit with one or two characters inserted, one left out (if four remain), doubled or replaced."""
    letters = list(unit[1:-1])
    n = len(letters)
    other = lambda: int(rng.integers(1, 27))
    out = [letters[:i] + [other()] + letters[i:] for i in range(1, n)]
    out += [letters[:i] + [letters[i]] + letters[i:] for i in range(n)]
    if n > 4:
        out += [letters[:i] + [int(rng.integers(28, 60))] + letters[i + 1 :] for i in range(n)]
        out += [letters[:i] + letters[i + 1 :] for i in range(n)]
    for i in range(1, n):
        lo, hi = sorted((i, int(rng.integers(1, n))))
        out.append(letters[:lo] + [other()] + letters[lo:hi] + [other()] + letters[hi:])
        out.append(letters[:i] + [other(), other()] + letters[i:])
    return [bytes([START, *x, END]) for x in out if SHORTEST <= len(x) <= LONGEST]


def _solved(units: list[bytes], y: np.ndarray, weight: np.ndarray, marks: list[bytes]) -> tuple[np.ndarray, float]:
    """Coefficients of the landmarks and the bias, from the machine in the space that these span."""
    near = _kernel(marks, marks).astype(np.float64)
    root = np.linalg.cholesky((near + near.T) / 2 + 1e-3 * np.eye(len(marks)))
    x, back = _kernel(units, marks), np.linalg.inv(root).T
    for lo in range(0, len(x), 1000):
        x[lo : lo + 1000] = x[lo : lo + 1000] @ back
    w = _svm(x, y, weight * (len(y) / weight.sum()), 1e-5)
    return np.linalg.solve(root.T, w[:-1]), float(w[-1])


def _linear(units: list[bytes], weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units))
    for at, ids, weight in _features(units):
        out[at] = weights[ids] @ weight
    return out


def train(texts: list[str], toxic: np.ndarray, landmarks: int = 1000, rounds: int = 8, seed: int = 3) -> ToxicityModel:
    """Fit on texts with their labels (0, 1)."""
    toxic = np.asarray(toxic, np.int64)
    nothing = ToxicityModel(np.zeros(CODES**3, np.float32))
    if not len(toxic) or toxic.min() == toxic.max():
        return nothing
    rng = np.random.default_rng(seed)
    s = Corpus(texts)
    label = toxic[s.doc]
    # distinct single runs and how many texts of each label have them
    single, name, names = s.names()
    pairs = np.unique(s.doc[single].astype(np.int64) * len(names) + name)
    counts = np.zeros((2, len(names)))
    np.add.at(counts, (toxic[pairs // max(1, len(names))], pairs % max(1, len(names))), 1)
    n = np.bincount(toxic, minlength=2)
    odds = np.log((counts[1] + 0.5) / (n[1] + 1)) - np.log((counts[0] + 0.5) / (n[0] + 1))
    # a run that clean texts have is no witness
    fit_for = counts[0] <= 0.02 * counts[1] * n[0] / n[1]
    usual = np.flatnonzero((counts[1] >= max(5, OFTEN * n[1])) & (odds > np.log(8.0)) & fit_for)
    usual = np.sort(usual[np.argsort(-counts[1][usual], kind="stable")][:DISTURBED_WITNESSES])
    bad = single[label[single] == 1]
    bad_name = name[label[single] == 1]
    clean = np.flatnonzero(label == 0)
    by_hash = np.argsort((clean * np.int64(2654435761)) % np.int64(1 << 32), kind="stable")[: CLEAN_UNITS // 4]
    easy = s.units(clean[by_hash])
    hard: list[bytes] = []
    disturbed = {k: _disturbed(names[k], rng) for k in usual.tolist()}
    marks: list[bytes] = []
    folded, bias = np.zeros(CODES**3), 0.0
    value = np.zeros(len(s.doc), np.float32)
    for turn in range(rounds):
        worth = odds[bad_name] if not turn else value[bad]
        order = np.lexsort((worth, s.doc[bad]))
        final = np.append(s.doc[bad][order][1:] != s.doc[bad][order][:-1], True) if len(order) else np.zeros(0, bool)
        found, times = np.unique(bad_name[order[final]], return_counts=True)
        found, times = found[fit_for[found]], times[fit_for[found]].astype(float)
        # and runs that several toxic texts have and no clean one
        extra = np.flatnonzero((counts[1] >= 4) & (odds > np.log(8.0)) & (counts[0] == 0))
        words = np.union1d(np.union1d(found, usual), extra)
        if not len(words):
            return nothing
        weight = np.ones(len(words))
        weight[np.searchsorted(words, found)] += times
        # runs split in two or three are learnt as they are
        units, weight = [names[k] for k in words] + [_joined(names[k]) for k in usual], weight.tolist() + (counts[1][usual] / 2).tolist()
        for more in disturbed.values():
            units += more
            weight += [DISTURBED * n[1] / len(disturbed) / len(more)] * len(more)
        known = set(units)
        against = [u for u in dict.fromkeys([*hard, *easy]) if u not in known]
        size = landmarks if turn >= rounds - 3 else landmarks // 3  # the first rounds only look for hard units
        top = [names[k] for k in words[np.argsort(-counts[1][words], kind="stable")][: size // 3]]
        marks = list(dict.fromkeys([*top, *units[len(words) :: max(1, (len(units) - len(words)) // (size // 3))], *against]))[:size]
        share = np.concatenate([np.array(weight) / sum(weight), np.full(len(against), 2 / max(1, len(against)))])
        y = np.concatenate([np.ones(len(units)), -np.ones(len(against))])
        alpha, bias = _solved([*units, *against], y, share, marks)
        folded = np.zeros(CODES**3)
        for at, ids, weights in _features(marks):
            np.add.at(folded, ids, alpha[at][:, None] * weights[None, :])
        value = s.values(folded.astype(np.float32)) + np.float32(bias)
        # clean units within the margin stay or join, the worst first
        worst = clean[value[clean] > -1]
        worst = worst[np.argsort(-value[worst], kind="stable")]
        hard = list(dict.fromkeys([*s.units(worst[: CLEAN_UNITS // 4]), *hard]))[: CLEAN_UNITS * 3 // 4]

    model = ToxicityModel(folded.astype(np.float32), bias, landmarks=marks)
    values = np.full(len(toxic), FLOOR)
    np.maximum.at(values, s.doc, value)
    # as many texts again whose witness is disturbed
    more = [u for v in disturbed.values() for u in v]
    if more:
        weights = np.repeat([1 / len(v) for v in disturbed.values()], [len(v) for v in disturbed.values()])
        drawn = rng.choice(len(more), int(n[1]), p=weights / weights.sum())
        own = _linear([more[k] for k in drawn], model.weights) + bias
        values, toxic = np.concatenate([values, own]), np.concatenate([toxic, np.ones(len(drawn), np.int64)])
    model.curve = _logistic(values, toxic.astype(float))
    return model


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    """Rows kept from training: crc32 of the id as text, modulo ``parts``."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, parts: int, rest: int, per_class: int) -> DataFrame:
    """At most ``per_class`` training rows of each label, those of the least hashes: id, text, label."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col), parts, rest)).select(id_col, label)
    by_hash = [usable.filter(F.col(label) == y).orderBy(F.xxhash64(id_col), id_col).limit(per_class) for y in (0, 1)]
    picked = by_hash[0].unionByName(by_hash[1])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(picked.select(F.col(id_col).alias("id"), F.col(label).alias("label")), "id")
    # an id that repeats counts once, so the sample is bounded whatever the table holds
    return rows.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "text", "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> ToxicityModel:
    def run(rows: pd.DataFrame) -> ToxicityModel:
        rows = rows.sort_values(["id", "label"], kind="stable")
        return train(rows["text"].tolist(), rows["label"].to_numpy())

    return fitted_in_a_task(labelled_sample(docs, labels, "toxic", id_col, text_col, 3, 1, per_class), run)


def scored(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 (in the place of a column of that name, if there)."""

    @F.pandas_udf(T.DoubleType())
    def udf(texts: pd.Series) -> pd.Series:
        parts = [model.score(model.text_values(pdf["text"].tolist())) for pdf in text_chunks(texts.to_frame("text"), "text", 1 << 19)]
        return pd.Series(np.concatenate(parts) if parts else np.zeros(0))

    rows = boxed(docs).withColumn("_score", udf(F.col(f"_doc.`{text_col}`")))
    return rows.select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c != out], F.col("_score").alias(out))
