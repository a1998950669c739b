"""Toxicity by a linear-chain conditional random field over words.

Labels are of documents, so words are labelled first: features (a word, and its first 3 to 7 letters) are counted once
a document over the training documents, and those far more frequent in toxic documents mark words of toxic documents
as toxic. A two-state field is fitted to these word labels: the weights of features and the four transitions climb the
likelihood of the whole chain, by the difference of marked and expected words and transitions. Forward-backward marginals
tag each word; their noisy-or, sum and largest value are the inputs of a logistic document score; words over a half are spans.

Only words with a marked feature carry evidence. The words between two of them all have the same factor, so the
recursion steps over them with a power of one 2x2 matrix: the marginals and expected transitions are those of the full chain.

Null and empty texts have no words and get the score of a document without evidence. Rows that share a doc_id are all
scored. Rows without a label are never trained on; a doc_id with both labels counts as toxic. Without labels of both kinds, nothing is toxic: scores are 0. Ties in a text's
evidence do not matter, as nothing is ranked. An empty table gives no rows. Other columns are left out of scores, and kept by the filter.
A text is held whole, with a number for each word that has evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import in_batches, tidy

WORD = re.compile(r"[^\W\d_]+")
PREFIXES = range(3, 8)
#: Bound on the labelled rows that are fitted to; chosen by hash. Rows with toxic = 1 and with 0 have half each.
TRAIN_ROWS = 12_000
#: Features that mark toxic words: at least so many toxic training documents, and log-odds.
LEAST_DOCS, LEAST_ODDS = 4, 3.0
#: Steps up the likelihood, and the size of the first ones.
ROUNDS, RATE = 60, 0.1
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))


@dataclass
class ToxicField:
    """Weights: of each marked feature for state 1, of the four transitions, of the document score."""

    features: dict[str, float] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.array([[2.0, -8.0], [1.0, -6.0]]))
    score: np.ndarray = field(default_factory=lambda: np.array([-30.0, 0.0, 0.0, 0.0]))


def features_of(word: str) -> list[str]:
    return [word, *(f"{word[:k]}^" for k in PREFIXES if len(word) > k)]


def _evidence(text: str, marked: dict[str, float], seen: dict[str, float]) -> tuple[int, list[tuple[int, float, int, int]]]:
    """The text's number of words, and place, weight, start and end of each word with a marked feature."""
    found, n = [], 0
    lowered = text.lower()
    for n, m in enumerate(WORD.finditer(lowered if len(lowered) == len(text) else text), 1):
        word = m.group()
        weight = seen.get(word)
        if weight is None:
            if len(seen) > 100_000:
                seen.clear()
            weight = seen[word] = sum(marked.get(f, 0.0) for f in features_of(word.lower()))
        if weight:
            found.append((n - 1, weight, m.start(), m.end()))
    return n, found


def _log_matmul(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a[..., :, 0, None] + b[..., None, 0, :], a[..., :, 1, None] + b[..., None, 1, :])


class _Chain:
    """Forward-backward over words with evidence, stepping over runs of the others."""

    def __init__(self, transitions: np.ndarray):
        self.step = transitions
        self.powers = [np.array([[0.0, -np.inf], [-np.inf, 0.0]]), self.step]

    def power(self, n: np.ndarray) -> np.ndarray:
        """Log of step^n for each n, by squaring."""
        out = np.broadcast_to(self.powers[0], (*n.shape, 2, 2)).copy()
        square, left = self.step, n.copy()
        while left.any():
            odd = (left & 1).astype(bool)
            if odd.any():
                out[odd] = _log_matmul(out[odd], square)
            square, left = _log_matmul(square, square), left >> 1
        return out

    def marginals(self, gaps: np.ndarray, weights: np.ndarray, used: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Probability of state 1 at each used cell, forward and backward messages, and log Z.

        gaps: words since the evidence before; tail: words after the last. A chain begins as if after state 0.
        """
        rows, cells = weights.shape
        into = _log_matmul(self.power(np.maximum(gaps - 1, 0)), np.broadcast_to(self.step, (rows, cells, 2, 2)))
        into = into + np.stack([np.zeros_like(weights), weights], -1)[..., None, :]
        into = np.where(used[..., None, None], into, self.powers[0])
        forward = np.empty((rows, cells + 1, 2))
        forward[:, 0] = [0.0, -np.inf]
        for t in range(cells):
            forward[:, t + 1] = np.logaddexp(forward[:, t, 0, None] + into[:, t, 0], forward[:, t, 1, None] + into[:, t, 1])
        end = self.power(tail)
        backward = np.empty((rows, cells + 1, 2))
        backward[:, cells] = np.logaddexp(end[..., 0], end[..., 1])
        for t in range(cells, 0, -1):
            backward[:, t - 1] = np.logaddexp(into[:, t - 1, :, 0] + backward[:, t, 0, None], into[:, t - 1, :, 1] + backward[:, t, 1, None])
        log_z = np.logaddexp(*(forward[:, cells] + backward[:, cells]).T)
        state = np.exp(forward[:, 1:] + backward[:, 1:] - log_z[:, None, None])
        return state[..., 1] * used, forward, backward, log_z

    def _paths(self, n: np.ndarray) -> np.ndarray:
        """Log of the weight of all paths of n steps with one step from i to j marked: n x i x j x first state x last state."""
        scale = np.log(np.abs(np.linalg.eigvals(np.exp(self.step))).max())
        step = np.exp(self.step - scale)
        square = np.zeros((2, 2, 4, 4))
        square[..., :2, :2] = square[..., 2:, 2:] = step
        for i in (0, 1):
            for j in (0, 1):
                square[i, j, i, 2 + j] = step[i, j]
        out, left = np.broadcast_to(np.eye(4), (len(n), 2, 2, 4, 4)).copy(), n.copy()
        while left.any():
            odd = (left & 1).astype(bool)
            out[odd] = out[odd] @ square
            square, left = square @ square, left >> 1
        with np.errstate(divide="ignore"):
            return np.log(out[..., :2, 2:]) + (scale * n)[:, None, None, None, None]

    def expected(self, gaps: np.ndarray, weights: np.ndarray, used: np.ndarray, tail: np.ndarray, forward: np.ndarray, backward: np.ndarray, log_z: np.ndarray) -> np.ndarray:
        """Expected number of each transition over all texts, words without evidence included."""
        row, cell = np.nonzero(used)
        n, which = np.unique(np.concatenate([gaps[row, cell], tail]), return_inverse=True)
        paths = self._paths(n)[which]
        left = np.concatenate([forward[row, cell], forward[:, -1]])
        right = np.concatenate([backward[row, cell + 1] + np.stack([np.zeros(len(row)), weights[row, cell]], 1), np.zeros((len(tail), 2))])
        total = left[:, None, None, :, None] + paths + right[:, None, None, None, :] - np.concatenate([log_z[row], log_z])[:, None, None, None, None]
        return np.exp(total).sum((0, 3, 4))


def _padded(found: list[tuple[int, list]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cells = max((len(e) for _, e in found), default=0)
    gaps, weights, used, tail = np.zeros((len(found), cells), np.int64), np.zeros((len(found), cells)), np.zeros((len(found), cells), bool), np.zeros(len(found), np.int64)
    for i, (n, e) in enumerate(found):
        last = -1
        for j, (at, w, *_) in enumerate(e):
            gaps[i, j], weights[i, j], used[i, j], last = at - last, w, True, at
        tail[i] = n - 1 - last
    return gaps, weights, used, tail


def _alike(found: list[tuple[int, list]], rows: int = 256, cells: int = 100_000) -> Iterator[list[int]]:
    """Numbers of texts, those of like numbers of words with evidence together: no more than `rows`, nor than `cells` when padded."""
    order, at = sorted(range(len(found)), key=lambda i: len(found[i][1])), 0
    while at < len(order):
        widest = max(1, len(found[order[min(at + rows, len(order)) - 1]][1]))
        part = order[at : at + max(1, min(rows, cells // widest))]
        yield part
        at += len(part)


def _aggregates(p: np.ndarray) -> np.ndarray:
    """Rows of 1, log-odds of the noisy-or, log of the expected number of toxic words, and the largest marginal."""
    p = np.clip(p, 0, 1 - 1e-12)
    none = np.log1p(-p).sum(1) if p.shape[1] else np.zeros(len(p))
    some = np.clip(-np.expm1(none), 1e-6, 1 - 1e-6)
    return np.stack([np.ones(len(p)), np.log(some / (1 - some)), np.log1p(p.sum(1)), p.max(1) if p.shape[1] else np.zeros(len(p))], 1)


def _tagged(model: ToxicField, texts: list[str], seen: dict[str, float]) -> tuple[np.ndarray, list, list]:
    """Scores, marginals and evidence of each text."""
    chain = _Chain(model.transitions)
    found = [_evidence(t or "", model.features, seen) for t in texts]
    scores, tags = np.empty(len(texts)), [np.empty(0)] * len(texts)
    for part in _alike(found):
        p = chain.marginals(*_padded([found[i] for i in part]))[0]
        scores[part] = 1 / (1 + np.exp(-_aggregates(p) @ model.score))
        for k, i in enumerate(part):
            tags[i] = p[k, : len(found[i][1])]
    return scores, tags, found


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> ToxicField:
    """Fit to labelled rows with crc32(doc_id as text) mod 3 other than 1, no more than train_rows of them.

    Counts of features are made on the executors; the driver gets those of marked features, and for each row
    the words that have one.
    """
    marks = labels.filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    halves = [marks.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows // 2) for k in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(halves[0].unionByName(halves[1])), "doc_id").select("toxic", "text")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            n = {}
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                for f in {f for w in set(WORD.findall((text or "").lower())) for f in features_of(w)}:
                    n.setdefault(f, [0, 0])[toxic] += 1
                n.setdefault("", [0, 0])[toxic] += 1
            yield pd.DataFrame([(f, *v) for f, v in n.items()], columns=["feature", "n0", "n1"])

    counts = in_batches(rows).mapInPandas(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    total = counts.filter("feature = ''").collect()
    if not total or not total[0]["n0"] or not total[0]["n1"]:
        return ToxicField()
    t0, t1 = total[0]["n0"], total[0]["n1"]
    odds = F.log((F.col("n1") + 0.5) / (t1 + 1)) - F.log((F.col("n0") + 0.5) / (t0 + 1))
    chosen = counts.filter((F.col("feature") != "") & (F.col("n1") >= LEAST_DOCS) & (odds >= LEAST_ODDS)).select("feature", odds.alias("odds")).collect()
    if not chosen:
        return ToxicField()
    marked = {r["feature"]: 1.0 for r in chosen}

    def evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for toxic, text in zip(frame["toxic"], frame["text"], strict=True):
                places, names, n = [], [], 0
                for n, word in enumerate(WORD.findall((text or "").lower()), 1):
                    if any(f in marked for f in features_of(word)):
                        places.append(n - 1)
                        names.append(word)
                out.append((toxic, n, places, names))
            yield pd.DataFrame(out, columns=["toxic", "n", "places", "names"])

    sample = in_batches(rows).mapInPandas(evidence, "toxic int, n int, places array<int>, names array<string>").collect()
    model = _fit_field(sample, {r["feature"]: r["odds"] for r in chosen})
    # the halves of the sample are brought back to their shares among all labelled rows
    there = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    model.score[0] += math.log(there[1] / there[0]) - math.log(t1 / t0)
    return model


def _marked_transitions(n: int, places: list[int]) -> np.ndarray:
    """How often each transition occurs in a text of n words whose words at `places` (ascending) are toxic."""
    if not n:
        return np.zeros((2, 2))
    inside = sum(b - a == 1 for a, b in zip(places[:-1], places[1:], strict=True))
    out = len(places) - inside - bool(places and places[-1] == n - 1)
    return np.array([[n - len(places) - out, len(places) - inside], [out, inside]], float)


def _fit_field(sample: list, odds: dict[str, float], rounds: int = ROUNDS) -> ToxicField:
    """Climbs the penalised log-likelihood of the word labels (weights and transitions), then that of the document labels."""
    names = sorted(odds)
    index = {f: k for k, f in enumerate(names)}
    strength = np.array([odds[f] for f in names])
    found = [(r["n"], list(zip(r["places"], r["names"], strict=True))) for r in sample]
    toxic = np.array([r["toxic"] for r in sample])
    parts, uses, shared, steps = [], np.zeros(len(names)), np.zeros(len(names)), np.zeros((2, 2))
    for part in _alike(found):
        gaps, _, used, tail = _padded([(found[i][0], [(at, 1.0) for at, _ in found[i][1]]) for i in part])
        cell = [(k, j, index[f]) for k, i in enumerate(part) for j, (_, w) in enumerate(found[i][1]) for f in features_of(w) if f in index]
        row, col, feat = np.array(cell, np.int64).reshape(-1, 3).T
        best, together = np.zeros(used.shape), np.zeros(used.shape)
        np.maximum.at(best, (row, col), strength[feat])
        np.add.at(together, (row, col), 1.0)
        uses += np.bincount(feat, minlength=len(names))
        shared += np.bincount(feat, together[row, col], len(names))
        gold = (best >= LEAST_ODDS) & (toxic[part][:, None] == 1) & used
        steps += sum((_marked_transitions(found[i][0], [at for (at, _), g in zip(found[i][1], gold[k], strict=False) if g]) for k, i in enumerate(part)), np.zeros((2, 2)))
        parts.append((part, gaps, used, tail, row, col, feat, gold))
    # as many weights as features: they start from the counts, shared among the features that a word has together
    start = strength / np.maximum(1, shared / np.maximum(1, uses))
    at = np.concatenate([start, ToxicField().transitions.reshape(-1)])
    mean, spread = np.zeros(len(at)), np.zeros(len(at))

    def tagged(weights, gaps, used, tail, row, col, feat) -> tuple:
        cells = np.zeros(used.shape)
        np.add.at(cells, (row, col), weights[feat])
        return cells, chain.marginals(gaps, cells, used, tail)

    for n in range(1, rounds + 1):
        weights, chain = at[:-4], _Chain(at[-4:].reshape(2, 2))
        slope, expected = -0.01 * weights, np.zeros((2, 2))
        for _, gaps, used, tail, row, col, feat, gold in parts:
            cells, (p, *messages) = tagged(weights, gaps, used, tail, row, col, feat)
            slope = slope + np.bincount(feat, ((gold - p) * used)[row, col], len(names))
            expected += chain.expected(gaps, cells, used, tail, *messages)
        slope = np.concatenate([slope, (steps - expected).reshape(-1) - 0.01 * at[-4:]])
        # steps of like size in every direction, shorter as the rounds go on
        mean, spread = 0.8 * mean + 0.2 * slope, 0.95 * spread + 0.05 * slope**2
        at = at + RATE * (1 - (n - 1) / rounds) * (mean / (1 - 0.8**n)) / (np.sqrt(spread / (1 - 0.95**n)) + 1e-9)
    weights, chain = at[:-4], _Chain(at[-4:].reshape(2, 2))
    model = ToxicField(dict(zip(names, weights.tolist(), strict=True)), at[-4:].reshape(2, 2))
    x = np.empty((len(sample), 4))
    for part, gaps, used, tail, row, col, feat, _ in parts:
        x[part] = _aggregates(tagged(weights, gaps, used, tail, row, col, feat)[1][0])
    b = np.zeros(x.shape[1])
    for _ in range(50):  # Newton's steps
        s = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        b = b + np.linalg.solve((x * (s * (1 - s) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(b)), x.T @ (toxic - s) - 0.1 * b)
    model.score = b
    return model


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, rows) for batch in batches for at in range(0, batch.num_rows, rows))


def score_documents(docs: DataFrame, model: ToxicField) -> DataFrame:
    """doc_id, score, spans (array of start, end, probability, in code points of the text) for every row."""

    @tidy
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for part in _parts(batches):
            scores, tags, found = _tagged(model, part.column("text").to_pylist(), seen)
            spans = [[{"start": s, "end": e, "p": float(q)} for (_, _, s, e), q in zip(f, p, strict=True) if q >= 0.5] for (_, f), p in zip(found, tags, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores), pa.array(spans, SPANS)], ["doc_id", "score", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return in_batches(docs.select("doc_id", "text")).mapInArrow(score, f"doc_id {kind}, score double, spans array<struct<start:int,end:int,p:double>>")


def toxicity_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted, spans."""
    scored = score_documents(docs, fit(docs, labels))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "spans")


def without_toxic(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.7) -> DataFrame:
    """docs without the rows that score at or over the threshold; all columns kept. Labels are of the rows of `labelled`, or of docs."""
    model = fit(docs if labelled is None else labelled, labels)

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, float] = {}
        for part in _parts(batches):
            yield part.filter(pa.array(_tagged(model, part.column("text").to_pylist(), seen)[0] < threshold))

    return in_batches(docs).mapInArrow(keep, docs.schema)
