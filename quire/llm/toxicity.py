"""Toxicity scores from a support vector machine over a subsequence string kernel.

Texts are read as tokens: words with everything but letters taken out, in lower case; letters that stand alone one after
another are one token. Two tokens are alike by the three-letter subsequences that they share within ``SPAN`` letters, each
weighted by ``DECAY`` to the power of the letters it spans, so that gaps and inserted characters cost something but do not
hide a word. The kernel is divided by what a token of that length has at most.

Training takes a bounded sample of labelled documents (``per_class`` of each label, by a hash of their id). Only documents
carry labels; a toxic one has at least one toxic sentence, and in it a token that makes it so. Tokens that toxic documents
have far more often than clean ones are the first witnesses. A linear machine with squared hinge loss is trained on the
Nyström features of witnesses and of clean documents' tokens. In further rounds the best token of each toxic document
without a witness joins the witnesses, and the clean tokens that score highest are added to the negatives. A document's score
is a logistic function of its two highest tokens, fitted on the sample.

A machine over Nyström features is a weighted sum of kernels with the landmarks, and each kernel is a sum over subsequences;
so the trained machine is one table of subsequence weights, and scoring is a few look-ups for each letter.

Null and empty texts have no tokens and get the score of a document with the lowest tokens possible. Rows are scored alone, so
repeated rows score alike. Several labels of one id count as toxic if any is; null labels and ids are not learnt from. Without
any labelled rows of both classes every score is the share of toxic ones (0 without labels). An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.arrays import lower, prefix_hash, range_hash, slices, words

SPAN, DECAY, BITS = 6, 0.7, 6
PER_CLASS, LANDMARKS, ROUNDS = 2500, 240, 3
LOWEST = -4.0
_PAIRS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]
_CODE = np.full(256, 255, np.uint8)
_CODE[97:123] = np.arange(26)
_CODE[128:] = 26 + np.arange(128) % ((1 << BITS) - 26)


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter codes without all else, the first letter of each token (one more than tokens), the first token of each row (one more than rows)."""
    start, _, first_word = words(data, off)
    code = _CODE[lower(data)]
    is_letter = code != 255
    before = np.concatenate([[0], np.cumsum(is_letter)])
    begin = np.append(before[start], before[-1])
    count = np.diff(begin)
    filled = count > 0
    row = np.repeat(np.arange(len(off) - 1), np.diff(first_word))[filled]
    begin, count = begin[:-1][filled], count[filled]
    if not len(begin):
        return code[is_letter], np.zeros(1, np.int64), np.zeros(len(off), np.int64)
    joined = np.zeros(len(begin), bool)
    joined[1:] = (count[1:] == 1) & (count[:-1] == 1) & (row[1:] == row[:-1])
    return code[is_letter], np.append(begin[~joined], before[-1]), np.searchsorted(row[~joined], np.arange(len(off)))


def token_norm(size: np.ndarray) -> np.ndarray:
    """Square root of what a token of this many letters has in common with itself if no subsequence repeats."""
    total = np.zeros(len(size))
    for _, k in _PAIRS:
        total += np.maximum(size - k, 0) * DECAY ** (2 * (k + 1))
    return np.sqrt(total)


def _subsequences(code: np.ndarray, token: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Place of the first letter, subsequence number and weight, for each shape of gaps."""
    wide = code.astype(np.int32)
    left = np.repeat(token[1:], np.diff(token)) - np.arange(len(code))
    for j, k in _PAIRS:
        at = np.flatnonzero(left > k)
        yield at, wide[at] << 2 * BITS | wide[at + j] << BITS | wide[at + k], DECAY ** (k + 1)


def weigh(code: np.ndarray, token: np.ndarray, table: np.ndarray) -> np.ndarray:
    """For each token, the sum of its subsequences' weights in the table, by the token's norm; NaN for tokens under three letters."""
    size = np.diff(token)
    if not len(size):
        return np.zeros(0)
    own = np.zeros(len(code))
    for at, number, weight in _subsequences(code, token):
        own[at] += weight * table[number]
    total = np.concatenate([[0.0], np.cumsum(own)])
    norm = token_norm(size)
    return np.where(size > 2, (total[token[1:]] - total[token[:-1]]) / np.where(norm > 0, norm, 1), np.nan)


class Tokens:
    """Distinct tokens of some texts, with their letters and the texts that have them."""

    def __init__(self, texts: list[str]) -> None:
        keys, owners, sizes, codes, done = [], [], [], [], 0
        for part, data, off in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), "text"):
            code, token, row = letters(data, off)
            size = np.diff(token)
            fit = np.flatnonzero(size > 2)
            own, first, which = np.unique(range_hash(prefix_hash(code), token[:-1][fit], token[1:][fit]), return_index=True, return_inverse=True)
            pairs = np.unique(np.repeat(np.arange(part.num_rows), np.diff(row))[fit] * len(own) + which) if len(own) else np.zeros(0, np.int64)
            owners.append((own[pairs % max(len(own), 1)], done + pairs // max(len(own), 1)))
            kept = fit[first]
            n = size[kept]
            keys.append(own)
            sizes.append(n)
            codes.append(code[np.repeat(token[:-1][kept] - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            done += part.num_rows
        every, size, code = np.concatenate(keys), np.concatenate(sizes), np.concatenate(codes)
        start = np.cumsum(size) - size
        self.keys, first = np.unique(every, return_index=True)
        n = size[first]
        self.begin = np.concatenate([[0], np.cumsum(n)])
        self.code = code[np.repeat(start[first] - self.begin[:-1], n) + np.arange(self.begin[-1])]
        self.token = np.searchsorted(self.keys, np.concatenate([o[0] for o in owners]))
        self.text = np.concatenate([o[1] for o in owners])

    def kernel(self, tokens: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
        """Kernel of some tokens with each of the landmark tokens."""
        size = np.diff(self.begin)
        begin = np.concatenate([[0], np.cumsum(size[tokens])])
        code = self.code[np.repeat(self.begin[:-1][tokens] - begin[:-1], size[tokens]) + np.arange(begin[-1])]
        out = np.empty((len(tokens), len(landmarks)), np.float32)
        for i, t in enumerate(landmarks.tolist()):
            out[:, i] = weigh(code, begin, self.table(np.array([t]), np.ones(1)))
        return out

    def table(self, landmarks: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Weights of subsequences that give the weighted sum of the landmarks' kernels."""
        size = np.diff(self.begin)[landmarks]
        begin = np.concatenate([[0], np.cumsum(size)])
        code = self.code[np.repeat(self.begin[:-1][landmarks] - begin[:-1], size) + np.arange(begin[-1])]
        scale = np.repeat(weights / token_norm(size), size)
        out = np.zeros(1 << 3 * BITS)
        for at, number, weight in _subsequences(code, begin):
            np.add.at(out, number, weight * scale[at])
        return out


def machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, shrink: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Linear weights and bias with squared hinge loss, both classes of equal weight in all, by accelerated gradient steps."""
    x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1).astype(np.float64)
    mass = np.where(y > 0, 0.5 * weight / max(weight[y > 0].sum(), 1), 0.5 * weight / max(weight[y < 0].sum(), 1))
    w = v = np.zeros(x.shape[1])
    rate = 1 / (2 * np.linalg.eigvalsh(x.T @ (mass[:, None] * x))[-1] + shrink)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v))
        fresh = v - rate * (-2 * x.T @ (mass * y * slack) + shrink * np.append(v[:-1], 0))
        v = fresh + t / (t + 3) * (fresh - w)
        w = fresh
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 40) -> np.ndarray:
    """Weights (the last is the bias) by Newton steps with a small ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-3 * np.eye(len(w)), x.T @ (p - y) + 1e-3 * w)
    return w


def top_two(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The two highest values of each row, ``LOWEST`` where there are fewer."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fit = ~np.isnan(values)
    values, row = np.maximum(values[fit], LOWEST), row[fit]
    out = np.full((len(first) - 1, 2), LOWEST)
    np.maximum.at(out[:, 0], row, values)
    # One token at the highest value does not count again.
    best = np.flatnonzero(values == out[row, 0])
    lead = best[np.unique(row[best], return_index=True)[1]]
    rest = np.ones(len(values), bool)
    rest[lead] = False
    np.maximum.at(out[:, 1], row[rest], values[rest])
    return out


class Model:
    def __init__(self, texts: list[str], toxic: np.ndarray, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> None:
        self.table, self.bias, self.share = None, 0.0, float(toxic.mean()) if len(toxic) else 0.0
        if not 0 < self.share < 1:
            return
        t = Tokens(texts)
        n_toxic = np.bincount(t.token, toxic[t.text], len(t.keys))
        n_clean = np.bincount(t.token, 1 - toxic[t.text], len(t.keys))
        lift = np.log((n_toxic + 0.5) / (toxic.sum() + 1)) - np.log((n_clean + 0.5) / ((1 - toxic).sum() + 1))
        witness = (n_toxic >= 4) & (lift > 2.5)
        if not witness.any():
            witness[np.argmax(lift)] = True
        order = np.argsort(t.keys, kind="stable")  # keys are hashes: an arbitrary but fixed order
        negatives = np.zeros(len(t.keys), bool)
        clean_only = order[(n_clean[order] > 0) & ~witness[order]]
        negatives[clean_only[np.argsort(-n_clean[clean_only], kind="stable")][:6000]] = True
        negatives[clean_only[:6000]] = True
        strong = np.flatnonzero(witness)
        chosen = np.concatenate([strong[np.argsort(-lift[strong], kind="stable")][: landmarks // 2], np.flatnonzero(negatives)[np.argsort(t.keys[negatives])][: landmarks // 2]])
        values, vectors = np.linalg.eigh(t.kernel(chosen, chosen).astype(np.float64))
        keep = values > 1e-6 * values[-1]
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        features = np.zeros((len(t.keys), 0), np.float32)
        known = np.full(len(t.keys), -1)
        for _ in range(rounds):
            use = np.flatnonzero(witness | negatives)
            fresh = use[known[use] < 0]
            known[fresh] = np.arange(len(fresh)) + (known >= 0).sum()
            own = t.kernel(fresh, chosen) @ whiten.astype(np.float32)
            features = np.concatenate([features[:0].reshape(0, own.shape[1]) if not features.size else features, own])
            w, self.bias = machine(features[known[use]], np.where(witness[use], 1.0, -1.0), np.where(witness[use], n_toxic[use], 1.0))
            self.table = t.table(chosen, whiten @ w).astype(np.float32)
            score = weigh(t.code, t.begin, self.table) + self.bias
            # Toxic documents without a witness name their best token, if it beats what clean documents have.
            has = np.zeros(len(texts), bool)
            has[t.text[witness[t.token]]] = True
            open_ = toxic.astype(bool) & ~has
            pick = open_[t.text]
            best = np.full(len(texts), -np.inf)
            np.maximum.at(best, t.text[pick], score[t.token[pick]])
            named = t.token[pick][score[t.token[pick]] == best[t.text[pick]]]
            witness[named[(n_clean[named] == 0) & (score[named] > 0.5)]] = True
            against = clean_only[np.argsort(-score[clean_only], kind="stable")][:2000]
            negatives[against[~witness[against]]] = True
        tops = [self.tops(data, off) for _, data, off in slices(pa.record_batch({"text": pa.array(texts, pa.string())}), "text")]
        self.weights = logistic(np.concatenate(tops), toxic)

    def tops(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        code, token, first = letters(data, off)
        return top_two(weigh(code, token, self.table) + self.bias, first)

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        if self.table is None:
            return np.full(len(off) - 1, self.share)
        return 1 / (1 + np.exp(-np.clip(self.tops(data, off) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model from at most ``per_class`` labelled documents of each class, none of them held out."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.where(~is_held_out()).withColumn("place", F.xxhash64("doc_id"))
    part = lambda y: known.where(F.col("toxic") == y).orderBy("place").limit(per_class)
    sample = F.broadcast(part(1).union(part(0)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(sample, "doc_id").select("place", "text", "toxic").toArrow()
    rows = rows.sort_by([("place", "ascending"), ("text", "ascending")])
    return Model([x or "" for x in rows.column("text").to_pylist()], np.array(rows.column("toxic").to_pylist(), float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(shared.value.scores(data, off).astype(float))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
