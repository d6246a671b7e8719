"""Log probabilities of texts under a word count model and a small causal self-attention model on subword ids.

The attention model predicts the class of the next subword and then the subword within its class:
P(id | context) = P(class | context) * P(id | class, class before). Classes are clusters of ids by their neighbours. The class
comes from one layer of masked self-attention with relative position biases over the last 16 to 31 ids. The id within its class
comes from counts over all training documents, smoothed by the counts without the class before, and those by a uniform share,
so that every text has a probability.

Everything is learnt from all training documents, where they lie. Neighbour counts are added up over all tasks, and what the
driver sees of them are the sums of products of their columns and a few coordinates of each id. The weights are trained in
rounds: each document is in one of ROUNDS parts, and a round takes one part. Every file's rows of that part are run through
with Adam from the weights of the round before; weights and moments are averaged by key on the executors, those of an id by how
often a file met it, and only the averages come to the driver and are sent out again. Weights follow from the rows of each
file, so a table that lies in other files gives slightly other ones.

Texts are scored in overlapping windows: each holds 16 ids that are scored once and the 15 to 16 before them as context. Windows
of many texts are one batch.

Word counts are exact over all training words. Documents are first written to the shared folder with their ids, in files of
bounded size; each file asks for the counts of its own distinct words, the counts are added up by word, and each file's answers are written beside
it, so that scoring looks up words in one sorted array of its file. No text is shuffled, and no vocabulary is sent whole.

Null and empty texts are their end token alone. Repeated rows count and score as often as they occur. Without training rows
all counts are zero and the attention model is uniform over classes. Other columns do not matter. An empty table gives no rows.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm.arrays import lower, prefix_hash, range_hash, slices, text_buffer, words
from quire.llm.shared import fresh_dir, store
from quire.llm.tokens import Pieces, forget, with_end

NEW, BACK = 16, 15
WIDE = NEW + BACK
DIM, CLASSES = 16, 48
EPOCHS, BATCH, ROUNDS, RATE = 3, 512, 4, 0.01
BLOCK = 256
ID_BYTES = 1 << 19
FILE_ROWS = 8000
END_WORD = np.uint64(0x6E64)  # stands for the end token among word hashes


def is_held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 1, F.lit(False))


def doc_windows(ids: np.ndarray, rows: np.ndarray, start_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs (window, WIDE), targets (window, NEW), which targets exist, and the row of each window."""
    n = np.diff(rows)
    count = -(-n // NEW)
    row = np.repeat(np.arange(len(n)), count)
    within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    # All rows in one line, each behind start symbols and filled up with them to whole windows: input place p of a window is the
    # id before target p - BACK.
    lead = BACK + 1
    line = np.full(len(row) * NEW + len(n) * lead + WIDE, start_id)
    begin = (np.cumsum(count) - count) * NEW + np.arange(len(n)) * lead
    line[np.arange(rows[-1] - rows[0]) + np.repeat(begin + lead - rows[:-1] + rows[0], n)] = ids[rows[0] : rows[-1]]
    at = np.arange(len(row)) * NEW + row * lead
    inputs = np.lib.stride_tricks.sliding_window_view(line, WIDE)[at]
    exists = within[:, None] * NEW + np.arange(NEW) < n[row][:, None]
    targets = np.minimum(np.lib.stride_tricks.sliding_window_view(line, NEW)[at + lead], start_id - 1)
    return inputs, targets, exists, row


LEAST, CONTEXTS, DIMS = 5, 512, 32


def neighbours(ids: np.ndarray, line: np.ndarray, column: np.ndarray, table: np.ndarray) -> None:
    """Adds to ``table`` (line, column) how often each id with a line stands after and before each id with a column."""
    contexts = table.shape[1] // 2
    for a, b, shift in ((ids[1:], ids[:-1], 0), (ids[:-1], ids[1:], contexts)):
        good = (line[a] >= 0) & (column[b] >= 0)
        np.add.at(table.reshape(-1), line[a][good] * (2 * contexts) + column[b][good] + shift, 1)


def places(seen: np.ndarray, least: int, contexts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids that are met often enough, the line of every id among them, and its column among the most frequent (-1 for none)."""
    kinds = np.flatnonzero(seen >= least)
    line, column = np.full(len(seen), -1), np.full(len(seen), -1)
    line[kinds] = np.arange(len(kinds))
    top = np.argsort(-seen, kind="stable")[:contexts]
    column[top] = np.arange(len(top))
    return kinds, line, column


def shares(table: np.ndarray) -> np.ndarray:
    return np.sqrt(table / np.maximum(table.sum(1, keepdims=True), 1))


def axes(products: np.ndarray, total: np.ndarray, n: int, dims: int = DIMS) -> np.ndarray:
    """Main directions of n rows about their mean, from the sum of their products and their sum."""
    return np.linalg.eigh(products - np.outer(total, total) / max(n, 1))[1][:, -dims:]


def k_means(points: np.ndarray, seen: np.ndarray, classes: int) -> np.ndarray:
    """Cluster of each point, from 0 to ``classes`` - 2, weighted by how often its id is met."""
    centres = points[np.argsort(-seen, kind="stable")[: classes - 1]]
    for _ in range(20):
        near = ((points**2).sum(1)[:, None] - 2 * points @ centres.T + (centres**2).sum(1)).argmin(1)
        total = np.zeros_like(centres)
        np.add.at(total, near, points * seen[:, None])
        mass = np.bincount(near, seen, classes - 1)
        centres = np.where(mass[:, None] > 0, total / np.maximum(mass, 1)[:, None], centres)
    return near


def cluster(ids: np.ndarray, n_ids: int, classes: int, least: int = LEAST, contexts: int = CONTEXTS, dims: int = DIMS) -> np.ndarray:
    """Class of every id from the ids around it, where all ids are at hand; ids met too seldom share class 0."""
    out = np.zeros(n_ids, np.int64)
    seen = np.bincount(ids, minlength=n_ids)
    kinds, line, column = places(seen, least, contexts)
    if len(kinds) < classes:
        return out
    table = np.zeros((len(kinds), 2 * contexts))
    neighbours(ids, line, column, table)
    table = shares(table)
    out[kinds] = k_means(table @ axes(table.T @ table, table.sum(0), len(table), dims), seen[kinds], classes) + 1
    return out


def sum_by(index: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers in ``index`` and the sums of their rows of ``values``."""
    index = index.astype(np.uint16) if index.max() < 1 << 16 else index
    order = np.argsort(index, kind="stable")
    index = index.take(order)
    start = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    return index[start], np.add.reduceat(values.take(order, 0), start, axis=0)


class Attention:
    """Parameters, training and batched scoring of the class model."""

    def __init__(self, n_ids: int, of_id: np.ndarray, classes: int = CLASSES, dim: int = DIM) -> None:
        rng = np.random.default_rng(7)
        self.of_id, self.start_id = of_id, n_ids
        draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        self.p = {
            "embed": draw(n_ids + 1, dim), "q": draw(dim, dim), "k": draw(dim, dim), "v": draw(dim, dim),
            "near": np.zeros(WIDE, np.float32), "out": draw(dim, classes), "pair": np.zeros((classes + 1, classes), np.float32),
        }
        self.class_before = np.append(of_id, classes)  # the start symbol has a row of its own
        self.ahead = np.arange(WIDE)[None, :] > np.arange(BACK, WIDE)[:, None]
        self.back = np.maximum(np.arange(BACK, WIDE)[:, None] - np.arange(WIDE)[None, :], 0)

    def forward(self, inputs: np.ndarray) -> tuple:
        p = self.p
        e = p["embed"][inputs]
        q, k, v = e[:, BACK:] @ p["q"], e @ p["k"], e @ p["v"]
        s = q @ k.transpose(0, 2, 1) * np.float32(DIM**-0.5) + np.where(self.ahead, np.float32(-1e4), p["near"][self.back])
        w = np.exp(s - s.max(2, keepdims=True))
        w /= w.sum(2, keepdims=True)
        h = w @ v + e[:, BACK:]
        before = self.class_before[inputs[:, BACK:]]
        z = h @ p["out"] + p["pair"][before]
        y = np.exp(z - z.max(2, keepdims=True))
        y /= y.sum(2, keepdims=True)
        return e, q, k, v, w, h, before, y

    def distinct(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids that are met, and the place of each input among them."""
        here = np.zeros(self.start_id + 1, bool)
        here[inputs] = True
        met = np.flatnonzero(here)
        place = np.empty(len(here), np.intp)
        place[met] = np.arange(len(met))
        return met, place.take(inputs)

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, exists: np.ndarray, block: int = BLOCK) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients, of the embedding only for the ids that are met; those ids; and the loss.

        What follows from an id alone is computed once an id; windows go in blocks that fit the processor's cache. No maximum is
        taken out of small logits.
        """
        p, classes = self.p, self.p["out"].shape[1]
        n = np.float32(max(int(exists.sum()), 1))
        met, places = self.distinct(inputs)
        e, scale = p["embed"].take(met, 0), np.float32(DIM**-0.5)
        turn, side = p["q"] * scale, np.concatenate([p["k"], p["v"]], 1)
        asks, gives = np.concatenate([e @ turn, e], 1), np.concatenate([e @ side, e], 1)
        class_before = self.class_before.take(met).astype(np.uint8 if classes < 256 else np.int64)  # short numbers sort faster
        want, share = self.of_id.take(targets), exists / n
        bias = np.ascontiguousarray(np.where(self.ahead, np.float32(-1e4), p["near"][self.back]).T)
        g = {k: np.zeros_like(p[k]) for k in ("q", "out", "pair")} | {"side": np.zeros_like(side), "near": np.zeros_like(bias)}
        de = np.empty((*inputs.shape, DIM), np.float32)
        many, width, kinds = (np.ones(m, np.float32) for m in (WIDE, DIM, classes))
        flat = lambda x: x.reshape(-1, x.shape[-1])
        turned = lambda x: np.ascontiguousarray(x.transpose(0, 2, 1))
        near, loss = float(np.abs(p["near"]).max()), 0.0
        for at in range(0, len(inputs), block):
            x = places[at : at + block]
            own, every = asks.take(x[:, BACK:], 0), gives.take(x, 0)
            q, k, v = own[..., :DIM], every[..., :DIM], every[..., DIM : 2 * DIM]
            w = k @ turned(q)
            large = max(float(w.max()), -float(w.min())) + near > 60
            w += bias
            if large:
                w -= w.max(1, keepdims=True)
            np.exp(w, out=w)
            w *= 1 / (many @ w)[:, None]
            seen = w.transpose(0, 2, 1) @ v
            # Places go in the order of the class before them, so that its weights are added to a stretch at a time.
            before = class_before.take(x[:, BACK:]).ravel()
            order, stops = np.argsort(before, kind="stable"), np.bincount(before, minlength=classes + 1).cumsum().tolist()
            stretches = [(c, a, b) for c, (a, b) in enumerate(zip([0, *stops], stops)) if a < b]
            h = flat(seen + own[..., DIM:]).take(order, 0)
            z = h @ p["out"]
            for c, a, b in stretches:
                z[a:b] += p["pair"][c]
            if z.max() > 60 or z.min() < -60:
                z -= z.max(1, keepdims=True)
            np.exp(z, out=z)
            part, total = share[at : at + block].ravel().take(order), z @ kinds
            hit = np.arange(len(z)) * classes + want[at : at + block].ravel().take(order)
            loss -= float((np.log(np.maximum(z.ravel().take(hit) / total, 1e-30)) * part).sum(dtype=float))
            z *= (part / total)[:, None]
            z.reshape(-1)[hit] -= part
            g["out"] += h.T @ z
            for c, a, b in stretches:
                g["pair"][c] += np.ones(b - a, np.float32) @ z[a:b]
            dh = np.empty_like(h)
            dh[order] = z @ p["out"].T
            dh = dh.reshape(seen.shape)
            d_side = np.empty((len(x), WIDE, 2 * DIM), np.float32)
            np.matmul(w, dh, out=d_side[..., DIM:])
            ds = v @ turned(dh)
            ds -= ((dh * seen) @ width)[:, None]
            ds *= w
            g["near"] += ds.sum(0)
            np.matmul(ds, q, out=d_side[..., :DIM])
            dq = ds.transpose(0, 2, 1) @ k
            g["side"] += flat(every[..., 2 * DIM :]).T @ flat(d_side)
            g["q"] += flat(own[..., DIM:]).T @ flat(dq)
            np.matmul(flat(d_side), side.T, out=flat(de[at : at + block]))
            de[at : at + block, BACK:] += (flat(dq) @ turn.T).reshape(dh.shape) + dh
        d_side = g.pop("side")
        g |= {"q": g["q"] * scale, "k": d_side[:, :DIM], "v": d_side[:, DIM:]}
        g["near"] = np.bincount(self.back.ravel(), (g["near"].T * ~self.ahead).ravel(), WIDE).astype(np.float32)
        g["embed"] = sum_by(places.ravel(), flat(de))[1]
        return g, met, loss

    def start(self) -> None:
        """Moments of Adam and the number of steps."""
        self.m, self.s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.t = 0.0

    def step(self, inputs: np.ndarray, targets: np.ndarray, exists: np.ndarray, rate: float) -> float:
        g, met, loss = self.gradients(inputs, targets, exists)
        self.t += 1
        for k, d in g.items():
            at = met if k == "embed" else slice(None)
            m = self.m[k][at] + np.float32(0.1) * (d - self.m[k][at])
            s = self.s[k][at] + np.float32(0.01) * (d * d - self.s[k][at])
            self.m[k][at], self.s[k][at] = m, s
            self.p[k][at] -= (rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.99**self.t)) + 1e-8)).astype(np.float32)
        return loss

    def run(self, ids: np.ndarray, rows: np.ndarray, rng: np.random.Generator, batch: int = BATCH, rate=lambda i: RATE) -> list[float]:
        """Steps over all windows of the rows, in random order; ``rate`` tells the rate of the i-th."""
        inputs, targets, exists, _ = doc_windows(ids, rows, self.start_id)
        order = rng.permutation(len(inputs))
        parts = [order[at : at + batch] for at in range(0, len(order), batch)]
        return [self.step(inputs[x], targets[x], exists[x], rate(i)) for i, x in enumerate(parts)]

    def train(self, ids: np.ndarray, rows: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = RATE) -> list[float]:
        """Training where all ids are at hand."""
        self.start()
        rng, losses = np.random.default_rng(11), []
        total = epochs * -(-int((-(-np.diff(rows) // NEW)).sum()) // batch)
        for _ in range(epochs):
            done = len(losses)
            losses += self.run(ids, rows, rng, batch, lambda i: rate * (1 - 0.9 * (done + i + 1) / total))
        return losses

    def prepare(self) -> None:
        """Tables for scoring, by id: query beside embedding, key beside value."""
        e = self.p["embed"]
        self.asks = np.concatenate([(e @ self.p["q"]) * np.float32(DIM**-0.5), e], 1)
        self.gives = np.concatenate([e @ self.p["k"], e @ self.p["v"]], 1)
        self.bias = np.where(self.ahead, np.float32(-1e4), self.p["near"][self.back]).astype(np.float32)

    def log_class(self, inputs: np.ndarray, targets: np.ndarray, step: int = 192) -> np.ndarray:
        """Natural log probability of each target's class, in steps that fit the processor's cache.

        Logits are small by training, so no maximum is taken out unless it is large.
        """
        out = np.empty(targets.shape, np.float32)
        last, pair = self.p["out"], self.p["pair"]
        ones, many = np.ones(last.shape[1], np.float32), np.ones(WIDE, np.float32)
        for at in range(0, len(inputs), step):
            x = inputs[at : at + step]
            own = x[:, BACK:]
            asks, gives = self.asks.take(own, 0), self.gives.take(x, 0)
            w = np.matmul(asks[..., :DIM], gives[..., :DIM].transpose(0, 2, 1))
            w += self.bias
            if (high := w.max()) > 60:
                w -= high - 60
            np.exp(w, out=w)
            h = np.matmul(w, gives[..., DIM:])
            h /= (w @ many)[..., None]
            h += asks[..., DIM:]
            z = h.reshape(-1, DIM) @ last
            z += pair.take(self.class_before.take(own).ravel(), 0)
            want = self.of_id.take(targets[at : at + step]).ravel()
            hit = z[np.arange(len(z)), want]
            high = max(float(z.max()) - 60, 0.0)
            if high:
                z -= high
            np.exp(z, out=z)
            out[at : at + step] = (hit - high - np.log(z @ ones)).reshape(-1, NEW)
        return out


def inner_table(counts: np.ndarray, of_id: np.ndarray, classes: int, strength: float = 20.0) -> np.ndarray:
    """Natural log of P(id | class, class before) as (class before, id), from counts of the same shape."""
    n = counts.sum(0) + 0.1
    general = n / np.bincount(of_id, n, classes)[of_id]
    out = np.empty(counts.shape, np.float32)
    for b in range(len(counts)):
        mass = np.bincount(of_id, counts[b], classes)[of_id]
        out[b] = np.log((counts[b] + strength * general) / (mass + strength))
    return out


def id_kind(n_ids: int) -> np.dtype:
    return np.dtype("<u2" if n_ids <= 1 << 16 else "<u4")


def snapshot(docs: DataFrame, tokenizer: str, n_ids: int, file_rows: int = FILE_ROWS, rounds: int = ROUNDS) -> DataFrame:
    """The documents with their ids and training part, written in files of bounded size, with the file each row is in."""
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)).cast("int").alias("part")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), part, F.col("text").cast("string").alias("text"))
    kind = id_kind(n_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.load(tokenizer)
        for batch in batches:
            for part, data, off in slices(batch, "text"):
                ids, first = encode(lower(data), off, pieces, n_ids - 1)
                cells = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((first * kind.itemsize).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.RecordBatch.from_arrays([*part.columns, cells], names=["doc_id", "held_out", "part", "text", "ids"])

    made = rows.mapInArrow(run, "doc_id long, held_out boolean, part int, text string, ids binary")
    return store(made, "texts", maxRecordsPerFile=file_rows).withColumn("chunk", F.substring(F.md5(F.element_at(F.split(F.input_file_name(), "/"), -1)), 1, 16))


def read_ids(batches: Iterator[pa.RecordBatch], n_ids: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of batches with their ids and the first of each row."""
    kind = id_kind(n_ids)
    for batch in batches:
        for part, data, off in slices(batch, "ids", ID_BYTES):
            yield part, data.view(kind).astype(np.int64), off // kind.itemsize


def counts(texts: DataFrame, n_ids: int, size: int, add, kind: type = np.int64) -> DataFrame:
    """``key`` and ``n`` of a table of ``size`` numbers, which ``add(table, ids, rows)`` fills for all training rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        table = np.zeros(size, kind)
        for _, ids, rows in read_ids(batches, n_ids):
            add(table, ids, rows)
        some = np.flatnonzero(table)
        for at in range(0, len(some), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(some[at : at + 100_000]), pa.array(table[some[at : at + 100_000]].astype(np.int64))], names=["key", "n"])

    made = texts.where("NOT held_out").select("ids").mapInArrow(run, "key long, n long")
    return made.groupBy("key").agg(F.sum("n").alias("n"))


def fetch(counted: DataFrame, size: int) -> np.ndarray:
    out, got = np.zeros(size, np.int64), counted.toArrow()
    out[got.column("key").to_numpy()] = got.column("n").to_numpy()
    return out


def classes_of(texts: DataFrame, n_ids: int, classes: int, least: int = LEAST, contexts: int = CONTEXTS, dims: int = DIMS) -> np.ndarray:
    """What ``cluster`` gives for the ids of all training rows, without gathering them."""
    spark, wide = texts.sparkSession, 2 * contexts
    seen = fetch(counts(texts, n_ids, n_ids, lambda table, ids, rows: np.add.at(table, ids, 1)), n_ids)
    out = np.zeros(n_ids, np.int64)
    kinds, line, column = places(seen, least, contexts)
    if len(kinds) < classes:
        return out
    shared = spark.sparkContext.broadcast((line, column))

    def add(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        neighbours(ids, *shared.value, table.reshape(-1, wide))

    pairs = counts(texts, n_ids, len(kinds) * wide, add, np.uint32)
    lines = pairs.groupBy(F.expr(f"key div {wide}").alias("line")).agg(F.collect_list("key").alias("key"), F.collect_list("n").alias("n"))
    lines = store(lines, "neighbours")

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                table = np.zeros((part.num_rows, wide))
                row = np.repeat(np.arange(part.num_rows), part.column(1).value_lengths().to_numpy())
                table[row, part.column(1).flatten().to_numpy() % wide] = part.column(2).flatten().to_numpy()
                yield part, shares(table)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((wide + 1, wide))
        for _, table in dense(batches):
            sums[:wide] += table.T @ table
            sums[wide] += table.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

    sums = np.zeros((wide + 1, wide))
    for r in lines.coalesce(4).mapInArrow(multiply, "sums binary").toLocalIterator():
        sums += np.frombuffer(r.sums).reshape(sums.shape)
    # Ids with a line but no neighbour among the columns are rows of zeros.
    base = axes(sums[:wide], sums[wide], len(kinds), dims)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, table in dense(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.tobytes() for x in table @ base], pa.binary())], names=["line", "point"])

    points, got = np.zeros((len(kinds), dims)), lines.mapInArrow(project, "line long, point binary").toArrow()
    if got.num_rows:
        points[got.column("line").to_numpy()] = np.frombuffer(b"".join(got.column("point").to_pylist())).reshape(-1, dims)
    out[kinds] = k_means(points, seen[kinds], classes) + 1
    return out


REST = ("q", "k", "v", "near", "out", "pair")


def flat_state(a: Attention) -> np.ndarray:
    """All weights but the embedding, with both moments."""
    return np.concatenate([x[k].ravel() for x in (a.p, a.m, a.s) for k in REST])


def set_flat_state(a: Attention, values: np.ndarray) -> None:
    for x in (a.p, a.m, a.s):
        for k in REST:
            x[k], values = values[: x[k].size].reshape(x[k].shape).astype(np.float32), values[x[k].size :]


def copy_of(a: Attention) -> Attention:
    b = copy.copy(a)
    b.p, b.m, b.s = ({k: v.copy() for k, v in x.items()} for x in (a.p, a.m, a.s))
    return b


def one_round(rows: DataFrame, attention: Attention, n_ids: int, rate: float, batch: int = BATCH) -> int:
    """Trains every file's rows from the same weights and leaves their average in ``attention``; the number of windows."""
    shared = rows.sparkSession.sparkContext.broadcast(attention)
    schema, wide = "key int, weight double, steps double, state binary", 3 * DIM

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        mine = chunk = None
        embed, weight = np.zeros((n_ids + 1, wide)), np.zeros(n_ids + 1)
        rest = np.zeros(len(flat_state(shared.value)))
        rest_weight = steps = windows = 0.0
        met = np.zeros(n_ids + 1)

        def close() -> None:
            nonlocal rest, rest_weight, steps, windows
            at = np.flatnonzero(met)
            embed[at] += met[at, None] * np.concatenate([x["embed"][at] for x in (mine.p, mine.m, mine.s)], 1)
            weight[at] += met[at]
            rest += windows * flat_state(mine)
            steps += windows * (mine.t - shared.value.t)
            rest_weight += windows
            met[:], windows = 0, 0.0

        for part, ids, first in read_ids(batches, n_ids):
            names = part.column(1).to_pylist()
            cuts = [i for i, x in enumerate(names) if not i or names[i - 1] != x] + [len(names)]
            for a, b in zip(cuts, cuts[1:]):
                if names[a] != chunk:
                    if mine is not None:
                        close()
                    mine, chunk, rng = copy_of(shared.value), names[a], np.random.default_rng(11)
                own, start = ids[first[a] : first[b]], first[a : b + 1] - first[a]
                mine.run(own, start, rng, batch, lambda i: rate)
                met += np.bincount(own, minlength=n_ids + 1)
                met[n_ids] += b - a
                windows += float((-(-np.diff(start) // NEW)).sum())
        if mine is None:
            return
        close()
        at = np.flatnonzero(weight)
        state = [x.tobytes() for x in (embed[at] / weight[at, None]).astype(np.float32)] + [(rest / rest_weight).astype(np.float32).tobytes()]
        yield pack(np.append(at, -1), np.append(weight[at], rest_weight), steps, state)

    def pack(key: np.ndarray, weight: np.ndarray, steps: float, state: list[bytes]) -> pa.RecordBatch:
        # The number of steps goes with the other weights.
        columns = [pa.array(key.astype(np.int32)), pa.array(weight.astype(float)), pa.array(np.where(key < 0, steps, 0.0)), pa.array(state, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["key", "weight", "steps", "state"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed, weight = np.zeros((n_ids + 1, wide)), np.zeros(n_ids + 1)
        rest, rest_weight, steps = 0.0, 0.0, 0.0
        for b in batches:
            key, w = b.column(0).to_numpy(), b.column(1).to_numpy()
            state = b.column(3).to_pylist()
            some = np.flatnonzero(key >= 0)
            if len(some):
                np.add.at(embed, key[some], w[some, None] * np.frombuffer(b"".join(state[i] for i in some), np.float32).reshape(-1, wide))
                np.add.at(weight, key[some], w[some])
            for i in np.flatnonzero(key < 0):
                rest = rest + w[i] * np.frombuffer(state[i], np.float32)
                rest_weight += w[i]
                steps += b.column(2)[int(i)].as_py()
        at = np.flatnonzero(weight)
        if len(at):
            yield pack(at, weight[at], 0.0, [x.tobytes() for x in (embed[at] / weight[at, None]).astype(np.float32)])
        if rest_weight:
            yield pack(np.array([-1]), np.array([rest_weight]), steps, [(rest / rest_weight).astype(np.float32).tobytes()])

    got = rows.mapInArrow(local, schema).repartition("key").mapInArrow(average, schema).toArrow()
    shared.unpersist()
    key, state, n = got.column("key").to_numpy(), got.column("state").to_pylist(), 0
    some = np.flatnonzero(key >= 0)
    if len(some):
        values = np.frombuffer(b"".join(state[i] for i in some), np.float32).reshape(-1, wide)
        for j, x in enumerate((attention.p, attention.m, attention.s)):
            x["embed"][key[some]] = values[:, j * DIM : (j + 1) * DIM]
    for i in np.flatnonzero(key < 0).tolist():
        set_flat_state(attention, np.frombuffer(state[i], np.float32))
        n = int(got.column("weight")[i].as_py())
        attention.t += got.column("steps")[i].as_py() / n
    return n


def train_on(texts: DataFrame, attention: Attention, n_ids: int, epochs: int = EPOCHS, rounds: int = ROUNDS, rate: float = RATE) -> list[int]:
    """Trains on all training rows, each once an epoch; the windows of each round."""
    attention.start()
    rows, done = texts.where("NOT held_out"), []
    for i in range(epochs * rounds):
        now = rate * (1 - 0.9 * (i + 0.5) / (epochs * rounds))
        done.append(one_round(rows.where(F.col("part") == i % rounds).select("ids", "chunk"), attention, n_ids, now))
    return done


def encode(low: np.ndarray, off: np.ndarray, pieces: Pieces, end: int, prefix: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of lower-cased rows, each with the end symbol, and the first of each row."""
    ids, rows = with_end(*pieces.encode(low, off, prefix), end)
    return ids.astype(np.int64), rows


def gather(texts: DataFrame) -> DataFrame:
    """Counts of words in training rows, by file: ``chunk``, ``key``, ``n``; held-out words with 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        keys, counts, chunk = [], [], None

        def pack(name: str, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n)], names=["chunk", "key", "n"])

        def merged() -> Iterator[pa.RecordBatch]:
            key, which = np.unique(np.concatenate(keys), return_inverse=True)
            n = np.bincount(which, np.concatenate(counts), len(key)).astype(np.int64)
            for at in range(0, len(key), 100_000):
                yield pack(chunk, key[at : at + 100_000], n[at : at + 100_000])

        for batch in batches:
            for part, data, off in slices(batch, "text"):
                for name in part.column(2).unique().to_pylist() if part.num_rows else []:
                    if name != chunk and keys:
                        yield from merged()
                        keys, counts = [], []
                    chunk = name
                    own = part.column(2).to_pylist()
                    mine = np.array([x == name for x in own])
                    train = ~part.column(1).to_numpy(zero_copy_only=False).astype(bool) & mine
                    start, stop, first = words(data, off)
                    per = np.diff(first)
                    hashes = range_hash(prefix_hash(lower(data)), start, stop)
                    here = np.repeat(mine, per)
                    key, which = np.unique(hashes[here], return_inverse=True)
                    keys += [key, np.array([END_WORD])]
                    counts += [np.bincount(which, np.repeat(train, per)[here], len(key)), np.array([float(train.sum())])]
        if keys:
            yield from merged()

    return texts.select("text", "held_out", "chunk").mapInArrow(run, "chunk string, key long, n long")


class Scorer:
    def __init__(self, attention: Attention, inner: np.ndarray, base: float, folder: str) -> None:
        self.attention, self.inner, self.base, self.folder = attention, inner, base, folder
        self.chunk: str | None = None

    def load(self, chunk: str) -> None:
        """The sorted word counts of a file."""
        if chunk == self.chunk:
            return
        import pyarrow.dataset as ds
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(f"{self.folder}/chunk={chunk}")
        answers = ds.dataset(path, filesystem=where, format="parquet").to_table(columns=["key", "total"])
        key = answers.column("key").to_numpy().view(np.uint64)
        # A file that several tasks read has several rows for a word, all with its total.
        self.keys, first = np.unique(key, return_index=True)
        self.counts, self.chunk = answers.column("total").to_numpy()[first], chunk

    def count(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        if not (self.keys[at] == hashes).all():
            raise ValueError(f"the words of file {self.chunk} are not all in its counts")
        return self.counts[at]

    def __call__(self, data: np.ndarray, off: np.ndarray, chunk: str, ids: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        self.load(chunk)
        start, stop, first = words(data, off)
        n = np.diff(first)
        kinds, which = np.unique(range_hash(prefix_hash(lower(data)), start, stop), return_inverse=True)
        c = self.count(kinds)
        end = int(self.count(np.array([END_WORD]))[0])
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[first])
        base = sums(np.log10(c + 0.5)[which]) + np.log10(end + 0.5) + (n + 1) * self.base
        a = self.attention
        inputs, targets, exists, row = doc_windows(ids, rows, a.start_id)
        log = a.log_class(inputs, targets) + self.inner[a.class_before[inputs[:, BACK:]], targets]
        score = np.bincount(row, np.where(exists, log, 0).sum(1, dtype=float), len(n)) / np.log(10)
        return [n + 1, sums((c > 0)[which]) + int(end > 0), base, score]


def score_texts(docs: DataFrame, tokenizer: str, classes: int = CLASSES, file_rows: int = FILE_ROWS) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of every row."""
    spark = docs.sparkSession
    n_ids = Pieces.load(tokenizer).tokenizer.get_vocab_size() + 1  # the last is the end of a text
    texts = snapshot(docs, tokenizer, n_ids, file_rows)
    of_id = classes_of(texts, n_ids, classes)
    attention = Attention(n_ids, of_id, classes)
    train_on(texts, attention, n_ids)
    attention.m = attention.s = None
    attention.prepare()

    def add(table: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        before = np.append(classes, of_id[ids[:-1]])
        before[rows[:-1]] = classes
        np.add.at(table, before * n_ids + ids, 1)

    table = fetch(counts(texts, n_ids, (classes + 1) * n_ids, add), (classes + 1) * n_ids).astype(float)
    inner = inner_table(table.reshape(classes + 1, n_ids), of_id, classes)
    counted = store(gather(texts), "counts")
    by_word = W.partitionBy("key")
    answers = counted.withColumn("total", F.sum("n").over(by_word)).withColumn("first", F.row_number().over(by_word.orderBy("chunk")) == 1)
    folder = fresh_dir(spark, "answers")
    answers.repartition("chunk").write.partitionBy("chunk").parquet(folder)
    if answers_empty(counted):
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    total = spark.read.parquet(folder).agg(F.sum("n").alias("n"), F.sum((F.col("first") & (F.col("total") > 0)).cast("long")).alias("v")).first()
    base = -float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    shared = spark.sparkContext.broadcast(Scorer(attention, inner, base, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer, kind = shared.value, id_kind(n_ids)
        for batch in batches:
            # Rows of one file follow one another.
            names = batch.column(3).to_pylist()
            cuts = [i for i, x in enumerate(names) if not i or names[i - 1] != x] + [len(names)]
            for a, b in zip(cuts, cuts[1:]):
                for part, data, off in slices(batch.slice(a, b - a), "text", 1 << 20):
                    cells, at = text_buffer(part.column(4))
                    made = scorer(data, off, names[a], cells.view(kind).astype(np.int64), at // kind.itemsize)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *map(pa.array, made)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            part = data = off = cells = batch = None  # the next batch comes before these names are used again

    scored = texts.select("doc_id", "held_out", "text", "chunk", "ids").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.withColumn("train_tokens", F.lit(int(total["n"])).cast("long"))


def answers_empty(counted: DataFrame) -> bool:
    return counted.isEmpty()
