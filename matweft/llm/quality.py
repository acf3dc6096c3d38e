"""Quality classifier with supervised subword embeddings.

A document is the average of the learned vectors of its hashed features: every word, every
character n-gram of its words, and a shared feature for a word that repeats the one before
it. A softmax layer over the average gives the label. All weights are trained together by
stochastic gradient descent in numpy, on a bounded sample of labelled documents.

Since the output is linear in the average, the trained model is kept as one margin a
bucket. Scoring adds up the margins of each distinct word once in a task and then only
looks words up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that training may use; chosen by a hash of their ids.
MAX_TRAIN = 4000
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
DIM = 8
EPOCHS = 6
#: Small training sets are gone through more often, until so many steps are made.
MIN_STEPS = 600
RATE = 8.0
BATCH = 32
#: Word memory of a scoring task is emptied beyond this many distinct words.
MAX_WORDS = 500_000

_P = np.uint64(0x100000001B3)


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(BUCKETS - 1) + np.uint64(1)).astype(np.int64)


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word position, bucket) of all features of the words; bucket 0 is the repeat."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    length = np.array([len(w) + 2 for w in words])
    start = np.cumsum(length) - length
    owner = np.repeat(np.arange(len(words)), length)
    power = np.cumprod(np.full(int(length.max()), _P, np.uint64))
    whole = np.add.reduceat((flat + np.uint64(7)) * power[np.arange(len(flat)) - start[owner]], start)
    where, bucket = [np.arange(len(words))], [_mixed(whole, 1)]
    for n in GRAMS:
        if len(flat) < n:
            continue
        h = np.zeros(len(flat) - n + 1, np.uint64)
        for k in range(n):
            h = h * _P + flat[k : len(flat) - n + 1 + k]
        inside = owner[: len(h)] == owner[n - 1 :]
        where.append(owner[: len(h)][inside])
        bucket.append(_mixed(h[inside], n + 1))
    return np.concatenate(where), np.concatenate(bucket)


def repeats(words: list[bytes]) -> int:
    return sum(map(bytes.__eq__, words, words[1:]))


def train(bags: list[tuple[list[bytes], list[int], int, int]], seed: int = 5) -> tuple[np.ndarray, float]:
    """(margin of each bucket, bias) from bags (distinct words, counts, repeats, label 0 or 1)."""
    names: dict[bytes, int] = {}
    docs = [(np.array([names.setdefault(w, len(names)) for w in ws], np.int64), np.array(cs, np.float64), rep, y) for ws, cs, rep, y in bags]
    owner, bucket = features(list(names))
    order = np.argsort(owner, kind="stable")
    bucket, count = bucket[order].astype(np.int32), np.bincount(owner, minlength=len(names))
    first = np.cumsum(count) - count
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    batches = max(1, -(-len(docs) // BATCH))
    epochs = max(EPOCHS, -(-MIN_STEPS // batches))
    steps, step = epochs * batches, 0
    for _ in range(epochs):
        shuffled = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            rows, ids, weight, label = [], [], [], []
            for r, d in enumerate(shuffled[at : at + BATCH]):
                w, c, rep, y = docs[d]
                n = count[w]
                place = np.repeat(first[w] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                total = max(1.0, float((c * n).sum() + rep))
                ids.append(np.append(bucket[place], 0))
                weight.append(np.append(np.repeat(c, n), rep) / total)
                rows.append(np.full(len(place) + 1, r))
                label.append(y)
            rows, ids, weight = np.concatenate(rows), np.concatenate(ids), np.concatenate(weight).astype(np.float32)
            taken = vectors[ids]
            starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            mean = np.add.reduceat(taken * weight[:, None], starts)
            logit = mean @ out + bias
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            wrong = prob
            wrong[np.arange(len(label)), label] -= 1
            back = (wrong @ out.T)[rows] * weight[:, None]
            out -= rate * 0.05 * (mean.T @ wrong)
            bias -= rate * 0.05 * wrong.mean(0)
            for k in range(DIM):
                vectors[:, k] -= rate * np.bincount(ids, back[:, k], BUCKETS).astype(np.float32)
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _bag(words: list[bytes]) -> tuple[list[bytes], list[int]]:
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    return list(seen), list(seen.values())


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_train: int = MAX_TRAIN) -> tuple[bytes, float]:
    """(margins, bias) learned from documents (doc_id, text) with a non-null label.

    learn: condition on doc_id for rows that may be learned from. Of conflicting labels of
    one id the least counts. At most max_train ids are used, the first by hash; their whole
    texts are reduced to bags of words where they lie, and one task trains on the bags.
    Without labelled documents every score is 0.5.
    """
    ids = labels.select("doc_id", F.col(label).alias("y")).where(F.col("y").isin(0, 1) & learn)
    ids = ids.groupBy("doc_id").agg(F.min("y").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text")  # at most max_train ids

    def bag(batches):
        for batch in batches:
            got = [(i, y, (t or b"").split()) for i, y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist())]
            bags = [_bag(words) for _, _, words in got]
            yield pa.RecordBatch.from_arrays(
                [pa.array([str(g[0]) for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32()), pa.array([repeats(g[2]) for g in got], pa.int32()), pa.array([b[0] for b in bags], pa.list_(pa.binary())), pa.array([b[1] for b in bags], pa.list_(pa.int32()))],
                names=["id", "y", "rep", "words", "counts"],
            )

    def learn_all(table: pa.Table) -> pa.Table:
        got = sorted(zip(*(table.column(c).to_pylist() for c in ("id", "words", "counts", "rep", "y"))))
        margin, bias = train([g[1:] for g in got])
        return pa.table({"margin": [margin.tobytes()], "bias": [bias]})

    bags = rows.mapInArrow(bag, "id string, y int, rep int, words array<binary>, counts array<int>")
    model = bags.groupBy(F.lit(0).alias("all")).applyInArrow(learn_all, "margin binary, bias double").first()
    return (bytes(model.margin), model.bias) if model else (np.zeros(BUCKETS, np.float32).tobytes(), 0.0)


class _Margins(dict):
    """Word -> (sum of margins, features), filled for many words at once."""

    def __init__(self, margin: np.ndarray):
        self.margin = margin

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in set(words) if w not in self]
        if new:
            owner, bucket = features(new)
            n = np.bincount(owner, minlength=len(new))
            total = np.bincount(owner, self.margin[bucket], len(new))
            self.update(zip(new, zip(total.tolist(), n.tolist())))


def score(docs: DataFrame, model: tuple[bytes, float], name: str = "score") -> DataFrame:
    """docs with one more column: the probability of label 1 from the whole text.

    Null and empty texts get the probability that the bias alone gives. A column called name
    is replaced; all others pass through.
    """
    docs = docs.drop(name)
    raw, bias = model
    columns = docs.columns
    at = columns.index("text")

    def run(batches):
        known = _Margins(np.frombuffer(raw, np.float32))
        for batch in batches:
            out = []
            for text in batch.column(at).cast(pa.binary()):
                words = (text.as_py() or b"").split()
                if len(known) > MAX_WORDS:
                    known.clear()
                known.learn(words)
                rep = repeats(words)
                total, n = rep * float(known.margin[0]), rep
                for s, k in map(known.__getitem__, words):
                    total += s
                    n += k
                x = bias + (total / n if n else 0.0)
                out.append(1 / (1 + np.exp(-x)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], names=[*columns, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{fields}, `{name}` double")
