"""Language identification as a mixture over languages.

Byte trigrams of the lower-cased letters, hashed into a fixed number of buckets, are
counted per language over all labelled documents. For a document,
expectation-maximisation estimates the proportion of each language from the likelihoods of
its trigrams; the set of languages is the one with the best likelihood less half the log of
the number of trigrams for each proportion.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

BUCKETS = 1 << 13
ROUNDS = 30
#: A language with less of a document than this is not tried as a further one.
LEAST_SHARE = 0.02
SMOOTH = 0.5
#: Languages of a model, whose table of some 64 KB each goes to every executor.
MAX_LANGUAGES = 1000

_WORDLIKE = re.compile(r"[^\W\d_]")
_TABLE = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def has_letter(text: str) -> bool:
    """Whether any character is a letter (the pattern also meets fractions and the like)."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def trigrams(text: str) -> np.ndarray:
    """Bucket of each byte trigram about a letter; a word of one byte is a trigram with both its edges."""
    raw = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass").translate(_TABLE), np.uint8)
    if len(raw) < 3:
        return np.zeros(0, np.int64)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    keep = b != 32
    code = (a[keep].astype(np.uint32) << 16) | (b[keep].astype(np.uint32) << 8) | c[keep]
    return ((code * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int64)


def fit(docs: DataFrame, learn: Column) -> tuple[list[str], np.ndarray]:
    """(languages, log likelihoods of buckets) from text and lang of documents that meet
    learn and have both. The counts cover all of them; a language has at most BUCKETS, and
    more than MAX_LANGUAGES languages are an error."""

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = np.bincount(trigrams(text.as_py()), minlength=BUCKETS)
                counts[lang] = counts[lang] + got if lang in counts else got
        for lang, got in counts.items():
            where = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(where), pa.string()), pa.array(where.astype(np.int32)), pa.array(got[where])], names=["lang", "bucket", "n"])

    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    got = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # one row a language to the driver, of at most BUCKETS numbers
    got = staged(got, "lang_counts")
    if (n := got.select("lang").distinct().count()) > MAX_LANGUAGES:
        raise ValueError(f"{n} languages; at most {MAX_LANGUAGES} can be told apart")
    got = got.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n")).orderBy("lang").collect()
    table = np.full((len(got), BUCKETS), SMOOTH)
    for k, r in enumerate(got):
        table[k, r.b] += r.n
    return [r.lang for r in got], np.log(table / table.sum(1, keepdims=True)) if got else table


def mixture(counts: np.ndarray, like: np.ndarray) -> tuple[np.ndarray, float]:
    """(proportions, log likelihood) of a mixture of the rows of like, given per item."""
    share = np.full(len(like), 1 / len(like))
    total, was = counts.sum(), -np.inf
    for _ in range(ROUNDS):
        each = share @ like
        now = float(counts @ np.log(each))
        share = share * (like @ (counts / each)) / total
        if now - was < 1e-3:
            break
        was = now
    return share, now


def identify(counts: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages of the selected set, their proportions), most first."""
    top = logs.max(0)
    like = np.exp(logs - top)
    share, _ = mixture(counts, like)
    order = np.argsort(-share, kind="stable")
    price = 0.5 * np.log(counts.sum() + 1)
    best, best_value = (order[:1], np.ones(1)), float(counts @ np.log(like[order[0]]))
    for k in range(2, len(order) + 1):
        if share[order[k - 1]] < LEAST_SHARE:
            break
        part, value = mixture(counts, like[order[:k]])
        if value - (k - 1) * price > best_value:
            best, best_value = (order[:k], part), value - (k - 1) * price
    langs, part = best
    by = np.argsort(-part, kind="stable")
    return langs[by], part[by]


def languages(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Rows (doc_id, lang_pred, score, langs), one per row of docs (doc_id, text).

    lang_pred is the language with the largest proportion in the selected set, score that
    proportion, langs the whole set with proportions. One letter is enough for a language.
    Texts that are null or without any letter (digits and fractions are none), and all texts if no language was learned, are und with score 0. Whole texts
    count, repeated rows are separate, other columns are ignored.
    """
    names = model[0]
    # languages x BUCKETS numbers, fetched once an executor
    held = docs.sparkSession.sparkContext.broadcast(model[1])

    def run(batches):
        logs = held.value
        for batch in batches:
            pred, score, sets = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                got = trigrams(text) if names and text and has_letter(text) else ()
                if len(got):
                    counts = np.bincount(got, minlength=BUCKETS)
                    where = np.flatnonzero(counts)
                    which, part = identify(counts[where].astype(np.float64), logs[:, where])
                    pred.append(names[which[0]])
                    score.append(min(1.0, float(part[0])))
                    sets.append([{"lang": names[k], "share": float(p)} for k, p in zip(which, part)])
                else:
                    pred.append("und")
                    score.append(0.0)
                    sets.append([])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, kind)], names=["doc_id", "lang_pred", "score", "langs"])

    slim = docs.select("doc_id", "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, langs array<struct<lang:string,share:double>>")
