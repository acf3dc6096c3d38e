"""Benchmark decontamination with a distributed positional inverted index.

The training documents are indexed in segments of a bounded number of words: for every
term of a segment the increasing positions where it stands. A search takes the phrases of
the test set in blocks, sends each by a join on the term of it that the fewest segments hold to
just these segments, and fetches the postings of the terms by another. In a segment it
intersects the offset-adjusted lists of a phrase, rarest first, leaving it as soon as nothing
is left. Documents are kept apart by a gap in the positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: A segment ends at this many words, so a search holds a bounded part of the index.
SEGMENT_WORDS = 4_000_000
#: Phrases searched together in a segment.
BLOCK_PHRASES = 20_000
#: Up to so many distinct test terms are broadcast (some 10 MB); more are joined by shuffle.
BROADCAST_TERMS = 200_000
#: Up to so many phrases are broadcast to where their terms stand; more are joined by shuffle.
BROADCAST_PHRASES = 50_000

_KEEP = [c for c in range(256) if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80]
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c in _KEEP else 0x20 for c in range(256))


def split_words(text: bytes | None) -> list[bytes]:
    """Runs of digits, ASCII letters (lower-cased) and anything beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


class _Ids(dict):
    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _segment(number: int, docs: list, lengths: list, ids: list, terms: _Ids, kind: pa.DataType, schema: pa.Schema):
    """The rows of one segment: a row of documents, and a row for each term."""
    gap = np.repeat(np.arange(len(lengths)), lengths)  # one free position after each document
    where = np.arange(len(gap)) + gap
    term = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    order = np.argsort(term, kind="stable")
    where, count = where[order], np.bincount(term, minlength=len(terms))
    starts = np.cumsum(count) - count
    step = np.diff(where, prepend=0)
    step[starts] = where[starts]
    offsets = np.append(starts, len(where)).astype(np.int32) * 4
    postings = pa.Array.from_buffers(pa.binary(), len(terms), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(step.astype("<u4").tobytes())])
    n = len(terms)
    yield pa.RecordBatch.from_arrays(
        [pa.array([number]), pa.array([None], pa.binary()), pa.array([None], pa.binary()), pa.array([docs], pa.list_(kind)), pa.array([lengths], pa.list_(pa.int32()))], schema=schema
    )
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, number)), pa.array(list(terms), pa.binary()), postings, pa.nulls(n, pa.list_(kind)), pa.nulls(n, pa.list_(pa.int32()))], schema=schema
        )


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """The index of docs (doc_id, text) as a staged table.

    Rows with a term hold its positions in a segment as differences; the one row of each
    segment without a term lists its documents and their numbers of words.
    """
    slim = docs.select("doc_id", "text")
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        held_docs, lengths, ids, terms, n, arrow = [], [], [], _Ids(), 0, None
        for batch in batches:
            arrow = batch.column(0).type
            schema = pa.schema([("segment", pa.int64()), ("term", pa.binary()), ("positions", pa.binary()), ("docs", pa.list_(arrow)), ("lengths", pa.list_(pa.int32()))])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                words = split_words(text.as_py())
                ids.append(np.fromiter(map(terms.__getitem__, words), np.int32, len(words)))
                held_docs.append(doc)
                lengths.append(len(words))
                n += len(words)
                if n >= segment_words:
                    yield from _segment(part << 32 | made, held_docs, lengths, ids, terms, arrow, schema)
                    made += 1
                    held_docs, lengths, ids, terms, n = [], [], [], _Ids(), 0
        if held_docs:
            yield from _segment(part << 32 | made, held_docs, lengths, ids, terms, arrow, schema)

    return staged(slim.mapInArrow(run, f"segment long, term binary, positions binary, docs array<{kind}>, lengths array<int>"), "postings")


def phrases(items: DataFrame, width: int = 10) -> DataFrame:
    """Distinct windows of `width` consecutive words of items (item_id, text), with the ids
    (as strings) of the items they stand in. A shorter item is one window, an item without
    words none. A null id counts as the string null."""
    slim = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")

    def run(batches):
        for batch in batches:
            out_item, out = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                words = split_words(text)
                k = min(width, len(words))
                for i in range(len(words) - k + 1 if k else 0):
                    out_item.append(item)
                    out.append(words[i : i + k])
            yield pa.RecordBatch.from_arrays([pa.array(out_item, pa.string()), pa.array(out, pa.list_(pa.binary()))], names=["item", "terms"])

    return slim.mapInArrow(run, "item string, terms array<binary>").groupBy("terms").agg(F.collect_set("item").alias("items"))


def intersect(lists: list, slop: int = 0, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the phrase whose k-th term stands at lists[k].

    slop 0: each term right after the one before. More: each term may be up to slop
    positions off its place, counted from the rarest term, and is the nearest one in the
    document of the rarest term (of two as near, the earlier); ends are the positions after
    each document.
    """
    order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
    start = lists[order[0]].astype(np.int64) - order[0]
    low, high = start + order[0], start + order[0]
    if slop:
        doc = np.searchsorted(ends, low, "right")
        first, end = np.append(0, ends)[doc], ends[doc]
    for k in order[1:]:
        if not len(start):
            break
        at = np.searchsorted(lists[k], start + k)
        if slop:
            far = np.iinfo(np.int64).max // 4
            before, after = lists[k][np.maximum(at - 1, 0)], lists[k][np.minimum(at, len(lists[k]) - 1)]
            off = [np.where((x >= first) & (x < end), abs(start + k - x), far) for x in (before, after)]
            near = np.where(off[0] <= off[1], before, after)
            good = np.minimum(*off) <= slop
            first, end = first[good], end[good]
        else:
            near = lists[k][np.minimum(at, len(lists[k]) - 1)]
            good = near == start + k
        start, low, high = start[good], np.minimum(low[good], near[good]), np.maximum(high[good], near[good])
    return low, high


def routes(held: DataFrame, wanted: DataFrame, most: int | None = None) -> DataFrame:
    """Rows (seg, block, terms, items): each phrase of wanted (terms, items, block) once for each
    segment that holds the term of it which the fewest segments hold (ties: the smallest).

    held has the distinct (seg, term) of the terms of wanted. A phrase with a term that no segment
    holds goes nowhere. Up to `most` phrases (BROADCAST_PHRASES) are broadcast.
    """
    spread = held.groupBy("term").agg(F.count("*").alias("n"))
    each = wanted.select("terms", "items", "block", F.explode(F.array_distinct("terms")).alias("term")).join(spread, "term", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("rarest")
    keyed = staged(each.groupBy("terms", "items", "block").agg(rarest).where("rarest.n > 0").select("terms", "items", "block", F.col("rarest.term").alias("rare")), "phrase_routes")
    if keyed.count() <= (BROADCAST_PHRASES if most is None else most):
        keyed = F.broadcast(keyed)
    return held.join(keyed, F.col("term") == F.col("rare")).select("seg", "block", "terms", "items")


def search(index: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """Rows (segment, nth, hit, items): for the nth document of a segment the word positions
    inside matches, and the items whose windows match, a row for each block of phrases.

    wanted has the rows of phrases(). With slop 0 matches are exact phrases, else proximity
    matches inside a document. The visits of phrases to segments are as many as the segments
    that hold their rarest terms.
    """
    wanted = staged(wanted, "phrases")
    blocks = max(1, -(-wanted.count() // BLOCK_PHRASES))
    wanted = wanted.withColumn("block", F.pmod(F.xxhash64("terms"), F.lit(blocks)).cast("int"))
    terms = staged(wanted.select(F.col("block").alias("blk"), F.explode("terms").alias("term")).distinct(), "phrase_terms")
    alone = terms.select("term").distinct()
    if terms.count() <= BROADCAST_TERMS:
        terms, alone = F.broadcast(terms), F.broadcast(alone)
    # renamed keys: both sides come from the same staged table
    postings = index.where("term is not null").select(F.col("segment").alias("seg"), "term", "positions")
    lists = postings.join(terms, "term")
    held = staged(postings.select("seg", "term").join(alone, "term"), "phrase_segments")
    sets = routes(held, wanted).groupBy("seg", "block").agg(F.collect_list(F.struct("terms", "items")).alias("phrases"))
    segments = index.where("term is null").select("segment", "lengths")
    asked = segments.join(sets, F.col("segment") == F.col("seg")).select("segment", "block", "lengths", "phrases")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"segment": [], "nth": [], "hit": [], "items": []}
        if right.num_rows and left.num_rows:
            post = {t: p for t, p in zip(left.column("term").to_pylist(), left.column("positions").to_pylist())}
            cache: dict = {}
            length = np.array(right.column("lengths")[0].as_py(), dtype=np.int64)
            base = np.cumsum(length + 1) - (length + 1)
            hits: dict = {}
            for phrase in right.column("phrases")[0].as_py():
                lists = []
                for t in phrase["terms"]:
                    if t not in post:
                        break
                    if t not in cache:
                        cache[t] = np.cumsum(np.frombuffer(post[t], "<u4"), dtype=np.int64)
                    lists.append(cache[t])
                if len(lists) < len(phrase["terms"]):
                    continue
                for a, b in zip(*intersect(lists, slop, base + length + 1)):
                    nth = int(np.searchsorted(base, a, "right")) - 1
                    if b < base[nth] + length[nth]:
                        got = hits.setdefault(nth, (set(), set()))
                        got[0].update(range(int(a - base[nth]), int(b - base[nth]) + 1))
                        got[1].update(phrase["items"])
            number = right.column("segment")[0].as_py()
            for nth, (where, items) in hits.items():
                for k, v in (("segment", number), ("nth", nth), ("hit", sorted(where)), ("items", sorted(items))):
                    out[k].append(v)
        return pa.table([pa.array(out["segment"], pa.int64()), pa.array(out["nth"], pa.int32()), pa.array(out["hit"], pa.list_(pa.int32())), pa.array(out["items"], pa.list_(pa.string()))], names=list(out))

    return lists.groupBy("seg", "blk").cogroup(asked.groupBy("segment", "block")).applyInArrow(run, "segment long, nth int, hit array<int>, items array<string>")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10, slop: int = 0) -> DataFrame:
    """Rows (doc_id, n_words, n_hit, items), one per row of docs: the words of the document,
    those inside any occurrence of an item's window, and the items that have one, sorted.

    Null and empty texts have no words. Repeated rows are separate documents; repeated items
    count once. Columns other than doc_id, text, item_id are ignored. Without items nothing
    is hit; without documents there are no rows.
    """
    index = build_index(docs)
    found = search(index, phrases(items, width), slop)
    found = found.groupBy("segment", "nth").agg(F.array_distinct(F.flatten(F.collect_list("hit"))).alias("hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    each = index.where("term is null").select("segment", F.posexplode(F.arrays_zip("docs", "lengths")).alias("nth", "d"))
    return each.join(found, ["segment", "nth"], "left").select(
        F.col("d.docs").alias("doc_id"),
        F.col("d.lengths").cast("long").alias("n_words"),
        F.coalesce(F.size("hit"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
