"""SimHash near-dedup over a Gray-order hierarchical index.

Fingerprints are made in Arrow batches. Distinct fingerprints are dealt out by pairs of
bit blocks (two fingerprints that differ in at most four bits agree on at least two of six
blocks), sorted by Gray rank inside each block value, and searched there through an index:
consecutive codes form groups, each group keeps the bits its members share, an upper node
keeps what its groups share, and a search adds up differences on the way down and leaves a
group as soon as they exceed the limit. Tasks return spanning links, never all pairs.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, shuffle_partitions, staged

FANOUT = 8
CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    words = text.lower().split()  # on bytes: A-Z, and space, tab, LF, VT, FF, CR only
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[: len(words) - width].tolist()]
    stops = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], dtype=np.uint64)
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    top = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(top).view(">u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """Rows (doc_id, text_hash, fp): fp is the 64-bit fingerprint as a signed long (null text
    gives 0), text_hash the xxhash64 of the text."""

    def run(batches):
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            got = np.array([fingerprint(t.as_py() or b"", shingle, seed) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64))], names=["doc_id", "text_hash", "fp"])

    slim = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long")


def gray_rank(code: np.ndarray) -> np.ndarray:
    """Position of each uint64 in the reflected Gray order."""
    out = code.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class GrayIndex:
    """Codes sorted by (bucket, Gray rank) and the levels of shared bits above them."""

    def __init__(self, bucket: np.ndarray, code: np.ndarray, fanout: int = FANOUT):
        self.code = code
        ones, zeros = code, ~code
        first, buckets = np.arange(len(code)), bucket
        self.levels = []  # lowest first: (mask, pattern, first leaf, end leaf, first child)
        self.levels.append((np.full(len(code), ~np.uint64(0)), code, first, first + 1, first))
        while True:
            _, where, place = np.unique(buckets, return_index=True, return_inverse=True)
            inside = np.arange(len(buckets)) - where[place]
            starts = np.flatnonzero(inside % fanout == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, starts), np.bitwise_and.reduceat(zeros, starts)
            leaf_first = self.levels[-1][2][starts]
            leaf_end = np.append(leaf_first[1:], len(code))
            self.levels.append((ones | zeros, ones, leaf_first, leaf_end, starts))
            buckets = buckets[starts]
            if len(np.unique(buckets)) == len(buckets):
                break
        self.root = np.repeat(np.arange(len(buckets)), self.levels[-1][3] - self.levels[-1][2])

    def links(self, most: int):
        """Arrays (i, j) whose links give the same classes as all pairs at most `most` bits apart."""
        out, closed = [], []
        for start in range(0, len(self.code), CHUNK):
            q = np.arange(start, min(start + CHUNK, len(self.code)))
            node, gone = self.root[q], np.zeros(len(q), np.int64)
            above = np.zeros(len(q), np.uint64)  # bits already compared
            for level in range(len(self.levels) - 1, -1, -1):
                mask, pattern, first, end, child = self.levels[level]
                gone = gone + np.bitwise_count((self.code[q] ^ pattern[node]) & mask[node] & ~above)
                keep = (gone <= most) & (end[node] > q + 1)  # later codes only
                q, node, gone = q[keep], node[keep], gone[keep]
                if level == 0:
                    out.append((q, first[node]))
                    break
                # a node whose members are all within reach of the code is taken as a whole
                free = 64 - np.bitwise_count(mask[node]).astype(np.int64)
                sure = gone + free <= most
                out.append((q[sure], first[node][sure]))
                closed.append((first[node][sure], end[node][sure]))
                q, node, gone = q[~sure], node[~sure], gone[~sure]
                lower = self.levels[level - 1]
                stop = np.append(child[1:], len(lower[0]))[node]
                count = stop - child[node]
                inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                above = np.repeat(mask[node], count)
                q, gone, node = np.repeat(q, count), np.repeat(gone, count), np.repeat(child[node], count) + inside
        for first, end in closed:
            for a, b in np.unique(np.stack([first, end], 1), axis=0):
                run = np.arange(a, b)
                out.append((run[:-1], run[1:]))
        return tuple(np.concatenate(x) for x in zip(*out))


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position of each of n positions' classes under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(deep := new[new], new):
            new = deep
        if np.array_equal(new, label):
            return label
        label = new


def _blocks(blocks: int) -> list[int]:
    """Masks of the blocks of bits, as even as can be."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def near_links(codes: DataFrame, bits: int = 4, blocks: int = 6) -> DataFrame:
    """Links (a, b) between ids of rows (id, fp), fp distinct, that span the classes of
    fingerprints at most `bits` bits apart."""
    spark = codes.sparkSession
    masks = [sum(c) for c in combinations(_blocks(blocks), blocks - bits)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    gray = F.col("fp")
    for s in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, s))
    keyed = codes.withColumn("gray", gray.bitwiseXOR(F.lit(-(1 << 63)))).select(
        "id", "fp", "gray", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("tab", "part")
    )
    dealt = keyed.repartition(shuffle_partitions(spark), "tab", "part").sortWithinPartitions("tab", "part", "gray")
    kind = codes.schema["id"].dataType.simpleString()

    def run(batches):
        held: list = []
        for batch in batches:
            tab, part = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            new = np.flatnonzero((tab[1:] != tab[:-1]) | (part[1:] != part[:-1]))
            if len(new):  # all but the last bucket of this batch are whole
                held.append(batch.slice(0, int(new[-1]) + 1))
                yield from _bucket_links(held, bits)
                batch = batch.slice(int(new[-1]) + 1)
                held = []
            elif held and (held[-1].column(4)[0] != batch.column(4)[0] or held[-1].column(3)[0] != batch.column(3)[0]):
                yield from _bucket_links(held, bits)
                held = []
            held.append(batch)
        if held:
            yield from _bucket_links(held, bits)

    return dealt.mapInArrow(run, f"a {kind}, b {kind}")


def _bucket_links(held: list, bits: int):
    t = pa.Table.from_batches(held)
    tab, part = t.column(3).to_numpy(), t.column(4).to_numpy()
    bucket = np.cumsum(np.append(False, (tab[1:] != tab[:-1]) | (part[1:] != part[:-1])))
    size = np.bincount(bucket)[bucket]
    keep = np.flatnonzero(size > 1)
    if not len(keep):
        return
    code = t.column(1).to_numpy()[keep].astype(np.int64).view(np.uint64)
    a, b = GrayIndex(bucket[keep], code).links(bits)
    label = spanning(len(code), a, b)
    moved = np.flatnonzero(label != np.arange(len(code)))
    ids = t.column(0).take(pa.array(keep)).combine_chunks()
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(label[moved]))], names=["a", "b"])


def simhash_classes(docs: DataFrame, shingle: int = 4, bits: int = 4, blocks: int = 6) -> DataFrame:
    """Rows (doc_id, text_hash, fp, component_id, class), one per row of docs; class is a
    fingerprint that names the class of linked ones.

    component_id is the smallest doc_id reachable through fingerprints at most `bits` bits
    apart, the document itself included. Null and empty texts have fingerprint zero, which
    links like any other. Rows with a null doc_id link like others, but name no component: a
    class of such rows only has a null one. Repeated rows stay. Columns other than doc_id and
    text are ignored. No documents give no rows.
    """
    fps = staged(fingerprints(docs, shingle), "simhash")
    codes = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash_codes")
    # fingerprints stand for themselves, so that those of rows without an id link as well
    links = near_links(codes.select(F.col("fp").alias("id"), "fp"), bits, blocks)
    classes = connected_components(links).select(F.col("node").alias("fp"), "component")
    named = staged(codes.join(classes, "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("class")), "simhash_classes")
    least = named.groupBy("class").agg(F.min("id").alias("component_id"))
    named = named.join(least, "class").select("fp", "component_id", "class")
    return fps.join(named, "fp", "left").select("doc_id", "text_hash", "fp", "component_id", "class")
