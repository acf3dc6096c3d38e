"""Embedding near-dedup by p-stable hashing for the Euclidean distance.

Vectors are normalised; a cosine of at least c is a distance of at most sqrt(2 - 2c). In
each of L tables a vector's bucket is the tuple of k random projections, shifted at random
and cut into steps of width w. Vectors of a bucket are compared by exact cosine in double
precision, in blocks, with a product of matrices. A pair counts in the first table in which
it meets, so links are counted without listing pairs; what leaves a task is a count for
each vector and links that span its classes.

k grows with the number of vectors, so that unrelated ones seldom meet; L follows from k
and the wanted recall at the threshold. Identical vectors are collapsed first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, shuffle_partitions, staged
from .simhash import spanning

#: Chance that a pair at the threshold meets in no table.
MISS = 0.0005
WIDTH = 2.0
#: Unrelated vectors that a vector should meet in a table, about.
STRANGERS = 512
#: Vectors of a bucket compared in one task; larger buckets are dealt out as pairs of parts.
PART = 4096
BLOCK = 1024


def meeting(distance: float, width: float = WIDTH) -> float:
    """Chance that one projection puts two vectors at this distance into the same step."""
    t = width / distance
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, cosine: float, miss: float = MISS) -> tuple[int, int]:
    """(projections a table, tables) for n vectors."""
    near, far = meeting(math.sqrt(2 - 2 * cosine)), meeting(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(n, 1) / STRANGERS + 1) / -math.log(far)))
    return k, math.ceil(math.log(miss) / math.log(1 - near**k))


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow of their squares."""
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)
    return scaled / np.sqrt((scaled**2).sum(1, keepdims=True))


def table_keys(units: np.ndarray, k: int, tables: int, seed: int, width: float = WIDTH) -> np.ndarray:
    """Bucket keys, one column a table."""
    rng = np.random.default_rng([seed, units.shape[1]])
    direction, shift = rng.normal(size=(units.shape[1], k * tables)), rng.uniform(0, width, k * tables)
    odd = rng.integers(1, 1 << 62, k * tables, dtype=np.int64) | 1
    step = np.floor((units @ direction + shift) / width).astype(np.int64)
    mixed = (step * odd).reshape(len(units), tables, k).sum(2)
    mixed ^= mixed >> 31
    return mixed * 0x5851F42D4C957F2D


def _number(vectors: DataFrame) -> str:
    """float where the numbers are floats, so that vectors travel as they came; else double."""
    return "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"


def _plain(vectors: DataFrame) -> Column:
    """The embedding without negative zeros."""
    kind = _number(vectors)
    return F.expr(f"transform(cast(embedding as array<{kind}>), x -> x + cast(0 as {kind}))")


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (id, n, v, vec_id): distinct usable vectors, a 64-bit hash that names each, how many
    rows have it, the least vec_id. Among 10^9 vectors there is a chance of 3 % that any two
    get the same name."""
    ok = "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    usable = vectors.where(f"coalesce({ok}, false)").select("vec_id", _plain(vectors).alias("v"))
    return usable.groupBy("v").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).withColumn("id", F.xxhash64("v"))


def near_pairs(distinct: DataFrame, cosine: float, seed: int = 11, miss: float = MISS) -> DataFrame:
    """Rows (id, links, to): for distinct vectors (id, n, v), parts of the number of rows
    linked to a vector, and a vector of the same class, or null."""
    spark = distinct.sparkSession
    k, tables = plan(distinct.count(), cosine, miss)
    kind, array = distinct.schema["id"].dataType.simpleString(), distinct.schema["v"].dataType.simpleString()

    def keyed(batches):
        for batch in batches:
            rows = batch.column(2).to_pylist()
            lengths = np.array([len(r) for r in rows])
            for d in np.unique(lengths):  # vectors of different lengths never meet
                at = np.flatnonzero(lengths == d)
                got = table_keys(unit(np.array([rows[i] for i in at], np.float64)), k, tables, seed)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at)) for c in range(3)), pa.array(list(got), pa.list_(pa.int64()))], names=["id", "n", "v", "keys"])

    hashed = staged(distinct.select("id", "n", "v").mapInArrow(keyed, f"id {kind}, n long, v {array}, keys array<long>"), "vectors")
    met = hashed.select(F.size("v").alias("d"), F.posexplode("keys").alias("tab", "key")).groupBy("d", "tab", "key").count().where("count > 1")
    # only vectors that meet another go on, and in a large bucket as members of pairs of parts
    parts = met.select("d", "tab", "key", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    rows = hashed.select("id", "n", "v", F.size("v").alias("d"), F.posexplode("keys").alias("tab", "key")).join(parts, ["d", "tab", "key"])
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("id", "n", "v", "d", "tab", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part")
    dealt = rows.repartition(shuffle_partitions(spark), "d", "tab", "key", "p", "q").sortWithinPartitions("d", "tab", "key", "p", "q", "part")

    def keys_of(units):
        return table_keys(units, k, tables, seed)

    def compare(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            marks = np.stack([held.column(c).to_numpy() for c in (3, 4, 5, 6, 7)])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            if len(cuts):
                yield from _compared(held.slice(0, int(cuts[-1])), cosine, keys_of)
                held = held.slice(int(cuts[-1]))
        if held is not None:
            yield from _compared(held, cosine, keys_of)

    return dealt.mapInArrow(compare, f"id {kind}, links long, to {kind}")


def _compared(t: pa.Table, cosine: float, keys_of):
    """Links inside whole runs of rows with equal (d, tab, key, p, q). Keys in earlier tables
    are made anew, for the vectors of found pairs only, rather than sent along."""
    d, tab, key, p, q, part = (t.column(c).to_numpy() for c in range(3, 9))
    n = t.column(1).to_numpy()
    marks = np.stack([d, tab, key, p, q])
    edges = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1, [len(d)]])
    vectors = t.column(2).combine_chunks()
    links, label = np.zeros(len(d), np.int64), np.arange(len(d))
    for a, b in zip(edges, edges[1:]):
        if b - a < 2:
            continue
        u = unit(vectors.slice(a, b - a).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b - a, -1))
        keys = None
        half = int(np.searchsorted(part[a:b], q[a])) if p[a] < q[a] else 0  # two parts: only across
        left, right = [], []
        for i0 in range(0, half or b - a, BLOCK):
            for j0 in range(half or i0, b - a, BLOCK):
                i, j = np.nonzero(u[i0 : min(i0 + BLOCK, half or b - a)] @ u[j0 : j0 + BLOCK].T >= cosine)
                i, j = i + i0, j + j0
                if not half:
                    i, j = i[i < j], j[i < j]
                if tab[a] and len(i):  # met in no earlier table
                    keys = np.zeros((b - a, tab[a]), np.int64) if keys is None else keys
                    some = np.unique(np.concatenate([i, j]))
                    keys[some] = keys_of(u[some])[:, : tab[a]]
                    first = ~(keys[i] == keys[j]).any(1)
                    i, j = i[first], j[first]
                np.add.at(links, a + i, n[a + j])
                np.add.at(links, a + j, n[a + i])
                left.append(i)
                right.append(j)
        label[a:b] = a + spanning(b - a, np.concatenate(left), np.concatenate(right))
    keep = np.flatnonzero(links > 0)
    ids = t.column(0).combine_chunks()
    to = pa.array(label[keep], mask=label[keep] == keep)
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array(links[keep]), ids.take(to)], names=["id", "links", "to"])


def embedding_classes(vectors: DataFrame, cosine: float = 0.95, seed: int = 11, miss: float = MISS) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of vectors (vec_id, embedding).

    Links join rows whose cosine is at least `cosine`; identical vectors link with each
    other. n_links counts the rows linked directly, component_id is the smallest vec_id
    reachable, kept tells whether it is the row's own. Vectors that are null, empty, zero or
    hold null or non-finite numbers link with nothing. Vectors of different lengths do not
    link. Rows that share a vec_id are told apart by their vectors. A row with a null vec_id
    links like others but names no component: where no other is reachable its component is
    null and it is kept. Other columns are ignored.

    A pair at the threshold is missed with probability `miss`, closer ones less often; no
    pair below the threshold is linked.
    """
    slim = vectors.select("vec_id", "embedding")
    distinct = staged(distinct_vectors(slim), "distinct_vectors")
    found = staged(near_pairs(distinct.select("id", "n", "v"), cosine, seed, miss), "near_vectors")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    classes = connected_components(found.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "id")
    named = distinct.select("id", "n", "vec_id").join(counts, "id", "left").join(classes, "id", "left")
    named = staged(named.select("id", "vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "id").alias("class")), "vector_classes")
    least = named.groupBy("class").agg(F.min("vec_id").alias("component"))
    named = named.join(least, "class").join(distinct.select("id", "v"), "id").select("v", "links", "component")
    # null embeddings and others that are not usable find no partner here
    got = slim.select("vec_id", _plain(slim).alias("v")).join(named, "v", "left")
    component = F.coalesce("component", "vec_id")
    kept = F.coalesce(F.col("vec_id") == component, component.isNull())
    return got.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), kept.alias("kept"))
