"""Language-model scoring with a probabilistic suffix tree over words.

The tree predicts the next token of a text (a lower-cased word, or the end) from the longest
of its contexts that the tree retains. The root holds the discounted distribution of all
training tokens, with the discounted mass for one unknown token. Longer contexts are runs of
up to DEPTH tokens, the end before a text's first word among them. A context is a candidate
if it occurs at least LEAST_COUNT times in training, a number of occurrences and not a share,
so the tree grows with the corpus. It is retained if its next tokens diverge from those of its
longest proper suffix by more than chance. A retained distribution holds every token seen
twice or more in the context; its other mass, and PRIOR, go to the distribution of its longest
retained suffix.

Neither words nor contexts are ever gathered in one place. Documents are dealt to segments, a
bucketed table that every pass reads without a shuffle. A pass over the segments counts runs
of one more token; the totals go back to the segments that have those runs, and to no others.
Runs are told apart by 64-bit codes made of the XXH64 of their words. Codes are uniform, so
ranges of them are even buckets, dealt so that a bucket has a bounded number of runs.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shared_dir, shuffle_partitions, staged

DEPTH = 3
#: Least number of times that a context must occur in training.
LEAST_COUNT = 100
#: Standard deviations by which a context's test must exceed what chance gives, and its
#: least divergence in nats.
LEAST_SIGMA, LEAST_DIVERGENCE = 4.0, 0.002
#: A next token is a cell of its own in the test if it is expected once or seen so often;
#: the others are one cell together.
LEAST_SEEN = 5
#: Weight of the suffix's distribution in a context's, in counts.
PRIOR = 5.0
SEGMENT_WORDS = 3_000_000
#: Greatest number of runs that a bucket has on average.
BUCKET_RUNS = 2_000_000
#: Keys that a look-up puts into one hash table.
TABLE_KEYS = 500_000

#: The end is a word of no bytes, the first of every segment.
END = b""
SEED = 42  # of Spark's xxhash64


def normal(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.lower().split() if text else []


def gather(docs: DataFrame, held_out: Column) -> DataFrame:
    """One pass over docs (doc_id, text), written in buckets of segments. Rows of three kinds:
    documents (segment, doc_id, held_out, tokens: numbers of words in the segment), hashes of
    the words of a segment (segment, hashes), and its words (segment, word, nth, n in training
    documents)."""
    spark = docs.sparkSession
    slim = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    parts = [("segment", pa.int64()), ("doc_id", None), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("word", pa.binary()), ("nth", pa.int32()), ("n", pa.int64())]

    def run(batches):
        part, made, schema, seen, n = TaskContext.get().partitionId(), 0, None, {END: 0}, 0
        counts = [np.zeros(1, np.int64)]

        def rows(count, **have):
            return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(count, f.type)) for f in schema], schema=schema)

        def dictionary():
            m, segment = len(seen), part << 32 | made
            total = np.zeros(m, np.int64)
            for c in counts:
                total[: len(c)] += c
            hashes = np.array([xxhash.xxh64_intdigest(w, SEED) for w in seen], np.uint64)
            yield rows(1, segment=pa.array([segment], pa.int64()), hashes=pa.array([hashes.tobytes()], pa.binary()))
            yield rows(m, segment=pa.array(np.full(m, segment)), word=pa.array(list(seen), pa.binary()), nth=pa.array(np.arange(m, dtype=np.int32)), n=pa.array(total))

        for batch in batches:
            schema = pa.schema([(name, t or batch.column(0).type) for name, t in parts])
            segments, tokens = [], []
            for out, text in zip(batch.column(2).to_pylist(), batch.column(1).cast(pa.binary())):
                got = np.array([seen.setdefault(w, len(seen)) for w in normal(text.as_py())], np.int32)
                if not out:
                    counts.append(np.bincount(got, minlength=1))
                    counts[-1][0] = 1  # its end
                tokens.append(got.tobytes())
                segments.append(part << 32 | made)
                n += len(got) + 1
                if len(counts) >= 64:
                    total = np.zeros(len(seen), np.int64)
                    for c in counts:
                        total[: len(c)] += c
                    counts = [total]
                if n >= SEGMENT_WORDS:
                    yield from dictionary()
                    made, n, seen, counts = made + 1, 0, {END: 0}, [np.zeros(1, np.int64)]
            yield rows(len(tokens), segment=pa.array(segments, pa.int64()), doc_id=batch.column(0), held_out=batch.column(2), tokens=pa.array(tokens, pa.binary()))
        if n:
            yield from dictionary()

    rows = slim.mapInArrow(run, f"segment long, doc_id {kind}, held_out boolean, tokens binary, hashes binary, word binary, nth int, n long")
    table = f"matweft_lm_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{table}"
    rows.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(shuffle_partitions(spark), "segment").saveAsTable(table)
    read = spark.table(table)
    read.schema  # resolved: the files stay when the name goes
    spark.sql(f"DROP TABLE {table}")
    return read


def extend(code: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Codes of runs that are one token longer."""
    x = (code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ hashes.view(np.uint64)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def packed(x: np.ndarray) -> bytes:
    """The bytes of numbers by place value, which compress where the numbers are small."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def unpacked(cells: pa.ChunkedArray, dtype) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    sizes = pc.binary_length(cells).to_numpy() // width
    out, at = np.empty(sizes.sum(), dtype), 0
    for cell, n in zip(cells, sizes):
        out[at : at + n].view(np.uint8).reshape(n, width)[:] = np.frombuffer(cell.as_buffer(), np.uint8).reshape(width, n).T
        at += n
    return out


def look_up(keys: np.ndarray, values: np.ndarray, want: np.ndarray, missing: int) -> np.ndarray:
    """Values of the keys wanted; no key stands twice. One share of the keys is in a hash table at a time."""
    found = np.full(len(want), missing, values.dtype)
    shares = len(keys) // TABLE_KEYS + 1
    mine, theirs = (x.view(np.uint64) % np.uint64(shares) if shares > 1 else None for x in (keys, want))
    for k in range(shares):
        have, asked = (slice(None) if x is None else np.flatnonzero(x == k) for x in (mine, theirs))
        at = pd.Index(keys[have]).get_indexer(want[asked])
        found[asked] = np.where(at >= 0, np.append(values[have], 0)[at], missing)
    return found


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct codes, the place of one of each, and the group of every place."""
    which, distinct = pd.factorize(codes)
    place = np.zeros(len(distinct), np.int64)
    place[which[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return distinct, place, which


class Segment:
    """The tokens of a segment's documents in a row, an end before and after each document.

    side: what is known of them, rows (kind, key, value): counts of words by number (kind 0)
    and of runs of d + 1 tokens by code (kind d), the mass that retained contexts of d tokens
    hold themselves (kind -d). Rows of runs may hold many, packed in keys and values; a value is
    then twice the number, and 1 more in one of the segments that have the run (told).
    At each place of at[d] a context of d tokens that is a candidate ends just before it;
    codes[d] and counts[d] are those of that context and the token there. Of the longest,
    last_codes and last_counts hold them for the places of at[depth] only.
    """

    def __init__(self, left: pa.Table, side: pa.Table, depth: int, least: int):
        hashes = [np.frombuffer(x, np.int64) for x in left.column("hashes").drop_null().to_pylist()]
        self.docs = left.filter(left.column("tokens").is_valid())
        texts = [np.frombuffer(x, np.int32) for x in self.docs.column("tokens").to_pylist()]
        lengths = np.array([len(t) for t in texts], np.int64) + 2
        self.starts = np.cumsum(lengths) - lengths
        tokens = np.zeros(lengths.sum(), np.int32)
        for start, text in zip(self.starts, texts):
            tokens[start + 1 : start + 1 + len(text)] = text
        self.offset = (np.arange(len(tokens)) - np.repeat(self.starts, lengths)).astype(np.int32)
        self.learned = np.repeat(~self.docs.column("held_out").to_numpy(zero_copy_only=False).astype(bool), lengths)
        self.hashes = hashes[0][tokens]
        self.side = side
        of_word = np.zeros(len(hashes[0]), np.int64)
        nth, n = self.known(0)
        of_word[nth] = n
        self.codes, self.counts = [self.hashes], [of_word[tokens]]
        self.at = [np.flatnonzero(self.offset > 0).astype(np.int32)]
        for d in range(1, depth + 1):
            at = self.at[-1]
            at = at[self.offset[at] >= d]
            at = at[self.counts[-1][at - 1] >= least]
            code = extend(self.codes[-1][at - 1], self.hashes[at])
            count = look_up(*self.known(d), code, 0)
            self.at.append(at)
            if d == depth:
                self.last_codes, self.last_counts = code, count
                break
            for kept, found in ((self.codes, code), (self.counts, count)):
                kept.append(np.zeros_like(self.hashes))
                kept[-1][at] = found

    def _of_kind(self, kind: int) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        """The rows of a kind, and the codes and values of those that hold many. Only what is asked
        for is unpacked, and not kept: all kinds together are several times the documents."""
        rows = self.side.filter(pc.equal(self.side.column("kind"), kind))
        many = rows.filter(rows.column("keys").is_valid())
        return rows, *(unpacked(many.column(c), np.int64) for c in ("keys", "values"))

    def known(self, kind: int) -> tuple[np.ndarray, np.ndarray]:
        rows, codes, totals = self._of_kind(kind)
        one = rows.filter(rows.column("keys").is_null())
        totals >>= 1
        return np.concatenate([one.column("key").to_numpy(), codes]), np.concatenate([one.column("value").to_numpy(), totals])

    def told(self, kind: int) -> np.ndarray:
        _, codes, totals = self._of_kind(kind)
        return codes[totals & 1 == 1]


def _beside(rows: DataFrame, kind: int, key: str, value: str) -> DataFrame:
    number = lambda c: F.col(c).cast("long")
    none = F.lit(None).cast("binary")
    return rows.select(F.col("segment").alias("seg"), F.lit(kind).alias("kind"), number(key).alias("key"), number(value).alias("value"), none.alias("keys"), none.alias("values"))


_RUNS = {"code": np.int64, "n": np.int64, "ctx": np.int64, "length": np.int32, "n_ctx": np.int64, "expected": np.float32}
_STATS = ("n", "held", "g", "seen", "expected", "free")


def context_sums(ctx: np.ndarray, n_ctx: np.ndarray, seen: np.ndarray, expected: np.ndarray) -> dict[str, np.ndarray]:
    """What retained needs of next tokens seen once or more, summed by context."""
    order = np.argsort(ctx, kind="stable")
    ctx, n_ctx, seen, mean = ctx[order], n_ctx[order], seen[order], expected[order].astype(np.float64)
    cell = (mean > 0) & ((mean >= 1) | (seen >= LEAST_SEEN))
    g = np.where(cell, seen * np.log(seen / np.where(cell, mean, 1)), 0.0)
    starts = _starts(ctx)
    add = lambda x: np.add.reduceat(x, starts) if len(starts) else np.zeros(0, x.dtype)
    sums = (n_ctx[starts], add(np.where(seen >= 2, seen, 0)), add(g), add(np.where(cell, seen, 0.0)), add(np.where(cell, mean, 0.0)), add(cell.astype(np.int64)))
    return {"ctx": ctx[starts], **dict(zip(_STATS, sums))}


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])


def count_runs(texts: DataFrame, side: DataFrame, depth: int, train: int, least: int, buckets: int, last: int) -> DataFrame:
    """The runs of a candidate context of depth tokens and one more, totalled over all segments.

    Rows (segment, codes, totals) have runs of a segment that were seen twice or more in
    training, packed. Rows (segment, code, total) repeat those of least times or more. Rows
    (depth, ctx, n, held, g, seen, expected, free) have, without a segment, sums over a part of
    the next tokens of a context: see retained. Longer runs that can neither be seen twice nor
    be a cell of the test are not sent. Runs of two tokens are the most, and are sent without
    their contexts: the sums of these are made by the segments in the next pass, with the
    totals at hand, if there is one (last > 1)."""
    alone = depth == 1 < last

    def earlier(s: Segment) -> np.ndarray:
        """Sums for contexts of one token: each run counts in one of its segments."""
        at = s.at[1]
        code, first, which = grouped(s.codes[1][at])
        n, total, place = np.bincount(which, s.learned[at], minlength=len(code)), s.counts[1][at[first]], at[first]
        use = (pd.Index(s.told(1)).get_indexer(code) >= 0) | ((total == 0) & (n == 1))  # without a total it was seen here only
        place, seen = place[use], np.maximum(total[use], 1)
        n_ctx, n_run = s.counts[0][place - 1], s.counts[0][place]
        share = np.where(n_run < least, 0, n_run / max(train, 1))
        sums = context_sums(s.hashes[place - 1], n_ctx, seen, (n_ctx * share).astype(np.float32))
        return np.concatenate([x.view(np.int64) for x in sums.values()])

    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        s, segment, rows = Segment(left, right, depth, least), left.column("segment")[0].as_py(), []
        if depth == 2:
            rows.append({"bucket": segment % buckets, "sums": packed(earlier(s)), **dict.fromkeys(_RUNS, b"")})
        at, codes = s.at[depth], s.last_codes
        n_ctx, n_run = s.counts[depth - 1][at - 1], s.counts[depth - 1][at]
        share = n_run / (train if depth == 1 else s.counts[depth - 2][at - 1])
        if depth == 1:
            share[n_run < least] = 0  # tokens rarer than least are no cells after the root
        expected = (n_ctx * share).astype(np.float32)
        if depth > 1:  # a run is as rare as the run without its first token: others are no cell, nor seen twice
            use = (n_run >= 2) | (expected >= 1)
            at, codes, n_ctx, expected = at[use], codes[use], n_ctx[use], expected[use]
        code, first, which = grouped(codes)
        n = np.bincount(which, s.learned[at], minlength=len(code)).astype(np.int64)
        ctx, n_ctx, expected = s.codes[depth - 1][at[first] - 1], n_ctx[first], expected[first]
        bucket = ((code.view(np.uint64) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(code.view(np.uint64)) if alone else np.lexsort((ctx, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
            starts = _starts(ctx[part])
            length = np.diff(np.append(starts, len(part))).astype(np.int32)
            columns = (code[part], n[part], ctx[part][starts], length, n_ctx[part][starts], expected[part])
            rows.append({"bucket": int(bucket[part[0]]), **{c: b"" if alone and c not in ("code", "n") else packed(x) for c, x in zip(_RUNS, columns)}})
        schema = pa.schema([("segment", pa.int64()), ("bucket", pa.int64()), *((c, pa.binary()) for c in (*_RUNS, "sums"))])
        return pa.Table.from_pylist([{"segment": segment, **r} for r in rows], schema)

    def total(table: pa.Table) -> pa.Table:
        code, n, ctx, length, n_ctx, expected = (unpacked(table.column(c), t) for c, t in _RUNS.items())
        row = np.repeat(np.arange(len(table)), [len(c) // 8 for c in table.column("code").to_pylist()])
        distinct, place, which = grouped(code)
        totals = np.bincount(which, n, len(distinct)).astype(np.int64)  # exact below 2^53
        out = []
        for cell in table.column("sums").drop_null().to_pylist():
            whole = unpacked(pa.chunked_array([[cell]], pa.binary()), np.int64).reshape(1 + len(_STATS), -1)
            out.append(pa.table({"depth": np.full(whole.shape[1], depth - 1), **{c: x.view(schema.field(c).type.to_pandas_dtype()) for c, x in zip(("ctx", *_STATS), whole)}}))
        if not alone:  # one row of each run is for the sums over contexts
            one, seen = place[totals > 0], totals[totals > 0]
            sums = context_sums(np.repeat(ctx, length)[one], np.repeat(n_ctx, length)[one], seen, expected[one])
            out.append(pa.table({"depth": np.full(len(sums["ctx"]), depth), **sums}))
        # the rest goes back to the segments, by code
        first = np.zeros(len(code), np.int64)
        first[place] = 1
        order = np.flatnonzero((totals >= 2)[which])
        order = order[np.lexsort((code[order], row[order]))]
        first, totals = first[order], totals[which[order]]
        segments = table.column("segment").to_numpy()
        often = totals >= least
        out.append(pa.table({"segment": segments[row[order[often]]], "code": code[order[often]], "total": totals[often]}))
        cuts = np.flatnonzero(np.diff(row[order])) + 1
        for codes, counts, at in zip(np.split(code[order], cuts), np.split(2 * totals + first, cuts), np.split(order, cuts)):
            if len(at):
                out.append(pa.table({"segment": segments[row[at[:1]]], "codes": pa.array([packed(codes)], pa.binary()), "totals": pa.array([packed(counts)], pa.binary())}))
        return pa.concat_tables([schema.empty_table(), *out], promote_options="default").select(schema.names).cast(schema)

    long = ("segment", "code", "total", "depth", "ctx", "n", "held", "free")
    schema = pa.schema([*((c, pa.int64()) for c in long), *((c, pa.float64()) for c in ("g", "seen", "expected")), ("codes", pa.binary()), ("totals", pa.binary())])
    kinds = {pa.int64(): "long", pa.float64(): "double", pa.binary(): "binary"}
    sent = texts.groupBy("segment").cogroup(side.groupBy("seg")).applyInArrow(send, ", ".join(["segment long", "bucket long", *(f"{c} binary" for c in (*_RUNS, "sums"))]))
    return staged(sent.groupBy("bucket").applyInArrow(total, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)), f"lm_runs{depth}")


def retained(runs: DataFrame) -> DataFrame:
    """Rows (ctx, held): contexts whose next tokens diverge from their suffix's by more than chance
    and the number of their next tokens that were seen twice or more.

    Of the cells of a context, g is the sum of seen * log(seen / expected), free their number."""
    stats = runs.where("ctx is not null").groupBy("ctx").agg(F.max("n").alias("n"), *(F.sum(c).alias(c) for c in _STATS[1:]))
    rest = F.greatest(F.col("n") - F.col("seen"), F.lit(0.0))
    g = F.col("g") + F.when(rest > 0, rest * F.log(rest / F.greatest(F.col("n") - F.col("expected"), F.lit(0.5)))).otherwise(0.0)
    chance = F.col("free") + LEAST_SIGMA * F.sqrt(2.0 * F.col("free"))
    return stats.where((F.col("free") > 0) & (2 * g >= chance) & (g >= LEAST_DIVERGENCE * F.col("n"))).select("ctx", "held")


def score_documents(docs: DataFrame, held_out: Column, depth: int = DEPTH, least: int = LEAST_COUNT) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, n_in_context, train_tokens, base_score, score),
    one per row of docs (doc_id, text).

    held_out: condition on doc_id of rows that are not learned from (null: learned from).
    Tokens are the lower-cased words and one end. base_score is the add-one unigram log10
    probability of the tokens, score that of the tree; in both an unknown word is one
    unknown token. n_in_context counts the tokens that are predicted by a context longer than
    none. Null and empty texts have the end only. Repeated rows are separate documents. Other
    columns are ignored. Without training documents both scores are 0.
    """
    rows = gather(docs, held_out)
    words = rows.where("word is not null").select("segment", "word", "nth", "n")
    # a word has at most one row a segment, so none is hot, and the window spills
    of_word = W.partitionBy("word")
    told = words.withColumn("c", F.sum("n").over(of_word)).withColumn("one", F.col("segment") == F.min("segment").over(of_word))
    frequent = F.when(F.col("c") >= least, F.xxhash64("word")).alias("h")
    known = staged(told.where("c > 0").select("segment", "nth", "c", frequent, "one"), "lm_known")
    number = lambda of: F.coalesce(F.sum(of.cast("long")), F.lit(0))
    c, one = F.col("c"), F.col("one")
    got = known.agg(number(F.when(one, c)).alias("n"), number(one).alias("v"), number(one & (c == 1)).alias("n1"), number(one & (c == 2)).alias("n2"), number(F.col("nth") == 0).alias("segments")).first()
    train, distinct = got.n, got.v
    discount = (got.n1 + 0.5) / (got.n1 + 2 * got.n2 + 1)
    unknown = discount * distinct / train if train else 1.0
    buckets = max(2 * shuffle_partitions(docs.sparkSession), -(-got.segments * SEGMENT_WORDS // BUCKET_RUNS))

    texts = rows.where("tokens is not null or hashes is not null").select("segment", "doc_id", "held_out", "tokens", "hashes")
    contexts = side = _beside(known.where("h is not null"), 0, "nth", "c")
    beside = _beside(known, 0, "nth", "c")
    endings = {1: known.where("h is not null").select("segment", F.col("h").alias("ctx"))}  # contexts a segment has
    none = [F.lit(None).cast("long").alias(c) for c in ("key", "value")]
    for d in range(1, depth + 1):
        runs = count_runs(texts, side, d, train, least, buckets, depth)
        often = runs.where("code is not null")
        totals = runs.where("codes is not null").select(F.col("segment").alias("seg"), F.lit(d).alias("kind"), *none, F.col("codes").alias("keys"), F.col("totals").alias("values"))
        beside = beside.unionByName(totals)
        for e in (1, 2) if d == 2 else () if d == 1 < depth else (d,):
            beside = beside.unionByName(_beside(endings[e].join(retained(runs.where(F.col("depth") == e)), "ctx"), -e, "ctx", "held"))
        # shorter runs than those just counted are needed as contexts only
        side = contexts.unionByName(totals)
        contexts = contexts.unionByName(_beside(often, d, "code", "total"))
        endings[d + 1] = often.select("segment", F.col("code").alias("ctx"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "n_in_context", "base_score", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        s = Segment(left, right, depth, least)
        c = s.counts[0]
        p = np.where(c > 0, (c - discount) / max(train, 1), unknown)
        inside = np.zeros(len(c), np.int64)
        for d in range(1, depth + 1):
            at = s.at[d]
            held = look_up(*s.known(-d), s.codes[d - 1][at - 1], -1)
            n_run = s.last_counts if d == depth else s.counts[d][at]
            at, n_run, held = at[held >= 0], n_run[held >= 0], held[held >= 0]
            n_ctx = s.counts[d - 1][at - 1]
            p[at] = (n_run + (n_ctx - held + PRIOR) * p[at]) / (n_ctx + PRIOR)
            inside[at] = 1
        token = s.offset > 0
        summed = lambda x: np.add.reduceat(np.where(token, x, 0), s.starts) if len(s.starts) else np.zeros(0, x.dtype)
        base = np.log10(c + 1) - np.log10(train + distinct + 1)
        columns = [summed(token.astype(np.int64)), summed((c > 0).astype(np.int64)), summed(inside), summed(base), summed(np.log10(p))]
        return pa.table([s.docs.column("doc_id"), s.docs.column("held_out"), *(pa.array(x) for x in columns)], names=names)

    result = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, n_in_context long, base_score double, score double"
    scored = texts.groupBy("segment").cogroup(beside.groupBy("seg")).applyInArrow(run, result)
    return scored.select(*names[:5], F.lit(int(train)).cast("long").alias("train_tokens"), "base_score", "score")
