import numpy as np
from pyspark.sql import functions as F

from matweft.llm import entries, langid
from tests.llm.helpers import docs


def test_held_out_accuracy(spark, tiny):
    got = entries.op6_langid(spark, tiny).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    held = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out]
    assert len(got) == 200 and held and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_mixture_and_selection():
    rng = np.random.default_rng(2)
    logs = np.log(rng.dirichlet(np.full(50, 0.3), size=4) + 1e-6)
    p = np.exp(logs)
    one = rng.multinomial(400, p[2] / p[2].sum())
    langs, part = langid.identify(one.astype(float), logs)
    assert langs.tolist() == [2] and part.tolist() == [1.0]
    mixed = rng.multinomial(600, (0.7 * p[1] + 0.3 * p[3]) / (0.7 * p[1] + 0.3 * p[3]).sum())
    langs, part = langid.identify(mixed.astype(float), logs)
    assert langs.tolist() == [1, 3] and abs(part[0] - 0.7) < 0.1


def test_edges(spark):
    rows = [(i, ("the cat and the dog " if i % 2 else "der hund und die katze ") * 5) for i in range(8)]
    table = docs(spark, rows + [(90, None), (91, ""), (92, "123 !? 4"), (92, "123 !? 4"), (None, "und die katze"), (93, "the dog " * 100_000)])
    from pyspark.sql import functions as F

    table = table.withColumn("lang", F.when(F.col("doc_id") < 8, F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de")))
    model = langid.fit(table, F.lit(True))
    got = {(r.doc_id, r.lang_pred) for r in langid.languages(table, model).collect()}
    assert got >= {(1, "en"), (2, "de"), (90, "und"), (91, "und"), (92, "und"), (None, "de"), (93, "en")}
    nothing = langid.fit(table.limit(0), F.lit(True))
    assert {r.lang_pred for r in langid.languages(table, nothing).collect()} == {"und"}
    assert langid.languages(table.limit(0), model).collect() == []


def test_words_of_one_letter(spark):
    rows = [(1, "a cat and a dog"), (2, "o gato e o rato"), (3, "A."), (4, "e - e"), (5, "1.")]
    table = docs(spark, rows)
    from pyspark.sql import functions as F

    table = table.withColumn("lang", F.expr("case doc_id when 1 then 'en' when 2 then 'pt' end"))
    got = {r.doc_id: (r.lang_pred, r.score > 0) for r in langid.languages(table, langid.fit(table, F.lit(True))).collect()}
    assert got[3] == ("en", True) and got[4] == ("pt", True) and got[5] == ("und", False)


def test_one_letter_and_no_letter(spark):
    train = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate([("a cat and a dog", "en"), ("ein Hund und eine Katze", "de")] * 3)], "doc_id long, text string, lang string")
    model = langid.fit(train, F.lit(True))
    table = docs(spark, [(1, "a"), (2, "I"), (3, "x y z"), (4, "½"), (5, "²³ 12"), (6, "½ a")])
    got = {r.doc_id: r.lang_pred for r in langid.languages(table, model).collect()}
    assert {i for i, p in got.items() if p == "und"} == {4, 5}


def test_selection_matches_a_plain_computation():
    """EM and the choice of languages, written out with loops."""
    import math

    rng = np.random.default_rng(3)
    like = rng.dirichlet(np.ones(40) * 0.2, 4)
    counts = np.round(60 * (0.6 * like[1] + 0.4 * like[3]) + 0.3)
    keep = counts > 0
    logs, counts = np.log(like[:, keep] + 1e-9), counts[keep]

    def em(which):
        share = [1 / len(which)] * len(which)
        was = -math.inf
        for _ in range(langid.ROUNDS):
            mixed = [sum(s * math.exp(logs[k][i]) for s, k in zip(share, which)) for i in range(len(counts))]
            now = sum(c * math.log(m) for c, m in zip(counts, mixed))
            share = [s * sum(c * math.exp(logs[k][i]) / m for i, (c, m) in enumerate(zip(counts, mixed))) / sum(counts) for s, k in zip(share, which)]
            if now - was < 1e-3:
                break
            was = now
        return share, now

    first, _ = em(range(4))
    order = sorted(range(4), key=lambda k: -first[k])
    best = (-math.inf, None, None)
    for k in range(1, 5):
        if k > 1 and first[order[k - 1]] < langid.LEAST_SHARE:
            break
        share, value = em(order[:k])
        value -= (k - 1) * 0.5 * math.log(sum(counts) + 1)
        if value > best[0]:
            best = (value, order[:k], share)
    which, part = langid.identify(counts, logs)
    assert sorted(which.tolist()) == sorted(best[1])
    assert np.allclose(dict(zip(which.tolist(), part))[best[1][0]], best[2][0], atol=1e-6)
