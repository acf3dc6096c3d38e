import numpy as np

from matweft.llm import entries, quality
from tests.llm.helpers import docs


def labels(spark, rows):
    return spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id bigint, quality int, toxic int, text string")


def test_features_do_not_depend_on_neighbours():
    words = [b"", b"a", b"the", "größe".encode(), b"x" * 300]
    owner, bucket = quality.features(words)
    for k, w in enumerate(words):
        alone = np.sort(quality.features([w])[1])
        assert np.array_equal(np.sort(bucket[owner == k]), alone)


def test_held_out_accuracy(spark, small):
    got = {r.doc_id: r for r in entries.op8_quality(spark, small).collect()}
    truth = spark.read.parquet(f"{small}/labels.parquet").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    held = [(got[r.doc_id].predicted, r.quality) for r in truth if got[r.doc_id].held_out]
    assert held and sum(a == b for a, b in held) >= 0.97 * len(held)


def test_edges(spark):
    rows = [(i, "good clean words here" if i % 2 else "%%% ### bad bad bad") for i in range(60)] + [(100, None), (101, ""), (None, "words"), (3, "good clean words here"), (102, "lang " * 50_000)]
    table = docs(spark, rows).drop("label")
    truth = labels(spark, [(i, i % 2) for i in range(60)] + [(1, None), (2, 1), (2, 0), (None, 1), (999, 0)])
    model = quality.fit(table, truth, entries.remainder(5) != 0)
    got = quality.score(table, model)
    assert got.columns == [*table.columns, "score"] and got.count() == len(rows)
    by = {r.doc_id: r.score for r in got.where("doc_id < 60").collect()}
    assert min(v for k, v in by.items() if k % 2) > max(v for k, v in by.items() if not k % 2)
    assert quality.score(table.limit(0), model).collect() == []
    nothing = quality.fit(table, truth.limit(0), entries.remainder(5) != 0)
    assert {r.score for r in quality.score(table, nothing).collect()} == {0.5}
