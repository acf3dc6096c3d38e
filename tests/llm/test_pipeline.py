import corpus_pipeline as cp
import pytest
from pyspark.sql import functions as F

from matweft.llm.common import staged
from tests.llm.test_decontam import brute as brute_hits
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_simhash import brute_classes, brute_fp


@pytest.fixture(scope="module")
def kept(spark, small):
    """What goes into the first stage and comes out of each."""
    rows = spark.read.parquet(f"{small}/documents.parquet")
    odd = rows.limit(1).select(F.expr("explode(array(struct(90001L as doc_id, cast(null as string) as text), struct(90002L as doc_id, '' as text), struct(90003L as doc_id, 'same same text' as text), struct(90003L as doc_id, 'same same text' as text)))").alias("d"))
    odd = odd.select("d.doc_id", "d.text", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n_chars"))
    clash = {c: F.lit("clash") for c in ("size", "copies", "text_hash", "score", "fp", "n_lines", "removed", "line", "component")}
    out = [staged(rows.unionByName(odd).withColumns(clash), "in")]
    for name, stage in cp.STAGES:
        out.append(staged(stage(spark, out[-1], small), name))
    return out


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_columns_and_order(kept):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "simhash_dedup", "decontamination", "mixing"]
    for df in kept[1:5]:
        assert df.columns == kept[0].columns
    assert set(kept[5].columns) > set(kept[0].columns)


def test_quality_keeps_clean_documents(spark, small, kept):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    left = {r.doc_id for r in kept[1].collect()}
    clean, junk = [i for i, q in truth.items() if q == 1], [i for i, q in truth.items() if q == 0]
    assert sum(i in left for i in clean) >= 0.99 * len(clean)
    assert sum(i not in left for i in junk) >= 0.9 * len(junk)


def test_lines(kept):
    want = brute_lines(pairs(kept[1]))
    assert sum(a == b for a, b in zip(pairs(kept[2]), want)) >= 0.99 * len(want)


def test_near_copies(kept):
    rows = sorted(set(pairs(kept[2])), key=lambda r: r[0])
    classes = brute_classes([brute_fp(t) for _, t in rows], 4)
    first = {}
    for r, c in zip(rows, classes):
        first.setdefault(c, r)
    assert pairs(kept[3]) == sorted(first.values(), key=str)


def test_contaminated(spark, small, kept):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute_hits(pairs(kept[3]), items, 10) if r[2]}
    assert pairs(kept[4]) == [r for r in pairs(kept[3]) if r[0] not in hit]


def mixed_well(rows):
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    for source in {r.source for r in rows}:
        mine = [r for r in rows if r.source == source]
        assert abs(sum(r.size for r in mine) - mine[0].target) <= max(3, 0.02 * mine[0].target)
        assert all(1 <= r.copy <= r.copies <= 2 for r in mine)


def test_mix(kept):
    rows = kept[5].collect()
    mixed_well(rows)
    assert {(r.doc_id, r.text) for r in rows} < set(pairs(kept[4]))


def test_run_returns_the_mix(spark, small, monkeypatch):
    monkeypatch.setattr(cp, "STAGES", [("mixing", cp.mix_sources)])
    rows = cp.run(spark, small).collect()
    mixed_well(rows)
    assert len({r.doc_id for r in rows}) < spark.read.parquet(f"{small}/documents.parquet").count()


def test_shared_ids_in_a_class(spark, small):
    rows = spark.createDataFrame([(3, "One two"), (3, "one TWO"), (None, "ONE two"), (4, "quite another text")], "doc_id bigint, text string")
    got = cp.drop_near_copies(spark, rows, small).collect()
    assert sorted(r.doc_id for r in got) == [3, 4]


def test_empty_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = staged(stage(spark, docs, small), name)
        assert docs.collect() == []
