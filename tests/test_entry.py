import os
import subprocess
import sys

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    got = entry.entry(spark)
    assert got.columns == ["i", "j", "v"] and got.count() == 64


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"sketch_y_n1", "parse_sketch_log", "gram_rbf"} <= set(entry.queries())


def test_works_without_the_optional_subpackage():
    code = (
        "import sys; sys.modules['matweft.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as e; assert 'sketch_y_n1' in e.queries() and not any(q.startswith('op') for q in e.queries()); e.oracle_sql()"
    )
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True)
