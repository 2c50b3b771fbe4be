"""Every registered query against its SQL, and those without one for rows."""

import pytest

from meridian.plans import registry
from same import duck_rows, spark_rows

QUERIES, ORACLE = registry.queries(), registry.oracle()


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert spark_rows(df) == duck_rows(duck, ORACLE[name])
        return
    # Operator tests hold these against brute force; here the rows must be there and not hang on how they are dealt out.
    once = spark_rows(df)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        assert once[1] and once == spark_rows(QUERIES[name](spark, sf_dir))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_corpus_operators(tmp_path):
    """The entry module loads where the corpus subpackage and the pipeline are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/meridian", tmp_path / "meridian", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'D7_covisitation' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
