"""The stated seed against its SQL where vectors have more ids than the smallest tables."""

import duckdb

from meridian.plans import registry
from same import duck_rows, spark_rows


def test_a_reader_without_terms_has_no_seed_however_many_vectors_there_are(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT range AS doc_id FROM range(9100)")
    con.execute("CREATE TABLE embeddings AS SELECT range AS vec_id, list_transform(range(1, 65), lambda i: ((range * 7 + i * 13) % 32 / 16)::FLOAT) AS embedding FROM range(9100)")
    for t in ("documents", "embeddings"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    got = spark_rows(registry.queries()["P8_stated_seed"](spark, str(tmp_path)))
    assert len(got[1]) == 11 and got == duck_rows(con, registry.oracle()["P8_stated_seed"])
