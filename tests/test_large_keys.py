"""Queries of the catalogue on keys of larger tables, against their SQL."""

import duckdb
import pytest

from lexigrove import queries, queries_catalogue  # noqa: F401

KEYS = {
    "label_structure": [*range(1, 40), *range(29_990, 30_030), *range(300_000, 300_040), *range(1_200_000, 1_200_030)],
    "catalogue_views": [*range(1, 30), *range(1_000_001, 1_000_030), *range(12_000_001, 12_000_030)],
    "catalogue_statistics": [*range(1, 30), *range(1_000_001, 1_000_030), *range(2_000_001, 2_000_015)],
}


@pytest.mark.parametrize("name", KEYS)
def test_keys_beyond_the_codes_digits(spark, tmp_path, name):
    rows = [(k, f"name {k % 7}", f"Brand#{k % 3}", f"KIND{k % 2} PLAIN", k % 5 + 1) for k in KEYS[name]]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
        want = db.execute(queries.ORACLE[name])
        names, want = [c[0] for c in want.description], want.fetchall()
    got = queries.QUERIES[name](spark, str(tmp_path))
    shown = lambda found: sorted(repr(tuple(r)) for r in found)
    assert shown(got.select(*names).collect()) == shown(want)
