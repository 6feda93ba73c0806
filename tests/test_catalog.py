"""Every query that SQL can express, against DuckDB on the same tables."""

import re
from pathlib import Path

import duckdb
import pytest

from trailmark.plans import audit_plans, catalog, study_plans, trace_plans  # noqa: F401  (they add their queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def norm(x):
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    return None if x != x else round(float(x), 3)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted((tuple(norm(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = catalog.QUERIES[name](spark, sf_dir).toArrow().to_pandas(integer_object_nulls=True)
    want = duck.sql(catalog.SQL[name]).arrow()
    want = (want.read_all() if hasattr(want, "read_all") else want).to_pandas(integer_object_nulls=True)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("method", ["T20", "N13", "Z30", "S7"])
def test_no_query_claims_what_is_not_covered(method):
    readme = (Path(__file__).parent.parent / "README.md").read_text()
    listed = readme[readme.index("Not covered yet") : readme.index("## Training-data operators")]
    assert re.search(rf"\b{method}\b", listed)
    assert not [n for n, q in catalog.QUERIES.items() if re.search(rf"\b{method}\b", q.__doc__ or "")]
