import pytest
from odd_texts import TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    """Documents of every odd kind, with extra columns whose names clash with results."""
    rows = [(i, t, "en", f"s{k % 3}" if k != 4 else None, len(t or ""), 0.5, k, "x") for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, start long, node string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")
