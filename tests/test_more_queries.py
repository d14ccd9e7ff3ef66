"""The queries of the further catalogues against their SQL forms on the smallest tables."""

import re
from pathlib import Path

import pytest
from test_catalog import DATA, db, rows  # noqa: F401 - the fixture

from papyrion.plans import catalog, stores, texts

NAMES = sorted(name for module in (stores, texts) for name in re.findall(r"^def (\w+)\(spark, folder\)", Path(module.__file__).read_text(), re.M) if not name.startswith("_"))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):  # noqa: F811
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_oracles_are_sql_text():
    assert all(isinstance(sql, str) for sql in catalog.ORACLES.values()) and set(NAMES) <= set(catalog.ORACLES)
