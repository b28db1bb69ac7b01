"""Every registered query against its SQL, on the smallest of the driver's tables."""

from __future__ import annotations

import os

import check_oracle
import pytest

import __spark_entry__ as spark_entry
from repomine.plans import catalog

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def connection():
    return check_oracle.connect(SF_DIR)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_equals_sql(spark, connection, name):
    _, difference = check_oracle.compare(spark, connection, SF_DIR, name)
    assert difference == ""


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["commit_url", "commit_hash", "author", "date", "message"]
