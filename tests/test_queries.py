"""Every registered query of the engine beside its SQL, on the smallest tables."""

import os

import pytest
from compare import differ

from lectern.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(name, spark, sf):
    assert differ(QUERIES[name], ORACLES[name], spark, sf) is None


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entries_import_without_a_session():
    import subprocess
    import sys

    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], capture_output=True, text=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert said.stdout.strip() == "True", said.stderr


def test_sentences(spark, sf):
    import re

    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["sentences"](spark, sf).collect():
        assert r["n"] == len([s for s in re.split(r"(?<=[.!?。])[ \t\n\r\f\v]+|\n+", texts[r["doc_id"]]) if s])


def test_whitespace_map(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["whitespace_map"](spark, sf).collect():
        assert r["n"] == len(" ".join(texts[r["doc_id"]].split()))
