"""The registry: every query runs and equals its SQL on the smallest tables."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.queries import QUERIES, SQL

DATA = Path("/root/testdata/sf0.001")
HEAVY = {"adversarial_catch_rates", "briefs", "claim_verification", "greedy_claims", "nb_tfidf_report"}


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return v if v is None or isinstance(v, (int, bool, str)) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(set(SQL) - HEAVY))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got = QUERIES[name](spark, str(DATA))
    columns = sorted(got.columns)
    rows = Counter(tuple(_plain(r[c]) for c in columns) for r in got.collect())
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == Counter(tuple(_plain(r[i]) for i in place) for r in cur.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", ["audit_sheet", "bootstrap_interval", "mention_rows", "normalized_documents", "pair_scores", "section_extract", "segment_sentences"])
def test_query_without_sql_gives_rows(spark, name):
    got = QUERIES[name](spark, str(DATA))
    assert got.count() > 0 and len(set(got.columns)) == len(got.columns)


def test_the_rest_imports_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'aspect_summary' in q and 'pipeline' not in q and not [x for x in q if x.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
