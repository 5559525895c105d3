import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


def test_names_and_oracles():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 70


def test_nothing_else_imports_the_corpus_operators():
    for path in (ROOT / "labeldates").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text("utf-8"), path


def test_imports_without_the_corpus_operators(tmp_path):
    import shutil

    shutil.copytree(ROOT / "labeldates", tmp_path / "labeldates", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert int(said.stdout.split()[0]) > 60


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
@pytest.mark.parametrize("name", ["q_k5_made_and_expiry", "q_f3_best_stage", "q_e7_by_group", "q_q_row_rules", "q_g5_suppressed", "q_g9_crop_size", "q_e11_sign_test", "q_s13_appended"])
def test_query_equals_its_sql(spark, name):
    import __spark_entry__ as entry
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = entry.queries()[name](spark, str(DATA)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns

    def rows(frame):
        shown = lambda v: "" if v is None or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
        return sorted(tuple(map(shown, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))

    assert rows(got) == rows(want)
