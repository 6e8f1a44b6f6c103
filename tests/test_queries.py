"""Every registered query against its SQL, and the driver contract."""

import subprocess
import sys

import pytest

from secspark.plans import registry

from .oracle import check

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_sql(spark, name):
    check(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["src_ip", "count"] and 0 < df.count() <= 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_the_subpackage(tmp_path):
    """As the driver does it: both folders and the pipeline are gone."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "secspark", tmp_path / "secspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'slice1_top_failed_sources' in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path), "HOME": str(tmp_path)})
