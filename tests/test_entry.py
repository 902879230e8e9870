import os
import shutil
import subprocess
import sys

import pytest

from conftest import ROOT
from layerkeep.plans import catalog

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_its_sql(spark, sf_dir, same_rows, name):
    same_rows(catalog.queries()[name](spark, sf_dir), SQL[name])


def test_entry_returns_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_entry_without_the_optional_parts(tmp_path):
    """The entry module imports and keeps the other queries when the subpackage and the pipeline are gone."""
    shutil.copytree(ROOT / "layerkeep", tmp_path / "layerkeep", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'overlay_visible' in q and not any(k.startswith('op') and k[2].isdigit() or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, timeout=120)
