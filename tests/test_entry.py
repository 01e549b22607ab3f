import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_the_rest_works_without_the_subpackage(tmp_path):
    """Without the folders of llm and its pipeline the entry still imports and lists the other queries."""
    shutil.copytree(os.path.join(ROOT, "siltstone"), tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for keep in (["corpus_pipeline.py"], []):
        for name in ["__spark_entry__.py", *keep]:
            if os.path.exists(os.path.join(ROOT, name)):
                shutil.copy(os.path.join(ROOT, name), tmp_path)
        code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q) and not any(k.startswith('op') or k == 'pipeline' for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
