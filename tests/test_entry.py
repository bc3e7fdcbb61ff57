import subprocess
import sys
from pathlib import Path

import __spark_entry__


def test_entry_and_registry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "avg_points" in df.columns
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)


def test_other_queries_stay_without_the_optional_subpackage():
    code = "import sys; sys.modules['courtside.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not [n for n in q if n.startswith('op') or n == 'pipeline'], sorted(q)"
    run = subprocess.run([sys.executable, "-W", "error::SyntaxWarning", "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert "left out" in run.stderr
