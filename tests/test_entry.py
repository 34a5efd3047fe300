import os
import subprocess
import sys

import __spark_entry__ as entry


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80
    assert all("SELECT" in s for s in sql.values())


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["row_id", "degree"] and rows.count() > 0


def test_without_a_dependency_of_the_training_data_operators():
    """The other queries are there although an import of the subpackage fails."""
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), set(e.oracle_sql()) <= set(q))"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, check=True).stdout.split()
    assert int(out[0]) > 80 and out[1:] == ["False", "True"]
