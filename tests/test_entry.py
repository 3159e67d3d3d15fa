import subprocess
import sys


def test_entry_names_and_sql():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p4_found", "p5_found"} <= set(q) and len(q) > 140


def test_core_does_not_import_llm():
    code = "import sys; import folioscope.plans.catalogue; assert not [m for m in sys.modules if m.startswith('folioscope.llm')]"
    assert subprocess.run([sys.executable, "-c", code], check=False).returncode == 0
