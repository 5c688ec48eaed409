"""The entry without its optional part."""

import subprocess
import sys
from pathlib import Path

TOP = Path(__file__).resolve().parents[1]
CODE = """
import sys
{spoil}
import __spark_entry__ as entry
found, sql = entry.queries(), entry.oracle_sql()
assert set(sql) <= set(found) and len(found) > 60
print(sorted(k for k in found if k.startswith("op") or k == "pipeline"))
"""


def listed(spoil):
    done = subprocess.run([sys.executable, "-c", CODE.format(spoil=spoil)], cwd=TOP, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.strip().splitlines()[-1]


def test_core_queries_stay_where_the_optional_part_is_gone_or_broken():
    assert listed("sys.modules['regex'] = None") == "[]"
    assert listed("sys.modules['quire.llm'] = None") == "[]"
    assert listed("sys.modules['corpus_pipeline'] = None") == "[]"
