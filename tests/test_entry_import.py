"""``__spark_entry__`` must import without a session, a JVM or Spark's jar folder."""

import glob
import os
import subprocess
import sys

import pyspark

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_imports_from_the_zipped_pyspark():
    home = os.path.dirname(pyspark.__file__)
    zips = sorted(glob.glob(os.path.join(home, "python", "lib", "*.zip")))
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([*zips, ROOT])}
    code = ("import __spark_entry__ as e, pyspark; q = e.queries(); s = e.oracle_sql(); "
            "print(pyspark.__file__, len(q), len(s), set(s) <= set(q))")
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd="/", capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    words = out.stdout.split()
    assert words[-1] == "True" and int(words[-3]) >= 41
    if zips:
        assert ".zip" in words[0]
