"""Python steps work from any working directory, without PYTHONPATH."""

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from tunelake.session import build_session
from tunelake.functions.lcs import lcs_length
spark = build_session("local[1]", 1, extra={{"spark.checkpoint.dir": {ckpt!r}}})
df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"])], "x array<string>, y array<string>")
print("LCS", df.select(lcs_length("x", "y").alias("n")).first()["n"])
spark.stop()
"""


def test_python_query_from_another_folder():
    cwd = tempfile.mkdtemp(prefix="tl-cwd-")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = SCRIPT.format(root=ROOT, ckpt=tempfile.mkdtemp(prefix="tl-ckpt-"))
    out = subprocess.run([sys.executable, "-c", code], cwd=cwd, env=env, capture_output=True, text=True, timeout=300)
    assert "LCS 2" in out.stdout, out.stderr[-2000:]
