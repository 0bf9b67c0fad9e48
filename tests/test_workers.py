import os
import subprocess
import sys

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from fieldscope.functions.text import strip_html
from fieldscope.operators.external import score_with
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
batches = spark.createDataFrame([(0, "[1]")], "batch_id long, request string")
replies = score_with(batches, lambda system, user: "[]").first()
from fieldscope.operators import termtable
from fieldscope.sources.landed import json_lines, read_landed
import os
os.mkdir("landed")
open("landed/1.json", "w").write('{{"a": "x"}}')
texts = spark.createDataFrame([("1", "a b")], "id string, text string")
print("MORE", read_landed(spark, os.path.abspath("landed"), json_lines, "a string").first()["a"],
      termtable.topic_matches(texts, spark.createDataFrame([("b a",)], "query string")).first()["query"])
print("OUT", replies["text"], batches.select(strip_html(F.lit("caf&eacute;")).alias("t")).first()["t"].encode("unicode_escape").decode())
"""


def test_workers_need_no_copy_of_the_package(tmp_path):
    """Run from a folder the package cannot be imported from."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and p != repo)
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=repo)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "OUT [] caf\\xe9" in done.stdout, done.stderr[-2000:]
    assert "MORE x b a" in done.stdout, done.stderr[-2000:]
