"""Python workers get the functions of the package, not its name."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from __spark_entry__ import queries
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
for name in ("salvaged_json", "avro_fields", "event_properties", "value_spread_per_user", "word_count_rdd"):
    assert queries()[name](spark, sys.argv[2]).count() > 0, name
print("all there")
"""


def test_queries_run_from_another_folder(tmp_path, sf_dir):
    """The package is on the path of this process only, as on a cluster without a shipped copy."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, REPO, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "all there" in done.stdout, done.stderr[-3000:]
