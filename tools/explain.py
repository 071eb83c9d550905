"""Print the formatted physical plan of registered queries (after running
them once so AQE shows its final plan). Usage: python tools/explain.py name [sf_dir]"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from waterbook import catalog  # noqa: E402
from waterbook.session import build_session  # noqa: E402

name = sys.argv[1]
sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
mode = os.environ.get("MODE", "formatted")
spark = build_session("explain", master="local[8]", shuffle_partitions=8)
spark.sparkContext.setLogLevel("ERROR")
df = catalog.QUERIES[name](spark, sf_dir)
df.collect()  # same QueryExecution, so explain shows the final adaptive plan
df.explain(mode)
spark.stop()
