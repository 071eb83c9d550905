"""Condensed physical plans as they would run at scale: automatic broadcasts
off (dimension-sized tables too big to broadcast), so every join and
aggregate shows its shuffle. Usage: python tools/scale_plans.py name [name ...]"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from waterbook import catalog  # noqa: E402
from waterbook.session import build_session  # noqa: E402

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.1")
OPS = re.compile(
    r"^[ :|+-]*(Union|HashAggregate\(keys=\[[^\]]*\]|SortAggregate\(key=\[[^\]]*\]|SortMergeJoin[^\n]*"
    r"|BroadcastHashJoin[^,]*, [^,]*, [A-Za-z]*|ShuffledHashJoin[^\n]*|Exchange [a-z]+(\([^)]*\))?"
    r"|FileScan parquet [^\[]*|Expand|Generate [a-z_]*|WindowGroupLimit[^\n]*|Window \[|FlatMapGroupsInPandas)"
)

spark = build_session("scale-plans", master="local[8]", shuffle_partitions=8,
                      extra_conf={"spark.sql.autoBroadcastJoinThreshold": "-1"})
spark.sparkContext.setLogLevel("ERROR")
for name in sys.argv[1:] or list(catalog.QUERIES):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    print(f"===== {name}  exchanges={plan.count('Exchange ')} scans={plan.count('FileScan')}")
    for line in plan.splitlines():
        m = OPS.match(line)
        if m:
            depth = (len(line) - len(line.lstrip(" :|+-"))) // 2
            print(" " * depth + m.group(1)[:120])
spark.stop()
