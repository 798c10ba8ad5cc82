"""Time registered queries twice in one session (first run warms the JVM).

    python tools/timing.py table_folder name [name ...]
"""

from __future__ import annotations

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from quire.plans import REGISTRY  # noqa: E402
from quire.session import build_session  # noqa: E402

if __name__ == "__main__":
    spark = build_session(
        master="local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in sys.argv[2:]:
        spent = []
        for _ in range(2):
            began = time.time()
            REGISTRY[name].run(spark, sys.argv[1]).write.format("noop").mode("overwrite").save()
            spent.append(f"{time.time() - began:.1f}s")
        print("time", name, *spent, flush=True)
