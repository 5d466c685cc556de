import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def brute_force(queries, candidates, k, metric="euclidean"):
    """{qid: [(nid, dist)]} from lists of (key, point), straight from the contract."""
    import numpy as np

    out = {}
    for qid, x in queries:
        x = np.asarray(x, float)
        found = []
        for nid, y in candidates:
            total = 0.0
            with np.errstate(invalid="ignore", over="ignore"):
                for a, b in zip(x, np.asarray(y, float)):
                    total += abs(a - b) if metric == "manhattan" else (a - b) * (a - b)
                dist = np.float32(total if metric == "manhattan" else np.sqrt(total))
            if dist > 0:
                found.append((dist, nid))
        if found:
            out[qid] = [(nid, float(dist)) for dist, nid in sorted(found)[:k]]
    return out
