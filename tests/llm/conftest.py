import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture(autouse=True)
def scratch(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("scratch")))


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, ids=None, partitions=2):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", "src", len(t or "")) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, DOC_SCHEMA).repartition(partitions)
