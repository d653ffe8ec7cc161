"""The two-core query over the whole graph against plain peeling."""

from __future__ import annotations

import os
from collections import Counter

import pytest

from ridgeflow import registry
from ridgeflow.plans.network import graph

DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_whole_two_core_is_plain_peeling(spark):
    edges = [tuple(r) for r in graph(spark, DATA).collect()]
    assert len({e for e, _, _ in edges}) == spark.read.parquet(f"{DATA}/part.parquet").count()
    left = edges
    while True:
        degree = Counter(v for _, a, b in left for v in (a, b))
        fewer = [(e, a, b) for e, a, b in left if degree[a] > 1 and degree[b] > 1]
        if len(fewer) == len(left):
            break
        left = fewer
    got = [r.e for r in registry.queries()["h7_two_core"](spark, DATA).collect()]
    assert sorted(got) == sorted(e for e, _, _ in left)
    assert any(e % 3 for e in got)
