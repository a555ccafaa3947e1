"""Workers need not have the package: what is broadcast unpickles without it, what is shipped travels by value."""

import pickle

import numpy as np
import pytest
from pyspark import SparkContext

from reportmill.llm import clusters, encoding, leakage, mixing, neardup, neighbors, places
from reportmill.llm.clusters import ClusterParams
from reportmill.llm.neighbors import NeighborParams
from reportmill.llm.tree import TreeParams


@pytest.fixture
def plain_broadcasts(monkeypatch):
    seen, real = [], SparkContext.broadcast

    def checked(self, value):
        data = pickle.dumps(value)
        assert b"reportmill" not in data
        seen.append(len(data))
        return real(self, value)

    monkeypatch.setattr(SparkContext, "broadcast", checked)
    yield seen
    assert seen


def test_broadcasts_are_plain(spark, plain_broadcasts):
    x = np.random.default_rng(1).standard_normal((60, 8))
    vectors = spark.createDataFrame([(f"s{k:02d}", v.tolist()) for k, v in enumerate(x)], "source_id string, embedding array<float>")
    p = TreeParams(leaf_rows=10)
    assert neighbors.neighbors(vectors, NeighborParams(tree=p)).count() == 300
    clusters.clusters(vectors, ClusterParams(tree=p)).collect()
    texts = spark.createDataFrame([(k, f"s{k}", f"el niño vio la montaña número {k % 7} otra vez y la luz", "a") for k in range(20)], "doc_id long, source_id string, text string, source string")
    encoding.garbled(texts).collect()
    neardup.near_pairs(texts, neardup.LOOSE, "source_id", "text")[0].collect()
    leakage.leaks(texts, texts.selectExpr("doc_id AS item_id", "text").limit(3)).collect()
    mixing.mix(texts, spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int"))[0].collect()
    reports = spark.createDataFrame([(1, "Austn", "TX"), (2, "Dalas", "TX")], "row_id long, city string, state string")
    gazetteer = spark.createDataFrame([(1, "TX", "Austin"), (2, "TX", "Dallas")], "place_id long, usps string, name string")
    got = places.matched(reports, gazetteer, spark.createDataFrame([("TX", "Texas")], "state string, state_name string")).collect()
    assert {tuple(r) for r in got} == {(1, 1), (2, 2)}
