"""Encoders and density clusters against plain definitions."""

import numpy as np
from pyspark.sql import functions as F

from reportmill.functions import text
from reportmill.operators import density, encode

TEXTS = ["A bright light over the lake", "a bright light over THE lake", None, "", "12 34", "Something else entirely & more", "x " * 50_000 + "end word"]


def test_default_vectors_are_deterministic_and_of_length_one(spark):
    df = spark.createDataFrame([(f"s{k}", t, "c") for k, t in enumerate(TEXTS)] + [(None, "text", "c")], "source_id string, narrative string, embedding string")
    got = {r.source_id: np.array(r.embedding) for r in encode.encoded(df, dim=64).collect()}
    again = {r.source_id: np.array(r.embedding) for r in encode.encoded(df.repartition(3), dim=64).collect()}
    assert set(got) == {f"s{k}" for k in range(7)} and all((got[k] == again[k]).all() and len(got[k]) == 64 for k in got)
    assert (got["s0"] == got["s1"]).all() and got["s0"] @ got["s5"] < 0.9
    assert [round(float(np.linalg.norm(got[f"s{k}"])), 5) for k in range(7)] == [1, 1, 0, 0, 0, 1, 1]
    cut = {r.source_id: np.array(r.embedding) for r in encode.encoded(df, dim=64, max_chars=10).collect()}
    assert (cut["s5"] != got["s5"]).any()
    assert encode.encoded(df.limit(0)).count() == 0


def test_any_encoder_can_be_plugged_in(spark):
    def lengths():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["ab", None, "abcd"])], "id long, t string")
    got = {r.id: list(r.embedding) for r in encode.encoded(df, "id", "t", 2, lengths, batch=2).collect()}
    assert np.allclose(got[0], np.array([2, 1]) / 5**0.5) and got[1] == [0, 0] and np.allclose(got[2], np.array([4, 1]) / 17**0.5)


def test_only_missing_rows_are_encoded(spark):
    cache = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None)], "source_id string, embedding array<float>")
    df = spark.createDataFrame([("a", "new text"), ("b", "text"), ("c", "more text"), ("c", "more text")], "source_id string, narrative string")
    got = {r.source_id: r.embedding for r in encode.refreshed(cache, df, dim=2).collect()}
    assert got["a"] == [1.0, 0.0] and set(got) == {"a", "b", "c"} and got["b"] is not None


def test_spanning_tree_is_minimal_under_mutual_reachability():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 4))
    a, b, w, core = density.spanning_tree(x, 5)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.allclose(core, np.sort(d, axis=1)[:, 5])
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    # Kruskal
    parent, total = list(range(60)), 0.0
    find = lambda v: v if parent[v] == v else find(parent[v])
    for i, j in sorted(((i, j) for i in range(60) for j in range(i)), key=lambda e: reach[e]):
        if find(i) != find(j):
            parent[find(i)] = find(j)
            total += reach[i, j]
    assert np.isclose(w.sum(), total) and len(set(map(find, range(60)))) == 1


def groups(rng):
    out = []
    for size in (60, 40, 25):
        c = rng.standard_normal(16)
        out.append(c / np.linalg.norm(c) + 0.05 * rng.standard_normal((size, 16)))
    return np.concatenate([*out, rng.standard_normal((30, 16))])


def test_dense_groups_and_noise(spark):
    x = groups(np.random.default_rng(5))
    rows = [(f"s{k:03d}", v.tolist(), 7) for k, v in enumerate(x)] + [("s000", x[0].tolist(), 7), ("n1", None, 7), ("n2", [0.0] * 16, 7)]
    df = spark.createDataFrame(rows, "source_id string, embedding array<float>, archetype int")
    got = {r.source_id: r.archetype for r in density.clustered(df, 15, 5).collect()}
    assert len(got) == len(x)
    for label, at in ((0, range(60)), (1, range(60, 100)), (2, range(100, 125))):
        assert np.mean([got[f"s{k:03d}"] == label for k in at]) > 0.95
    assert np.mean([got[f"s{k:03d}"] == -1 for k in range(125, 155)]) > 0.9
    part = {r.source_id: r.archetype for r in density.clustered(df, 15, 5, fit_rows=100).collect()}
    assert np.mean([part[k] == got[k] for k in got]) > 0.9 and len(part) == len(got)
    assert density.clustered(df.limit(0)).count() == 0 and {r.archetype for r in density.clustered(df.limit(5), 15, 5).collect()} == {-1}


def test_small_text_functions(spark):
    df = spark.createDataFrame([("o'hare 2nd-street", 'say {"a": {"b": 1}} ok'), (None, None), ("", "no {json}"), ("ÉCOLE", "")], "t string, j string")
    got = df.select(text.title_case(F.col("t")).alias("t"), text.salvaged(F.col("j")).alias("j"), text.highlighted(F.col("t"), "HARE").alias("h")).collect()
    assert [r.t for r in got] == ["O'Hare 2Nd-Street", None, "", "École"] and [r.j for r in got] == ['{"a": {"b": 1}}', None, None, None]
    assert got[0].h == ["o'", "hare", " 2nd-street"]
    a, b = df.limit(1).select(text.cache_key(F.lit(" Ab "), F.lit("c")), text.cache_key(F.lit("aB"), F.lit("c"))).first()
    assert a == b and len(a) == 64
