"""Bursts, windows and vectors against plain Python."""

import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from reportmill.operators import crossref, flaps, samenight, vectors, vocab
from reportmill.operators.components import components
from reportmill.params import Params

REP = "source_id string, state string, event_date date, city string, shape_norm string"


def test_islands_equal_a_fold(spark):
    rng = random.Random(4)
    rows = []
    for s in ("A", "B", "C"):
        start = date(2000, 1, 3)
        for k in range(30):
            start += timedelta(days=7 * rng.choice([1, 1, 2, 3, 4, 9]))
            rows.append((s, start, start + timedelta(days=6), rng.randrange(3, 9), round(rng.random(), 2), round(3 + rng.random() * 9, 1)))
    df = spark.createDataFrame(rows, "state string, week_start date, week_end date, reports long, baseline_weekly double, ratio double")
    want = []
    for r in sorted(rows):
        if want and want[-1][0] == r[0] and r[1] <= want[-1][2] + timedelta(days=14):
            w = want[-1]
            want[-1] = (w[0], w[1], max(w[2], r[2]), w[3] + r[3], max(w[4], r[5]), w[5])
        else:
            want.append((r[0], r[1], r[2], r[3], r[5], r[4]))
    got = flaps.islands(df, Params()).select("state", "start", "end", "flagged_reports", "peak_ratio", "baseline_weekly").collect()
    assert sorted(map(tuple, got)) == sorted(w for w in want if w[3] >= 8)


def test_burst_uses_the_year_the_week_ends_in(spark):
    rows = [(f"a{k}", "WA", date(2001, 12, 31), "c", "light") for k in range(5)] + [(f"b{k}", "WA", date(2002, 1, 1) + timedelta(days=k * 11), "c", "x") for k in range(30)]
    got = flaps.bursts(spark.createDataFrame(rows, REP), Params(flap_floor=0.1)).collect()
    assert [(r.week_start, r.reports, r.baseline_weekly) for r in got] == [(date(2001, 12, 31), 6, round(30 / 52, 2))]


def test_half_life(spark):
    d = date(2000, 1, 3)
    days = [0] * 3 + [1] * 8 + [2] * 5 + [4] * 4
    rows = [(f"r{k}", "WA", d + timedelta(days=x), "c", "x") for k, x in enumerate(days)] + [("z", "OR", d, "c", "x"), ("y", "OR", d + timedelta(days=1), "c", "x"), ("n", None, d, None, None)]
    found = spark.createDataFrame([("WA", d, d + timedelta(days=6)), ("OR", d, d + timedelta(days=6))], "state string, start date, end date")
    got = {r.state: (r.peak_date, r.half_life_days) for r in flaps.half_life(spark.createDataFrame(rows, REP), found).collect()}
    assert got == {"WA": (d + timedelta(days=1), 3), "OR": (d, None)}


def test_flaps_of_an_empty_table(spark):
    rows = spark.createDataFrame([], REP)
    assert flaps.catalog(rows).count() == 0 and flaps.weekly_filled(rows).count() == 0


def test_concurrent_flaps(spark):
    d = date(2000, 1, 3)
    f = spark.createDataFrame([("A", d, d + timedelta(days=40)), ("B", d + timedelta(days=35), d + timedelta(days=60)), ("C", d + timedelta(days=90), d + timedelta(days=99)), ("A", d + timedelta(days=50), d + timedelta(days=56))], "state string, start date, end date")
    got = sorted((r.state, r.start, r.concurrent_states) for r in flaps.concurrent(f).collect())
    assert [x[2] for x in got] == [["B"], ["B"], ["A"], []]


def _cluster_brute(dist, threshold):
    groups = [[i] for i in range(len(dist))]
    while len(groups) > 1:
        d, i, j = min((np.mean([dist[a, b] for a in x for b in y]), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if d >= threshold:
            break
        groups[i] += groups.pop(j)
    return sorted(sorted(g) for g in groups)


def test_average_linkage_equals_brute_force():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 8, 15, 24):
        centre = rng.standard_normal((4, 6))
        x = centre[rng.integers(0, 4, n)] + 0.5 * rng.standard_normal((n, 6))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        dist = 1 - x @ x.T
        label = samenight.average_linkage(dist, 0.35)
        assert sorted(np.flatnonzero(label == v).tolist() for v in np.unique(label)) == _cluster_brute(dist, 0.35)


def test_night_members_and_score(spark):
    d = date(2000, 1, 1)
    rep = [(f"s{k}", d, "TX" if k % 2 else "OK", f"c{k}", "light", "word " * 60) for k in range(4)] + [("x", d, "TX", "c", "y", "n"), ("null", None, None, None, None, None)]
    emb = [(f"s{k}", [1.0, 0.01 * k]) for k in range(4)] + [("s0", [1.0, 0.0]), ("x", [0.0, 1.0]), ("z", None), ("s9", [0.0, 0.0])]
    reports = spark.createDataFrame(rep, "source_id string, event_date date, state string, city string, shape_norm string, narrative string")
    embeddings = spark.createDataFrame(emb, "source_id string, embedding array<float>")
    got = samenight.members(reports, embeddings)
    assert sorted((r.cluster_key, r.source_id) for r in got.collect()) == [("s0", f"s{k}") for k in range(4)]
    row = samenight.scored(got, reports, embeddings).first()
    assert (row.n_reports, row.n_states, row.states, row.top_shape, row.cluster_id) == (4, 2, "OK, TX", "light", 0)
    assert row.representative_narrative.endswith("...") and abs(row.score - (0.3 * 0.4 + 0.3 * 0.4 + 0.4 * row.mean_cosine_sim)) < 1e-3


def test_coherence_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((20, 5))
    rows = [(f"k{i}", "g" if i < 19 else "h", x[i].tolist()) for i in range(20)]
    df = spark.createDataFrame(rows, "source_id string, g string, embedding array<double>")
    unit = vectors.units(df).join(df.select("source_id", "g"), "source_id")
    got = {r.g: r.coherence for r in vectors.coherence(unit, ["g"]).collect()}
    u = x[:19] / np.linalg.norm(x[:19], axis=1, keepdims=True)
    assert abs(got["g"] - (u @ u.T)[np.triu_indices(19, 1)].mean()) < 1e-9 and got["h"] == 1.0


def test_windows_of_records(spark):
    d = date(2000, 1, 10)
    rec = spark.createDataFrame([(1, d, "TX"), (2, None, "TX"), (3, d, "OK")], "record_id long, incident_date date, state string")
    rep = spark.createDataFrame([("a", "TX", d - timedelta(days=7), "c", "x"), ("b", "TX", d + timedelta(days=8), "c", "y"), ("c", "TX", d, "c", ""), ("d", "OR", d + timedelta(days=1), "c", "z"), ("e", None, d, None, None)], REP)
    assert [(r.record_id, r.n_reports, r.shapes) for r in crossref.same_state(rec, rep).collect()] == [(1, 2, "x")]
    assert sorted((r.record_id, r.n_reports, r.n_states) for r in crossref.any_state(rec, rep).collect()) == [(1, 3, 2), (3, 3, 2)]


def test_incident_fields(spark):
    names = [("virginia", "VA"), ("west virginia", "WV"), ("texas", "TX"), ("indiana", "IN"), ("oregon", "OR")]
    want = [
        ("6/1/47", date(1947, 6, 1), "Roswell, TX", "Roswell", "TX"), ("N/A", None, "somewhere in West Virginia", "Somewhere In West", "VA"), ("7/4/26", date(2026, 7, 4), "near TX line", "", ""),
        ("12/30/1947", date(1947, 12, 30), "Man in a field", "", ""), ("1947-12-30", date(1947, 12, 30), "Kabul, Afghanistan, or nearby", "", ""), ("March 5, 2019", date(2019, 3, 5), "Syria, in the desert", "", ""),
        ("2019-03-05 10:20:30", date(2019, 3, 5), "o'hare, texas", "O'Hare", "TX"), ("13/45/99", None, "Austin, TX, USA", "Austin, USA", "TX"), ("", None, "camp TX", "camp", "TX"), (None, None, None, "", ""),
        ("soon", None, "Springfield, or", "", ""),
    ]
    df = spark.createDataFrame([(k, r[0], r[2]) for k, r in enumerate(want)], "k int, d string, l string")
    got = df.select("k", crossref.incident_date(F.col("d")), *crossref.incident_place(F.col("l"), names), crossref.incident_state(F.col("l"), names)).orderBy("k").collect()
    assert [tuple(r)[1:4] for r in got] == [(r[1], r[3], r[4]) for r in want]
    assert [r[4] for r in got] == [r[4] or None for r in want]


def test_vocabulary_merges_add_rates(spark):
    rows = [(2001, "a tic tac and a triangle"), (2004, "triangular"), (2011, "nothing"), (1930, "triangle"), (2003, None), (None, "triangle")]
    r = vocab.rates(spark.createDataFrame(rows, "event_year int, narrative string"))
    got = {(x.time_bin, x.term): x.rate_per_1k for x in vocab.merged(r).collect()}
    assert got[2000, "tic-tac"] == 1000.0 and got[2000, "triangle/triangular"] == 1000.0 and got[2010, "tic-tac"] == 0.0
    assert {x.term: x.peak_bin for x in vocab.peaks(vocab.merged(r)).collect()} == {"tic-tac": 2000, "triangle/triangular": 2000}


def test_needed_literals():
    cases = {r"\bsaucer\b": "saucer", r"\bdi(?:sc|sk)\b": "di", r"a|bc": "", r"(?i)orb": "", r"\bv[- ]?shape": "shape", r"ab?cd": "cd", r"(": ""}
    got = {p: vocab.needed(p) for p in cases}
    assert got.pop(r"\bdi(?:sc|sk)\b") in ("di", "dis") and got == {k: v for k, v in cases.items() if not k.startswith(r"\bdi")}


def test_busy_dates_are_split_without_change(spark, monkeypatch):
    rng = np.random.default_rng(12)
    centers = rng.standard_normal((12, 8))
    x = np.concatenate([c / np.linalg.norm(c) + 0.25 * rng.standard_normal((12, 8)) for c in centers] + [rng.standard_normal((30, 8))])
    rows = [(f"s{k:03d}", "2001-02-03" if k % 5 else "2002-03-04", v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "source_id string, d string, embedding array<float>").repartition(4).withColumn("event_date", F.to_date("d"))
    whole = {tuple(r) for r in samenight.members(df, df.select("source_id", "embedding")).collect()}
    monkeypatch.setattr(samenight, "BLOCK_ROWS", 20)
    assert {tuple(r) for r in samenight.members(df, df.select("source_id", "embedding")).collect()} == whole and len(whole) > 60


def test_components_of_chains_and_hubs(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3)]
    got = components(spark.createDataFrame(edges, "a int, b int")).toPandas()
    assert got.node.is_unique and {k: set(g) for k, g in got.groupby("label").node} == {0: set(range(41)), 100: set(range(100, 130))}


def test_stored_vectors_scale_to_the_same_units(spark):
    x = np.random.default_rng(5).standard_normal((40, 384)).astype(np.float32) * 3
    rows = [(f"s{k:02d}", v.tolist()) for k, v in enumerate(x)]
    rows += [rows[0], ("zero", [0.0, 0.0]), ("hole", [1.0, None]), ("none", None), ("empty", []), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "source_id string, embedding array<float>").repartition(3)
    stored = vectors.directed(df)
    assert dict(stored.dtypes)["embedding"] == "array<float>"
    stored, unit = sorted(stored.collect()), dict(vectors.units(df).collect())
    got = vectors.scaled(np.array([v for _, v in stored], np.float32))
    assert {k: u.tolist() for (k, _), u in zip(stored, got, strict=True)} == unit and len(unit) == len(stored) == 40
