import duckdb
import pandas as pd
from pyspark.sql import functions as F

from reportmill.operators import archetypes, events, explore, signatures
from reportmill.plans import reports as base
from tests import compare

REP = "source_id string, event_year int, state string, shape_norm string, city string, narrative string, event_date date, narrative_chars int"


def reports(spark):
    rows = [("a", 2000, "TX", "light", "Austin", "A bright LIGHT near the school yard again", None, 10), ("b", 2001, "OK", "disc", "Tulsa", "the school yard at night", None, 20), ("c", None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, REP)


def test_filters_and_ranks(spark):
    r = reports(spark)
    assert [x.source_id for x in explore.filtered(r, 1990, 2010, ["TX"], [], "Light").collect()] == ["a"]
    assert explore.filtered(r, 1990, 2010).count() == 2
    assert [x.source_id for x in explore.searched(r, "TUL", ["city", "narrative"]).collect()] == ["b"]
    assert [(x.state, x["rank"]) for x in explore.ranked(r, "state").orderBy("rank").collect()] == [("OK", 1), ("TX", 2)]
    assert explore.metrics(r).first().n_states == 2 and explore.metrics(r.limit(0)).first().n_reports == 0


def test_sample_is_exact_and_the_same_however_partitioned(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("source_id"))
    a = {r.source_id for r in explore.sampled(df.repartition(7), 50).collect()}
    assert len(a) == 50 and a == {r.source_id for r in explore.sampled(df.coalesce(1), 50).collect()}


def test_router_takes_the_first_stage_that_knows_the_word(spark):
    t = lambda *v: spark.createDataFrame([(x, x) for x in v], "label string, term string")
    stages = [("state", t("TX", None), True), ("shape", t("light", "orb"), True), ("event", t("Phoenix Lights", "Night Lights"), False), ("term", t("orb of light"), False)]
    got = {r.keyword: (r.kind, r.label) for r in explore.routed([" LIGHT", "lights", "orb", "of light", "zzz", " ", "tx"], stages).collect()}
    assert got == {" LIGHT": ("shape", "light"), "lights": ("event", "Night Lights"), "orb": ("shape", "orb"), "of light": ("term", "orb of light"), "tx": ("state", "TX")}


def test_router_knows_years_within_bounds_only(spark):
    t = lambda *v: spark.createDataFrame([(x, x) for x in v], "label string, term string")
    none = t().withColumn("exact", F.lit(True))
    stages = explore.router_stages(t("TX"), t("orb"), none, t("1890", "1999", "2024"), t("Wave"), t("saucer"), t("Wave"))
    got = {r.keyword: r.kind for r in explore.routed(["1999", "1890", "2024", "sauc"], stages).collect()}
    assert got == {"1999": "year", "sauc": "term"}


def test_flatten_follows_any_depth(spark):
    rows = [(1, '{"a": 1, "b": {"c": {"d": "x", "e": [1.5, {"f": true}, null]}}, "g": 2.0}', 9), (2, None, 9), (3, "bad", 9), (4, '["u", [7]]', 9), (5, "3", 9), (6, "{}", 9), (7, "", 9)]
    got = explore.flattened(spark.createDataFrame(rows, "id int, j string, path int"), ["id"], "j").collect()
    assert [(r.path, r.value) for r in got if r.id == 1] == [("a", "1"), ("b.c.d", "x"), ("b.c.e[0]", "1.5"), ("b.c.e[1].f", "true"), ("b.c.e[2]", "null"), ("g", "2")]
    assert [(r.path, r.value) for r in got if r.id == 4] == [("[0]", "u"), ("[1][0]", "7")] and {r.id for r in got} == {1, 4}
    many = spark.createDataFrame([(1, str(list(range(50))))], "id int, j string")
    assert explore.flattened(many, ["id"], "j").count() == 40
    deep = spark.createDataFrame([(1, "[" * 900 + "1" + "]" * 900)], "id int, j string")
    assert explore.flattened(deep, ["id"], "j").first().path == "[0]" * 900


def test_phrases_meet_events_by_name(spark):
    cat = events.catalog(spark, (("Big Wave (1990)", "1990-01-01", "1990-01-02", None, None, ["red light"], "x"), ("Wave of Orbs", "1991-01-01", "1991-01-02", None, None, ["orb", "none"], "x"), ("Quiet Town", "1992-01-01", "1992-01-02", None, None, [], "y")))
    sig = spark.createDataFrame([("Wave of Orbs", "bright ORB here", 0.5), ("Wave of Orbs", "a phrase", 0.7), ("Big Wave (1990)", "red light", 0.2), ("Bigger thing", "x", 0.9)], "event string, phrase string, distinctiveness double")
    got = {r.event: tuple(r)[1:] for r in events.phrases_met(sig, cat).collect()}
    # the first two words name the signature; the catalog's order decides between several
    assert got == {"Big Wave (1990)": (True, 1, "red light", 0.2), "Wave of Orbs": (True, 0, "red light", 0.2), "Quiet Town": (False, 0, "", 0.0)}


def test_verdicts(spark):
    m = spark.createDataFrame([("a", "PASS"), ("a", "MISS"), ("b", "PARTIAL")], "kind string, status string")
    assert {r.kind: (r.n_events, r.passed, r.partial, r.missed, r.pct_passed) for r in events.verdicts(m).collect()} == {"a": (2, 1, 0, 1, 50.0), "b": (1, 0, 1, 0, 0.0), None: (3, 1, 1, 1, 33.3)}


def test_places_in_an_order_of_many_partitions(spark):
    df = spark.createDataFrame([(f"s{k:03d}", k * 37 % 101 if k % 9 else None) for k in range(100)], "source_id string, v int").repartition(7)
    got = sorted((r.place, r.v, r.source_id) for r in explore.listed(df, "v").collect())
    assert [p for p, _, _ in got] == list(range(100)) and [v for _, v, _ in got] == sorted((v for _, v, _ in got), key=lambda v: (v is None, v))
    assert explore.listed(df.limit(0), "v").count() == 0


def test_event_members_and_missing_events(spark):
    cat = events.catalog(spark)
    rows = [("a", "AZ", "triangle", "1997-03-12"), ("b", "TX", "disc", "1997-03-12"), ("c", "AZ", "disc", None)]
    rep = spark.createDataFrame(rows, "source_id string, state string, shape_norm string, d string").withColumn("event_date", F.to_date("d"))
    got = {r.event: r for r in events.coverage(rep, cat).collect()}
    assert len(got) == 13 and got["Phoenix Lights (1997)"].corpus_reports == 1 and got["Phoenix Lights (1997)"].shape_matches and not got["Illinois Triangle (2000)"].shape_matches


def test_signatures_of_repeated_ids_as_sql_gives_them(spark):
    texts = ["red light over lake", "red light over lake red light", "blue beam far away", "red light near barn", None, "", "blue beam over lake"]
    r = [(f"r{i % 9}", texts[i % 7]) for i in range(25)] + [(None, "red light over lake")]  # ids stand on several rows, with other texts
    m = [(f"r{i}", "ab"[i % 2]) for i in range(9)] + [("r1", "a"), ("r1", "a"), ("r2", "c"), (None, "a"), ("none", "c"), ("r3", None), ("r5", None), ("r7", None)]
    rep, members = spark.createDataFrame(r, "source_id string, narrative string"), spark.createDataFrame(m, "source_id string, grp string")
    con = duckdb.connect()
    con.register("reports", pd.DataFrame(r, columns=["source_id", "narrative"], dtype=object))
    con.register("known", pd.DataFrame(m, columns=["source_id", "grp"], dtype=object))
    want = con.execute(f"WITH {base._sig('grp')} SELECT * FROM sg").df()
    got = signatures.signatures(rep, members, "grp")
    assert len(want) > 10
    assert compare.rows(got.toPandas()) == compare.rows(want)


def test_signatures_take_texts_apart_once_for_a_group(spark):
    """n-gram occurrences are counted where they arise: one explode behind the vocabulary, and none is shuffled by its term."""
    rep = spark.range(50).selectExpr("cast(id AS string) AS source_id", "concat('red light over lake ', id % 3) AS narrative")
    plan = signatures.signatures(rep, rep.selectExpr("source_id", "'g' AS grp"), "grp")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1


def test_signatures_need_enough_reports(spark):
    rep = spark.createDataFrame([(f"s{k}", "bright orange orbs hovering" if k < 4 else "quiet night sky view", "TX") for k in range(9)] + [("n", None, None)], "source_id string, narrative string, state string")
    m = spark.createDataFrame([(f"s{k}", "g") for k in range(4)] + [("s8", "h"), ("gone", "g")], "source_id string, grp string")
    got = signatures.signatures(rep, m, "grp").collect()
    assert {r.grp for r in got} == {"g"} and "bright orange" in {r.phrase for r in got} and all(r.rate_pct == 100.0 for r in got)
    assert signatures.signatures(rep.limit(0), m, "grp").count() == 0


def test_archetypes_keep_every_vector_once(spark):
    rows = [(f"s{k}", [float(k % 3 == j) + 0.01 * k for j in range(3)]) for k in range(40)] + [("s0", [1.0, 0.0, 0.0]), ("n", None)]
    e = spark.createDataFrame(rows, "source_id string, embedding array<float>")
    got = archetypes.assigned(e, dims=2, k=3, min_size=5).collect()
    assert len(got) == 40 and {r.archetype for r in got} <= {-1, 0, 1, 2}
    assert archetypes.assigned(e.limit(0)).count() == 0


def test_detections_rest_on_written_rows_of_each_method(spark, folder):
    got = base.event_detections(spark, folder)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "nuforc" not in plan and plan.count("Exchange") < 20  # one plan of all methods held the scans and broadcasts of all
    matrix = base.event_matrix(spark, folder).collect()
    assert {r.kind: tuple(r)[1:] for r in got.collect()} == {
        kind: (len(m), sum(r.cluster_count > 0 for r in m), sum(r.flap_count > 0 for r in m), sum(r.sig_found for r in m), sum(r.shape_matches for r in m))
        for kind, m in ((k, [r for r in matrix if k in (None, r.kind)]) for k in ("unexplained", "prosaic", None))
    }
