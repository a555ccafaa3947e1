"""Near-duplicates, leaks, mixing and encodings."""

import random
import re

import numpy as np
import pytest

from reportmill.llm import encoding, leakage, mixing, neardup
from reportmill.llm.mixing import MixParams

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "sa", "te", "vo") for b in ("ba", "cho", "din", "fel", "gor", "hu", "jit", "lem", "nor", "pas", "ques", "rim")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def runs(text, n):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


@pytest.mark.parametrize(("params", "hot"), [(neardup.LOOSE, False), (neardup.NearDupParams(), False), (neardup.LOOSE, True)])
def test_pairs_equal_brute_force(spark, params, hot):
    rng = random.Random(7)
    base = [sentence(rng, 60) for _ in range(120)]
    texts = list(base)
    for k in range(120):
        w = (base[0] if hot else base[k % 40]).split()
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        texts.append(" ".join(w[rng.randrange(6) :]).upper())
    texts += ["", None, "one two", base[1], "x " * 3000, "x y " * 3000]
    df = spark.createDataFrame([(f"s{k:04d}", t, 1, "c") for k, t in enumerate(texts)] + [("s0000", texts[0], 1, "c"), (None, base[2], 1, "c")], "source_id string, narrative string, key int, runs string").repartition(3)
    links, classes = neardup.near_pairs(df, params)
    got = {tuple(r) for r in neardup.expanded(links, classes).collect()}
    sets = [runs(t, params.words) for t in texts]
    want = {(f"s{i:04d}", f"s{j:04d}") for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= params.similarity * len(sets[i] | sets[j])}
    assert got <= want and len(got) >= 0.99 * len(want)


def test_every_pair_within_the_radius_shares_a_key():
    p = neardup.LOOSE
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 2**63, (1, p.positions)).astype(np.uint64)
        b = a.copy()
        b[0, rng.choice(p.positions, p.radius, replace=False)] += np.uint64(1)
        assert (neardup._keys(a, p)[0] == neardup._keys(b, p)[0]).any()
        assert neardup.distances(neardup.short_forms(a, p), neardup.short_forms(b, p), p)[0] <= p.radius


def test_distances_count_positions():
    p = neardup.LOOSE
    sig = np.random.default_rng(2).integers(0, 2**63, (40, p.positions)).astype(np.uint64)
    low = neardup._mix(sig) & np.uint64(2**p.bits - 1)
    short = neardup.short_forms(sig, p)
    assert (neardup.distances(short[:-1], short[1:], p) == (low[:-1] != low[1:]).sum(axis=1)).all()


@pytest.mark.parametrize("stock", [0.0, 0.24, 0.4])
def test_pairs_of_half_similarity_are_found_with_stock_runs(spark, stock):
    """Pairs of similarity 0.5 whose common runs are stock as far as can be."""
    rng, n, size = random.Random(23), 300, 90
    held = [f"s{k}" for k in range(int(stock * size) + 2)]
    text = lambda own: " ".join(held + own)
    rows, want = [], set()
    for k in range(n):
        own = [f"a{k}x{i}" for i in range(size - int(stock * size))]
        common = size * 2 // 3 + 2 - int(stock * size)
        rows += [(f"p{k:04d}", text(own)), (f"q{k:04d}", text(own[:common] + [f"b{k}x{i}" for i in range(len(own) - common)]))]
        x, y = runs(rows[-2][1], 3), runs(rows[-1][1], 3)
        assert 0.5 <= len(x & y) / len(x | y) < 0.54
        want.add((f"p{k:04d}", f"q{k:04d}"))
    df = spark.createDataFrame(rows, "source_id string, narrative string").repartition(4)
    got = {(r.a, r.b) for r in neardup.near_pairs(df, neardup.LOOSE)[0].collect()}
    assert len(got & want) >= 0.97 * len(want)


@pytest.mark.parametrize("counters", [1 << 22, 1 << 12])
def test_every_pair_at_the_threshold_is_found(spark, counters):
    """Pairs of similarity 0.5 and little more, and just below it, among texts that share a third of their runs; with full counters too."""
    from dataclasses import replace

    rng, rows, size = random.Random(31), [], 60
    stock = [f"s{k}" for k in range(22)]
    for k in range(400):
        own = [f"a{k}x{i}" for i in range(size - 20)]
        common = size * 2 // 3 - 20 + rng.randrange(-1, 3)
        rows += [(f"p{k:04d}", " ".join(stock + own)), (f"q{k:04d}", " ".join(stock + own[:common] + [f"b{k}x{i}" for i in range(len(own) - common)]))]
    rows += [("z1", "one two three"), ("z2", "one two three four"), ("z3", "one two three four five"), ("z4", "two three four")]
    sets = {i: runs(t, 3) for i, t in rows}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "source_id string, narrative string").repartition(4)
    assert len(want) > 250
    assert {(r.a, r.b) for r in neardup.near_pairs(df, replace(neardup.LOOSE, counters=counters))[0].collect()} == want


def test_keys_above_the_block_size_lose_no_pair(spark):
    rng = random.Random(29)
    base = sentence(rng, 60).split()
    rows = []
    for k in range(150):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(60)] = rng.choice(WORDS)
        rows.append((f"s{k:03d}", " ".join(w)))
    df = spark.createDataFrame(rows, "source_id string, narrative string").repartition(3)
    from dataclasses import replace

    a = {(r.a, r.b) for r in neardup.near_pairs(df, neardup.LOOSE)[0].collect()}
    b = {(r.a, r.b) for r in neardup.near_pairs(df, replace(neardup.LOOSE, hot_rows=20, group_rows=500))[0].collect()}
    assert a == b and len(a) > 5000


def test_groups(spark):
    rng = random.Random(3)
    t = sentence(rng, 80)
    df = spark.createDataFrame([("a", t), ("b", t), ("c", t + " end"), ("d", sentence(rng, 80)), ("e", None)], "source_id string, narrative string")
    got = {r.id: (r.class_id, r.group_id, r.group_size, r.n_links) for r in neardup.groups(df).collect()}
    assert got == {"a": ("a", "a", 3, 1), "b": ("a", "a", 3, 1), "c": ("c", "a", 3, 1), "d": ("d", "d", 1, 0)}
    assert neardup.groups(df.limit(0)).count() == 0


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    items = [sentence(rng, rng.randrange(8, 60)) for _ in range(30)]
    docs = []
    for k in range(60):
        w = items[k % 30].split()
        n, at = rng.randrange(6, 30), rng.randrange(len(w))
        docs.append(sentence(rng, 40) + ". " + "; ".join(w[at : at + n]).upper() + "! " + sentence(rng, 20))
    docs += [None, "", "one", items[0] * 3, "ka " * 4000]
    d = spark.createDataFrame([(k, t, 1) for k, t in enumerate(docs)] + [(None, items[0], 1), (0, docs[0], 1)], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(k, t) for k, t in enumerate(items)] + [(99, None), (98, "")], "item_id long, text string")
    want = {(a, b) for a, t in enumerate(docs) for b, u in enumerate(items) if runs(t, 12) & runs(u, 12)}
    got = leakage.leaks(d, i)
    assert {(r.doc_id, r.item_id) for r in got.where("longest >= 12").collect()} == want
    shuffled = leakage.leaks(d, i, leakage.LeakParams(portion_words=60))
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, got.collect()))
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_reordered_passages_are_covered(spark):
    w = sentence(random.Random(9), 40).split()
    text = " ".join(w[20:30] + ["zzz"] + w[0:10] + ["yyy"] + w[10:20])
    r = leakage.leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(2, " ".join(w))], "item_id long, text string")).first()
    assert (r.longest, r.covered, r.n_tiles, r.coverage) == (10, 30, 3, 0.75)


def test_tiles_do_not_overlap():
    got = leakage.tiles([(0, 0, 10), (5, 20, 10), (30, 5, 9)], 60, 40, 3)
    assert got == [(0, 0, 10), (10, 25, 5), (35, 10, 4)]


def docs_frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, tokens int")


def test_shares_are_met_and_caps_kept(spark):
    rng = random.Random(11)
    rows = [(k, ("big", "small", "mid")[0 if k < 600 else 1 if k < 700 else 2], sentence(rng, rng.randrange(10, 40)), 0) for k in range(1000)]
    rows += [(2000 + k, "small", rows[k][2], 0) for k in range(60)] + [(3000, "big", None, 0), (3001, "big", "", 0), (3002, None, "text", 0), (3003, "other", "text", 0), (0, "big", rows[0][2], 0)]
    targets = spark.createDataFrame([("big", 0.4, 1), ("small", 0.35, 4), ("mid", 0.2, 2), ("gone", 0.05, 2), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    selection, report = mixing.mix(docs_frame(spark, rows), targets, MixParams(bucket_docs=100))
    got = {r.source: r for r in report.collect()}
    for s, share in (("big", 0.4), ("small", 0.35), ("mid", 0.2)):
        assert abs(got[s].actual_share - share / 0.95) < 0.01
    assert got["gone"].actual_share == 0.0 and got["none"].actual_tokens == 0
    taken = selection.toPandas()
    assert not taken.duplicated(["source", "doc_id"]).any() and (taken.copies <= taken.source.map({"big": 1, "small": 4, "mid": 2})).all()
    source = {(r[0], r[1]) for r in rows}
    assert all((d, s) in source for d, s in zip(taken.doc_id, taken.source))
    again = mixing.mix(docs_frame(spark, rows).repartition(7), targets, MixParams(bucket_docs=100))[0].toPandas()
    assert sorted(map(tuple, again.values.tolist())) == sorted(map(tuple, taken.values.tolist()))


def test_mixing_nothing(spark):
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mixing.mix(docs_frame(spark, []), t)[0].count() == 0
    assert mixing.mix(docs_frame(spark, [(1, "a", "text here", 0)]), t.limit(0))[0].count() == 0


def test_flow_prefers_first_uses():
    flow, quota = mixing.routed({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 3}, 160)
    assert quota == {"a": 80, "b": 80} and sum(v for (_, s), v in flow.items() if s == "b") == 80 and flow[("b",), "b"] <= 30
    flow, quota = mixing.routed({("a",): 100, ("b",): 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 110)
    assert quota["b"] <= 20 and quota["a"] == quota["b"]


GOOD = ["El niño señaló la montaña según la señora.", "Ça a duré près de la forêt, très étonnée à côté du château.", "Über den Dächern fuhren wir zurück zur Straße, völlig müde.", "The façade — it’s “naïve”, 40° and £35 ± ½.", "Oui. Ça va. Gut. Über uns."] * 25


@pytest.mark.parametrize(("page", "true"), [("cp1252", "utf-8"), ("mac_roman", "utf-8"), ("cp437", "utf-8"), ("cp1250", "utf-8"), ("cp1251", "utf-8"), ("cp850", "cp1252")])
def test_round_trip(spark, page, true):
    read = lambda s: "".join(chr(b) if page == "cp1252" and b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode(page, "replace") for b in s.encode(true))
    bad = [read(GOOD[0]), GOOD[0] + " " + read(GOOD[1]), read(GOOD[2])]
    rows = [(k, t, 1) for k, t in enumerate(GOOD)] + [(1000 + k, t, 1) for k, t in enumerate(bad)]
    got = {r.doc_id: r for r in encoding.garbled(spark.createDataFrame(rows, "doc_id long, text string, lost int")).collect()}
    whole = [k for k, t in enumerate(bad) if "�" not in t]
    assert set(got) == {1000 + k for k in range(3)}
    assert all(got[1000 + k].restored == (GOOD[0], GOOD[0] + " " + GOOD[1], GOOD[2])[k] for k in whole)


def test_twice_garbled_lost_and_rightly_rare(spark):
    twice = GOOD[0].encode().decode("cp1252").encode().decode("cp1252")
    rare = ["Both ┤ and ├ were carved.", "Route √2.", "Signal Ð-7.", "The sign said PÂTURAGE PRIVÉ.", "SÃO BRÁMIO", "a b", "Â ◊ marks", "5€™", "plain"]
    rows = [(k, t) for k, t in enumerate(GOOD + rare)] + [(500, twice), (501, "se�ora"), (502, None), (503, ""), (None, twice), (504, "plain " * 20_000)]
    got = {r.doc_id: (r.restored, r.lost) for r in encoding.garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {500: (GOOD[0], 0), 501: ("se�ora", 1)}
    assert encoding.garbled(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_segments_are_the_maximal_ones():
    assert encoding.segments([1, -5, 2, -1, 3, -9, 1]) == [(0, 1), (2, 5), (6, 7)] and encoding.segments([]) == [] and encoding.segments([-1, -2]) == []


@pytest.mark.parametrize("alike", ["copies", "desk"])
@pytest.mark.parametrize("true", ["utf-8", "cp1252"])
def test_a_third_of_the_rows_garbled_alike(spark, true, alike):
    rng = random.Random(13)
    read = lambda s: s.encode(true).decode("cp1252" if true == "utf-8" else "cp850")
    good = [f"{sentence(rng, 6)}. Él señaló la montaña, {sentence(rng, 3)}, según la señora." for _ in range(80)]
    bad = [read(good[0] if alike == "copies" else f"{sentence(rng, 6)}. Él señaló la montaña.") for _ in range(40)]
    rows = [(k, t) for k, t in enumerate(good + bad)]
    got = {r.doc_id for r in encoding.garbled(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(80, 120))


def test_most_right_pieces_are_left_alone(spark):
    rng = random.Random(17)
    good = [f"{sentence(rng, 6)}. Él señaló la montaña, {sentence(rng, 3)}, según la señora." for _ in range(400)]
    bad = [good[k].encode().decode("cp1252") for k in range(5)]
    p = encoding.EncodingParams(usual=2e-3)
    df = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)], "doc_id long, text string")
    known = encoding.model(encoding.pair_counts(df.select("text"), "text"), p)
    inside = lambda t, r: [any(a < m.end() and m.start() < b for a, b in r) for m in encoding.PIECE.finditer(t)]
    right = [x for t, r in zip(good, encoding.improbable(good, known)) for x in inside(t, r)]
    wrong = [x for t, r in zip(bad, encoding.improbable(bad, known)) for x in inside(t, r)]
    assert sum(right) < 0.2 * len(right) and all(wrong)
    # outside the runs no mapping is tested: without runs nothing is found
    assert encoding.restore(bad[0], known, p)[1] and not encoding.restore(bad[0], known, p, runs=[])[1]


def test_runs_stay_inside_their_text(spark):
    known = encoding.Model(np.array([], np.int64), np.array([]), np.array([]), -20.0)
    assert encoding.improbable(["", "é", "abc", "aéb", "é"], known) == [[], [(0, 1)], [], [(0, 3)], [(0, 1)]]
    assert encoding.improbable([], known) == [] and encoding.improbable(["aé", "éa"], known) == [[(0, 2)], [(0, 2)]]


def test_known_pairs_are_bounded_by_probability(spark):
    df = spark.createDataFrame([("é" * 3000 + "ü",), ("ñb",)], "text string")
    known = encoding.model(encoding.pair_counts(df, "text"), encoding.EncodingParams(floor_bits=10))
    assert known.pair.tolist() == [(0xE9 << 21) | 0xE9] and known.unseen == -12
