import random
import string

import pytest

from reportmill.llm import places
from reportmill.llm.places import PlaceParams, deletes, distance, matched, plain

GAZ = [(1, "WA", "Ivelcrest"), (2, "WA", "Saint Jutehaven"), (3, "OR", "Ivelmoor"), (4, "TX", "Mount Farrbridge"), (5, "CA", "Ivelmoor"), (6, "TX", "Köhlnorburn"), (7, "OR", "Skellwell Junction"), (8, "WA", "New Corvley")]
STATES = [("WA", "Washington"), ("OR", "Oregon"), ("TX", "Texas"), ("CA", "California")]
CASES = {
    ("Ivelcrst", "WA"): 1, ("IVELCREST", "wa"): 1, ("Ivelcrest (5 mi. W)", "Wash."): 1, ("near Ivelcrest", "Washingtonn"): 1, ("Ivelcrest, Washington", ""): 1, ("Ivelcrest WA", None): 1, ("Ivelcrest/WA", "??"): 1,
    ("St. Jutehaven", "WA"): 2, ("SaintJutehaven", "WA"): 2, ("Ivelcrest", ""): 1, ("Ivelmoor", ""): -1, ("Ivelmoor", "WA"): -1, ("Mt. Farrbrigde", "T.X."): 4, ("kohlnorburn", "tx"): 6, ("skellwell jct.", "Ore."): 7,
    ("N. Corvley", "WA"): 8, ("at sea", "WA"): -1, ("Ivelcrest", "BC"): -1, ("Nowhere", None): -1, ("ivelcrest village 98101", "WA"): 1, ("x" * 20_000, "WA"): -1, ("?", "WA"): -1,
}


def frames(spark, cases, gaz=GAZ):
    rep = spark.createDataFrame([(k, c, s, "clash", 0) for k, (c, s) in enumerate(cases)], "row_id long, city string, state string, place string, n int")
    return rep, spark.createDataFrame(gaz, "place_id long, usps string, name string"), spark.createDataFrame(STATES, "state string, state_name string")


def test_cases(spark):
    got = {r.row_id: r.place_id for r in matched(*frames(spark, CASES)).collect()}
    assert {k: got[i] for i, k in enumerate(CASES)} == CASES


def test_portions_give_the_same(spark):
    f = frames(spark, CASES)
    assert sorted(map(tuple, matched(*f).collect())) == sorted(map(tuple, matched(*f, PlaceParams(portion_rows=2)).collect()))


def test_exact_null_and_blank_rows_are_not_looked_up(spark):
    assert matched(*frames(spark, [("Ivelcrest", "WA"), (None, "WA"), ("  ", "WA")])).count() == 0


def test_empty(spark):
    assert matched(*frames(spark, [])).count() == 0
    assert [r.place_id for r in matched(*frames(spark, [("Ivelcrest", "WA")], [])).collect()] == [-1]


def _edits(a, b):
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@pytest.mark.parametrize("seed", range(3))
def test_deletes_find_all_names_within_two_edits(seed):
    rng = random.Random(seed)
    names = ["".join(rng.choice("abcde") for _ in range(rng.randrange(6, 10))) for _ in range(60)]
    book = places.Dictionary([(k, "WA", n, 0) for k, n in enumerate(names)], 2)
    for _ in range(60):
        w = list(rng.choice(names))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(string.ascii_lowercase[:6])
        w = "".join(w)
        near = {c for c, _, _ in book.near(w)}
        # the weighted alignment never has fewer edits than the plain one, so it may only leave out
        assert {n for n in names if _edits(w, n) <= 1} <= near <= {n for n in names if _edits(w, n) <= 2}


def test_distance():
    assert distance("abcd", "abdc") == (1, 0.8) and distance("abc", "abc") == (0, 0.0) and distance("saint x", "saintx")[1] == 0.7 and distance("abc", "xbc") == (1, 1.0)
    assert deletes("ab", 2) == {"ab", "a", "b", ""} and plain("  Köhl_nor-burn, TX ") == "kohl nor burn tx"
