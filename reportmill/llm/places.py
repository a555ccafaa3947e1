"""Typed place names mapped to a gazetteer by symmetric deletes.

Every gazetteer name, in plain letters, is filed under all strings that deleting up to ``max_edits`` characters leaves; a
typed name meets, through its own deletes, exactly the names within that many edits. These are ranked by a weighted
Damerau-Levenshtein distance and by how often the place is written exactly in the data (counted over all rows). The
dictionary is broadcast in portions of bounded size, and each worker builds a portion's deletes once; rows are never shuffled
unless there are several portions.

A typed name that is listed as it stands, in any state, is not looked up with edits: its weight is 0 there, and a name of the
typed state that needs edits would be refused beside it, so the search could not change the row.

Defined results: rows with a null or blank city, and rows whose state and city equal a place exactly, are not looked up.
-1 stands for: no such place, not listed in the typed state, a state outside the gazetteer, or no state and not exactly
one state with the name. Names equal in plain letters within one state: the more frequent place, then the smaller id.
Extra columns are ignored; an empty table gives no rows; with an empty gazetteer all rows are unmatched.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.runtime import small, spread

#: Customary abbreviations of states (letters only) and words around a name that are not part of it.
STATE_ABBREVIATIONS = {
    "ala": "AL", "alas": "AK", "ariz": "AZ", "ark": "AR", "cal": "CA", "calif": "CA", "cali": "CA", "colo": "CO", "conn": "CT", "del": "DE",
    "dela": "DE", "fla": "FL", "flor": "FL", "geo": "GA", "haw": "HI", "ida": "ID", "ill": "IL", "ills": "IL", "ind": "IN", "kan": "KS",
    "kans": "KS", "ken": "KY", "kent": "KY", "mass": "MA", "mary": "MD", "mich": "MI", "minn": "MN", "miss": "MS", "mont": "MT", "neb": "NE",
    "nebr": "NE", "nev": "NV", "nmex": "NM", "newm": "NM", "ncar": "NC", "ndak": "ND", "nodak": "ND", "okla": "OK", "ore": "OR", "oreg": "OR",
    "penn": "PA", "penna": "PA", "scar": "SC", "sdak": "SD", "sodak": "SD", "tenn": "TN", "tex": "TX", "wash": "WA", "wva": "WV", "westva": "WV",
    "wis": "WI", "wisc": "WI", "wyo": "WY", "virg": "VA", "verm": "VT", "washdc": "DC", "washingtondc": "DC",
}
SHORT_WORDS = {
    "st": "saint", "ste": "saint", "mt": "mount", "mtn": "mountain", "ft": "fort", "pt": "port", "lk": "lake", "hts": "heights", "hgts": "heights", "hgt": "heights", "spgs": "springs",
    "spg": "springs", "sprgs": "springs", "jct": "junction", "jctn": "junction", "jnc": "junction", "fls": "falls", "vly": "valley", "nw": "new", "n": "new", "riv": "river", "ctr": "center", "bch": "beach", "pk": "park", "hls": "hills",
}
BEFORE = r"(?:(?:just |right |slightly |somewhere )?(?:near|nr|outside(?: of)?|close to|around|by|above|over|between|in|at|(?:north|south|east|west|northeast|northwest|southeast|southwest|n|s|e|w|ne|nw|se|sw) of|(?:\d+ (?:mi|miles|km) )(?:\w+ )?(?:of|from)|greater|downtown|rural|the city of|city of|town of|north|south|east|west|northern|southern|eastern|western|n|s|e|w))"
AFTER = r"(?:area|areas|village|city|township|twp|twnshp|town|borough|boro|downtown|rural|near|vicinity|region|suburbs?|outside of|outside|north of|south of|east of|west of|county|co|metro|proper|\d{5}(?: \d{4})?)"


@dataclass(frozen=True)
class PlaceParams:
    max_edits: int = 2
    portion_rows: int = 10_000  #: places of one broadcast (about 0.8 million deletes, 150 MB in a worker)


def plain(text: str) -> str:
    """Lower-case letters and digits without accents, words parted by single spaces."""
    t = unicodedata.normalize("NFKD", text.replace("ß", "ss"))
    t = "".join(c for c in t if not unicodedata.combining(c)).lower()
    return " ".join(re.sub(r"[^a-z0-9]+", " ", t.replace("'", "").replace("’", "")).split())


def deletes(word: str, most: int) -> set[str]:
    """The word and all strings that deleting up to ``most`` of its characters leaves."""
    out = {word}
    for k in range(1, min(most, len(word)) + 1):
        out.update("".join(word[i] for i in range(len(word)) if i not in drop) for drop in map(frozenset, combinations(range(len(word)), k)))
    return out


def distance(a: str, b: str, most: int = 99) -> tuple[int, float]:
    """(edits, weighted edits) of the restricted Damerau-Levenshtein distance, of the alignment that weighs least.

    Alignments that shift by more than ``most`` letters are not looked at; they have more edits than that.

    A swap weighs 0.8, a dropped or doubled letter or a space 0.7, a vowel for a vowel 0.9, any other edit 1.
    """
    vowels = "aeiouy"
    far = (float(most + 1), most + 1)
    gap_a = [0.7 if c == " " or (k and a[k - 1] == c) else 1.0 for k, c in enumerate(a)]
    gap_b = [0.7 if c == " " or (k and b[k - 1] == c) else 1.0 for k, c in enumerate(b)]
    last: list[tuple[float, int]] = []
    row = [(0.0, 0)]
    for j in range(len(b)):
        row.append((row[j][0] + gap_b[j], j + 1))
    for i in range(1, len(a) + 1):
        before, last = last, row
        lo, hi = max(1, i - most), min(len(b), i + most)
        row = [far] * (len(b) + 1)
        if i <= most:
            row[0] = (last[0][0] + gap_a[i - 1], i)
        c = a[i - 1]
        for j in range(lo, hi + 1):
            d = b[j - 1]
            if c == d:
                best = last[j - 1]
            else:
                w, n = last[j - 1]
                best = (w + (0.9 if c in vowels and d in vowels else 1.0), n + 1)
                if i > 1 and j > 1 and c == b[j - 2] and a[i - 2] == d:
                    w, n = before[j - 2]
                    best = min(best, (w + 0.8, n + 1))
            w, n = last[j]
            best = min(best, (w + gap_a[i - 1], n + 1))
            w, n = row[j - 1]
            row[j] = min(best, (w + gap_b[j - 1], n + 1))
    w, n = row[-1]
    return n, w


class StateNames:
    """What a typed state means: a code, "" for nothing typed, "?" for one outside the list."""

    def __init__(self, states: list[tuple[str, str]]):
        self.exact = {k: v for k, v in STATE_ABBREVIATIONS.items() if any(c == v for c, _ in states)}
        self.exact |= {re.sub("[^a-z]", "", plain(n or "")): c for c, n in states if n} | {c.lower(): c for c, _ in states}
        self.long = {k: v for k, v in self.exact.items() if len(k) >= 4 and k not in STATE_ABBREVIATIONS}
        self.words = max((len(plain(n or "").split()) for _, n in states), default=1)

    def strict(self, text: str) -> str:
        return self.exact.get(re.sub("[^a-z]", "", plain(text)), "")

    def meant(self, text: str | None) -> str:
        key = re.sub("[^a-z]", "", plain(text or ""))
        if not key:
            return ""
        if key in self.exact:
            return self.exact[key]
        if len(key) >= 4:
            near = sorted((distance(key, k, 2), v) for k, v in self.long.items() if abs(len(k) - len(key)) <= 2)
            if near and near[0][0][0] <= (1 if len(key) <= 5 else 2) and (len(near) == 1 or near[1][0] != near[0][0]):
                return near[0][1]
        return "?"


def readings(city: str, states: StateNames) -> tuple[list[str], str]:
    """(names the text may hold, surest first; the state it holds or "")."""
    state = ""
    text = city.replace("_", " ")
    for note in re.findall(r"\(([^)]*)\)?", text):
        state = state or states.strict(note)
    text = re.sub(r"\([^)]*\)?", " ", text)
    text = re.sub(r"\s[-–—]+\s.*$", "", text.strip())
    parts = [x for x in re.split(r"[,/;|]", text) if x.strip()]
    if len(parts) > 1:
        for x in parts[1:]:
            state = state or states.strict(x) or (m if len(plain(x)) >= 6 and (m := states.meant(x)) != "?" else "")
        text = parts[0]
    name = plain(text)
    names = [name]
    words = name.split()
    for k in range(min(states.words, len(words) - 1), 0, -1):
        tail = "".join(words[-k:])
        found = states.exact.get(tail) or (m if len(tail) >= 6 and (m := states.meant(tail)) not in ("", "?") else "")
        if found:
            state = state or found
            words = words[:-k]
            names.append(" ".join(words))
            break
    for n in list(names):
        names.append(re.sub(rf"(?:^| ){AFTER}$", "", re.sub(rf"^{BEFORE} ", "", n)))
        names.append(re.sub(rf"(?: {AFTER})+$", "", re.sub(rf"^(?:{BEFORE} )+", "", n)))
    names += [" ".join(SHORT_WORDS.get(w, w) for w in n.split()) for n in names]
    return [n for n in dict.fromkeys(names) if n], state


class Dictionary:
    """Names under their deletes, with the places of each name."""

    def __init__(self, places: list[tuple[int, str, str, int]], max_edits: int):
        self.max_edits = max_edits
        self.places: dict[str, dict[str, tuple[int, int]]] = {}
        for pid, usps, name, freq in places:
            held = self.places.setdefault(plain(name), {})
            held[usps] = min(held.get(usps, (1, 0)), (-freq, pid))
        self.longest = max(map(len, self.places), default=0)
        self.filed: dict[str, list[str]] = {}
        for name in self.places:
            for d in deletes(name, max_edits):
                self.filed.setdefault(d, []).append(name)

    def near(self, name: str) -> list[tuple[str, int, float]]:
        """(listed name, edits, weighted edits) of all listed names within the bound (one edit for short names)."""
        most = self.max_edits if len(name) >= 6 else 1 if len(name) >= 4 else 0
        if len(name) > self.longest + most:
            return []  # too long for any listed name; its deletes would be too many
        out: dict[str, tuple[int, float]] = {}
        for c in {c for d in deletes(name, most) for c in self.filed.get(d, ()) if abs(len(c) - len(name)) <= most}:
            n, w = distance(name, c, most)
            if n <= most:
                out[c] = (n, w)
        return [(c, n, w) for c, (n, w) in out.items()]

    def look_up(self, names: list[str], state: str) -> tuple[float | None, int | None, int | None, float | None, list[str], int | None]:
        """Best in the state (weight, -frequency, place) and best anywhere (weight, its states, a place there)."""
        inside: tuple[float, int, int] | None = None
        best, where = None, {}
        listed = [n for n in names if n in self.places]  # a name that is listed as it stands needs no edits
        for name in listed or names:
            for c, _, w in [(name, 0, 0.0)] if listed else self.near(name):
                held = self.places[c]
                if state in held:
                    inside = min(inside or (9e9, 0, 0), (w, *held[state]))
                if best is None or w < best:
                    best, where = w, dict(held)
                elif w == best:
                    where |= held
        first = min((v[1] for v in where.values()), default=None)
        return (*(inside or (None, None, None)), best, sorted(where), first)


def _built(portion: dict) -> tuple[Dictionary, StateNames]:
    """Dictionary and state names of a broadcast portion, built where they are first used and kept in its value: once per worker."""
    if "built" not in portion:
        portion["built"] = Dictionary(portion["places"], portion["max_edits"]), StateNames(portion["states"])
    return portion["built"]


def matched(reports: DataFrame, gazetteer: DataFrame, states: DataFrame, params: PlaceParams = PlaceParams()) -> DataFrame:
    """(row_id, place_id): the place meant by every report whose city is no exact match, -1 where there is none."""
    p, spark = params, reports.sparkSession
    rows = spread(reports.select("row_id", "city", "state").where("trim(city) <> ''"))
    listed = gazetteer.where("usps IS NOT NULL AND name IS NOT NULL AND place_id IS NOT NULL").select("place_id", "usps", "name")
    exact = small(listed.groupBy(F.col("usps").alias("state"), F.col("name").alias("city")).agg(F.min("place_id").alias("place_id")))
    often = rows.join(exact, ["state", "city"]).groupBy("place_id").agg(F.count("*").alias("freq"))
    typed = rows.join(exact, ["state", "city"], "left_anti").select("row_id", "city", "state")
    names = [(r.state.strip().upper(), r.state_name) for r in states.where("state IS NOT NULL").select("state", "state_name").distinct().collect()]
    schema = "row_id long, state string, weight double, freq long, place long, best double, within array<string>, first long"

    def scan(held: list[tuple[int, str, str, int]]) -> DataFrame:
        shared = spark.sparkContext.broadcast({"places": held, "states": names, "max_edits": p.max_edits})

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            book, known = _built(shared.value)

            @lru_cache(maxsize=200_000)
            def answer(city: str, state: str | None) -> tuple:
                options, inner = readings(city, known)
                meant = known.meant(state) or inner
                return (meant, *book.look_up(options, meant))

            for b in batches:
                got = [answer(c, s) for c, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
                cols = list(zip(*got, strict=True)) or [[]] * 7
                kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.string()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["row_id", "state", "weight", "freq", "place", "best", "within", "first"])

        return typed.mapInArrow(search, schema)

    # The gazetteer passes by in order, a portion at a time.
    portions, held = [], []
    for r in listed.join(often, "place_id", "left").orderBy("usps", "place_id").toLocalIterator():
        if len(held) >= p.portion_rows:
            portions.append(scan(held))
            held = []
        held.append((r.place_id, r.usps, r.name, r.freq or 0))
    portions.append(scan(held))
    found = reduce(DataFrame.union, portions)
    if len(portions) > 1:
        low = F.struct("weight", "freq", "place")
        least = found.groupBy("row_id", "state").agg(F.min(F.when(F.col("weight").isNotNull(), low)).alias("i"), F.min("best").alias("best"))
        ties = found.join(least, ["row_id", "state"]).where(found["best"] == least["best"]).groupBy("row_id").agg(F.array_distinct(F.flatten(F.collect_list("within"))).alias("within"), F.min("first").alias("first"))
        found = least.join(ties, "row_id", "left").select("row_id", "state", "i.*", "best", "within", "first")  # at most all states for each row
    here = F.when(F.col("state") == "?", -1).when(F.col("state") == "", F.when(F.size("within") == 1, F.col("first")).otherwise(-1))
    # a name nearer by an edit to one that only other states list isn't listed here
    here = here.when(F.col("weight") < F.col("best") + F.lit(0.95), F.when((F.col("best") == 0) & (F.col("weight") > 0), -1).otherwise(F.col("place"))).otherwise(-1)
    return found.select("row_id", here.cast("long").alias("place_id"))
