"""Rates of vocabulary terms per time bin."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import dates
from reportmill.params import DEFAULT, Params

try:
    from re import _parser
except ImportError:  # before Python 3.11
    import sre_parse as _parser

#: The default vocabulary, a pattern per term, matched against the lower-cased narrative.
VOCABULARY = {
    "flying saucer": r"\bflying saucer", "saucer": r"\bsaucer\b", "disc/disk": r"\bdi(?:sc|sk)\b", "cigar": r"\bcigar\b", "triangle": r"\btriangle\b",
    "triangular": r"\btriangular\b", "V-shape": r"\bv[- ]?shape", "chevron": r"\bchevron\b", "boomerang": r"\bboomerang\b", "sphere": r"\bsphere\b",
    "orb": r"\borb\b", "oval": r"\boval\b", "cylinder": r"\bcylinder\b", "rectangle": r"\brectangle\b", "diamond": r"\bdiamond\b",
    "cross": r"\bcross[- ]?shape", "egg": r"\begg[- ]?shape", "fireball": r"\bfireball\b", "star-like": r"\bstar[- ]?like\b", "hovering": r"\bhovert?(ing|ed)\b",
    "zigzag": r"\bzig[- ]?zag", "pulsing": r"\bpuls(?:ing|ed|ating)\b", "silent": r"\bsilent\b", "humming": r"\bhumm(?:ing|ed)\b", "blinking": r"\bblink(?:ing|ed)\b",
    "darting": r"\bdart(?:ing|ed)\b", "formation": r"\bformation\b", "disappeared": r"\bdisappear(?:ed|ing)\b", "shot up": r"\bshot up\b", "took off": r"\btook off\b",
    "orange": r"\borange\b", "red light": r"\bred light", "green light": r"\bgreen light", "white light": r"\bwhite light", "amber": r"\bamber\b",
    "drone": r"\bdrone\b", "tic-tac": r"\btic[- ]?tac\b", "tic tac": r"\btic tac\b", "UAP": r"\bUAP\b", "UFO": r"\bUFO\b", "alien": r"\balien\b",
    "military": r"\bmilitary\b", "satellite": r"\bsatellite\b", "Starlink": r"\b[Ss]tarlink\b", "Chinese lantern": r"\b[Cc]hinese lantern", "flare": r"\bflare\b",
    "meteor": r"\bmeteor\b", "ISS": r"\bISS\b", "space station": r"\bspace station\b", "jet": r"\bjet\b", "helicopter": r"\bhelicopter\b",
    "aircraft": r"\baircraft\b", "abduction": r"\babduct(?:ion|ed)\b", "missing time": r"\bmissing time\b", "beam": r"\bbeam\b", "landing": r"\blanding\b",
    "occupant": r"\boccupant\b", "entity": r"\bentit(?:y|ies)\b",
}
#: Terms whose rates are added under one name.
MERGED = {"tic-tac": ("tic-tac", "tic tac"), "triangle/triangular": ("triangle", "triangular")}


def needed(pattern: str) -> str:
    """The longest literal that every match of a pattern holds, from the pattern's outermost parts; empty if there is none.

    Patterns with flags, and what only another dialect understands, have none.
    """
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return ""
    if parsed.state.flags & ~re.UNICODE:
        return ""
    runs, run = [""], ""
    for op, value in [*parsed, (None, None)]:
        if op is _parser.LITERAL:
            run += chr(value)
        else:
            runs.append(run)
            run = ""
    return max(runs, key=len)


def holds(text: Column, pattern: str) -> Column:
    """Whether a text matches; the regular expression runs only on texts that hold the pattern's literal."""
    return F.contains(text, F.lit(needed(pattern))) & text.rlike(pattern)


def rates(reports: DataFrame, vocabulary: dict[str, str] = VOCABULARY, params: Params = DEFAULT) -> DataFrame:
    """(time_bin, term, hits, narratives, rate_per_1k): one scan counts all terms per bin; terms never met are left out.

    Upper-case letters in a pattern can never match lower-cased text; such terms stay at zero and are left out.
    Rows without a year or narrative are not counted.
    """
    rows = reports.where(F.col("event_year") >= params.vocab_first_year).where("narrative IS NOT NULL")
    rows = rows.select(dates.year_bin(F.col("event_year"), params.vocab_bin).alias("time_bin"), F.lower("narrative").alias("t"))
    hits = [F.sum(holds(F.col("t"), p).cast("int")).alias(f"h{k}") for k, p in enumerate(vocabulary.values())]
    bins = rows.groupBy("time_bin").agg(F.count("*").alias("narratives"), *hits)
    pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(vocabulary)])
    long = bins.select("time_bin", "narratives", F.explode(pairs).alias("x")).select("time_bin", "x.term", "x.hits", "narratives")
    met = F.sum("hits").over(Window.partitionBy("term"))
    return long.withColumn("met", met).where("met > 0").drop("met").withColumn("rate_per_1k", F.round(F.col("hits") * 1000 / F.col("narratives"), 4))


def merged(rated: DataFrame, groups: dict[str, tuple[str, ...]] = MERGED) -> DataFrame:
    """(time_bin, term, rate_per_1k) with the rates of near-duplicate terms added; a narrative with both counts in both."""
    name = reduce(lambda c, kv: F.when(F.col("term").isin(list(kv[1])), kv[0]).otherwise(c), groups.items(), F.col("term"))
    return rated.groupBy("time_bin", name.alias("term")).agg(F.round(F.sum("rate_per_1k"), 4).alias("rate_per_1k"))


def peaks(rated: DataFrame) -> DataFrame:
    """(term, peak_bin, peak_rate_per_1k, total_mentions): the bin of the highest rate (ties: the earliest); the total is the whole part of the sum of rates."""
    return rated.groupBy("term").agg(
        F.max_by("time_bin", F.struct("rate_per_1k", -F.col("time_bin"))).alias("peak_bin"), F.round(F.max("rate_per_1k"), 2).alias("peak_rate_per_1k"), F.floor(F.sum("rate_per_1k") + 1e-9).alias("total_mentions"),
    )


def heatmap(rated: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Each rate as a share of its term's highest, for terms whose rates sum to the least total."""
    w = Window.partitionBy("term")
    out = rated.withColumns({"top": F.max("rate_per_1k").over(w), "total": F.sum("rate_per_1k").over(w)}).where(F.col("total") >= params.vocab_min_total)
    return out.select("term", "time_bin", F.when(F.col("top") > 0, F.round(F.col("rate_per_1k") / F.col("top") + 1e-9, 4)).otherwise(0.0).alias("share_of_peak"))
