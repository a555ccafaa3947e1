"""Schemas that drift between files.

Every file of a feed has a fingerprint: its fields, the headers they stand under and the JSON kind most of their values have.
A registry holds the versions of each feed and, as rows, the explicit migration steps that lead from version to version:
``add``, ``rename``, ``alias``, ``default`` and ``cast``. The changes reported are those steps; lines are routed into one
canonical table by folding the steps up to their file's version.

A header means a canonical field by rule, or because it took the place of one: if a header no rule knows appears in the
very file in which a canonical field is missing, and holds that field's values (of reports that both files have, or
of all), it stands for the field from then on.

Defined results: a payload that is null, malformed or no object gives a line of nulls in the canonical table and no
header; an empty table gives empty results; a field with only nulls has no kind and never changes type; of several
headers of one field in one file the one in most lines counts (ties: the smaller string), the others fill its gaps; ties
between kinds go to the smaller word. Extra input columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.runtime import materialize, small, spread

#: A header takes a field's place if this share of the reports in both files hold the same value under it, of at least so many.
SAME_VALUES, SAME_REPORTS = 0.6, 3
#: Or if the values of the two files overlap by this share (common to both / in either), of at least so many.
SAME_KINDS, KINDS = 0.5, 3

CANONICAL = (
    "report_no", "datetime", "city", "state", "country", "shape", "duration_seconds", "duration_hours",
    "comments", "date_posted", "latitude", "longitude",
)

#: Headers, lower-cased and with everything but letters and digits made one space, that mean a canonical field.
HEADER_RULES = {
    "report_no": r"(?:(?:report|case|sighting) )?(?:id|no|number|nr)|sighting|report",
    "datetime": r"(?:event |sighting )?(?:datetime|date time|timestamp)|occurred(?: at| on)?|event date",
    "city": r"city|town|city town|city name|place|place name|municipality",
    "state": r"state|state code|us state|state province|province",
    "country": r"country|country code|nation",
    "shape": r"(?:(?:object|ufo|reported) )?shape(?: reported)?",
    "duration_seconds": r"duration (?:in )?(?:seconds?|secs?|s)|seconds",
    "duration_hours": r"duration(?: (?:in )?(?:hours? min(?:utes)?|hours?|text|min|hours min|free text))?",
    "comments": r"(?:(?:witness|report|full|raw|observer|sighting|event) )*(?:comments?|text|narrative|description)(?: text)?",
    "date_posted": r"(?:date )?posted(?: (?:at|on|date))?|post date|posting date",
    "latitude": r"(?:(?:city|place|site|event|report|geo) )*(?:latitude|lat)(?: (?:deg|degrees?|dd|decimal|wgs84))*",
    "longitude": r"(?:(?:city|place|site|event|report|geo) )*(?:longitude|long|lon|lng)(?: (?:deg|degrees?|dd|decimal|wgs84))*",
}


def field_of(header: Column) -> Column:
    """The canonical field a header means by rule, else the header itself."""
    plain = F.trim(F.regexp_replace(F.lower(header), "[^a-z0-9]+", " "))
    rules = [(F.lit(field), plain.rlike(f"^(?:{rule})$")) for field, rule in HEADER_RULES.items()]
    return reduce(lambda chain, r: chain.when(r[1], r[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise(header)


def headers(raw: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, header, kind, n): how often each header holds each JSON kind in each file; a file without headers has one row of nulls."""
    kind = F.coalesce(F.expr("schema_of_variant(value)"), F.lit("VOID"))
    named = (
        F.when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("number")
    )
    return (
        spread(raw.select("feed", "file_seq", "file_id", "payload"))
        .select("feed", "file_seq", "file_id", F.explode_outer(F.from_json("payload", "map<string,variant>")).alias("header", "value"))
        .groupBy("feed", "file_seq", "file_id", "header", F.when(F.col("header").isNotNull(), named).alias("kind"))
        .agg(F.count("*").alias("n"))
    )


def _order(*more: str) -> Window:
    return Window.partitionBy("feed", *more).orderBy("file_seq", "file_id")


def taken_places(raw: DataFrame, heads: DataFrame) -> DataFrame:
    """(feed, header, field): headers no rule knows that took the place of a canonical field, judged by their values.

    Only the files where such a header appears and a canonical field is missing are read again, each with the file before.
    """
    ruled = heads.where("header IS NOT NULL").select("feed", "file_seq", "file_id", "header", field_of(F.col("header")).alias("field")).distinct()
    per = heads.select("feed", "file_seq", "file_id").distinct().join(ruled.groupBy("file_id").agg(F.collect_set("field").alias("fields")), "file_id", "left")
    per = per.withColumn("fields", F.coalesce("fields", F.array().cast("array<string>"))).withColumns({"old": F.lag("fields").over(_order()), "old_id": F.lag("file_id").over(_order())})
    known = F.array(*[F.lit(c) for c in CANONICAL])
    gone = F.array_intersect(F.array_except("old", "fields"), known)
    new = F.array_except(F.array_except("fields", "old"), known)
    swaps = per.where("old_id IS NOT NULL").select("feed", "file_id", "old_id", gone.alias("gone"), new.alias("new")).where("size(gone) > 0 AND size(new) > 0")
    swaps = materialize(swaps, "swaps")
    if swaps.isEmpty():
        return raw.sparkSession.createDataFrame([], "feed string, header string, field string")
    wanted = swaps.select(F.explode(F.array("file_id", "old_id")).alias("file_id")).distinct()
    doc = F.from_json("payload", "map<string,string>")
    cells = (
        raw.join(small(wanted), "file_id", "left_semi").select("file_id", F.explode(doc).alias("header", "value"), doc.alias("doc"))
        .withColumns({"field": field_of(F.col("header")), "value": F.lower(F.trim("value"))}).where("value <> ''")
    )
    reports = ruled.where("field = 'report_no'").groupBy("file_id").agg(F.min("header").alias("no_header"))
    cells = cells.join(small(reports), "file_id", "left").select("file_id", "field", "value", F.expr("try_element_at(doc, no_header)").alias("report")).distinct()
    cells = materialize(cells, "cells")
    pairs = swaps.select("feed", "file_id", "old_id", F.explode("gone").alias("gone"), "new").withColumn("new", F.explode("new"))
    now = pairs.join(cells.select("file_id", F.col("field").alias("new"), "value", "report"), ["file_id", "new"])
    old = pairs.join(cells.select(F.col("file_id").alias("old_id"), F.col("field").alias("gone"), F.col("value").alias("was"), "report"), ["old_id", "gone"])
    by = ["feed", "file_id", "gone", "new"]
    met = now.where("report IS NOT NULL").join(old.select(*by, "report", "was"), [*by, "report"])
    met = met.groupBy(*by).agg(F.count_distinct("report").alias("met"), F.count_distinct(F.when(F.col("value") == F.col("was"), F.col("report"))).alias("alike"))
    sets = now.select(*by, "value", F.lit(1).alias("side")).union(old.select(*by, F.col("was").alias("value"), F.lit(2).alias("side"))).distinct()
    sets = sets.groupBy(*by, "value").agg(F.count("*").alias("sides")).groupBy(*by).agg(F.avg((F.col("sides") == 2).cast("int")).alias("overlap"), F.sum((F.col("sides") == 2).cast("int")).alias("common"))
    judged = sets.join(met, by, "left").withColumn("share", F.coalesce(F.col("alike") / F.col("met"), F.lit(0.0)))
    judged = judged.where(((F.col("met") >= SAME_REPORTS) & (F.col("share") >= SAME_VALUES)) | ((F.col("common") >= KINDS) & (F.col("overlap") >= SAME_KINDS)))
    best = judged.groupBy("feed", "new").agg(F.max_by("gone", F.struct("share", "overlap", "gone")).alias("field"))
    return best.select("feed", F.col("new").alias("header"), "field")


def registry(raw: DataFrame) -> DataFrame:
    """(feed, file_seq, file_id, fingerprint, version, fields, steps): a row for each file.

    ``fields``: field -> (headers, the main one first, and kind). ``steps``: the migration steps from the file before, each (op, field, was, now, headers);
    a feed's first file adds all its fields. The payloads are parsed once (files in which a header may have taken a field's place, twice).
    """
    heads = materialize(headers(raw), "headers")
    by = ["feed", "file_seq", "file_id"]
    named = heads.join(small(taken_places(raw, heads)), ["feed", "header"], "left").withColumn("field_name", F.coalesce("field", field_of(F.col("header"))))
    kinds = named.where("kind <> 'null'").groupBy(*by, "field_name", "kind").agg(F.sum("n").alias("n")).groupBy(*by, "field_name").agg(F.min_by("kind", F.struct(-F.col("n"), "kind")).alias("kind"))
    names = named.where("header IS NOT NULL").groupBy(*by, "field_name", "header").agg(F.sum("n").alias("n"))
    names = names.groupBy(*by, "field_name").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "header"))), lambda x: x["header"]).alias("headers"))
    entry = F.struct("field_name", F.struct("headers", "kind").alias("at"))
    fields = names.join(kinds, [*by, "field_name"], "left").groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fields"))
    per = heads.select(*by).distinct().join(fields, "file_id", "left").withColumn("fields", F.expr("coalesce(fields, map())"))
    line = F.transform(F.map_entries("fields"), lambda e: F.concat_ws("\t", e["key"], F.array_join(e["value"]["headers"], "|"), F.coalesce(e["value"]["kind"], F.lit("-"))))
    per = per.withColumn("fingerprint", F.sha2(F.array_join(line, "\n"), 256)).withColumns({"old": F.lag("fields").over(_order()), "old_print": F.lag("fingerprint").over(_order())})
    per = per.withColumn("version", F.sum(F.when(F.col("old_print") == F.col("fingerprint"), 0).otherwise(1)).over(_order()))
    step = lambda cond, op, was, now: f"CASE WHEN {cond} THEN named_struct('op', '{op}', 'field', f, 'was', {was}, 'now', {now}, 'headers', fields[f].headers) END"
    had, has = "coalesce(map_contains_key(old, f), false)", "map_contains_key(fields, f)"
    h0, h1, k0, k1 = "old[f].headers[0]", "fields[f].headers[0]", "old[f].kind", "fields[f].kind"
    ops = [
        step(f"NOT {had}", "add", "CAST(NULL AS string)", h1), step(f"NOT {has}", "default", h0, "CAST(NULL AS string)"), step(f"{had} AND {has} AND {h0} <> {h1}", "rename", h0, h1),
        step(f"{had} AND {has} AND {h0} = {h1} AND old[f].headers <> fields[f].headers", "alias", h0, h1), step(f"{had} AND {has} AND {k0} <> {k1}", "cast", k0, k1),
    ]
    names_ = "array_sort(array_union(coalesce(map_keys(old), array()), map_keys(fields)))"
    steps = f"filter(flatten(transform({names_}, f -> array({', '.join(ops)}))), s -> s IS NOT NULL)"
    return materialize(per.withColumn("steps", F.expr(steps)).select(*by, "fingerprint", "version", "fields", "steps", F.col("old").isNull().alias("first")), "registry")


#: What a migration step is called in a report of changes.
CHANGE_OF = {"add": "added", "default": "removed", "rename": "renamed", "cast": "type_changed"}


def changes(raw: DataFrame) -> DataFrame:
    """(feed, file_id, field_name, change_kind, was, now): the migration steps of every file but the first of its feed."""
    steps = registry(raw).where("NOT first").select("feed", "file_id", F.explode("steps").alias("s"))
    kind = reduce(lambda c, kv: c.when(F.col("s.op") == kv[0], kv[1]), list(CHANGE_OF.items())[1:], F.when(F.col("s.op") == "add", "added"))
    return steps.select("feed", "file_id", F.col("s.field").alias("field_name"), kind.alias("change_kind"), F.col("s.was").alias("was"), F.col("s.now").alias("now")).where("change_kind IS NOT NULL")


def versions(raw: DataFrame) -> DataFrame:
    """(feed, file_id, file_seq, fingerprint, version, n_fields, steps): the schema version each file has.

    The version counts the changes of fingerprint within the feed; ``steps`` are the migration steps from the file before, as text.
    """
    said = (
        F.when(F.col("x.op") == "rename", F.concat(F.lit("rename "), "x.was", F.lit(" -> "), "x.now"))
        .when(F.col("x.op") == "cast", F.concat(F.lit("cast "), "x.field", F.lit(": "), "x.was", F.lit(" -> "), "x.now"))
        .when(F.col("x.op") == "default", F.concat(F.lit("default "), "x.field", F.lit(" = null")))
        .otherwise(F.concat("x.op", F.lit(" "), "x.field"))
    )
    told = registry(raw).withColumn("x", F.explode_outer(F.when(~F.col("first"), F.col("steps"))))
    return told.groupBy("feed", "file_id", "file_seq", "fingerprint", "version", F.size("fields").cast("long").alias("n_fields")).agg(F.array_sort(F.collect_list(said)).alias("steps"))


def routes(registered: DataFrame) -> DataFrame:
    """(file_id, route): field -> its headers at the version of each file, by folding the steps of its feed in order.

    ``add``, ``rename`` and ``alias`` set a field's headers, ``default`` takes them away, ``cast`` leaves them.
    """
    step = registered.select("feed", "file_seq", "file_id", F.explode("steps").alias("s")).where("s.op <> 'cast'").select("feed", "file_seq", "file_id", F.col("s.field").alias("field"), F.col("s.headers").alias("headers"))
    files = registered.select("feed", "file_seq", "file_id").join(step.select("feed", "field").distinct(), "feed")
    last = F.last(F.when(F.col("moved"), F.struct("headers")), ignorenulls=True).over(_order("field").rowsBetween(Window.unboundedPreceding, 0))
    folded = files.join(step.withColumn("moved", F.lit(True)), ["feed", "file_seq", "file_id", "field"], "left").withColumn("at", last)
    return folded.where("at.headers IS NOT NULL").groupBy("file_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "at.headers")))).alias("route"))


def _words(text: Column) -> Column:
    """Text from a string, a list of sentences or {"body": ..}."""
    return F.when(text.startswith("["), F.coalesce(F.array_join(F.from_json(text, "array<string>"), " "), text)).when(text.startswith("{"), F.coalesce(F.get_json_object(text, "$.body"), text)).otherwise(text)


def unified(raw: DataFrame) -> DataFrame:
    """All lines with the canonical columns, cast to one type each, and a map of the other fields; routed by the folded steps of their file.

    Lines meet the route of their file in one join; routes are a small written table, broadcast while their number allows.
    """
    route = materialize(routes(registry(raw)), "routes")
    lines = raw.select("file_id", "feed", "file_seq", "file_name", "acquired_at", "row_no", F.from_json("payload", "map<string,string>").alias("doc")).join(small(route), "file_id", "left")
    held = lambda field: f"try_element_at(filter(transform(try_element_at(route, {field}), h -> try_element_at(doc, h)), v -> v IS NOT NULL), 1)"
    out = lines.withColumns({f"_{c}": F.expr(held(f"'{c}'")) for c in CANONICAL})
    typed: dict[str, Column] = {c: F.col(f"_{c}") for c in CANONICAL}
    typed["comments"] = _words(F.col("_comments"))
    typed["duration_seconds"] = F.expr("try_cast(trim(_duration_seconds) AS double)")
    for c in ("latitude", "longitude"):
        pair = f"from_json(_{c}, 'array<double>')"
        typed[c] = F.expr(
            f"CASE WHEN _{c} LIKE '[%' THEN {pair}[0] + CASE WHEN {pair}[0] < 0 THEN -coalesce({pair}[1], 0) ELSE coalesce({pair}[1], 0) END / 60 "
            f"WHEN _{c} LIKE '{{%' THEN try_cast(get_json_object(_{c}, '$.deg') AS double) ELSE try_cast(trim(_{c}) AS double) END"
        )
    own = "array(" + ", ".join(f"'{c}'" for c in CANONICAL) + ")"
    extras = F.expr(f"map_from_entries(transform(filter(map_keys(coalesce(route, map())), f -> NOT array_contains({own}, f) AND exists(route[f], h -> map_contains_key(doc, h))), f -> struct(f, {held('f')})))")
    return out.select("file_id", "feed", "file_seq", "file_name", "acquired_at", "row_no", *[typed[c].alias(c) for c in CANONICAL], extras.alias("other_fields"))
