import pandas as pd
import pytest

from reportmill.sources import html, readers, writers
from reportmill.streaming import bursts

INDEX = """<html><table><tr><th>x</th></tr>
<tr><td><a href="/s/?id=111">Open</a></td><td>1/1/2000</td><td>A</td><td>TX</td><td>USA</td><td>Light</td><td>sum</td><td>1/2/2000</td><td></td><td></td></tr>
<tr><td><a href="/s/?id=114">Open !</a></td><td>1/1/2000</td><td>B</td><td>TX</td><td>USA</td><td>Light</td><td>sum</td><td>1/2/2000</td><td></td><td></td></tr>
<tr><td><a href="/s/?id=149">Open</a></td><td>1/1/2000</td><td>C</td><td>TX</td><td>USA</td><td>Light</td><td>sum</td><td>1/2/2000</td><td>Y</td><td>Aircraft</td></tr>
<tr><td>short</td></tr></table><table><tr><td><a href="?id=9">x</a></td></tr></table></html>"""
DETAIL = "<main><p>Occurred: 2000-01-01 20:00</p><p>Shape: Light</p><p>Shape: Disk</p><p>Duration: 5 min</p><p>We saw &amp; heard it.</p><p>Then it left.</p></main><footer>end</footer>"


def test_index(spark):
    got = html.parse_index(spark.createDataFrame([(INDEX,), ("<p>none</p>",), (None,), ("",)], "html string")).collect()
    assert [(r.sighting_id, r.is_tier1, r.explanation) for r in got] == [(111, False, ""), (114, True, ""), (149, False, "Aircraft")]


def test_detail(spark):
    a, b = html.parse_details(spark.createDataFrame([(1, DETAIL), (2, None)], "sighting_id long, html string")).collect()
    assert (a.occurred, a.shape, a.duration, a.narrative) == ("2000-01-01 20:00", "Disk", "5 min", "We saw & heard it.\nThen it left.") and (b.occurred, b.narrative) == ("", "")


def test_csv_encodings_and_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('city,text \n"Köln, x","a ""b""\nc"\n'.encode("latin-1"))
    r = readers.csv(spark, str(tmp_path / "a.csv"))
    assert r.columns == ["city", "text "] and tuple(r.first()) == ("Köln, x", 'a "b"\nc')
    (tmp_path / "b.csv").write_text("city\nKöln\n", encoding="utf-8")
    assert readers.csv(spark, str(tmp_path / "b.csv")).first().city == "Köln"


def test_jsonl_counts_malformed_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"sighting_id": 1, "shape": "x"}\n\n{bad\n   \n{"sighting_id": 2}\n')
    good, bad = readers.jsonl(spark, str(tmp_path / "a.jsonl"), "sighting_id long, shape string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, "x"), (2, None)] and bad.count() == 1
    assert readers.reports(spark, str(tmp_path / "a.jsonl")).count() == 2


def test_gazetteer_headers(spark, tmp_path):
    (tmp_path / "g.tsv").write_text("USPS\tNAME\tINTPTLAT\tINTPTLONG   \nTX\tAustin city\t30.2\t-97.7  \nTX\tBad\tx\t1\n")
    assert [tuple(r) for r in readers.gazetteer_tsv(spark, str(tmp_path / "g.tsv")).collect()] == [("TX", "Austin city", 30.2, -97.7), ("TX", "Bad", None, 1.0)]


def test_absent_table_reads_as_empty(spark, tmp_path):
    assert readers.parquet(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.parquet(spark, str(tmp_path / "none"))


def test_upsert_and_pending(spark):
    old = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([("b", 2, 1), ("b", 3, 2), ("c", 4, 1)], "k string, v int, t int")
    assert sorted((r.k, r.v) for r in writers.upserted(old, new, "k", "t").collect()) == [("a", 1), ("b", 3), ("c", 4)]
    assert [r.k for r in readers.pending(new, old, "k").collect()] == ["c"]


def test_writers_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    writers.parquet(df, str(tmp_path / "p"))
    writers.csv(df, str(tmp_path / "c"))
    writers.append_jsonl(df, str(tmp_path / "j"))
    writers.append_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2 and pd.read_csv(next((tmp_path / "c").glob("*.csv"))).shape == (1, 2)
    (tmp_path / "x.bin").write_bytes(b"abc")
    row = writers.provenance(spark, str(tmp_path / "x.bin")).first()
    assert row.bytes == 3 and row.sha256.startswith("ba7816bf")


def test_stream_gives_the_weeks_of_the_table(spark, folder, tmp_path):
    table = spark.read.parquet(f"{folder}/events.parquet")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    bursts.run_once(bursts.weekly_counts(stream, late="60 days"), str(tmp_path / "out"), str(tmp_path / "cp"))
    last = bursts.weekly_counts(table)
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got <= {tuple(r) for r in last.collect()}
    assert bursts.alerts(last, last.groupBy("event_type").avg("reports").toDF("event_type", "baseline_weekly"), ratio=1.0).count() > 0


def test_encoding_is_decided_by_every_line_of_every_file(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_bytes(b"city\n" + b"plain town\n" * 120_000 + "Köln\n".encode("latin-1"))
    (tmp_path / "d" / "b.csv").write_text("city\nZürich\n", encoding="utf-8")
    (tmp_path / "d" / "c d.csv").write_bytes("city\nMünchen\n".encode("latin-1"))
    got = {r.city for r in readers.csv(spark, str(tmp_path / "d")).distinct().collect()}
    assert got == {"plain town", "Köln", "Zürich", "München"}
    latin, utf8 = readers.encodings(spark, str(tmp_path / "d"))
    assert [f.rsplit("/")[-1] for f in latin] == ["a.csv", "c d.csv"] and [f.rsplit("/")[-1] for f in utf8] == ["b.csv"]


def test_a_table_is_not_written_where_it_is_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, v int")
    writers.parquet(df, str(tmp_path / "t"))
    with pytest.raises(ValueError, match="read and written"):
        writers.parquet(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t"))
    writers.parquet(spark.read.parquet(str(tmp_path / "t")), str(tmp_path / "t2"))
    assert spark.read.parquet(str(tmp_path / "t2")).count() == 1


def test_guards(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="missing"):
        readers.required(spark, str(tmp_path / "none"))
    df = spark.createDataFrame([("a",)], "k string")
    assert readers.nonempty(df, "cleaning") is df
    with pytest.raises(ValueError, match="cleaning"):
        readers.nonempty(df.limit(0), "cleaning")


def test_provenance_of_large_files_and_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "x.bin").write_bytes(b"abc")
    small_ = writers.provenance(spark, str(tmp_path / "x.bin")).first()
    monkeypatch.setattr(writers, "ONE_VALUE", 1)
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    large = writers.provenance(spark, str(tmp_path / "x.bin"), rows).first()
    assert (large.sha256, large.bytes, large.n_rows, large.schema) == (small_.sha256, 3, 1, "struct<k:string,v:int>") and small_.n_rows is None and large.acquired_at


def test_cached_views_expire(spark):
    made = [spark.createDataFrame([(k,)], "v int") for k in range(3)]
    assert readers.cached_view(made[0], "kept", 60).first().v == 0 and readers.cached_view(made[1], "kept", 60).first().v == 0
    assert readers.cached_view(made[2], "kept", 0).first().v == 2 and spark.table("kept").first().v == 2


def test_work_lists(spark):
    ids = spark.createDataFrame([(k % 10,) for k in range(30)] + [(None,)], "id int")
    assert [r.id for r in readers.work_list(ids, "id", 4, 3).collect()] == [4, 5, 6] and readers.work_list(ids, "id").count() == 11


def test_details_can_be_stamped(spark):
    row = html.parse_details(spark.createDataFrame([(1, DETAIL)], "sighting_id long, html string"), stamp=True).first()
    assert row.shape == "Disk" and pd.Timestamp(row.scraped_at).tzname() == "UTC"
