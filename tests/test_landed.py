"""The data source of landed responses: batch, filters, stream by marks, and the three disclosure endpoints."""

import json

import pytest
from pyspark.sql import functions as F

from braidwork.sources import landed, readers

FEED = "<rss><channel><item><title>{}</title><link>http://a/{}</link><pubDate>d</pubDate></item></channel></rss>"


def land(root, source, number, body=None, status=200, etag=None, last_modified=None):
    folder = root / source
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{number:012d}.json").write_text(json.dumps({"status": status, "etag": etag, "last_modified": last_modified, "body": body}))


def seen(rows):
    return sorted((r["source_id"], r["number"]) for r in rows)


def test_batch_reads(spark, tmp_path, monkeypatch):
    """Repeated marks and 304 bring nothing, also where a partition ends between them; no marks always bring something."""
    for n, tag in enumerate(["x", None, "x", "y", None, "x"]):
        land(tmp_path, "a", n, "body", 304 if tag is None else 200, tag)
    for n in range(3):
        land(tmp_path, "b", n, "same")
    land(tmp_path, "c", 0, "old", last_modified="Mon")
    land(tmp_path, "c", 7, "new", last_modified="Tue")
    (tmp_path / "c" / "notes.txt").write_text("no response")
    want = [("a", 0), ("a", 3), ("a", 5), ("b", 0), ("b", 1), ("b", 2), ("c", 0), ("c", 7)]
    assert seen(landed.responses(spark, str(tmp_path)).collect()) == want
    for files in (1, 2, 5):
        monkeypatch.setattr(landed, "FILES", files)
        reader = landed.BatchReader(f"file://{tmp_path}")
        assert sorted(r[:2] for p in reader.partitions() for r in reader.read(p)) == want
    assert landed.responses(spark, str(tmp_path / "none")).count() == 0


def test_filters_choose_folders(spark, tmp_path):
    for s in ("a", "b", "c"):
        land(tmp_path, s, 1, s)
    (tmp_path / "c" / "000000000002.json").write_text("not json")  # reading it would fail
    df = landed.responses(spark, str(tmp_path))
    assert seen(df.where("source_id = 'a'").collect()) == [("a", 1)]
    assert seen(df.where("source_id in ('a', 'b') and number > 0 and source_id <> 'a'").collect()) == [("b", 1)]
    assert df.where("source_id = 'z'").count() == 0
    reader = landed.BatchReader(str(tmp_path))
    rest = list(reader.pushFilters([landed.EqualTo(("source_id",), "a"), landed.EqualTo(("status",), 200)]))
    assert [p.source for p in reader.partitions()] == ["a"] and [f.attribute for f in rest] == [("status",)]


def test_stream_by_marks(spark, tmp_path):
    """Three runs over growing folders, each from the marks of the one before; one that finds nothing new makes no batch."""
    root, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        s = readers.feed_items(landed.responses(spark, str(root), stream=True).select("source_id", F.lit("o").alias("outlet"), F.col("body").alias("xml")))
        q = s.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["title"] for r in spark.read.schema(s.schema).parquet(out).collect())

    land(root, "a", 1, FEED.format("A1", 1), etag="e1")
    land(root, "b", 1, FEED.format("B1", 1), last_modified="m1")
    assert run() == ["A1", "B1"]
    land(root, "a", 2, None, 304, "e1")
    land(root, "b", 2, FEED.format("B1 again", 1), last_modified="m1")
    assert run() == ["A1", "B1"]
    land(root, "a", 3, FEED.format("A2", 2), etag="e2")
    land(root, "c", 1, FEED.format("C1", 1))
    assert run() == ["A1", "A2", "B1", "C1"]


def test_offsets_hold_marks(tmp_path):
    land(tmp_path, "a", 1, "x", etag="e1")
    s = landed.StreamReader(str(tmp_path))
    first = s.latestOffset()
    assert first == {"a": {"number": 1, "etag": "e1", "last_modified": None}}
    land(tmp_path, "a", 2, None, 304, "e1")
    land(tmp_path, "a", 3, "x", etag="e1")
    assert s.latestOffset() == first
    land(tmp_path, "a", 4, "y", etag="e2")
    land(tmp_path, "a", 5, None, 304, "e2")
    second = s.latestOffset()
    assert second["a"]["number"] == 4
    again = landed.StreamReader(str(tmp_path))  # after a restart
    assert [r[1] for p in again.partitions(first, second) for r in again.read(p)] == [4]
    assert [r[1] for p in again.partitions({}, second) for r in again.read(p)] == [1, 4]
    assert again.latestOffset() == second


def test_disclosure_endpoints(spark, tmp_path):
    ok = lambda **x: json.dumps({"status": "000", "message": "ok", **x})
    none, bad = json.dumps({"status": "013", "message": "no data"}), json.dumps({"status": "020", "message": "limit"})
    land(tmp_path / "o", "001", 1, ok(corp_name="N", est_dt="19700101"))
    land(tmp_path / "o", "002", 1, none)
    o = {r["source_id"]: (r["status"], r["corp_name"], r["est_dt"]) for r in landed.overviews(landed.responses(spark, str(tmp_path / "o"))).collect()}
    assert o == {"001": ("000", "N", "19700101"), "002": ("013", None, None)}
    land(tmp_path / "s", "001", 1, ok(list=[{"nm": "x", "trmend_posesn_stock_qota_rt": "5.1"}, {"nm": "y"}]))
    land(tmp_path / "s", "002", 1, none)
    land(tmp_path / "s", "003", 1, ok())
    s = landed.shareholders(landed.responses(spark, str(tmp_path / "s"))).collect()
    assert [(r["source_id"], r["ordinal"], r["nm"], r["trmend_posesn_stock_qota_rt"]) for r in s] == [("001", 0, "x", "5.1"), ("001", 1, "y", None)]
    land(tmp_path / "d", "001", 1, ok(list=[{"report_nm": "r1"}, {"report_nm": "r2"}], total_count=2))
    land(tmp_path / "d", "002", 1, none)
    d = landed.disclosures(landed.responses(spark, str(tmp_path / "d"))).collect()
    assert [(r["source_id"], r["report_nm"]) for r in d] == [("001", "r1"), ("001", "r2")]
    for folder, parse in (("o", landed.overviews), ("s", landed.shareholders), ("d", landed.disclosures)):
        land(tmp_path / folder, "009", 1, bad)
        with pytest.raises(Exception, match="status 020 limit"):
            parse(landed.responses(spark, str(tmp_path / folder))).collect()
        land(tmp_path / folder, "009", 1, "<html>")
        with pytest.raises(Exception, match="status missing"):
            parse(landed.responses(spark, str(tmp_path / folder))).collect()
