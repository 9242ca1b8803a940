import datetime as dt
import http.server
import io
import json
import threading
import urllib.parse
import zipfile

import pytest

from barloom.operators.cleaning import clock_report
from barloom.sources import http as web
from barloom.sources import readers, sinks
from barloom.streaming import bars as streaming

T0 = dt.datetime(2024, 1, 1)


def test_headerless_bars_keep_rows_with_unreadable_fields(spark, tmp_path):
    (tmp_path / "A_1.csv").write_text("2024-01-01 00:00:00,1,2,0.5,1.5,10,15,5,7,3\n2024-01-01 00:01:00,x,2,0.5,1.5,10,15,5,7,3\n")
    (tmp_path / "A_2.csv").write_text("2024-01-01 00:02:00,1,2\n")
    rows = readers.csv_bars(spark, f"{tmp_path}/A_*.csv").orderBy("ts").collect()
    assert [r.open for r in rows] == [1.0, None, 1.0] and rows[2].close is None and rows[0].trades == 3


def test_zipped_files_with_and_without_header(spark, tmp_path):
    def put(name, text):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, text)
        (tmp_path / f"{name}.zip").write_bytes(b.getvalue())

    put("a", "calc_time,hours,rate\n1704067200000,8,0.0001\n")
    put("b", "1704096000000,8,\n1704124800000,x,0.0003\n")
    put("c", "")
    (tmp_path / "d.zip").write_bytes(b"no archive")
    d = readers.zipped_csv(spark, f"{tmp_path}/*.zip", ["calc_time", "funding_interval_hours", "last_funding_rate"], "calc_time bigint, funding_interval_hours bigint, last_funding_rate double")
    rows = sorted((r[0], r[1], r[2]) for r in d.collect())
    assert rows == [(1704067200000, 8, 0.0001), (1704096000000, 8, None), (1704124800000, None, 0.0003)]
    s = readers.settlements([d, d]).orderBy("ts").collect()
    assert [r.ts for r in s] == [T0, T0 + dt.timedelta(hours=8), T0 + dt.timedelta(hours=16)]


def test_archives_with_several_members_and_broken_ones(spark, tmp_path):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("one.csv", "a,b\n1,2\n")
        z.writestr("dir/", "")
        z.writestr("two.csv", "3,4\n5,6\n")
        z.writestr("three.csv", b"\xff\xfe\xfd")
    (tmp_path / "many.zip").write_bytes(b.getvalue())
    (tmp_path / "none.zip").write_bytes(b"no archive")
    d = readers.zipped_csv(spark, f"{tmp_path}/*.zip", ["a", "b"], "a bigint, b bigint")
    assert sorted((r.a, r.b) for r in d.collect()) == [(1, 2), (3, 4), (5, 6)]
    bad = {(r.path.rsplit("/", 1)[-1], r.member) for r in readers.broken_archives(readers.archives(spark, f"{tmp_path}/*.zip")).collect()}
    assert bad == {("many.zip", "three.csv"), ("none.zip", None)}


def test_klines(spark):
    s = "symbol string, open_time bigint, open double, high double, low double, close double, volume double, quote_volume double, trades bigint, n bigint"
    rows = [("A", 0, 1.0, 1.0, 1.0, c, v, 1.0, 1, i) for i, (c, v) in enumerate([(5.0, 0.0), (6.0, 1.0)])] + [("A", m, 1.0, 1.0, 1.0, c, v, 1.0, 1, 9) for m, c, v in ((60000, 0.0, 1.0), (120000, 1.0, -1.0), (180000, None, 1.0), (240000, float("nan"), 1.0), (300000, 2.0, 0.0))] + [("B", None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1)]
    got = sorted((r.symbol, r.ts.minute, r.close) for r in readers.klines(spark.createDataFrame(rows, s), order=["n"], source="symbol").collect())
    assert got == [("A", 0, 5.0), ("A", 5, 2.0)]


@pytest.fixture
def archive():
    """A listing of 250 keys in pages of 100, and files of which some fail twice before they come."""
    failed = {}
    keys = [f"data/S{i // 50}/m{i:03d}.zip" for i in range(250)]

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            url = urllib.parse.urlparse(self.path)
            q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query, keep_blank_values=True).items()}
            code, body = 200, b"x" + url.path.encode()
            if url.path == "/list":
                if q.get("delimiter"):
                    found = sorted({"data/" + k.split("/")[1] + "/" for k in keys})
                    body = "".join(f"<CommonPrefixes><Prefix>{k}</Prefix></CommonPrefixes>" for k in found if k > q["marker"])
                    body = f'<R xmlns="urn:x"><IsTruncated>false</IsTruncated>{body}</R>'.encode()
                else:
                    left = [k for k in keys if k.startswith(q["prefix"]) and k > q["marker"]]
                    body = f"<R><IsTruncated>{str(len(left) > 100).lower()}</IsTruncated>{''.join(f'<Contents><Key>{k}</Key></Contents>' for k in left[:100])}</R>".encode()
            elif "gone" in url.path:
                code = 404
            elif "never" in url.path:
                code = 503
            elif "denied" in url.path:
                code = 403
            elif "late" in url.path and failed.setdefault(url.path, 0) < 2:
                failed[url.path] += 1
                code = 503
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", keys
    server.shutdown()


def test_listings_and_files_over_http(spark, archive):
    base, keys = archive
    assert list(web.listing(f"{base}/list", "data/")) == keys
    assert list(web.listing(f"{base}/list", "data/S3/")) == keys[150:200]
    assert list(web.listing(f"{base}/list", "data/", delimiter="/")) == [f"data/S{i}/" for i in range(5)]
    waits = []
    assert web.fetch(f"{base}/late", sleep=waits.append) == b"x/late" and waits == [1.0, 2.0]
    assert web.fetch(f"{base}/gone") is None
    with pytest.raises(Exception, match="503"):
        web.fetch(f"{base}/never", tries=2, sleep=waits.append)
    with pytest.raises(Exception, match="403"):
        web.fetch(f"{base}/denied", sleep=waits.append)
    urls = spark.createDataFrame([(f"{base}/{k}",) for k in ("a", "gone", "late2", "b")], "url string")
    got = {r.path.rsplit("/", 1)[-1]: bytes(r.content) for r in web.fetched(urls, pause=0.01).collect()}
    assert got == {"a": b"x/a", "late2": b"x/late2", "b": b"x/b"}


def test_settlements_of_different_symbols_stay_apart(spark):
    d = spark.createDataFrame([("A", 1704067200000, 0.1, 8), ("A", 1704067200000, 0.2, 8), ("B", 1704067200000, 0.3, 4)], "symbol string, ms bigint, rate double, hours bigint")
    s = readers.settlements([d], ms="ms", rate="rate", hours="hours", source="symbol").collect()
    assert sorted((r.symbol, r.ts, r.funding_rate, r.interval_hours) for r in s) == [("A", T0, 0.1, 8), ("B", T0, 0.3, 4)]


def test_json_sources(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"at": "2", "n": 1}\nbroken\n[1]\n{"at": "9", "n": 2}\n{"at": "5"}\n')
    rows = readers.json_lines(spark, f"{tmp_path}/log.jsonl", "at string, n int", "at", 2).collect()
    assert [r.at for r in rows] == ["9", "5"]
    for i, fam in enumerate(("open", "shut")):
        (tmp_path / f"H{i}.json").write_text(json.dumps({"id": f"H{i}", "family": fam, "universe": ["A", "B"]}, indent=1))
    reg = readers.json_registry(spark, f"{tmp_path}/H*.json", "id string, family string, universe array<string>", spark.createDataFrame([("shut",)], "family string"))
    assert [r.id for r in reg.collect()] == ["H0"] and readers.registered_universe(reg).count() == 2


def test_ingest_views(spark):
    s = "symbol string, ts timestamp_ntz, open_interest double"
    rows = [("A", T0 + dt.timedelta(minutes=5 * i), 1.0) for i in range(288)] + [("A", T0 + dt.timedelta(days=1, minutes=5 * i), 1.0) for i in range(215)] + [("A", T0 + dt.timedelta(days=2), None)]
    d = spark.createDataFrame(rows, s)
    assert readers.complete_days(d).count() == 288
    want = spark.createDataFrame([("A", (T0 + dt.timedelta(days=k)).date()) for k in range(4)], "symbol string, day date")
    assert [r.day.day for r in readers.missing_days(want, d).collect()] == [4]
    new = spark.createDataFrame([("A", T0, 9.0), ("B", T0, 3.0)], s)
    got = {(r.symbol, r.ts): r.open_interest for r in readers.resumed(d, new).collect()}
    assert got[("A", T0)] == 9.0 and got[("B", T0)] == 3.0 and len(got) == 505
    months = spark.createDataFrame([("A", "2024-01"), ("A", "2024-03"), ("B", "2024-02")], "symbol string, month string")
    life = {r.symbol: (r.first_month, r.last_month, r.still_listed) for r in readers.lifecycle(months, spark.createDataFrame([("A",)], "symbol string")).collect()}
    assert life == {"A": ("2024-01", "2024-03", True), "B": ("2024-02", "2024-02", False)}
    two = spark.createDataFrame([("A", T0), ("A", T0 + dt.timedelta(hours=1)), ("B", T0), ("B", T0 + dt.timedelta(hours=9))], "symbol string, ts timestamp_ntz")
    assert {r.symbol for r in readers.load_valid(two, lambda p: clock_report(p, 60)).collect()} == {"A"}


def test_table_rows_by_milliseconds(spark):
    d = readers.table_bars(spark.createDataFrame([("A", 1704067200000, 1.0), ("B", 0, 2.0)], "symbol string, open_time bigint, close double"), symbol="A")
    assert [(r.ts, r.close) for r in d.collect()] == [("2024-01-01 00:00:00", 1.0)]


def test_panel_datasets_and_bundles(spark, tmp_path):
    p = spark.createDataFrame([(s, T0 + dt.timedelta(days=i), float(i)) for s in "ABCDE" for i in range(4)], "symbol string, ts timestamp_ntz, close double")
    path = f"file://{tmp_path}/panel"
    assert sinks.write_panel(p, path, clock="1h") == []
    sinks.write_panel(p.where("symbol = 'A'"), path, clock="1m")
    assert sinks.read_panel(spark, path, clock="1h").count() == 20
    assert sinks.read_panel(spark, path, clock="1h", sources=["A", "C"]).count() == 8
    assert sinks.read_panel(spark, path, clock="1m").count() == 4
    # One source anew: the others stay; a full build prunes those it lacks, of its own clock alone.
    sinks.write_panel(p.where("symbol = 'B'").limit(1), path, clock="1h")
    assert sinks.read_panel(spark, path, clock="1h").count() == 17
    assert sinks.write_panel(p.where("symbol < 'D'"), path, clock="1h", full=True) == ["D", "E"]
    assert sinks.read_panel(spark, path, clock="1h").count() == 12 and sinks.read_panel(spark, path, clock="1m").count() == 4
    assert {(r.clock, r.symbol) for r in sinks.panel_catalog(spark, path).collect()} == {("1h", "A"), ("1h", "B"), ("1h", "C"), ("1m", "A")}
    odd = spark.createDataFrame([("1000", T0, 1.0), ("2024-01-01", T0, 2.0), ("a/b", T0, 3.0)], p.schema)
    sinks.write_panel(odd, f"{path}2", clock="1h")
    assert {r.symbol: r.close for r in sinks.read_panel(spark, f"{path}2", clock="1h").collect()} == {"1000": 1.0, "2024-01-01": 2.0, "a/b": 3.0}
    with pytest.raises(ValueError):
        sinks.write_panel(p.withColumn("symbol", sinks.F.lit(None).cast("string")), f"{path}3", clock="1h")
    m = sinks.export_bundle(p, f"file://{tmp_path}/bundle", seal="2024-01-03").collect()
    assert {r.symbol for r in m} == set("ABCDE") and all(r.rows == 2 and str(r.last_ts) < "2024-01-03" for r in m)
    with pytest.raises(Exception):
        sinks.export_bundle(p, f"file://{tmp_path}/bundle", seal="2024-01-03")
    sinks.append_json(p, f"file://{tmp_path}/log")
    sinks.append_json(p, f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 40
    text = sinks.markdown(p.orderBy("symbol", "ts").limit(1), "Bars")
    assert text.startswith("## Bars") and "| A |" in text and "there are more" not in text
    assert "The first 3 rows" in sinks.markdown(p, "Bars", limit=3)


def test_streaming_tumble_takes_late_bars_and_drops_repeats(spark, tmp_path):
    s = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    bar = lambda m, v=1.0: ("A", T0 + dt.timedelta(minutes=m), 1.0 + m, 2.0 + m, 0.5 + m, 1.5 + m, v)
    for k, rows in enumerate([[bar(0), bar(1), bar(1), bar(59)], [bar(30, 7.0), bar(61)], [bar(400)], [bar(2, 99.0)], [bar(1000)]]):
        spark.createDataFrame(rows, s).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = streaming.bar_stream(spark, f"{tmp_path}/in/*", s)
    q = streaming.streaming_tumble(stream).writeStream.format("memory").queryName("tumbled").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        rows = {r.ts: r for r in spark.table("tumbled").collect()}
    finally:
        q.stop()
    first = rows[T0]
    assert (first.open, first.close, first.minutes_present, first.volume) in {(1.0, 60.5, 4, 10.0), (1.0, 60.5, 5, 109.0)}


def test_heartbeats(spark, tmp_path):
    spark.createDataFrame([("w", T0 + dt.timedelta(minutes=m)) for m in (0, 10, 20, 90, 95, 900)], "worker string, ts timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/hb/0")
    beats = streaming.bar_stream(spark, f"{tmp_path}/hb/*", "worker string, ts timestamp_ntz")
    q = streaming.heartbeat_gaps(beats).writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert sorted(r.beats for r in spark.table("beats").collect()) == [2, 3]
    finally:
        q.stop()
