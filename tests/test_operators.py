"""Operators on literal fixtures: traps, brute force, round trips."""

import datetime as dt
import hashlib
import io
import itertools
import random
import zipfile

from pyspark.sql import functions as F

from orrery.functions import scalars as S
from orrery.operators import classify, digest, graph, quality, reconcile, resolve, select, study, temporal
from orrery.sources import archive, fixed_text, html, json_arrays, store
from orrery.streaming import observations


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wall_clock_gap_and_overlap(spark):
    got = {w: one(spark, S.eastern_to_utc(F.lit(w).cast("timestamp"))).asDict() for w in ("2024-03-10 02:30:00", "2024-11-03 01:30:00", "2024-07-01 12:00:00", "2024-11-03 02:30:00")}
    assert [v["problem"] for v in got.values()] == ["gap", "overlap", None, None]
    assert got["2024-07-01 12:00:00"]["utc"] == dt.datetime(2024, 7, 1, 16)
    assert got["2024-03-10 02:30:00"]["utc"] is None


def test_identifiers_and_dates(spark):
    assert [one(spark, S.normalise_registrant(F.lit(x))) for x in ("CIK0000320193", "320193", "0", "10000000000", "abc", " 7 ")] == ["0000320193", "0000320193", None, None, None, "0000000007"]
    assert one(spark, S.parse_accession(F.lit("0000320193-24-000001"))).asDict() == {"filer": "0000320193", "year": "24", "sequence": "000001"}
    assert one(spark, S.parse_accession(F.lit("0000320193-24000001"))) is None
    assert [one(spark, S.strict_date(F.lit(x))) for x in ("2024-02-29", "2023-02-29", "20240101", "2024-1-1")] == [dt.date(2024, 2, 29), None, None, None]
    assert one(spark, S.circular_day_distance(F.lit("2023-12-31").cast("date"), F.lit("2024-01-01").cast("date"))) == 1
    assert one(spark, S.date_part(F.lit("20240131170000"))) == dt.date(2024, 1, 31)


def test_urls(spark):
    want = {"HTTP://Example.COM:80/a//./b?z=1&a=2#f": "http://example.com/a/b?a=2&z=1", "https://e.com": "https://e.com/", "https://e.com/a/": "https://e.com/a/", "https://e.com/a/../b": None, "ftp://e.com/": None}
    assert {u: one(spark, S.normalise_url(F.lit(u))) for u in want} == want


def test_resolution_states(spark):
    rows = [("a", 1, 2, False, "x"), ("a", 2, 1, False, "y"), ("b", 3, 1, False, "x"), ("b", 4, 1, False, " x "), ("c", 5, 1, False, "x"), ("c", 6, 1, False, None), ("d", 7, 4, False, "x"), ("e", 8, 1, False, "x"), ("e", 9, 1, True, "z")]
    df = spark.createDataFrame(rows, "k string, id long, level int, fix boolean, v string")
    got = {r["k"]: (r["status"], r["value"], r["n_winners"]) for r in resolve.resolve_field(df, ["k"], F.col("v"), F.col("level"), F.col("fix"), F.col("id")).collect()}
    assert got == {"a": ("resolved", "y", 1), "b": ("resolved", "x", 2), "c": ("unresolved", None, 0), "d": ("unresolved", None, 0), "e": ("resolved_by_correction", "z", 1)}


def test_upsert_and_insert(spark):
    old = spark.createDataFrame([(1, "a", 5, 2), (2, None, 1, 1)], "k long, first string, most long, total long")
    new = spark.createDataFrame([(1, "b", 3, 4), (2, "c", 9, 1), (3, "d", 0, 0)], "k long, first string, most long, total long")
    got = {tuple(r) for r in reconcile.upsert(old, new, "k", ["first"], ["most"], ["total"]).select("k", "first", "most", "total").collect()}
    assert got == {(1, "a", 5, 6), (2, "c", 9, 2), (3, "d", 0, 0)}
    made = reconcile.insert_new(spark.createDataFrame([], "row_id string"), new.union(new), ["k", "first"])
    assert made.count() == 3 and reconcile.insert_new(made, new, ["k", "first"]).count() == 0
    odd = spark.createDataFrame([(None, "a"), ("a", None), ("a|b", "c"), ("a", "b|c"), ("", None), (None, ""), ("null", "a"), ("a\\", "|b"), ("a", "\\|b")], "u string, v string")
    assert reconcile.insert_new(spark.createDataFrame([], "row_id string"), odd, ["u", "v"]).count() == 9
    a, b = (spark.createDataFrame(x, "k long, u string, v string") for x in ([(1, "ab", "c"), (2, None, "a"), (3, "x", "y")], [(1, "a", "bc"), (2, "a", None), (3, "x", "y")]))
    assert {r["k"]: r["change"] for r in reconcile.release_diff(a, b, "k", ["u", "v"]).collect()} == {1: "changed", 2: "changed"}


def test_chains(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 99), (5, 4), (6, 7), (7, 6), (8, 6), (9, 9)], "id long, parent long")
    got = {r["id"]: (r["root"], r["depth"], r["outcome"]) for r in graph.roots(df, "id", "parent").collect()}
    assert got == {1: (1, 0, "root"), 2: (1, 1, "resolved"), 3: (1, 2, "resolved"), 4: (4, 0, "missing_parent"), 5: (4, 1, "missing_parent"), 6: (None, None, "cycle"), 7: (None, None, "cycle"), 8: (None, None, "cycle"), 9: (None, None, "cycle")}


def test_selection_is_exact(spark):
    rng = random.Random(5)
    for trial in range(12):
        pool = [select.Candidate(i, rng.randint(0, 2), hashlib.sha256(f"{trial}|{i}".encode()).hexdigest(), (rng.choice("ab"), rng.choice("xyz")), rng.random() < 0.5) for i in range(11)]
        quotas = select.Quotas([{"a": 2, "b": 2}, {"x": 2, "y": 1, "z": 1}], flagged=2)
        best = None
        for c in itertools.combinations(pool, 4):
            if all(sum(m.cell[d] == v for m in c) == n for d, q in enumerate(quotas.exact) for v, n in q.items()) and sum(m.flag for m in c) >= 2:
                key = sum(m.penalty for m in c), sorted(m.rank for m in c)
                if best is None or key < best[0]:
                    best = key, [m.id for m in sorted(c, key=lambda m: m.rank)]
        got = select.choose(pool, quotas)
        assert (got.status, got.members) == (("feasible", best[1]) if best else ("infeasible", []))
    assert select.choose(pool, quotas, node_limit=3).status == "infeasible_or_unproven"


def test_filing_choice_is_exact():
    rng = random.Random(9)
    for trial in range(12):
        pool = [select.Filing(i, rng.choice("AB"), rng.choice(["base", "stress"]), rng.randint(0, 1), hashlib.sha256(f"{trial}|{i}".encode()).hexdigest(), frozenset((rng.choice("pq"), rng.randint(0, 3)) for _ in range(2))) for i in range(9)]
        need, best = {"p": 2, "q": 2}, None
        for n in range(1, 10):
            for c in itertools.combinations(sorted(pool, key=lambda f: f.rank), n):
                units = {u for f in c for u in f.units}
                bases = [f for f in c if f.role == "base"]
                if all(sum(q == k for k, _ in units) >= m for q, m in need.items()) and {f.entity for f in bases} >= {"A"} and all(sum(f.entity == e for f in bases) <= 2 for e in "AB"):
                    key = (sum(f.penalty for f in c), len(bases), sum(f.role == "stress" for f in c), tuple(f.rank for f in c))
                    if best is None or key < best[0]:
                        best = key, [f.id for f in c]
        got = select.choose_filings(pool, need, base_per_entity=2, floors=["A"])
        assert (got.status, got.members) == (("feasible", best[1]) if best else ("infeasible", []))


def test_digest_ignores_row_order_only(spark):
    a = spark.createDataFrame([(1, "x", True), (2, None, False)], "k long, t string, f boolean")
    b = spark.createDataFrame([(2, None, False), (1, "x", True)], "k long, t string, f boolean")
    text = "t\x1ek\x1ft\x1ff\x1e1\x1fx\x1f1\x1e2\x1f\x00null\x1f0"
    for f in (digest.table_digest, digest.large_digest):
        x, y = (f(d, "t", ["k", "t", "f"]).first() for d in (a, b))
        assert x == y and f(a, "u", ["k", "t", "f"]).first()["digest"] != x["digest"] and f(a.union(a), "t", ["k", "t", "f"]).first()["digest"] != x["digest"]
    assert digest.table_digest(a, "t", ["k", "t", "f"]).first()["digest"] == hashlib.sha256(text.encode()).hexdigest()
    assert digest.manifest(digest.table_digest(a, "t", ["k"]), quality.gates(a, rows=F.count(F.lit(1)) == 2), name="r").startswith('{"gates":{"all":"pass","rows":"pass"},"name":"r"')


def test_percentile_rule(spark):
    got = quality.distribution(spark.range(1, 11).select(F.col("id").alias("v")), "v").first()
    assert (got["p90"], got["median"], got["mean"], got["n"]) == (10, 6, 5.5, 10)


def test_calendar_and_availability(spark):
    t, f = F.lit(True), F.lit(False)
    assert one(spark, temporal.calendar_verdict(t, t, f, f, t, f)) == "unknown"
    assert one(spark, temporal.calendar_verdict(t, f, t, f, f, f)) == "operating"
    assert one(spark, temporal.calendar_verdict(f, f, t, f, f, t)) == "unknown"
    assert one(spark, temporal.calendar_verdict(f, f, f, f, f, f)) == "unknown"
    assert one(spark, temporal.calendar_verdict(f, f, f, t, t, f)) == "non_operating"


def test_strata_and_links(spark):
    rows = spark.createDataFrame([(1, "L"), (1, "LL"), (2, "L"), (2, "?"), (3, None), (4, "L"), (4, "S"), (5, "?")], "k long, label string")
    got = {r["k"]: (r["stratum"], r["level"]) for r in classify.size_stratum(rows, ["k"], "label", {"L": "large", "LL": "large", "S": "small"}).collect()}
    assert got == {1: ("large", "provisional"), 2: (None, "conflicting"), 3: (None, "unavailable"), 4: (None, "conflicting"), 5: (None, "review_required")}


def test_archive_members(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name in ("a.json", "../b.json", "/c.json", "d/./e.json", "A.JSON", "n.txt"):
            z.writestr(name, b"{}")
    (tmp_path / "x.zip").write_bytes(buffer.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no")
    got = {(r["archive"], r["member"]): r["problem"] for r in archive.scan(spark, str(tmp_path)).collect()}
    assert got == {("x.zip", "a.json"): None, ("x.zip", "../b.json"): "TRAVERSAL", ("x.zip", "/c.json"): "ABSOLUTE_NAME", ("x.zip", "d/e.json"): None, ("x.zip", "A.JSON"): "NAME_COLLISION", ("x.zip", "n.txt"): None, ("bad.zip", ""): "NOT_AN_ARCHIVE"}


def test_html_sources(spark):
    page = "<title> Codes </title><table><tr><th>Code</th><th>Office</th><th>Title</th></tr><tr><td>0100<td>A<td>Farm &amp; Field</tr><tr><td>12</td><td>B</td><td>x</td></tr></table><ul><li>January 1, 2024 Federal holiday</li><li>May 5, 2024 party</li></ul><script>var a='<li>no</li>'</script>"
    x = html.extract(spark.createDataFrame([(1, page), (2, None)], "id long, html string"), "id", "html")
    assert [tuple(r) for r in html.code_table(x, "id").collect()] == [(1, "0100", "A", "Farm & Field")]
    assert [(r["day"], r["id"]) for r in html.calendar_days(x, "id").collect()] == [(dt.date(2024, 1, 1), 1)]
    assert {r["id"]: r["title"] for r in x.collect()} == {1: "Codes", 2: ""}
    y = html.extract(spark.createDataFrame([(1, "<title>June 19, 2024</title><li>Offices are closed</li>")], "id long, html string"), "id", "html")
    assert html.announcement(y, "id", "June 19, 2024").first()["claim"] == "closed"


def test_json_and_text_sources(spark):
    df = spark.createDataFrame([(1, [1, 2], ["a", "b"]), (2, [1], ["a", "b"]), (3, None, ["a"]), (4, [], [])], "k long, x array<long>, y array<string>")
    good, bad = json_arrays.transpose(df, ["k"], ["x", "y"])
    assert good.count() == 2 and {r["k"] for r in bad.collect()} == {2, 3}
    rec = json_arrays.records_map(spark.createDataFrame([(1, '{"0": {"cik": 5, "t": "A"}}')], "k long, d string"), ["k"], "d", "cik:long,t:string")
    assert [tuple(r) for r in rec.collect()] == [(1, "0", 5, "A")]
    assert one(spark, json_arrays.former_names(F.lit("Old Name"))).asDict() == {"name": "Old Name", "from": None, "to": None}
    lines = spark.createDataFrame([(1, 1, "Name  Form"), (1, 2, "-" * 20), (1, 3, "ACME CO   10-K     123   2024-01-02   edgar/x.txt"), (1, 4, "odd"), (2, 1, "nothing")], "document long, line_number long, line string")
    rows, bad, docs = fixed_text.parse_index(lines)
    assert tuple(rows.first()) == (1, 3, "ACME CO", "10-K", "123", "2024-01-02", "edgar/x.txt") and bad.count() == 1
    assert {r["document"]: r["state"] for r in docs.collect()} == {1: "readable", 2: "unreadable"}


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(b"a",), (b"b",), (b"a",)], "content binary")
    for more in (df, df, df.union(spark.createDataFrame([(b"c",), (None,)], "content binary"))):
        n = store.write_objects(more, "content", str(tmp_path / "o")).count()
    assert n == 3 and spark.read.parquet(str(tmp_path / "o")).count() == 3
    assert all(r["ok"] for r in store.verify_objects(spark, str(tmp_path / "o")).collect())
    t = spark.createDataFrame([(2, "x"), (1, "y")], "k long, v string")
    store.write_json_lines(t, ["k"], str(tmp_path / "j"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "j")).collect()] == ['{"k":1,"v":"y"}', '{"k":2,"v":"x"}']
    assert store.audit_json_lines(spark, t, str(tmp_path / "j")).count() == 0
    assert [r["v"] for r in store.scan_prefix(t, "v", "x").collect()] == ["x"]


def test_ols_and_drift(spark):
    rng = random.Random(1)
    rows = [(i, x := rng.random(), 2.0 + 3.0 * x + rng.random() * 0.01, int(i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, x double, y double, c int")
    got = {r["term"]: r["coefficient"] for r in study.ols_hc3(df, "y", ["x"], "k").collect()}
    assert abs(got["x"] - 3) < 0.02 and abs(got["intercept"] - 2) < 0.02
    assert 0 <= study.drift_classifier(df, ["x", "y"], "c").first()["drift"] <= 1


def test_streams_match_batch(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    for name in ("a", "b"):  # delivered twice
        events.repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
    stream = observations.idempotent(observations.read(spark, str(tmp_path / "in"), events), ["event_id"], "ts", "60 days")
    q = observations.append_once(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"]).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
    counts = observations.period_counts(observations.read(spark, str(tmp_path / "in"), events), "ts", "1 hour", "1 day", ["event_type"])
    q = counts.writeStream.outputMode("append").format("memory").queryName("periods").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    q.awaitTermination()
    batch = events.groupBy(F.window("ts", "1 day")["start"].alias("s"), "event_type").agg((2 * F.count(F.lit(1))).alias("n"))
    want = {(r["s"], r["event_type"]): r["n"] for r in batch.collect()}
    got = {(r["period_start"], r["event_type"]): r["n"] for r in spark.table("periods").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_member_names_are_refused_not_repaired():
    good = {"a/b.txt": "a/b.txt", "./a//b": "a/b", "e\u0301.txt": "\xe9.txt", "a/b:c": "a/b:c", "console.txt": "console.txt"}
    assert {n: archive.canonical_name(n) for n in good} == {n: (w, None) for n, w in good.items()}
    bad = ["", "a%2e%2e/b", "a%2Fb", "con.txt", "x/LPT1", "a./b", "a /b", "a\x1fb", "a\x00", "ab:c", "C:/x", "/a", "../a", "a/../b", "a\\b", ".", "./"]
    assert not [n for n in bad if archive.canonical_name(n)[1] is None]


def test_a_reserve_is_another_entity(spark):
    rows = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s"), (4, "t"), (5, "u")], "id long, sig string")
    got = {r["id"]: r["reserve"] for r in select.reserves(rows, rows.union(rows), "id", ["sig"], F.col("id")).collect()}
    assert got == {1: 2, 2: 1, 3: 1, 4: None, 5: None}
