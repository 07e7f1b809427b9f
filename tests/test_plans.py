"""Folds, certificates, files, the defect study, the stream guard, and every query against its SQL."""

import hashlib
import json
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from waybill.contracts import ContentContract, StreamContract, contracts_frame
from waybill.functions.seeding import seed_all
from waybill.operators.guard import StepGuard
from waybill.plans import catalog, certificate, defects, reports
from waybill.sources import fixtures
from waybill.sources import observations as sources
from waybill.streaming.guarded import guarded_sink, windowed_range

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "statuses,want",
    [([], "INCONCLUSIVE"), (["PASS", "N/A"], "PASS"), (["PASS", "FAIL", "UNDECL"], "FAIL"), (["PASS", "UNDECL"], "UNDECLARED"), (["N/A", "SKIP"], "INCONCLUSIVE"), (["PASS", "SKIP"], "PARTIAL"), (["PASS", "ODD"], "PARTIAL")],
)
def test_fold(statuses, want):
    assert certificate.verdict_of(statuses) == want


def record(gate, status):
    return {"gate": gate, "status": status, "message": "", "evidence": {}}


def test_certificate_document(tmp_path):
    d = certificate.document("p", "as declared", [record("b", "FAIL"), record("a", "FAIL"), record("c", "UNDECL")], clip_length=32)
    assert certificate.violations(d) == [] and d["failed_gates"] == ["b", "a"] and d["undeclared_gates"] == ["c"]
    sources.write_certificate(d, str(tmp_path / "x" / "c.json"))
    assert json.loads((tmp_path / "x" / "c.json").read_text())["status"] == "FAIL"
    for field, value in {"commit": "xyz", "status": "PASS", "gates": [record("a", "ODD")], "clip_length": 0, "created_utc": "today", "gt_stream_sha256": "0"}.items():
        bad = d | {field: value}
        assert certificate.violations(bad)
        with pytest.raises(ValueError):
            sources.write_certificate(bad, str(tmp_path / "bad.json"))
    assert not (tmp_path / "bad.json").exists()
    assert certificate.violations({k: v for k, v in d.items() if k != "notes"}) == ["notes: missing"]
    assert "FAIL" in certificate.summary(d)
    with pytest.raises(ValueError):
        certificate.document("p", "x", [], other=1)


def test_repository_provenance():
    got = certificate.repository("/root/repo")
    assert got["commit"] is None or len(got["commit"]) == 40


def test_certificates_frame(spark):
    rows = spark.createDataFrame([("s", "g1", "PASS", "", "{}"), ("s", "g2", "N/A", "", "{}")], "subject string, gate string, status string, message string, evidence string")
    got = certificate.certificates(rows).first()
    assert got.status == "PASS" and len(got.gates) == 2


def test_seed_report():
    assert "random" in seed_all(3).reached


def test_defect_study(spark):
    matrix = defects.defect_matrix(spark).persist()
    assert matrix.count() == 58 and matrix.where("is_target").count() == 10 == matrix.where("detected").count()
    assert reports.collateral(matrix).count() == 0
    alarms = defects.false_alarms(spark, [1, 2])
    assert alarms.count() == 12 and alarms.where("status <> 'PASS'").count() == 0
    assert reports.study_summary(matrix, alarms).first().false_alarms == 0
    matrix.unpersist()


def test_csv_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1)], "x string, n int")
    for name, frame in (("some", rows), ("none", rows.where("false"))):
        sources.write_csv(frame, str(tmp_path / name))
        assert sources.read_csv(spark, str(tmp_path / name)).columns == ["x", "n"]
    folder = tmp_path / "files"
    folder.mkdir()
    for name in ("one", "two", "three"):
        (folder / name).write_text(name)
    lines = [f"{hashlib.sha256(b'one').hexdigest()}  one", f"{'0' * 64}  two", f"{'1' * 64}  gone"]
    (folder / "SUMS").write_text("\n".join(lines) + "\n")
    got = {r["name"]: r["outcome"] for r in sources.verify_manifest(spark, str(folder / "SUMS"), str(folder)).collect()}
    assert got == {"one": "ok", "two": "changed", "gone": "missing", "three": "unlisted"}


def test_reports(spark):
    times = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 9.0)], "gate string, seconds double")
    cost = reports.gate_cost(times)
    assert {r.gate: (r.runs, r.median_seconds) for r in cost.collect()} == {"a": (2, 2.0), "b": (1, 9.0)}
    assert reports.slowest_gate(cost).first().slowest_gate == "b"
    sizes = spark.createDataFrame([("s", 47, 0.1), ("s", 47, 0.3), ("t", 89, 0.2)], "subject string, adapter_loc int, gates_seconds double")
    results = spark.createDataFrame([("s", "N/A"), ("s", "SKIP"), ("t", "FAIL")], "subject string, status string")
    table = {r.subject: r for r in reports.effort(sizes, results).collect()}
    assert table["s"].gates_applicable == 1 and table["t"].gates_failed == 1 and abs(table["s"].gates_seconds - 0.2) < 1e-9
    assert reports.effort_summary(reports.effort(sizes, results)).first().median_loc == 89
    assert reports.drift(times, times.where("gate = 'a'"), ["gate"]).collect() == [("b", "before")]
    code = spark.createDataFrame([("f", '"""doc\nstring"""\n\nx = 1\n# note\n  y = 2\n')], "name string, content string")
    assert reports.code_lines(code).first().adapter_loc == 2


def test_drift_counts_copies(spark, monkeypatch):
    monkeypatch.setattr(reports, "COPIES", 3, raising=False)
    frame = lambda *rows: spark.createDataFrame([(k, s) for k, s, n in rows for _ in range(n)], "k long, status string")
    before, after = frame((1, "a", 9), (2, "a", 2), (None, None, 5), (4, "b", 1)), frame((1, "a", 2), (2, "a", 2), (None, None, 6), (4, "c", 4))
    got = Counter(map(tuple, reports.drift(before, after, ["k", "status"]).collect()))
    assert got == {(1, "a", "before"): 7, (None, None, "after"): 1, (4, "b", "before"): 1, (4, "c", "after"): 4}


def test_drift_parts_follow_the_tables(spark, monkeypatch):
    """Each table is read once, and the records a task holds are bounded by what the tables weigh."""
    monkeypatch.setattr(reports, "PART_BYTES", 10_000, raising=False)
    frame = catalog.drift_diff(spark, SF)
    assert frame._jdf.queryExecution().sparkPlan().collectLeaves().size() == 2
    held = [r[0] for r in frame.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).select("n").collect()]
    assert sum(held) == 3000 and len(held) > 10 and max(held) < 500


def test_stream_guard(spark, tmp_path):
    asked = contracts_frame(spark, {"s": ContentContract(StreamContract(lo=0.0, hi=255.0, channels=3))})
    frames = sources.observed(fixtures.make_pair(spark, 2, (8, 8), "signature", "signature").where("stream = 'lq'"), "s")
    for name, rows in (("good", frames), ("bad", frames.withColumn("px", F.transform("px", lambda v: v + 999)))):
        rows.write.parquet(str(tmp_path / name))
        seen: list[int] = []
        stream = spark.readStream.schema(frames.schema).parquet(str(tmp_path / name))
        running = guarded_sink(stream, StepGuard(asked), lambda batch, epoch, seen=seen: seen.append(batch.count())).option("checkpointLocation", str(tmp_path / f"{name}-at")).start()
        if name == "good":
            running.processAllAvailable()
            running.stop()
            assert seen == [2]
        else:
            with pytest.raises(Exception, match="outside the declared range"):
                running.processAllAvailable()
            assert seen == []


def test_stream_windows(spark):
    events = spark.readStream.schema(spark.read.parquet(f"{SF}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(SF)
    running = windowed_range(events, "ts", "value", "1 day").writeStream.outputMode("complete").format("memory").queryName("ranges").start()
    running.processAllAvailable()
    running.stop()
    assert spark.sql("select sum(n) from ranges").first()[0] == spark.read.parquet(f"{SF}/events.parquet").count()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(set(catalog.SQL) - {"defect_matrix", "collateral"}))
def test_query_against_sql(spark, name):
    db = duckdb.connect()
    for table in ("part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "labels", "conversations"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    frame = catalog.QUERIES[name](spark, SF)
    got = db.execute(catalog.SQL[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == sorted(frame.columns)

    def plain(row):
        return tuple(round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v for v in row)

    want = sorted((plain(r) for r in got.fetchall()), key=repr)
    assert sorted((plain(r) for r in frame.select(*names).collect()), key=repr) == want


def test_audit_gives_every_gate_a_record(spark):
    """A subject that delivered and called nothing is SKIP under every gate that applies, and never PASS."""
    from waybill.contracts import LOADER_OUTPUT, OBSERVATIONS, ContentContract, Declaration, StreamContract, contracts_frame
    from waybill.plans import audit

    contract = ContentContract(StreamContract(lo=0.0, hi=255.0, channels=1), StreamContract(lo=0.0, hi=255.0, channels=1))
    frame = lambda stream, draw, pos: ("here", LOADER_OUTPUT, 0, draw, stream, pos, None, 1, 4, 1, "uint8", [0.0, 1.0, 2.0, 255.0])
    seen = spark.createDataFrame([frame(s, d, p) for s in ("lq", "gt") for d in (0, 1) for p in range(2)], OBSERVATIONS)
    calls = spark.createDataFrame([("here", 0, 0, 0, "a"), ("here", 0, 1, 0, "b")], "subject string, seed long, draw int, call_pos int, name string")
    declared = [Declaration(s, num_frames=2, use_precomputed=True, operator_policy="random_permutation", content=contract) for s in ("here", "gone")]
    shapes = spark.createDataFrame([("here", 4, 4, 8, 8)], "subject string, dh int, dw int, eh int, ew int")
    steps = spark.createDataFrame([("here", "geometry", 32, False, None), ("here", "geometry", 64, True, "PASS"), ("here", "value_range", 32, False, None)], "subject string, gate string, length int, ok boolean, status string")
    ask = lambda **k: {(r.subject, r.gate): r for r in audit.audit(seen, calls, contracts_frame(spark, {"here": contract, "gone": contract}), declared, ("a", "b"), "sharpen", **k).collect()}
    got = ask()
    assert len(got) == 12 and {r.status for (s, _), r in got.items() if s == "gone"} == {"SKIP"}
    assert got["here", "operator_trace"].status == got["here", "value_range"].status == "PASS"
    results = audit.audit(seen.where("false"), calls.where("false"), contracts_frame(spark, {"gone": contract}), declared[1:], ("a",), "sharpen", shapes)
    assert results.count() == 7 and audit.verdicts(results).first().status == "INCONCLUSIVE"
    stepped = ask(shapes=shapes, lengths=steps)
    assert stepped["here", "geometry"].status == "UNDECL" and '"underlying_status":"PASS"' in stepped["here", "geometry"].evidence
    assert stepped["here", "value_range"].status == "ERROR" and stepped["gone", "geometry"].status == "SKIP" and len(audit.ALL_CHECKS) == 8


def test_portability_summary(spark):
    from waybill.plans import reports

    rows = [("a", "RUN", 47, 0.5, 0, 1), ("b", "PARTIAL", 89, 0.9, 2, 0), ("c", "UNAVAILABLE", None, None, None, None), ("d", "GATE_ERROR", 9, 9.0, 9, 9), ("e", "ADAPTER_ERROR", None, None, None, None)]
    table = spark.createDataFrame(rows, "subject string, outcome string, adapter_loc long, adapter_seconds double, gates_failed long, gates_undecl long")
    got = reports.portability_summary(table, spark.range(12)).first()
    assert (got.subjects_registered, got.subjects_run, got.subjects_unavailable, got.subjects_partial, got.subjects_adapter_error) == (5, 2, ["c"], ["b"], ["d", "e"])
    assert (got.median_adapter_loc, got.min_adapter_loc, got.max_adapter_loc, got.max_adapter_seconds, got.total_failures, got.total_undeclared, got.gate_rows, got.clip_escalation) == (89, 47, 89, 0.9, 2, 1, 12, 1)
