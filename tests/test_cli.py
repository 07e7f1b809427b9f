"""Audits over tables, and the command line's exit codes."""

import json

from pyspark.sql import functions as F

from waybill import cli
from waybill.contracts import CALLS, ContentContract, Declaration, StreamContract, contracts_frame
from waybill.plans.audit import audit, verdicts
from waybill.sources import fixtures
from waybill.sources.observations import observed


def tables(spark):
    """A subject that samples windows of an index clip, and one that always starts at the first frame."""
    frames = fixtures.frames(spark, "index", 32, (16, 16))
    out = None
    for name, starts in (("good", (3, 11, 20)), ("prefix", (0, 0, 0))):
        for draw, start in enumerate(starts):
            window = frames.where(F.col("frame_pos").between(start, start + 4)).withColumn("frame_pos", F.col("frame_pos") - start)
            for stream in ("gt", "lq"):
                part = observed(window.withColumn("stream", F.lit(stream)), name, draw=draw)
                out = part if out is None else out.unionByName(part)
    calls = spark.createDataFrame([(s, 0, d, i, n) for s in ("good", "prefix") for d in range(3) for i, n in enumerate(["blur", "noise"][:: 1 if d else -1] + ["sharpen"] * 5)], CALLS)
    contract = StreamContract(lo=0.0, hi=255.0, require_extrema=True, channels=3)
    return out, calls, contracts_frame(spark, {s: ContentContract(contract, contract) for s in ("good", "prefix")})


def test_audit(spark):
    seen, calls, contracts = tables(spark)
    said = [Declaration(s, target_transforms=1, operator_policy="random_permutation") for s in ("good", "prefix")]
    results = audit(seen, calls, contracts, said, ("blur", "noise"), "sharpen").persist()
    by = {(r.subject, r.gate): r.status for r in results.collect()}
    assert by["good", "temporal_window"] == "PASS" and by["prefix", "temporal_window"] == "FAIL"
    assert {by[s, g] for s in ("good", "prefix") for g in ("value_range", "channel_content", "operator_trace", "target_transforms")} == {"PASS"}
    assert by["good", "precomputed_input"] == "N/A"
    assert {r.subject: r.status for r in verdicts(results).collect()} == {"good": "PASS", "prefix": "FAIL"}


def test_audit_command(spark, tmp_path):
    for name, frame in zip(("observations", "calls", "contracts"), tables(spark), strict=True):
        frame.coalesce(1).write.parquet(str(tmp_path / name))
    (tmp_path / "said.json").write_text(json.dumps({s: {"target_transforms": 1, "operator_policy": "random_permutation"} for s in ("good", "prefix")}))
    args = ["audit", *(x for n in ("observations", "calls", "contracts") for x in (f"--{n}", str(tmp_path / n))), "--declarations", str(tmp_path / "said.json"), "--out", str(tmp_path / "out"), "--operators", "blur", "noise", "--transform", "sharpen"]
    assert cli.main([*args, "--only", "good"]) == 0
    assert json.loads((tmp_path / "out" / "good.json").read_text())["status"] == "PASS"
    assert cli.main(args) == 1
    assert cli.main([*args, "--only", "nobody"]) == 64
