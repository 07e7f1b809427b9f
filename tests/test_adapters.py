"""Adapters: wrap-around, windows, missing and broken subjects, and the registry."""

import pytest
from pyspark.sql import functions as F

from waybill.contracts import ContentContract, Declaration, StreamContract
from waybill.plans import reports
from waybill.sources import adapters, fixtures


def declared(name, **more):
    return Declaration(name, content=ContentContract(StreamContract(0.0, 255.0, channels=3), StreamContract(0.0, 255.0, channels=3) if more.get("has_target", True) else None), **more)


def clip(spark, n, name=0):
    return fixtures.frames(spark, "index", n, (16, 16)).withColumn("clip", F.lit(name))


def test_pairs_begin_again(spark):
    frames = fixtures.frames(spark, "signature", 3, (8, 8))
    got = adapters.PairedPictures("p", frames, frames, 7).observe(spark, declared("p", num_frames=1))
    assert sorted((r.draw, r.claimed_frame_id) for r in got.where("stream = 'lq'").collect()) == [(d, d % 3) for d in range(7)]
    assert got.where("stream = 'gt'").count() == 7
    assert adapters.InputOnly("p", frames, 2).observe(spark, declared("p", num_frames=1, has_target=False)).select("stream").distinct().collect() == [("lq",)]


def test_clip_windows(spark):
    frames = clip(spark, 6, 1).unionByName(clip(spark, 5, 2)).unionByName(clip(spark, 3, 3))
    got = adapters.ClipFolder("c", frames, frames, 8).observe(spark, declared("c"))
    seen = {}
    for r in got.where("stream = 'gt'").orderBy("draw", "frame_pos").collect():
        seen.setdefault(r.draw, []).append(r.claimed_frame_id)
    # clips 1 and 2 in turn, the third is shorter than a window; clip 1 has two starts, clip 2 one
    assert seen == {d: [(d // 2 % 2 if d % 2 == 0 else 0) + i for i in range(5)] for d in range(8)}


def test_study_of_subjects(spark):
    frames = clip(spark, 32)
    pictures = fixtures.frames(spark, "signature", 4, (16, 16))

    def broken():
        raise ValueError("no such option")

    def missing():
        raise FileNotFoundError("/nowhere")

    subjects = {
        "clips": lambda: adapters.ClipFolder("clips", frames, frames, 12), "odd_name": lambda: adapters.InputOnly("odd_name", pictures, 3), "gone": lambda: None, "missing": missing, "broken": broken,
        "empty": lambda: adapters.PairedPictures("empty", pictures.where("false"), None, 2),
    }
    known = {n: declared(n, num_frames=5 if n == "clips" else 1, has_target=n == "clips") for n in subjects}
    study = adapters.run_subjects(spark, subjects, known)
    got = {r.subject: r.outcome for r in study.outcomes.collect()}
    assert got == {"clips": "RUN", "odd_name": "RUN", "gone": "UNAVAILABLE", "missing": "UNAVAILABLE", "broken": "ADAPTER_ERROR", "empty": "ADAPTER_ERROR"}
    gates = {(r.subject, r.gate): r.status for r in study.results.collect()}
    assert gates["clips", "temporal_window"] == "PASS" and gates["odd_name", "temporal_window"] == "N/A"
    assert {s for s, _ in gates} == {"clips", "odd_name"}
    none = adapters.run_subjects(spark, {"gone": lambda: None}, known)
    assert none.results is None and none.outcomes.first().outcome == "UNAVAILABLE"


def test_registry():
    assert len(adapters.REGISTRY) == 8
    assert {s.kind for s in adapters.REGISTRY.values()} == {"clips", "online", "pairs", "input"}
    assert adapters.REGISTRY["zerodce"].declaration.content.gt is None
    assert adapters.REGISTRY["basicsr_reds"].declaration.clip_length == 100
    assert adapters.REGISTRY["pix2pix_colorization"].declaration.content.gt.channels == 2


@pytest.mark.parametrize("n", [1, 2, 5, 30001, 30002])
def test_median_of_a_hot_gate(spark, n):
    rows = spark.range(n).select(F.lit("g").alias("gate"), ((F.col("id") * 7919) % 30011).cast("double").alias("seconds"))
    want = sorted((i * 7919) % 30011 for i in range(n))
    got = reports.gate_cost(rows).first()
    assert got.runs == n and got.median_seconds == (want[(n - 1) // 2] + want[n // 2]) / 2
