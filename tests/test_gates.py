"""The gates' decisions on small observations, and the frames behind them."""

import math

import pytest
from pyspark.sql import functions as F

from waybill.contracts import LOADER_OUTPUT, OBSERVATIONS, ContentContract, Declaration, StreamContract, contracts_frame, declarations_frame, invalid_contracts
from waybill.functions import stats
from waybill.operators import gates
from waybill.operators.guard import ContractViolation, StepGuard, guard_step
from waybill.operators.separability import energy_test, pair_matrix, separability
from waybill.sources import fixtures
from waybill.sources.observations import observed, to_hwc

RGB = StreamContract(lo=0.0, hi=255.0, require_extrema=True, channels=3, require_distinct=True)


def content(spark, px, lo=0.0, hi=255.0, c=3, **more):
    """Range and channel statuses of one frame."""
    contract = StreamContract(lo=lo, hi=hi, channels=c, **more)
    row = [("s", LOADER_OUTPUT, 0, 0, "lq", 0, None, 1, len(px) // c, c, "double", [float(v) for v in px])]
    seen = spark.createDataFrame(row, OBSERVATIONS)
    asked = contracts_frame(spark, {"s": ContentContract(contract)})
    return gates.value_range(seen, asked).first(), gates.channel_content(seen, asked).first()


def signature(spark, scale=1.0):
    return [v * scale for v in fixtures.frames(spark, "signature", 1, (16, 16)).first().px]


def test_signature_passes(spark):
    a, b = content(spark, signature(spark), require_extrema=True, require_distinct=True)
    assert (a.status, b.status) == ("PASS", "PASS")


def test_rescaled_misses_anchors(spark):
    a, _ = content(spark, signature(spark, 1 / 255), require_extrema=True)
    assert a.status == "FAIL" and "extremes" in a.message


def test_luminance_collapses(spark):
    px = signature(spark)
    grey = [sum(px[i - i % 3 : i - i % 3 + 3]) / 3 for i in range(len(px))]
    assert content(spark, grey, require_distinct=True)[1].status == "FAIL"


def test_non_finite(spark):
    assert content(spark, [math.nan] * 48, 0, 1)[0].status == "FAIL"
    assert content(spark, [math.nan] * 48, 0, 1, require_finite=False)[0].status == "PASS"
    assert content(spark, [math.inf, 0.5, 0.2], 0, 1)[0].status == "FAIL"


def test_single_channel(spark):
    assert [r.status for r in content(spark, [0.0] * 16, 0, 1, c=1)] == ["PASS", "PASS"]


def test_declared_stream_that_delivers_nothing(spark):
    seen = observed(fixtures.make_pair(spark, 2, (8, 8), "signature", "signature").where("stream = 'lq'"), "s")
    rows = {r.stream: r.status for r in gates.value_range(seen, contracts_frame(spark, {"s": ContentContract(RGB, RGB)})).collect()}
    assert rows == {"lq": "PASS", "gt": "FAIL"}


@pytest.mark.parametrize("bad", [{"lo": 1.0, "hi": 0.0}, {"lo": 0.0}, {"lo": 0.0, "hi": math.inf}, {"range_atol": -1.0}, {"channels": 0}, {"require_distinct": True, "channels": 1}])
def test_contracts_refuse(bad):
    with pytest.raises(ValueError):
        StreamContract(**bad)


def test_contract_rules_as_a_query(spark):
    rows = contracts_frame(spark, {"ok": ContentContract(RGB)})
    assert invalid_contracts(rows).count() == 0
    assert invalid_contracts(rows.withColumn("lo", F.lit(300.0))).first().reason.startswith("a range has finite ends")
    assert declarations_frame(spark, [Declaration("s")]).first().num_frames == 5


def windows(spark, ids, num_frames=5, claim=None):
    rows = [("s", d, p, i, None if claim is None else i + claim) for d, w in enumerate(ids) for p, i in enumerate(w)]
    return gates.temporal_window(spark.createDataFrame(rows, "subject string, draw int, pos int, frame_id int, claimed_id int"), num_frames, 32).first()


def test_temporal_window(spark):
    assert windows(spark, [range(3, 8), range(9, 14)]).status == "PASS"
    assert windows(spark, [range(5)] * 3).message == "prefix"
    assert windows(spark, [range(4, 9)] * 3).message == "inert"
    assert windows(spark, [[4]]).message == "length"
    assert windows(spark, [[4]], num_frames=1).status == "N/A"
    assert windows(spark, [range(3, 8), range(9, 14)], claim=1).message == "mismatch"
    assert windows(spark, [range(3, 8), range(9, 14)], claim=0).status == "PASS"
    unread = windows(spark, [[None, 1, 2, 3, 4], [1, None, 2, 3, 4]])
    assert unread.status == "PASS" and unread.n_windows == 2 and unread.n_ids == 4


def test_target_transforms(spark):
    frames = spark.createDataFrame([("s", 0, 5), ("s", 1, 5), ("s", 2, 0)], "subject string, draw int, n_target int")
    calls = spark.createDataFrame([("s", 0, 0, i, "sharpen") for i in range(5)], "subject string, seed long, draw int, call_pos int, name string")
    by = lambda **k: {r.draw: r.status for r in gates.target_transforms(frames, calls, "sharpen", **k).collect()}
    assert by(expected=1.0) == {0: "PASS", 1: "FAIL", 2: "FAIL"}
    assert by(expected=0.0, declared=False) == {0: "UNDECL", 1: "PASS", 2: "FAIL"}
    assert by(expected=1.0, has_target=False) == dict.fromkeys(range(3), "N/A")


def trace(spark, draws, policy="random_permutation"):
    rows = [("s", 0, d, i, n) for d, w in enumerate(draws) for i, n in enumerate(w)]
    return gates.operator_trace(spark.createDataFrame(rows, "subject string, seed long, draw int, call_pos int, name string"), ["a", "b"], policy).first()


def test_operator_trace(spark):
    assert trace(spark, ["xaab", "xbba"]).status == "PASS"
    assert trace(spark, ["aab", "ab"]).status == "FAIL"
    assert trace(spark, ["aabab", "ab"], "fixed").status == "PASS"
    assert trace(spark, ["ab", "ba"], "fixed").status == "FAIL"
    assert trace(spark, ["xyz"]).status == "SKIP"
    assert trace(spark, ["ab"]).status == "FAIL"


def test_precomputed_input(spark):
    shown = fixtures.frames(spark, "checker", 2, (16, 16)).select(F.lit("s").alias("subject"), "px")
    flat = fixtures.frames(spark, "flat", 2, (16, 16)).select(F.lit("s").alias("subject"), "px")
    none = spark.createDataFrame([], "subject string, seed long, draw int, call_pos int, name string")
    called = spark.createDataFrame([("s", 0, 0, 0, "generator_x")], none.schema)
    assert gates.precomputed_input(shown, none).first().status == "PASS"
    assert gates.precomputed_input(shown, called).first().status == "FAIL"
    assert gates.precomputed_input(flat, none, declared=False).first().status == "N/A"


def test_geometry(spark):
    shapes = spark.createDataFrame([("a", 368, 640, 180, 320), ("b", 360, 640, 180, 320), ("c", 180, 320, 180, 320)], "subject string, dh int, dw int, eh int, ew int")
    assert {r.subject: r.status for r in gates.geometry(shapes).collect()} == {"a": "FAIL", "b": "PASS", "c": "PASS"}


def test_escalation(spark):
    rows = [("need32", 16, False, None), ("need32", 32, True, "PASS"), ("bad32", 16, False, None), ("bad32", 32, True, "FAIL"), ("fine", 16, True, "PASS"), ("never", 16, False, None)]
    outcomes = spark.createDataFrame(rows, "subject string, length int, ok boolean, status string")
    assert {r.subject: (r.status, r.used) for r in gates.escalate(outcomes, 16).collect()} == {"need32": ("UNDECL", 32), "bad32": ("FAIL", 32), "fine": ("PASS", 16), "never": ("ERROR", None)}
    assert {r.subject: r.status for r in gates.escalate(outcomes, 16, declared=32).collect()} == {"need32": "PASS", "bad32": "FAIL"}


def arms(spark, n, shift=0.0, reseed=0, size=48):
    import numpy as np

    rows = [(s, (np.random.default_rng(s + reseed).normal(100, 10, size) + shift).tolist()) for s in range(n)]
    return spark.createDataFrame(rows, "seed long, px array<double>")


def test_separability(spark):
    a = arms(spark, 16)
    assert separability(a, a, distributional=True).first().message == "unexpected equality"
    shifted = separability(a, arms(spark, 16, 20.0), distributional=True, permutations=511, permutation_seed=19).first()
    assert shifted.status == "PASS" and shifted.p_value <= 0.05
    same = separability(a, arms(spark, 16, reseed=500), distributional=True, permutations=255, permutation_seed=31).first()
    assert same.status == "FAIL" and same.p_value > 0.05
    one = lambda v: spark.createDataFrame([(0, [float(v)] * 12)], "seed long, px array<double>")
    assert separability(one(0), one(1)).first().status == "PASS"
    assert separability(one(0), one(math.nan)).first().message == "non-finite values"
    assert separability(one(0), one(0), declared="identical").first().status == "PASS"
    assert separability(one(0), arms(spark, 1), declared="identical").first().message == "shapes differ"
    for bad in ({"declared": "other"}, {"alpha": 1.0}, {"permutations": 50}, {"distributional": True}):
        with pytest.raises(ValueError):
            separability(one(0), one(1), **bad)


def test_energy_test_is_the_definition(spark):
    import numpy as np

    a, b = arms(spark, 6), arms(spark, 6, 3.0, reseed=50)
    x, y = (np.array([r.px for r in f.orderBy("seed").collect()]) for f in (a, b))

    def energy(x, y):
        d = lambda p, q: np.sqrt(((p[:, None] - q[None]) ** 2).mean(axis=2)).mean()
        return 2 * d(x, y) - d(x, x) - d(y, y)

    got = energy_test(pair_matrix(a, b), 6).first()
    all_ = []
    for mask in range(64):
        s = np.array([mask >> i & 1 for i in range(6)], bool)[:, None]
        all_.append(energy(np.where(s, y, x), np.where(s, x, y)))
    assert abs(got.effect - energy(x, y)) < 1e-9 and got.exceed == sum(e >= energy(x, y) - 1e-12 for e in all_)


def test_index_frames(spark):
    shown = fixtures.frames(spark, "index", 20, (16, 16)).where("frame_pos in (1, 17)")
    ids = lambda px: [r[0] for r in shown.orderBy("frame_pos").select(stats.decode_index(px)).collect()]
    px = F.col("px")
    assert ids(px) == ids(F.transform(px, lambda v: v / 255)) == ids(F.transform(px, lambda v: v / 127.5 - 1)) == [1, 17]
    assert ids(F.slice(px, 1, 16 * 12 * 3)) == [1, 17]
    ramp = F.transform(px, lambda v, i: i % 256 * 1.0)
    assert ids(ramp) == [None, None]
    with pytest.raises(ValueError):
        fixtures.frames(spark, "index", 300)


def test_layout(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "px array<double>").select(to_hwc(F.col("px"), F.lit(1), F.lit(2), F.lit(3))).first()
    assert row[0] == [1.0, 3.0, 5.0, 2.0, 4.0, 6.0]


def test_guard_blocks_before_the_step(spark):
    asked = contracts_frame(spark, {"s": ContentContract(StreamContract(lo=0.0, hi=255.0, require_extrema=True, channels=3))})
    good = observed(fixtures.make_pair(spark, 2, (8, 8), "signature", "signature").where("stream = 'lq'"), "s")
    grey = good.withColumn("px", F.transform("px", lambda v: v * 0 + 0.5))
    seen = []
    step = guard_step(asked, argument="batch")(lambda batch: seen.append(1) or "done")
    assert step(batch=good) == "done"
    with pytest.raises(ContractViolation, match=r"value_range\[training_step_input\]"):
        step(batch=grey)
    with pytest.raises(TypeError):
        step()
    with pytest.raises(TypeError):
        StepGuard(asked).assert_batch([1])
    records: list = []
    StepGuard(asked, certificate=records).assert_batch(good)
    assert len(seen) == 1 and {r.status for r in records} == {"PASS"}


def test_five_channels(spark):
    """No number of channels is too many: two of five that are equal are found, five that differ pass."""
    px = [float((7 * i + 31 * c) % 97) for i in range(16) for c in range(5)]
    assert content(spark, px, c=5, require_distinct=True)[1].status == "PASS"
    same = [px[i - 4] if i % 5 == 4 else v for i, v in enumerate(px)]
    assert content(spark, same, c=5, require_distinct=True)[1].message == "channels collapse"


def test_separability_scales_its_arms_and_needs_their_seeds(spark):
    """Tensors in 0..1 and -1..1 are compared on 0..255; a seed that one arm lacks is an error; a null is not finite."""
    one = lambda *v: spark.createDataFrame([(0, [float(x) for x in v])], "seed long, px array<double>")
    got = separability(one(0, 0.5, 1), one(0, 0.25, 1)).first()
    assert (got.max_abs, got.mae) == (63.75, 21.25)
    assert separability(one(-1, 0, 1), one(0, 127.5, 255), declared="identical").first().status == "PASS"
    with pytest.raises(ValueError, match="3 seeds are in one arm only"):
        separability(arms(spark, 6), arms(spark, 3))
    holed = spark.createDataFrame([(0, [1.0, None])], "seed long, px array<double>")
    assert separability(holed, one(1, 2)).first().message == "non-finite values"


def test_index_frames_that_show_none(spark):
    """Noise, lost contrast, and whole numbers that only look like a range of 0..1."""
    shown = fixtures.frames(spark, "index", 256, (16, 16)).where("frame_pos in (0, 1, 2, 100, 200)").orderBy("frame_pos")
    ids = lambda px, floating=True: [r[0] for r in shown.select(stats.decode_index(px, floating)).collect()]
    noisy = F.transform("px", lambda v, j: v + F.when(j % 2 == 0, 5.0).otherwise(-5.0))
    assert ids(noisy) == ids(F.transform("px", lambda v: v * 0.6)) == [None] * 5
    flat = F.transform("px", lambda v: v * 0 + 1)
    assert ids(flat) == [255] * 5 and ids(flat, False) == [1] * 5
    assert ids(F.transform("px", lambda v: v * 0 - 3)) == [-3] * 5 and ids(F.transform("px", lambda v: F.lit(None).cast("double"))) == [None] * 5


def test_content_hash(spark):
    import hashlib

    row = spark.createDataFrame([([0.4, 254.6, 300.0, -2.0, 16.5],)], "px array<double>").select(stats.content_hash(F.col("px"))).first()
    assert row[0] == hashlib.sha256(bytes([0, 255, 255, 0, 16])).hexdigest()[:16]
