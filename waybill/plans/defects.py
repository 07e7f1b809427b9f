"""The seeded-defect study: one simulated loader, its mutations as subjects, and all gates over all of them at once.

A subject is a row key, so a study of any number of variants or seeds is the same few queries. Randomness is an
MD5 of seed, draw and name: the same in every engine and partitioning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import CONTRACTS, LOADER_OUTPUT, StreamContract
from ..operators import gates, separability
from ..sources import fixtures

OPERATORS = ("blur", "downsample", "noise", "jpeg")
#: Mutations of the loader and the gate that each must trip; none is the control.
DEFECTS = {
    "none": None, "ignore_precomputed": "precomputed_input", "prefix_window": "temporal_window", "frozen_window": "temporal_window", "double_sharpen": "target_transforms",
    "no_sharpen": "target_transforms", "fixed_order": "operator_trace", "value_range": "value_range", "channel_collapse": "channel_content",
}
LOADER_GATES = ("precomputed_input", "temporal_window", "target_transforms", "operator_trace", "value_range", "channel_content")
WINDOW, CLIP, PROBES, DRAWS, SHAPE = 5, 32, 8, 12, (16, 16)


def coin(*parts: Column | str) -> Column:
    """A number from 0 to 2**28 - 1 that the parts decide."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))), 1, 7), 16, 10).cast("long")


def subjects(spark: SparkSession, defects: list[str], seeds: list[int]) -> DataFrame:
    """subject, defect, seed."""
    return spark.createDataFrame([(f"{d}/{s}", d, s) for d in defects for s in seeds], "subject string, defect string, seed long")


def windows(who: DataFrame) -> DataFrame:
    """Sampled windows of the index clip: subject, draw, pos, frame_id, claimed_id."""
    draws = who.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(PROBES - 1))))
    start = F.pmod(coin("window", F.col("seed"), F.col("draw")), F.lit(CLIP - WINDOW)).cast("int")
    frozen = F.pmod(coin("window", F.col("seed"), F.lit(0)), F.lit(CLIP - WINDOW)).cast("int")
    begin = F.when(F.col("defect") == "prefix_window", 0).when(F.col("defect") == "frozen_window", frozen).otherwise(start)
    at = F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("pos")
    return draws.select("subject", "draw", begin.alias("begin"), at).select("subject", "draw", "pos", (F.col("begin") + F.col("pos")).alias("frame_id"), F.lit(None).cast("int").alias("claimed_id"))


def calls(who: DataFrame) -> DataFrame:
    """Recorded calls of every draw: the target's sharpening of each frame, and the degradation's operators in an order
    drawn anew each time, unless fixed by the defect. Without the pre-computed input the generator is called."""
    draws = who.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))))
    ops = draws.withColumn("name", F.explode(F.array(*map(F.lit, OPERATORS))))
    order = F.row_number().over(Window.partitionBy("subject", "draw").orderBy(F.when(F.col("defect") == "fixed_order", F.lit(0).cast("long")).otherwise(coin("order", F.col("seed"), F.col("draw"), F.col("name"))), "name"))
    degrade = ops.select("subject", "seed", "draw", order.alias("call_pos"), "name")
    times = F.when(F.col("defect") == "no_sharpen", 0).when(F.col("defect") == "double_sharpen", 2 * WINDOW).otherwise(WINDOW)
    sharpen = draws.select("subject", "seed", "draw", times.alias("n")).where("n > 0").select("subject", "seed", "draw", F.explode(F.sequence(F.lit(101), F.col("n") + 100)).alias("call_pos"), F.lit("sharpen").alias("name"))
    generator = who.where(F.col("defect") == "ignore_precomputed").select("subject", "seed", F.lit(0).alias("draw"), F.lit(99).alias("call_pos"), F.lit("generator").alias("name"))
    return degrade.union(sharpen).union(generator)


def content(who: DataFrame) -> DataFrame:
    """Signature frames as delivered, mutated: observations of both streams."""
    h, w = SHAPE
    px = fixtures.signature(h, w)
    mean = lambda i: (F.get("px", 3 * i) + F.get("px", 3 * i + 1) + F.get("px", 3 * i + 2)) / 3
    grey = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.array_repeat(mean(i), 3)))
    made = F.when(F.col("defect") == "value_range", F.transform("px", lambda v: v / 255)).when(F.col("defect") == "channel_collapse", grey).otherwise(F.col("px"))
    streams = who.withColumn("stream", F.explode(F.array(F.lit("lq"), F.lit("gt")))).withColumn("px", px)
    return streams.select("subject", F.lit(LOADER_OUTPUT).alias("boundary"), "stream", F.lit(3).alias("c"), made.alias("px"))


def inputs(who: DataFrame) -> DataFrame:
    """Delivered input frames where a checkerboard lay beside a flat target: the defect delivers the flat one."""
    h, w = SHAPE
    return who.select("subject", F.when(F.col("defect") == "ignore_precomputed", fixtures.flat(h, w)).otherwise(fixtures.checker(h, w)).alias("px"))


def loader_gates(who: DataFrame) -> DataFrame:
    """subject, gate, status, message of the six gates of every subject."""
    rgb = StreamContract(lo=0.0, hi=255.0, require_extrema=True, channels=3, require_distinct=True)
    one = F.struct(*(F.lit(getattr(rgb, k)).cast(t).alias(k) for k, t in (c.split() for c in CONTRACTS.split(", ")[2:])))
    declared = who.select("subject", F.explode(F.array(F.lit("lq"), F.lit("gt"))).alias("stream"), one.alias("c")).select("subject", "stream", "c.*")
    recorded, seen = calls(who), content(who)
    frames = who.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).select("subject", "draw", F.lit(WINDOW).alias("n_target"))
    worst = lambda rows: rows.groupBy("subject").agg(F.max_by("message", F.when(F.col("status") == "PASS", 0).otherwise(1)).alias("message"), F.max_by("status", F.when(F.col("status") == "PASS", 0).otherwise(1)).alias("status"))
    made = {
        "precomputed_input": gates.precomputed_input(inputs(who), recorded),
        "temporal_window": gates.temporal_window(windows(who), WINDOW, CLIP),
        "target_transforms": worst(gates.target_transforms(frames, recorded, "sharpen", 1.0)),
        "operator_trace": gates.operator_trace(recorded, list(OPERATORS)),
        "value_range": worst(gates.value_range(seen, declared)),
        "channel_content": worst(gates.channel_content(seen, declared)),
    }
    return reduce(DataFrame.unionByName, [v.select("subject", F.lit(k).alias("gate"), "status", "message") for k, v in made.items()])


def _arms(spark: SparkSession, shift: float, seeds: int = 16, size: int = 192) -> tuple[DataFrame, DataFrame]:
    px = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: 100 + F.pmod(coin("pixel", F.col("id"), i), F.lit(2000)).cast("double") / 100)
    a = spark.range(1234, 1234 + seeds).select(F.col("id").alias("seed"), px.alias("px"))
    return a, a.select("seed", F.transform("px", lambda v: v + shift).alias("px"))


def evaluation_gates(spark: SparkSession, permutations: int = 999) -> DataFrame:
    """defect, gate, status of the factor and geometry cases and of their controls."""
    rows = []
    for name, shift in (("inert_factor", 0.0), ("real_factor", 20.0)):
        a, b = _arms(spark, shift)
        rows.append(separability.separability(a, b, distributional=True, permutations=permutations, permutation_seed=23).select(F.lit(name).alias("defect"), F.lit("separability").alias("gate"), "status", "message"))
    shapes = spark.createDataFrame([("geometry_squeeze", 368, 640, 180, 320), ("geometry_faithful", 360, 640, 180, 320)], "subject string, dh int, dw int, eh int, ew int")
    rows.append(gates.geometry(shapes).select(F.col("subject").alias("defect"), F.lit("geometry").alias("gate"), "status", "message"))
    return reduce(DataFrame.unionByName, rows)


#: Cases of the evaluation gates: what each must trip, none for a control.
EVALUATION = {"inert_factor": "separability", "real_factor": None, "geometry_squeeze": "geometry", "geometry_faithful": None}


def defect_matrix(spark: SparkSession, seed: int = 1234) -> DataFrame:
    """defect, targeted_gate, gate, status, is_target, detected: every variant under every gate that applies to it."""
    targets = spark.createDataFrame([(k, v) for k, v in (DEFECTS | EVALUATION).items()], "defect string, targeted_gate string")
    loader = loader_gates(subjects(spark, list(DEFECTS), [seed])).select(F.regexp_extract("subject", "^([^/]+)/", 1).alias("defect"), "gate", "status", "message")
    found = loader.unionByName(evaluation_gates(spark)).join(F.broadcast(targets), "defect")
    target = F.coalesce(F.col("gate") == F.col("targeted_gate"), F.lit(False))
    return found.select("defect", "targeted_gate", "gate", "status", target.alias("is_target"), (target & (F.col("status") == "FAIL")).alias("detected"))


def false_alarms(spark: SparkSession, seeds: list[int]) -> DataFrame:
    """seed, gate, status, false_alarm of the unmutated loader under many seeds."""
    got = loader_gates(subjects(spark, ["none"], seeds))
    return got.select(F.regexp_extract("subject", "/(-?[0-9]+)$", 1).cast("long").alias("seed"), "gate", "status", (F.col("status") == "FAIL").alias("false_alarm"))
