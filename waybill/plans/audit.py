"""The audit: every gate that its declaration makes applicable, over tables of observations and calls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import LOADER_OUTPUT, Declaration
from ..functions.stats import decode_index
from ..functions.status import verdict
from ..operators import gates, separability

ORDER = ("precomputed_input", "temporal_window", "target_transforms", "operator_trace", "value_range", "channel_content")
#: All gates by name, in the order of the catalogue (fixed names).
ALL_CHECKS = {
    "precomputed_input": gates.precomputed_input, "temporal_window": gates.temporal_window, "separability": separability.separability, "target_transforms": gates.target_transforms,
    "operator_trace": gates.operator_trace, "value_range": gates.value_range, "channel_content": gates.channel_content, "geometry": gates.geometry,
}
#: Why a gate that applies has no record: nothing was delivered, or nothing was called.
NO_DATA = {
    "precomputed_input": "no input was delivered", "temporal_window": "no probe", "target_transforms": "no sample could be drawn", "operator_trace": "no draw called anything", "value_range": "nothing was delivered",
    "channel_content": "nothing was delivered", "geometry": "no shape was recorded",
}


def _worst(rows: DataFrame) -> DataFrame:
    """One record a subject from several (streams, draws): the one whose status weighs most, and all as evidence."""
    weight = F.expr("CASE status WHEN 'FAIL' THEN 4 WHEN 'UNDECL' THEN 3 WHEN 'SKIP' THEN 2 WHEN 'PASS' THEN 1 ELSE 0 END")
    return rows.groupBy("subject").agg(F.max_by("status", weight).alias("status"), F.max_by("message", weight).alias("message"), F.count(F.lit(1)).alias("parts"), F.count_if(F.col("status") == "FAIL").alias("failed"))


def audit(
    observations: DataFrame, calls: DataFrame, contracts: DataFrame, declarations: list[Declaration], operators: tuple[str, ...] = (), transform: str | None = None, shapes: DataFrame | None = None, lengths: DataFrame | None = None,
) -> DataFrame:
    """subject, gate, status, message, evidence: a record for every declared subject and gate, whatever was observed.

    Declarations are known on the driver, so a gate that one rules out is never planned: it is a record N/A. A gate that
    applies and has nothing to judge is SKIP, so a subject that delivered nothing can't pass. Subjects that share a
    window length, policy and transform declaration share a query: a study of many subjects is as many queries as there
    are kinds of declarations. Frame numbers are read from the target stream, or from the input where no target is
    declared. ``shapes`` (subject, dh, dw, eh, ew) adds the geometry gate; ``lengths`` (subject, gate, length, ok,
    status: outcomes on clips of each length, as :func:`gates.escalate` takes them) sets the status of the gates in it
    by the escalation rule, and a gate that ran on no length is ERROR, which no verdict passes.
    """
    spark = observations.sparkSession
    seen = observations.where(F.col("boundary") == LOADER_OUTPUT)
    parts: list[DataFrame] = [gates.as_results(_worst(gates.value_range(seen, contracts)), "value_range"), gates.as_results(_worst(gates.channel_content(seen, contracts)), "channel_content")]
    wanted = [(d.subject, g, "SKIP", NO_DATA[g]) for d in declarations for g in ("value_range", "channel_content")]

    def groups(gate: str, applies, key, why: str):
        """Subjects by kind of declaration; those that the gate does not apply to get their record at once."""
        kinds: dict = {}
        for d in declarations:
            wanted.append((d.subject, gate, "SKIP", NO_DATA[gate]) if applies(d) else (d.subject, gate, "N/A", why))
            if applies(d):
                kinds.setdefault(key(d), []).append(d.subject)
        return kinds.items()

    of = lambda table, names: table.where(F.col("subject").isin(names))
    for (target, frames, length), names in groups("temporal_window", lambda d: d.num_frames > 1, lambda d: (d.has_target, d.num_frames, d.fixture_clip_length or d.clip_length or 32), "a window of one frame"):
        own = of(seen, names).where(F.col("stream") == ("gt" if target else "lq"))
        ids = own.select("subject", "draw", F.col("frame_pos").alias("pos"), decode_index(F.col("px"), F.col("dtype").startswith("float") | (F.col("dtype") == "double")).alias("frame_id"), F.col("claimed_frame_id").alias("claimed_id"))
        parts.append(gates.as_results(gates.temporal_window(ids, frames, length), "temporal_window"))
    if operators:
        for (policy,), names in groups("operator_trace", lambda d: True, lambda d: (d.operator_policy,), ""):
            parts.append(gates.as_results(gates.operator_trace(of(calls, names), list(operators), policy), "operator_trace"))
    if transform is not None:
        for (expected, declared), names in groups("target_transforms", lambda d: d.has_target, lambda d: (d.target_transforms, d.transform_declared), "no target declared"):
            frames = of(seen, names).groupBy("subject", "draw").agg(F.count_if(F.col("stream") == "gt").cast("int").alias("n_target"))
            parts.append(gates.as_results(_worst(gates.target_transforms(frames, of(calls, names), transform, expected, declared)), "target_transforms"))
    for _, names in groups("precomputed_input", lambda d: d.use_precomputed, lambda d: (), "no pre-computed input declared"):
        parts.append(gates.as_results(gates.precomputed_input(of(seen, names).where("stream = 'lq'"), of(calls, names)), "precomputed_input"))
    if shapes is not None:
        parts.append(gates.as_results(gates.geometry(shapes), "geometry"))
        wanted += [(d.subject, "geometry", "SKIP", NO_DATA["geometry"]) for d in declarations]
    asked = spark.createDataFrame(wanted, "subject string, gate string, unmet string, why string")
    found = reduce(DataFrame.unionByName, parts)
    told = asked.join(found, ["subject", "gate"], "left").select("subject", "gate", F.coalesce("status", "unmet").alias("status"), F.coalesce("message", "why").alias("message"), F.coalesce("evidence", F.lit("{}")).alias("evidence"))
    return told if lengths is None else _escalated(told, lengths, declarations)


def _escalated(results: DataFrame, lengths: DataFrame, declarations: list[Declaration]) -> DataFrame:
    """The records with the status that escalation gives where outcomes by clip length are known; the gate's own status
    and the length used stay as evidence."""
    key = F.concat_ws("|", "subject", "gate")
    plain = lengths.select(key.alias("subject"), "length", "ok", "status")
    declared = {d.subject: d.clip_length for d in declarations if d.clip_length is not None}
    free = plain.where(~F.substring_index("subject", "|", 1).isin([*declared, ""]))
    made = [gates.escalate(free, 32).withColumn("declared", F.lit(None).cast("int"))]
    for length in sorted(set(declared.values())):
        own = plain.where(F.substring_index("subject", "|", 1).isin([s for s, n in declared.items() if n == length]))
        made.append(gates.escalate(own, 32, length).withColumn("declared", F.lit(length)))
    steps = reduce(DataFrame.unionByName, made).select(F.col("subject").alias("key"), "used", F.col("status").alias("stepped"), "escalated")
    both = results.withColumn("key", key).join(steps, "key", "left")
    need = F.when(F.col("escalated"), F.concat(F.lit("needs clips of "), F.col("used").cast("string"), F.lit(", which nobody declared"))).when(F.col("stepped") == "ERROR", "ran on no clip length")
    evidence = F.when(F.col("stepped").isNull(), F.col("evidence")).otherwise(F.to_json(F.struct(F.col("used").alias("clip_length"), F.col("status").alias("underlying_status"), F.col("evidence").alias("underlying"))))
    return both.select("subject", "gate", F.coalesce("stepped", "status").alias("status"), F.coalesce(need, "message").alias("message"), evidence.alias("evidence"))


def verdicts(results: DataFrame) -> DataFrame:
    """subject, status."""
    return results.groupBy("subject").agg(verdict(F.col("status")).alias("status"))
