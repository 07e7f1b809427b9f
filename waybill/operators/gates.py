"""The gates: each takes observations and declarations as DataFrames and gives one typed row a subject (or
stream), lazily. ``as_results`` brings any of them to the common record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import LOADER_OUTPUT, StreamContract
from ..functions import stats

#: Clip lengths tried in turn, and the least share of values near either end of a checkerboard (fixed values).
ESCALATION = (16, 32, 64, 100, 200)
BIMODAL_SHARE = 0.80


def gate_name(gate: str, boundary: str = LOADER_OUTPUT) -> str:
    """Content gates away from the loader carry their boundary in their name."""
    return gate if boundary == LOADER_OUTPUT else f"{gate}[{boundary}]"


def as_results(rows: DataFrame, gate: str | None = None) -> DataFrame:
    """subject, gate, status, message, evidence: what else a gate found goes into evidence as JSON."""
    fixed = ("subject", "gate", "status", "message")
    rest = [c for c in rows.columns if c not in fixed]
    evidence = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    name = F.lit(gate) if gate else F.col("gate")
    return rows.select("subject", name.alias("gate"), "status", (F.col("message") if "message" in rows.columns else F.lit("")).alias("message"), evidence.alias("evidence"))


# Range ------------------------------------------------------------------------------------------------------------


def range_status(rows: DataFrame) -> DataFrame:
    """Decide from n, n_bad (non-finite), v_min, v_max beside a contract's columns. A stream with non-finite values
    is not tested for bounds; failures are listed in order."""
    tested = (F.col("n") > 0) & (F.col("n_bad") == 0) & F.col("lo").isNotNull()
    below = F.col("v_min") < F.col("lo") - F.col("range_atol")
    above = F.col("v_max") > F.col("hi") + F.col("range_atol")
    no_lo = F.abs(F.col("v_min") - F.col("lo")) > F.col("range_atol")
    no_hi = F.abs(F.col("v_max") - F.col("hi")) > F.col("range_atol")
    found = F.array(
        F.when(F.coalesce(F.col("n"), F.lit(0)) == 0, "absent or empty"),
        F.when((F.col("n_bad") > 0) & F.col("require_finite"), "non-finite values"),
        F.when(tested & (below | above), "outside the declared range"),
        F.when(tested & F.col("require_extrema") & ~(below | above) & (no_lo | no_hi), "declared extremes not reached"),
    )
    declared = F.col("lo").isNotNull() | F.coalesce(F.col("require_extrema"), F.lit(False))
    failures = F.concat_ws("; ", F.filter(found, lambda x: x.isNotNull()))
    status = F.when(F.coalesce(~declared, F.lit(True)), "N/A").when(failures != "", "FAIL").otherwise("PASS")
    return rows.withColumn("message", F.when(status == "N/A", "no range declared").otherwise(failures)).withColumn("status", status)


def range_of_columns(table: DataFrame, contracts: dict[str, StreamContract | None], subject: str) -> DataFrame:
    """Range gate over columns of a table, one row a column. All of them are one aggregation over one scan."""
    finite = lambda c: ~stats.non_finite(F.col(c).cast("double"))
    aggs = [x for c in contracts for x in (F.count(c).alias(f"{c}__n"), F.count_if(~finite(c)).alias(f"{c}__bad"), F.min(F.when(finite(c), F.col(c).cast("double"))).alias(f"{c}__min"), F.max(F.when(finite(c), F.col(c).cast("double"))).alias(f"{c}__max"))]

    def stream(name: str, c: StreamContract | None) -> Column:
        c = c or StreamContract()
        return F.struct(
            F.lit(subject).alias("subject"), F.lit(name).alias("stream"), F.col(f"{name}__n").alias("n"), F.col(f"{name}__bad").alias("n_bad"), F.col(f"{name}__min").alias("v_min"), F.col(f"{name}__max").alias("v_max"),
            F.lit(c.lo).cast("double").alias("lo"), F.lit(c.hi).cast("double").alias("hi"), F.lit(c.range_atol).alias("range_atol"), F.lit(c.require_extrema).alias("require_extrema"), F.lit(c.require_finite).alias("require_finite"),
        )

    rows = table.agg(*aggs).select(F.inline(F.array(*(stream(k, v) for k, v in contracts.items()))))
    return range_status(rows).select("subject", "stream", "status", "message", "n", "n_bad", "v_min", "v_max")


def value_range(observations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Range gate over observed frames: subject, boundary, stream, status. A declared stream that delivered nothing
    fails; a stream without a contract row is not judged. Contracts have a row a subject and stream."""
    px = F.col("px")
    good = F.filter(px, lambda v: ~stats.non_finite(v))
    frames = observations.select("subject", "boundary", "stream", F.size(px).cast("long").alias("n"), (F.size(px) - F.size(good)).alias("bad"), F.array_min(good).alias("lo_"), F.array_max(good).alias("hi_"))
    seen = frames.groupBy("subject", "boundary", "stream").agg(F.sum("n").alias("n"), F.sum("bad").alias("n_bad"), F.min("lo_").alias("v_min"), F.max("hi_").alias("v_max"))
    at = seen.select("subject", "boundary").distinct()
    asked = contracts.join(at, "subject")
    return range_status(asked.join(seen, ["subject", "boundary", "stream"], "left")).select("subject", "boundary", "stream", "status", "message", "n", "n_bad", "v_min", "v_max")


# Channels ---------------------------------------------------------------------------------------------------------


def channel_status(rows: DataFrame) -> DataFrame:
    """Decide from n_frames, n_wrong (frames with another number of channels) and least_mae beside a contract."""
    wrong = F.col("n_wrong") > 0
    collapsed = F.col("require_distinct") & (F.coalesce(F.col("least_mae"), F.lit(0.0)) <= F.col("channel_atol"))
    status = F.when(F.col("channels").isNull(), "N/A").when((F.coalesce(F.col("n_frames"), F.lit(0)) == 0) | wrong | collapsed, "FAIL").otherwise("PASS")
    message = F.when(F.col("channels").isNull(), "no channels declared").when(F.coalesce(F.col("n_frames"), F.lit(0)) == 0, "absent or empty").when(wrong, "another number of channels").when(collapsed, "channels collapse").otherwise("")
    return rows.withColumn("message", message).withColumn("status", status)


def channel_content(observations: DataFrame, contracts: DataFrame) -> DataFrame:
    """Channel gate over observed frames: every frame's number of channels, and the least mean difference of two
    channels over all frames, of any number of channels."""
    frames = observations.select("subject", "boundary", "stream", "c", stats.least_mae_of_frame(F.col("px"), F.col("c")).alias("mae"))
    asked = contracts.select("subject", "stream", "channels", "require_distinct", "channel_atol")
    seen = frames.join(asked, ["subject", "stream"]).groupBy("subject", "boundary", "stream").agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.col("c") != F.col("channels")).alias("n_wrong"), F.min("mae").alias("least_mae"))
    at = observations.select("subject", "boundary").distinct()
    return channel_status(asked.join(at, "subject").join(seen, ["subject", "boundary", "stream"], "left")).select("subject", "boundary", "stream", "status", "message", "n_frames", "n_wrong", "least_mae")


def channels_of_column(table: DataFrame, column: str, channels: int, watched: int, atol: float, subject: str) -> DataFrame:
    """Channel gate over an array column whose elements are channels and whose rows are pixels of one frame: the
    number of channels of every row, and the least mean difference of any two of the first ``watched``. Differences are
    summed by pair within each task first, so that a few thousand sums a task are shuffled."""
    x = F.transform(F.slice(F.col(column), 1, watched), lambda v: v.cast("double"))
    got = table.agg(F.count(F.lit(1)).alias("n_frames"), F.count_if(F.size(column) != channels).alias("n_wrong"))
    least = F.lit(0.0)
    if watched > 1:
        pairs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(watched - 1)), lambda b: F.transform(F.sequence(F.lit(0), b - 1), lambda a: F.abs(F.get("x", a) - F.get("x", b)))))
        means = table.select(x.alias("x")).select(F.posexplode(pairs).alias("pair", "d")).groupBy("pair").agg(F.avg("d").alias("mae"))
        got = got.crossJoin(means.agg(F.min("mae").alias("least")))  # one row beside one row
        least = F.col("least")
    rows = got.select(F.lit(subject).alias("subject"), "n_frames", "n_wrong", least.alias("least_mae"), F.lit(channels).alias("channels"), F.lit(watched > 1).alias("require_distinct"), F.lit(atol).alias("channel_atol"))
    return channel_status(rows).select("subject", "status", "message", "n_frames", "n_wrong", "least_mae")


# Sampling windows -------------------------------------------------------------------------------------------------


def temporal_window(delivered: DataFrame, num_frames: int, clip_length: int | None = None, clips: DataFrame | None = None) -> DataFrame:
    """Window gate. delivered: subject, draw, pos, frame_id (null where undecodable), claimed_id (null: no claim).
    Clips are of one length, or of each subject's own (``clips``: subject, clip_length), and then every subject of
    ``clips`` gets a row.

    In this order: no probe SKIP; windows of one frame N/A; first probe of another length; all probes one window
    that starts the clip (prefix); all probes one window (inert); first claim differs from what came; else PASS.
    """
    frame = F.struct("pos", F.col("frame_id").alias("id"), F.col("claimed_id").alias("claim"))
    draws = delivered.groupBy("subject", "draw").agg(F.array_sort(F.collect_list(frame)).alias("frames"))
    ids = F.transform("frames", lambda f: f["id"])
    claims = F.transform("frames", lambda f: f["claim"])
    draws = draws.select("subject", "draw", ids.alias("ids"), F.when(F.forall("frames", lambda f: f["claim"].isNotNull()), claims).alias("claims"))
    first = lambda c: F.min_by(F.col(c), F.col("draw"))
    seen = draws.groupBy("subject").agg(
        F.count(F.lit(1)).alias("n_probes"), F.count_distinct(F.to_json(F.struct("ids"))).alias("n_windows"), F.size(first("ids")).alias("first_length"), first("ids").alias("first_ids"), first("claims").alias("first_claims"),
    )
    covered = delivered.groupBy("subject").agg(F.count_distinct("frame_id").alias("n_ids"))
    rows = seen.join(covered, "subject")
    rows = rows.withColumn("clip_length", F.lit(clip_length)) if clips is None else clips.join(rows, "subject", "left")
    prefix = F.coalesce(F.col("first_ids") == F.sequence(F.lit(0), F.lit(max(0, num_frames - 1))).cast("array<int>"), F.lit(False))
    one = F.col("n_windows") == 1
    mismatch = F.col("first_claims").isNotNull() & ~F.coalesce(F.col("first_claims").eqNullSafe(F.col("first_ids")), F.lit(False))
    reason = F.when(F.col("n_probes").isNull(), "no probe").when(F.lit(num_frames <= 1), "a window of one frame").when(F.col("first_length") != num_frames, "length").when(one & prefix, "prefix").when(one, "inert").when(mismatch, "mismatch").otherwise("")
    status = F.when(reason == "no probe", "SKIP").when(reason == "a window of one frame", "N/A").when(reason != "", "FAIL").otherwise("PASS")
    return rows.select("subject", status.alias("status"), reason.alias("message"), "n_probes", "n_windows", "n_ids", F.round(F.col("n_ids") / F.col("clip_length"), 4).alias("coverage"), one.alias("exhaustive"))


# Target transforms ------------------------------------------------------------------------------------------------


def target_transforms(frames: DataFrame, calls: DataFrame, name: str, expected: float, declared: bool = True, has_target: bool = True) -> DataFrame | None:
    """Transform gate. frames: subject, draw, n_target (target frames delivered; 0 for none); calls as observed.
    One row a draw: calls of ``name`` a target frame against what is expected. A draw without calls counts 0.
    Without a declared target nothing is joined or counted."""
    if not has_target:
        return frames.select("subject", "draw", F.lit("N/A").alias("status"), F.lit("no target declared").alias("message"), F.lit(None).cast("long").alias("n_calls"), F.lit(None).cast("double").alias("per_frame"))
    status = transform_status(expected, declared)
    message = F.when(_absent(), "target declared but absent").when(status == "PASS", "").when(status == "UNDECL", "transforms that nobody declared").otherwise("another number of transforms")
    return transform_counts(frames, calls, name).select("subject", "draw", status.alias("status"), message.alias("message"), "n_calls", _per_frame().alias("per_frame"))


def transform_counts(frames: DataFrame, calls: DataFrame, name: str) -> DataFrame:
    """The frames with n_calls: calls of ``name`` in their draw."""
    counts = calls.where(F.col("name") == name).groupBy("subject", "draw").agg(F.count(F.lit(1)).alias("n_calls"))
    return frames.join(counts, ["subject", "draw"], "left").withColumn("n_calls", F.coalesce("n_calls", F.lit(0).cast("long")))


def _per_frame() -> Column:
    return F.when(F.col("n_target") > 0, F.col("n_calls") / F.col("n_target")).otherwise(F.lit(0.0))


def _absent() -> Column:
    return F.coalesce(F.col("n_target"), F.lit(0)) == 0


def transform_status(expected: float, declared: bool = True) -> Column:
    """Status of a row of ``transform_counts``."""
    return F.when(_absent(), "FAIL").when(F.abs(_per_frame() - expected) < 1e-9, "PASS").when(F.lit(expected == 0 and not declared), "UNDECL").otherwise("FAIL")


# Operator order ---------------------------------------------------------------------------------------------------


def operator_orders(calls: DataFrame, operators: list[str]) -> DataFrame:
    """subject, draw, order: the watched calls of a draw, repeats in a row once, as many as there are operators."""
    by = Window.partitionBy("subject", "draw").orderBy("call_pos")
    some = calls.where(F.col("name").isin(list(operators)))
    runs = some.withColumn("before", F.lag("name").over(by)).where(F.col("before").isNull() | (F.col("before") != F.col("name")))
    top = runs.withColumn("rn", F.row_number().over(by)).where(F.col("rn") <= len(set(operators)))
    return top.groupBy("subject", "draw").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda x: x["name"]), "->").alias("order"))


def operator_trace(calls: DataFrame, operators: list[str], policy: str = "random_permutation") -> DataFrame:
    """Order gate: under ``random_permutation`` draws must differ; under any other policy they must agree. A
    subject none of whose draws calls a watched operator is skipped."""
    orders = operator_orders(calls, operators)
    seen = calls.select("subject").distinct().join(orders.groupBy("subject").agg(F.count(F.lit(1)).alias("n_draws"), F.count_distinct("order").alias("n_orders")), "subject", "left")
    n = F.coalesce(F.col("n_orders"), F.lit(0))
    bad = (n == 1) if policy == "random_permutation" else (n > 1)
    status = F.when(n == 0, "SKIP").when(bad, "FAIL").otherwise("PASS")
    message = F.when(n == 0, "no watched operator was called").when(bad, "one order in all draws" if policy == "random_permutation" else "orders differ").otherwise("")
    return seen.select("subject", status.alias("status"), message.alias("message"), F.coalesce("n_draws", F.lit(0).cast("long")).alias("n_draws"), n.cast("long").alias("n_orders"))


# Pre-computed inputs ----------------------------------------------------------------------------------------------


def precomputed_input(frames: DataFrame, calls: DataFrame, declared: bool = True, generator: str = "generator") -> DataFrame:
    """Gate for inputs that were made beforehand. frames: subject, px of input frames when a checkerboard input lay beside
    a flat target. The delivered frames must show the checkerboard, and no generator may have been called."""
    shown = frames.groupBy("subject").agg(F.avg(stats.bimodality(stats.to_255(F.col("px")))).alias("bimodality"))
    return precomputed_status(shown, calls, declared, generator)


def precomputed_status(shown: DataFrame, calls: DataFrame, declared: bool, generator: str = "generator") -> DataFrame:
    reached = calls.where(F.col("name").startswith(generator)).groupBy("subject").agg(F.count(F.lit(1)).alias("n_generator"))
    rows = shown.join(reached, "subject", "left").withColumn("n_generator", F.coalesce("n_generator", F.lit(0).cast("long")))
    good = (F.col("bimodality") >= BIMODAL_SHARE) & (F.col("n_generator") == 0)
    status = F.when(good, "PASS").otherwise(F.lit("FAIL" if declared else "N/A"))
    message = F.when(good, "").when(F.col("n_generator") > 0, "the generator was reached").otherwise("the input is not what lay there")
    return rows.select("subject", status.alias("status"), message.alias("message"), "bimodality", "n_generator")


# Geometry ---------------------------------------------------------------------------------------------------------


def geometry(shapes: DataFrame, aspect_tol: float = 0.005, deliver=None) -> DataFrame:
    """Shape gate. shapes: subject, dh, dw (delivered), eh, ew (declared). ``deliver``: a function of the declared
    columns (eh, ew) to delivered ones, in place of recorded shapes."""
    source = "recorded"
    if deliver is not None:
        dh, dw = deliver(F.col("eh"), F.col("ew"))
        shapes, source = shapes.select("subject", "eh", "ew", dh.alias("dh"), dw.alias("dw")), "measured"
    error = stats.aspect_error(F.col("dh"), F.col("dw"), F.col("eh"), F.col("ew"))
    same = (F.col("dh") == F.col("eh")) & (F.col("dw") == F.col("ew"))
    status = F.when(same | (error <= aspect_tol), "PASS").otherwise("FAIL")
    message = F.when(same, "").when(error <= aspect_tol, "another size of the same aspect").otherwise("aspect changed")
    return shapes.select("subject", status.alias("status"), message.alias("message"), F.round(error, 6).alias("aspect_error"), F.lit(source).alias("shape_source"))


# Clip escalation --------------------------------------------------------------------------------------------------


def escalate(outcomes: DataFrame, default: int, declared: int | None = None) -> DataFrame:
    """Escalation over outcomes (subject, length, ok, status): what a gate gave on clips of each length, ok false
    where the source could not run on it. A declared length is taken as it is. Else the default; and where it can't
    run, the first longer length of the ladder that can: then a FAIL stays, and all else is UNDECL, since
    the need was never declared. Subjects that run on no length are ERROR."""
    if declared is not None:
        return outcomes.where((F.col("length") == declared) & F.col("ok")).select("subject", F.col("length").alias("used"), "status", F.lit(False).alias("escalated"))
    tried = outcomes.where(F.col("ok") & ((F.col("length") == default) | ((F.col("length") > default) & F.col("length").isin(*ESCALATION))))
    best = tried.groupBy("subject").agg(F.min("length").alias("used"), F.min_by("status", "length").alias("under"))
    rows = outcomes.select("subject").distinct().join(best, "subject", "left")
    far = F.coalesce(F.col("used") > default, F.lit(False))
    status = F.when(F.col("used").isNull(), "ERROR").when(far & (F.col("under") != "FAIL"), "UNDECL").otherwise(F.col("under"))
    return rows.select("subject", "used", status.alias("status"), far.alias("escalated"))
