"""Reports over gate records and timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import upper_median

#: Error of the percentiles that bracket a median (one in so many), and timings of a gate that need no bracket.
BRACKET_ACCURACY, SMALL_GATE = 10_000, 10_000

#: Bytes of the tables read for one part of a shuffle, most parts, and the size from which it counts as unknown.
PART_BYTES, MAX_PARTS, UNKNOWN_BYTES = 8 << 20, 20_000, 1 << 60

#: Copies of a record that are made at once.
COPIES = 10_000


def collateral(matrix: DataFrame) -> DataFrame:
    """Gates that failed without being the target, the control's left out."""
    return matrix.where((F.col("status") == "FAIL") & ~F.col("is_target") & (F.col("defect") != "none")).select("defect", "gate", "status", "targeted_gate")


def gate_cost(timings: DataFrame, gate: str = "gate", seconds: str = "seconds") -> DataFrame:
    """Runs, mean, exact median and maximum by gate. Of a gate with very many timings no task holds all: a first pass
    brackets the median between two approximate percentiles and a second counts what lies below and takes the median's
    one or two values from within the bracket, some thousandths of the timings."""
    plain = timings.select(F.col(gate).alias("gate"), F.col(seconds).cast("double").alias("v"))
    ends = F.percentile_approx("v", F.array(F.lit(0.499), F.lit(0.501)), F.lit(BRACKET_ACCURACY))
    first = plain.groupBy("gate").agg(F.count(F.lit(1)).alias("runs"), F.count("v").alias("n"), F.avg("v").alias("mean_seconds"), F.max("v").alias("max_seconds"), F.min("v").alias("least"), ends.alias("ends"))
    wide = F.col("n") > SMALL_GATE  # a small gate's bracket is all of it
    by = first.withColumns({"lo": F.when(wide, F.col("ends")[0]).otherwise(F.col("least")), "hi": F.when(wide, F.col("ends")[1]).otherwise(F.col("max_seconds"))}).drop("ends", "least")
    low = plain.join(by.select(F.col("gate").alias("of"), "lo", "hi"), F.col("gate").eqNullSafe(F.col("of"))).where(F.col("v") <= F.col("hi"))
    counted = low.groupBy("gate", F.when(F.col("v") >= F.col("lo"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("k"))
    inner = F.when(F.col("v").isNotNull(), F.struct("v", "k"))
    held = counted.groupBy(F.col("gate").alias("of")).agg(F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("below"), F.array_sort(F.collect_list(inner)).alias("held"))
    found = by.join(held, F.col("gate").eqNullSafe(F.col("of")), "left")
    return found.select("gate", "runs", "mean_seconds", _middle().alias("median_seconds"), "max_seconds")


def _middle() -> Column:
    """The mean of the two middle values, by their ranks past ``below`` among ``held`` (value and count, sorted)."""

    def at(rank: Column) -> Column:
        start = F.struct(F.col("below").alias("upto"), F.lit(None).cast("double").alias("v"))
        step = lambda acc, x: F.struct((acc["upto"] + x["k"]).alias("upto"), F.when(acc["v"].isNull() & (acc["upto"] + x["k"] > rank), x["v"]).otherwise(acc["v"]).alias("v"))
        return F.aggregate("held", start, step, lambda acc: acc["v"])

    return (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2


def pass_cost(timings: DataFrame) -> DataFrame:
    """Gates and summed seconds of each seed's pass."""
    return timings.groupBy("seed").agg(F.count(F.lit(1)).alias("gates"), F.sum("seconds").alias("pass_seconds"))


def study_summary(matrix: DataFrame, alarms: DataFrame) -> DataFrame:
    """One row: targets, detected, collateral failures, records without a defect, false alarms."""
    of = matrix.agg(F.count_if("is_target").alias("targets"), F.count_if("detected").alias("detected"), F.count_if((F.col("status") == "FAIL") & ~F.col("is_target") & (F.col("defect") != "none")).alias("collateral"), F.count(F.lit(1)).alias("matrix_rows"))
    counts = alarms.agg(F.count(F.lit(1)).alias("alarm_rows"), F.count_if("false_alarm").alias("false_alarms")).first()
    return of.withColumns({k: F.lit(counts[k]) for k in ("alarm_rows", "false_alarms")})


def slowest_gate(cost: DataFrame) -> DataFrame:
    """The gate of the largest mean."""
    return cost.agg(F.max_by("gate", "mean_seconds").alias("slowest_gate"), F.max("mean_seconds").alias("mean_seconds"))


def portability(results: DataFrame) -> DataFrame:
    """A row a subject and a column a gate."""
    return results.groupBy("subject").pivot("gate").agg(F.first("status"))


def effort(subjects: DataFrame, results: DataFrame) -> DataFrame:
    """Adapter sizes and timings by subject (subject, adapter_loc, gates_seconds by repeat), with gate counts.
    N/A counts as applicable; SKIP and ERROR don't."""
    times = subjects.groupBy("subject").agg(F.max("adapter_loc").alias("adapter_loc"), F.percentile("gates_seconds", F.lit(0.5)).alias("gates_seconds"), F.min("gates_seconds").alias("gates_seconds_min"), F.max("gates_seconds").alias("gates_seconds_max"), F.count(F.lit(1)).alias("repeats"))
    counts = results.groupBy("subject").agg(F.count_if(~F.col("status").isin("SKIP", "ERROR")).alias("gates_applicable"), F.count_if(F.col("status") == "FAIL").alias("gates_failed"), F.count_if(F.col("status") == "UNDECL").alias("gates_undecl"))
    return times.join(counts, "subject", "left")


def effort_summary(table: DataFrame) -> DataFrame:
    """Smallest, upper median and largest adapter."""
    middle = upper_median(table, "adapter_loc")
    return table.agg(F.count(F.lit(1)).alias("subjects"), F.min("adapter_loc").alias("min_loc"), F.lit(middle).cast(table.schema["adapter_loc"].dataType).alias("median_loc"), F.max("adapter_loc").alias("max_loc"))


def portability_summary(effort: DataFrame, results: DataFrame, escalated: bool = True) -> DataFrame:
    """One row on a study of subjects: ``effort`` (subject, outcome of RUN, PARTIAL, UNAVAILABLE, ADAPTER_ERROR,
    GATE_ERROR; adapter_loc, adapter_seconds, gates_failed, gates_undecl) and its gate records. Lists are in order of
    name; sizes, times and sums are those of the subjects that ran."""
    ran = F.col("outcome").isin("RUN", "PARTIAL")
    names = lambda *kinds: F.array_sort(F.collect_list(F.when(F.col("outcome").isin(*kinds), F.col("subject"))))
    of = lambda c: F.when(ran, F.col(c))
    middle = upper_median(effort.where(ran), "adapter_loc")
    told = effort.agg(
        F.count(F.lit(1)).alias("subjects_registered"), F.count_if(ran).alias("subjects_run"), names("UNAVAILABLE").alias("subjects_unavailable"), names("PARTIAL").alias("subjects_partial"),
        names("ADAPTER_ERROR", "GATE_ERROR").alias("subjects_adapter_error"), F.lit(middle).cast("long").alias("median_adapter_loc"), F.min(of("adapter_loc")).alias("min_adapter_loc"), F.max(of("adapter_loc")).alias("max_adapter_loc"),
        F.max(of("adapter_seconds")).alias("max_adapter_seconds"), F.coalesce(F.sum(of("gates_failed")), F.lit(0)).alias("total_failures"), F.coalesce(F.sum(of("gates_undecl")), F.lit(0)).alias("total_undeclared"),
    )
    return told.withColumns({"gate_rows": F.lit(results.count()).cast("long"), "clip_escalation": F.lit(int(escalated))})


def drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Records of the keys' columns that only one side has, with its name; repeated records count each. Each side is read
    once, and its records are added up with its sign."""
    signed = before.select(*keys, F.lit(1).alias("_net")).union(after.select(*keys, F.lit(-1).alias("_net")))
    return _surplus(signed.repartition(parts(signed), *keys), keys)


def verdict_drift(rows: DataFrame, keys: list[str], before: Column, after: Column) -> DataFrame:
    """The drift of keys and status where both sides judge the same rows, which are read once."""
    sides = F.inline(F.array(F.struct(before.alias("status"), F.lit(1).alias("_net")), F.struct(after.alias("status"), F.lit(-1).alias("_net"))))
    return _surplus(rows.select(*keys, sides), [*keys, "status"])


def _surplus(signed: DataFrame, keys: list[str]) -> DataFrame:
    """Each record as often as its signs add up to, with the side that has more of it."""
    net = signed.groupBy(*keys).agg(F.sum("_net").alias("_net")).where(F.col("_net") != 0)
    blocks = net.withColumn("_block", F.explode(F.expr(f"sequence(0L, (abs(_net) - 1) div {COPIES})")))
    side = F.when(F.col("_net") > 0, "before").otherwise("after")
    return blocks.select(*keys, F.explode(F.array_repeat(side, F.least(F.lit(COPIES), F.abs("_net") - F.col("_block") * COPIES).cast("int"))).alias("side"))


def parts(*frames: DataFrame) -> int:
    """Parts for a shuffle of the frames' rows: one for each ``PART_BYTES`` of the tables they read, or as many as the
    session has where their size is not known. Spark merges parts of its own choice by their compressed size, until a
    task holds many millions of short records."""
    leaves = [f._jdf.queryExecution().optimizedPlan().collectLeaves() for f in frames]
    size = sum(int(str(seen.apply(i).stats().sizeInBytes())) for seen in leaves for i in range(seen.size()))
    return min(MAX_PARTS, size // PART_BYTES + 1) if size < UNKNOWN_BYTES else int(frames[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))


def code_lines(text: DataFrame) -> DataFrame:
    """name, lines of code: of Python files given as name, content; blank lines, comments and docstrings don't count."""
    bare = F.regexp_replace("content", r"(?s)(\"\"\".*?\"\"\"|'''.*?''')", "")
    return text.select("name", F.size(F.filter(F.split(bare, "\n"), lambda x: (F.trim(x) != "") & ~F.startswith(F.trim(x), F.lit("#")))).alias("adapter_loc"))
