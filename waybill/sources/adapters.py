"""Subjects as data: adapters that turn tables of pictures into observations, and a study of several that may fail.

A loader is asked for samples by number. Numbers past the end begin again, as data loaders' do, so every adapter
takes any number of draws. Sources are frame tables (frame_pos, h, w, c, px; clips also have clip).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..contracts import CALLS, LOADER_OUTPUT, ContentContract, Declaration, contracts_frame
from ..plans import audit
from .observations import Adapter, AdapterError, contract_of_range


def _draws(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("draw"))


def _numbered(frames: DataFrame) -> int:
    """How many samples a source has; one without any can't be driven."""
    n = frames.count()
    if n == 0:
        raise AdapterError("the source has no frames")
    return n


def _as_observations(rows: DataFrame, subject: str, seed: int, dtype: str) -> DataFrame:
    """Rows of draw, stream, pos, claimed, h, w, c, px in the order of the observations' columns."""
    return rows.select(
        F.lit(subject).alias("subject"), F.lit(LOADER_OUTPUT).alias("boundary"), F.lit(seed).cast("long").alias("seed"), "draw", "stream", F.col("pos").cast("int").alias("frame_pos"), F.col("claimed").cast("int").alias("claimed_frame_id"),
        "h", "w", "c", F.lit(dtype).alias("dtype"), "px",
    )


class _Adapter:
    """What adapters share: no calls unless given, and a number of draws."""

    def __init__(self, name: str, draws: int, calls: DataFrame | None = None, dtype: str = "uint8") -> None:
        self.name, self.draws, self.dtype, self._calls = name, draws, dtype, calls

    def calls(self, spark: SparkSession, declaration: Declaration) -> DataFrame:
        return self._calls if self._calls is not None else spark.createDataFrame([], CALLS)


class PairedPictures(_Adapter):
    """Single pictures, input beside target by frame_pos (from 0, gapless). A draw is a picture of each stream."""

    def __init__(self, name: str, lq: DataFrame, gt: DataFrame | None, draws: int, **options) -> None:
        super().__init__(name, draws, **options)
        self.streams = {"lq": lq} | ({"gt": gt} if gt is not None else {})

    def observe(self, spark: SparkSession, declaration: Declaration) -> DataFrame:
        n = _numbered(self.streams["lq"])
        asked = _draws(spark, self.draws).withColumn("frame_pos", F.pmod("draw", F.lit(n)).cast("int"))
        both = None
        for stream, frames in self.streams.items():
            got = asked.join(frames, "frame_pos").select("draw", F.lit(stream).alias("stream"), F.lit(0).alias("pos"), F.col("frame_pos").alias("claimed"), "h", "w", "c", "px")
            both = got if both is None else both.unionByName(got)
        return _as_observations(both, self.name, declaration.seed, self.dtype)


class InputOnly(PairedPictures):
    """Pictures without any target."""

    def __init__(self, name: str, lq: DataFrame, draws: int, **options) -> None:
        super().__init__(name, lq, None, draws, **options)


class OnlineInput(PairedPictures):
    """The input is made from the target as it is read: ``degrade`` gives the input's values from the target's."""

    def __init__(self, name: str, gt: DataFrame, degrade: Callable[[Column], Column], draws: int, channels: int | None = None, **options) -> None:
        made = gt.withColumn("px", degrade(F.col("px")))
        super().__init__(name, made if channels is None else made.withColumn("c", F.lit(channels)), gt, draws, **options)


class ClipFolder(_Adapter):
    """Clips: a draw is a window of num_frames consecutive frames of one clip. Draw d reads the clip of rank d modulo
    the clips, from the start of number d div clips modulo that clip's windows; clips shorter than a window aren't
    sampled. Only the clips' lengths are ranked, a row a clip."""

    def __init__(self, name: str, lq: DataFrame, gt: DataFrame | None, draws: int, **options) -> None:
        super().__init__(name, draws, **options)
        self.streams = {"lq": lq} | ({"gt": gt} if gt is not None else {})

    def windows(self, spark: SparkSession, num_frames: int) -> DataFrame:
        """draw, clip, start."""
        lengths = self.streams["lq"].groupBy("clip").agg(F.count(F.lit(1)).alias("length")).where(F.col("length") >= num_frames)
        ranked = lengths.withColumn("rank", F.row_number().over(Window.orderBy("clip")) - 1)
        n = _numbered(lengths)
        asked = _draws(spark, self.draws).withColumn("rank", F.pmod("draw", F.lit(n)).cast("int"))
        start = F.pmod(F.floor(F.col("draw") / n), F.col("length") - num_frames + 1).cast("int")
        return asked.join(ranked, "rank").select("draw", "clip", start.alias("start"))

    def observe(self, spark: SparkSession, declaration: Declaration) -> DataFrame:
        at = self.windows(spark, declaration.num_frames).select("draw", "clip", F.posexplode(F.sequence("start", F.col("start") + declaration.num_frames - 1)).alias("pos", "frame_pos"))
        both = None
        for stream, frames in self.streams.items():
            got = at.join(frames, ["clip", "frame_pos"]).select("draw", F.lit(stream).alias("stream"), "pos", F.col("frame_pos").alias("claimed"), "h", "w", "c", "px")
            both = got if both is None else both.unionByName(got)
        return _as_observations(both, self.name, declaration.seed, self.dtype)


# Subjects ---------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Subject:
    """A row of the registry: a public loader, the kind of adapter that reads its data, and what it declares."""

    loader: str
    kind: str
    declaration: Declaration


def _subject(name: str, loader: str, kind: str, lo: float, hi: float, extrema: tuple[bool, bool] = (True, True), channels: tuple[int, int] = (3, 3), **declared) -> Subject:
    one = lambda i: contract_of_range(lo, hi, channels[i], extrema[i])
    content = ContentContract(one(0), one(1) if declared.get("has_target", True) else None)
    return Subject(loader, kind, Declaration(name, content=content, **declared))


#: Eight public training loaders and their declarations (fixed values).
REGISTRY: dict[str, Subject] = {
    s.declaration.subject: s
    for s in (
        _subject("kair_video", "VideoRecurrentTrainDataset", "clips", 0, 255, use_precomputed=True),
        _subject("kair_blindsr", "DatasetBlindSR", "online", 0, 255, (False, True), num_frames=1, operator_policy="random_permutation"),
        _subject("uformer", "DataLoaderTrain", "pairs", 0, 1, num_frames=1, use_precomputed=True),
        _subject("mprnet", "DataLoaderTrain", "pairs", 0, 1, num_frames=1, use_precomputed=True),
        _subject("zerodce", "lowlight_loader", "input", 0, 1, (False, False), num_frames=1, has_target=False, use_precomputed=True),
        _subject("mmagic", "BasicFramesDataset", "clips", 0, 255, use_precomputed=True),
        _subject("pix2pix_colorization", "ColorizationDataset", "online", -1, 1, (False, False), (1, 2), num_frames=1),
        _subject("basicsr_reds", "REDSDataset", "clips", 0, 255, clip_length=100, use_precomputed=True),
    )
}


@dataclass
class Study:
    """What a study of subjects gave: outcomes (subject, outcome, error) and the gate records of those that ran."""

    outcomes: DataFrame
    results: DataFrame | None


def run_subjects(
    spark: SparkSession, subjects: dict[str, Callable[[], Adapter | None]], declarations: dict[str, Declaration] | None = None, operators: tuple[str, ...] = (), transform: str | None = None,
) -> Study:
    """Audit subjects each of which may be missing or break without harm to the others.

    A subject is a function that makes its adapter. None or a missing file: UNAVAILABLE. Any other error while it is
    made or asked for its observations: ADAPTER_ERROR, with the error's name and text (300 characters). The others
    RUN; one whose gates had to skip is PARTIAL. All that run are audited by one plan.
    """
    known = declarations or {k: s.declaration for k, s in REGISTRY.items()}
    told: list[tuple[str, str, str]] = []
    seen, called, ran = [], [], []
    for name, make in subjects.items():
        try:
            adapter, declared = make(), replace(known[name], subject=name)
            if adapter is None:
                told.append((name, "UNAVAILABLE", "not present"))
                continue
            rows, calls = adapter.observe(spark, declared), adapter.calls(spark, declared)
        except FileNotFoundError as missing:
            told.append((name, "UNAVAILABLE", str(missing)[:300]))
        except Exception as broken:  # whatever a foreign loader raises is its outcome
            told.append((name, "ADAPTER_ERROR", f"{type(broken).__name__}: {broken}"[:300]))
        else:
            seen.append(rows)
            called.append(calls.withColumn("subject", F.lit(name)))
            ran.append(declared)
    failed = spark.createDataFrame(told, "subject string, outcome string, error string")
    if not ran:
        return Study(failed, None)
    observations, calls = seen[0], called[0]
    for rows, more in zip(seen[1:], called[1:], strict=True):
        observations, calls = observations.unionByName(rows), calls.unionByName(more)
    contracts = contracts_frame(spark, {d.subject: d.content for d in ran if d.content is not None})
    results = audit.audit(observations, calls, contracts, ran, operators, transform)
    skipped = results.groupBy("subject").agg(F.count_if(F.col("status").isin("SKIP", "ERROR")).alias("n"))
    outcomes = skipped.select("subject", F.when(F.col("n") > 0, "PARTIAL").otherwise("RUN").alias("outcome"), F.lit("").alias("error"))
    return Study(outcomes.unionByName(failed), results)
