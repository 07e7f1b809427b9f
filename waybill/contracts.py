"""What a pipeline declares about the data it delivers, and the tables those declarations become."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: Gate statuses and the boundaries at which data are observed (fixed values).
PASS, FAIL, SKIP, NOT_APPLICABLE, UNDECLARED_GATE = "PASS", "FAIL", "SKIP", "N/A", "UNDECL"
GATE_STATUSES = (PASS, FAIL, SKIP, NOT_APPLICABLE, UNDECLARED_GATE)
LOADER_OUTPUT, TRAINING_STEP_INPUT = "loader_output", "training_step_input"

OBSERVATIONS = "subject string, boundary string, seed long, draw int, stream string, frame_pos int, claimed_frame_id int, h int, w int, c int, dtype string, px array<double>"
CALLS = "subject string, seed long, draw int, call_pos int, name string"
CONTRACTS = "subject string, stream string, lo double, hi double, range_atol double, require_extrema boolean, require_finite boolean, channels int, require_distinct boolean, channel_atol double"


@dataclass(frozen=True)
class StreamContract:
    """Range and channels of one stream; what is None is not declared."""

    lo: float | None = None
    hi: float | None = None
    range_atol: float = 1e-5
    require_extrema: bool = False
    require_finite: bool = True
    channels: int | None = None
    require_distinct: bool = False
    channel_atol: float = 1e-5

    def __post_init__(self) -> None:
        if (self.lo is None) != (self.hi is None):
            raise ValueError("a range has both ends")
        if self.lo is not None and not (math.isfinite(self.lo) and math.isfinite(self.hi) and self.lo < self.hi):
            raise ValueError("a range has finite ends in rising order")
        if self.range_atol < 0 or self.channel_atol < 0:
            raise ValueError("tolerances are not negative")
        if self.channels is not None and self.channels < 1:
            raise ValueError("a stream has a channel at least")
        if self.require_distinct and (self.channels is None or self.channels < 2):
            raise ValueError("distinct channels need two at least")


@dataclass(frozen=True)
class ContentContract:
    """Contracts of the input stream and, where a target is delivered, of the target."""

    lq: StreamContract
    gt: StreamContract | None = None

    def streams(self) -> dict[str, StreamContract]:
        return {"lq": self.lq} | ({"gt": self.gt} if self.gt else {})


@dataclass
class Declaration:
    """What a subject claims about its deliveries. The window of one sample (num_frames), the clip length that a
    source needs (clip_length) and the length that was manufactured (fixture_clip_length) are three things."""

    subject: str = ""
    num_frames: int = 5
    clip_length: int | None = None
    fixture_clip_length: int | None = None
    has_target: bool = True
    use_precomputed: bool = False
    operator_policy: str = "fixed"
    target_transforms: int = 0
    transform_declared: bool = True
    output_shape: tuple[int, int] | None = None
    seed: int = 0
    train: bool = True
    content: ContentContract | None = None
    options: dict[str, str] = field(default_factory=dict)


def contracts_frame(spark: SparkSession, contracts: dict[str, ContentContract]) -> DataFrame:
    """Contracts by subject as a table, a row a stream."""
    names = [c.split()[0] for c in CONTRACTS.split(", ")]
    real = {"lo", "hi", "range_atol", "channel_atol"}
    plain = lambda n, v: float(v) if n in real and v is not None else v
    rows = [tuple(plain(n, ({"subject": s, "stream": k} | asdict(v))[n]) for n in names) for s, c in contracts.items() for k, v in c.streams().items()]
    return spark.createDataFrame(rows, CONTRACTS)


def invalid_contracts(contracts: DataFrame) -> DataFrame:
    """The rows of a contracts table that the dataclass would refuse, with the reason: the same rules as a query."""
    return contracts.selectExpr("*", """CASE
        WHEN (lo IS NULL) <> (hi IS NULL) THEN 'a range has both ends'
        WHEN lo IS NOT NULL AND (isnan(lo) OR isnan(hi) OR abs(lo) = double('inf') OR abs(hi) = double('inf') OR lo >= hi) THEN 'a range has finite ends in rising order'
        WHEN range_atol < 0 OR channel_atol < 0 THEN 'tolerances are not negative'
        WHEN channels < 1 THEN 'a stream has a channel at least'
        WHEN require_distinct AND coalesce(channels, 0) < 2 THEN 'distinct channels need two at least'
        END AS reason""").where("reason IS NOT NULL")


def declarations_frame(spark: SparkSession, declarations: list[Declaration]) -> DataFrame:
    """Declarations as a table."""
    schema = "subject string, num_frames int, clip_length int, fixture_clip_length int, has_target boolean, use_precomputed boolean, operator_policy string, target_transforms int, transform_declared boolean, seed long, train boolean, options map<string,string>"
    names = [c.split()[0] for c in schema.split(", ")]
    return spark.createDataFrame([tuple(getattr(d, n) for n in names) for d in declarations], schema)
