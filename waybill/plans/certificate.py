"""Certificates: one document a subject, folded from its gate records, checked by predicates, written or summed up."""

from __future__ import annotations

import platform
import re
import subprocess
import sys
from datetime import UTC, datetime
from importlib import metadata
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..contracts import GATE_STATUSES
from ..functions.seeding import UNCONTROLLED
from ..functions.status import fold

SCHEMA = "delivery-certificate/1.2"
VERDICTS = ("PASS", "FAIL", "UNDECLARED", "PARTIAL", "INCONCLUSIVE")
#: Fields of a certificate, in order (fixed names of the format).
FIELDS = (
    "pipeline", "expected_treatment", "schema", "created_utc", "repository", "commit", "working_tree_dirty", "branch_reached", "delivery_modality", "gt_source", "lq_source", "gt_stream_sha256", "lq_stream_sha256",
    "channels", "value_range", "geometry", "unique_frames_reachable", "clip_length", "observed_operator_order", "target_transform_count", "training_seed", "render_seed", "data_order_seed", "uncontrolled_rng",
    "environment", "gates", "notes", "status", "failed_gates", "undeclared_gates",
)


def verdict_of(statuses: list[str]) -> str:
    """The fold of :mod:`waybill.functions.status` for a list on the driver."""
    if "FAIL" in statuses:
        return "FAIL"
    if "UNDECL" in statuses:
        return "UNDECLARED"
    if "PASS" not in statuses:
        return "INCONCLUSIVE"
    return "PASS" if set(statuses) <= {"PASS", "N/A"} else "PARTIAL"


def environment() -> dict[str, Any]:
    """Versions that a result may depend on."""
    packages = {}
    for name in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            packages[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            packages[name] = None
    return {"python": sys.version.split()[0], "platform": platform.platform(), "packages": packages}


def repository(path: str) -> dict[str, Any]:
    """Commit and cleanliness of a git working tree; bytecode doesn't count as a change. None where there is none."""

    def git(*args: str) -> str | None:
        got = subprocess.run(["git", "-C", path, *args], capture_output=True, text=True, check=False)
        return got.stdout.strip() if got.returncode == 0 else None

    changed = git("status", "--porcelain")
    lines = [x for x in (changed or "").splitlines() if "__pycache__" not in x and not x.endswith(".pyc")]
    return {"commit": git("rev-parse", "HEAD"), "working_tree_dirty": None if changed is None else bool(lines)}


def document(pipeline: str, expected: str, gates: list[dict[str, Any]], **fields: Any) -> dict[str, Any]:
    """A certificate with its verdict; fields that aren't given are null, lists empty."""
    unknown = set(fields) - set(FIELDS)
    if unknown:
        raise ValueError(f"no such fields: {sorted(unknown)}")
    out: dict[str, Any] = dict.fromkeys(FIELDS)
    out |= {"pipeline": pipeline, "expected_treatment": expected, "schema": SCHEMA, "created_utc": datetime.now(UTC).isoformat(), "uncontrolled_rng": list(UNCONTROLLED), "environment": environment(), "notes": [], "gates": [{k: g[k] for k in ("gate", "status", "message", "evidence")} for g in gates]}
    out |= fields
    out["status"] = verdict_of([g["status"] for g in gates])
    out["failed_gates"] = [g["gate"] for g in gates if g["status"] == "FAIL"]
    out["undeclared_gates"] = [g["gate"] for g in gates if g["status"] == "UNDECL"]
    return out


def violations(d: dict[str, Any]) -> list[str]:
    """What is wrong with a certificate; nothing for a valid one."""
    whole = lambda v, least: isinstance(v, int) and not isinstance(v, bool) and v >= least
    text = lambda v: isinstance(v, str)
    maybe = lambda test: lambda v: v is None or test(v)
    shape = lambda v: isinstance(v, (list, tuple)) and len(v) == 2 and all(whole(x, 1) for x in v)
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    texts = lambda v: isinstance(v, list) and all(map(text, v))
    digest = maybe(lambda v: text(v) and re.fullmatch("[0-9a-f]{64}", v))

    def stamp(v: Any) -> bool:
        try:
            return text(v) and datetime.fromisoformat(v) is not None
        except ValueError:
            return False

    rules = {
        "pipeline": lambda v: text(v) and v, "expected_treatment": lambda v: text(v) and v, "schema": lambda v: v == SCHEMA, "created_utc": stamp, "repository": maybe(text),
        "commit": maybe(lambda v: text(v) and re.fullmatch("[0-9a-fA-F]{40}", v)), "working_tree_dirty": maybe(lambda v: isinstance(v, bool)), "branch_reached": maybe(text), "delivery_modality": maybe(text), "gt_source": maybe(text), "lq_source": maybe(text),
        "gt_stream_sha256": digest, "lq_stream_sha256": digest, "channels": maybe(lambda v: whole(v, 1)),
        "value_range": maybe(lambda v: isinstance(v, dict) and set(v) <= {"gt", "lq"} and all(isinstance(r, (list, tuple)) and len(r) == 2 and all(map(number, r)) for r in v.values())),
        "geometry": maybe(lambda v: isinstance(v, dict) and set(v) == {"declared", "delivered", "source"} and shape(v["declared"]) and shape(v["delivered"]) and v["source"] in ("recorded", "measured")),
        "unique_frames_reachable": maybe(lambda v: whole(v, 0)), "clip_length": maybe(lambda v: whole(v, 1)), "observed_operator_order": maybe(texts), "target_transform_count": maybe(number),
        "training_seed": maybe(lambda v: whole(v, -(2**63))), "render_seed": maybe(lambda v: whole(v, -(2**63))), "data_order_seed": maybe(lambda v: text(v) or whole(v, -(2**63))), "uncontrolled_rng": texts,
        "environment": lambda v: isinstance(v, dict) and {"python", "platform", "packages"} <= set(v),
        "gates": lambda v: isinstance(v, list) and all(isinstance(g, dict) and set(g) == {"gate", "status", "message", "evidence"} and g["status"] in GATE_STATUSES for g in v),
        "notes": texts, "status": lambda v: v in VERDICTS, "failed_gates": texts, "undeclared_gates": texts,
    }
    found = [f"{k}: missing" for k in FIELDS if k not in d] + [f"{k}: not a field" for k in d if k not in FIELDS]
    found += [f"{k}: {d[k]!r}" for k, rule in rules.items() if k in d and not rule(d[k])]
    if not found and d["status"] != verdict_of([g["status"] for g in d["gates"]]):
        found.append("status: not the fold of the gates")
    return found


def certificates(results: DataFrame) -> DataFrame:
    """One row a subject: verdict, lists, and its gate records as an array; ``to_json`` of a row is its document."""
    gates = results.groupBy("subject").agg(F.array_sort(F.collect_list(F.struct("gate", "status", "message", "evidence"))).alias("gates"))
    return fold(results).join(gates, "subject")


def summary(d: dict[str, Any]) -> str:
    """A certificate as text: the verdict, then a line a gate."""
    return "\n".join([f"{d['pipeline']}: {d['status']} ({d['expected_treatment']})", *(f"  {g['status']:<7}{g['gate']}" + (f": {g['message']}" if g["message"] else "") for g in d["gates"]), *(f"  note: {n}" for n in d["notes"])])
