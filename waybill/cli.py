"""Command line: ``selftest``, ``study`` and ``audit``. Exit 0 for success, 1 for a finding, 2 where there is nothing
to audit, 64 for a subject that nobody knows."""

from __future__ import annotations

import argparse
import json
from pathlib import Path

from pyspark.sql import SparkSession

from .contracts import PASS, Declaration
from .plans import audit, certificate, defects, reports
from .sources import observations as sources


def _study(spark: SparkSession, out: Path | None, seeds: list[int]) -> int:
    matrix, alarms = defects.defect_matrix(spark).persist(), defects.false_alarms(spark, seeds).persist()
    summary = reports.study_summary(matrix, alarms).first().asDict()
    if out is not None:
        sources.write_csv(matrix, str(out / "defect_matrix"))
        sources.write_csv(alarms, str(out / "false_alarms"))
        sources.write_csv(reports.collateral(matrix), str(out / "collateral"))
        (out / "summary.json").write_text(json.dumps(summary, indent=2) + "\n")
    print(json.dumps(summary))
    return int(summary["detected"] != summary["targets"] or summary["collateral"] or summary["false_alarms"])


def _audit(spark: SparkSession, args: argparse.Namespace) -> int:
    seen = sources.read_table(spark, args.observations)
    known = {r.subject for r in seen.select("subject").distinct().collect()}
    if not known:
        return 2
    if args.only and args.only not in known:
        return 64
    chosen = sorted(known if not args.only else {args.only})
    declared = [Declaration(**({"subject": s} | json.loads(Path(args.declarations).read_text()).get(s, {}))) for s in chosen]
    contracts = spark.read.parquet(args.contracts).where(_in(chosen))
    results = audit.audit(seen.where(_in(chosen)), spark.read.parquet(args.calls), contracts, declared, tuple(args.operators), args.transform)
    verdict = PASS
    records: dict[str, list[dict]] = {s: [] for s in chosen}
    for r in results.collect():
        records[r.subject].append({"gate": r.gate, "status": r.status, "message": r.message, "evidence": json.loads(r.evidence)})
    for s, found in records.items():
        found.sort(key=lambda g: (audit.ORDER.index(g["gate"]) if g["gate"] in audit.ORDER else len(audit.ORDER), g["gate"]))
        d = certificate.document(s, "as declared", found)
        sources.write_certificate(d, str(Path(args.out) / f"{s}.json"))
        print(certificate.summary(d))
        verdict = verdict if d["status"] == PASS else d["status"]
    return int(verdict != PASS)


def _in(subjects: list[str]):
    from pyspark.sql import functions as F

    return F.col("subject").isin(subjects)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="waybill", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("selftest", help="the seeded-defect study on two seeds")
    study = commands.add_parser("study", help="defect matrix, false alarms and summary")
    study.add_argument("--out", type=Path, required=True)
    study.add_argument("--seeds", type=int, default=20)
    told = commands.add_parser("audit", help="certificates from tables of observations")
    for name in ("observations", "calls", "contracts", "declarations", "out"):
        told.add_argument(f"--{name}", required=True)
    told.add_argument("--only")
    told.add_argument("--operators", nargs="*", default=[])
    told.add_argument("--transform")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"waybill-{args.command}").getOrCreate()
    if args.command == "selftest":
        return _study(spark, None, [1, 2])
    if args.command == "study":
        args.out.mkdir(parents=True, exist_ok=True)
        return _study(spark, args.out, list(range(100, 100 + args.seeds)))
    return _audit(spark, args)


if __name__ == "__main__":
    raise SystemExit(main())
