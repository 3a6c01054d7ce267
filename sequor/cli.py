"""Command line: ``build``, ``target``, ``antibody``, ``sequence`` and ``validate`` over a snapshot."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sequor.operators import exports, targets
from sequor.plans import build as B


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="sequor", description=__doc__)
    p.add_argument("--snapshot", required=True)
    p.add_argument("--format", choices=("json", "csv", "fasta"), default="json")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("build")
    b.add_argument("--sources", required=True, help="JSON file: source key to adapter options")
    b.add_argument("--aliases", required=True, help="JSON file: canonical name to aliases")
    b.add_argument("--entities", help="JSON file: canonical name to entity, with identifiers, parent and relation")
    b.add_argument("--max-records", type=int)
    t = sub.add_parser("target")
    t.add_argument("query")
    t.add_argument("--family", action="append", choices=("direct", "functional", "negative"))
    t.add_argument("--paired", action="store_true")
    t.add_argument("--include-descendants", action="store_true")
    sub.add_parser("antibody").add_argument("id")
    s = sub.add_parser("sequence")
    s.add_argument("--heavy", default="")
    s.add_argument("--light", default="")
    s.add_argument("--mode", choices=("exact", "similar"), default="exact")
    sub.add_parser("validate")
    sub.add_parser("rebuild-similar")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """0 if fine, 1 if rules are broken, 2 if an id is stale or a name means no one target."""
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("sequor").getOrCreate()
    if a.command == "build":
        with open(a.sources, encoding="utf-8") as f, open(a.aliases, encoding="utf-8") as g:
            sources, aliases = json.load(f), json.load(g)
        observations, claims = B.gather(spark, sources, a.max_records)
        known = None
        if a.entities:
            with open(a.entities, encoding="utf-8") as f:
                known = targets.entity_table(spark, json.load(f))
        B.write(B.assemble(observations, claims, targets.alias_table(spark, aliases), known), a.snapshot)
        return 0
    snapshot = B.Snapshot(spark, a.snapshot)
    snapshot.check_version()
    query = {"type": a.command}
    if a.command == "rebuild-similar":
        B.rebuild_similar(snapshot)
        return 0
    if a.command == "target":
        families = tuple(a.family or ("direct",))
        target = snapshot.resolve(a.query)
        if target is None:
            print(f"no target is named {a.query}", file=sys.stderr)
            return 2
        out = snapshot.target(target, families, a.paired, a.include_descendants)
        query |= {"value": a.query, "target_id": target, "scope": "include_descendants" if a.include_descendants else "exact", "families": families}
    elif a.command == "antibody":
        out = snapshot.antibody(a.id)
        if out.where("status = 'stale_id'").count():
            print(f"unknown entity {a.id}", file=sys.stderr)
            return 2
    elif a.command == "sequence":
        out = snapshot.sequence(a.heavy.upper(), a.light.upper(), a.mode)
        query |= {"heavy": a.heavy, "light": a.light, "mode": a.mode}
    else:
        out = snapshot.violations()
    if a.format == "json" and a.command in ("target", "sequence"):
        print(json.dumps(snapshot.payload(query, out)))
    if a.format == "fasta" and a.command != "validate":
        key = "antibody_id" if "antibody_id" in out.columns else "id"
        out = snapshot.table("antibodies").join(out.select(F.col(key).alias("antibody_id")).distinct(), "antibody_id", "left_semi")
    # a report for a terminal: rows come one partition at a time
    n = 0
    simple = [c for c, t in out.dtypes if not t.startswith(("struct", "map", "array<struct"))] if a.format == "csv" else out.columns
    for n, row in enumerate(exports.render(out.select(simple), a.format).toLocalIterator(), 1):
        print(row[0])
    return int(a.command == "validate" and n > 0)


if __name__ == "__main__":
    sys.exit(main())
