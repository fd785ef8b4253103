"""python -m fluxion COMMAND: inspect, ingest, discover, assess, generate, evaluate, intuit, symmetries, systems."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence


def session():
    from pyspark.sql import SparkSession

    from .shipping import ship

    spark = SparkSession.builder.appName("fluxion").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def main(arguments: Sequence[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="fluxion", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *flags: tuple, **more) -> None:
        p = commands.add_parser(name, **more)
        for flag, how in flags:
            p.add_argument(flag, **how)

    file, model = ("path", {}), ("--rhs", {"required": True, "help": "model as JSON: {variable: expression}"})
    command("inspect", file, help="columns of a file")
    command("ingest", file, ("--to", {"help": "where to write trajectories and meta data"}), ("--hints", {"default": "{}"}), help="a table to trajectories or frames")
    command("discover", file, ("--branches", {"type": int, "default": 3}), ("--report", {}), help="from a file to an equation and a verdict")
    command("assess", file, model, help="assessment and verdict of a given model")
    command("intuit", file, help="facts and hypotheses before any fit")
    command("symmetries", file, ("--degree", {"type": int, "default": 3}), help="symmetries of the vector field")
    command("generate", ("system", {}), ("path", {}), ("--noise", {"type": float, "default": 0.01}), ("--kind", {"default": "gaussian"}), ("--seed", {"type": int, "default": 0}), ("--blind", {"action": "store_true"}), help="a data set with a hidden part")
    command("evaluate", file, ("--system", {"required": True}), model, help="score of a model on a data set's hidden part")
    command("systems", help="known systems")
    a = parser.parse_args(arguments)
    out = run(a)
    print(json.dumps(out, indent=1, default=str))
    return out


def run(a: argparse.Namespace) -> dict:
    from .operators import assess, datasets, diagnostics, field_assess, field_intuition, fields, scoring, symmetry
    from .operators.systems import SYSTEMS
    from .plans.discover import discover
    from .sources import ingest, readers

    if a.command == "systems":
        return {s.name: s.rhs for s in SYSTEMS.values()}
    spark = session()
    if a.command == "inspect":
        return {r["name"]: r.asDict() for r in readers.inspect(readers.read_file(spark, a.path)).collect()}
    if a.command == "generate":
        return datasets.generate(spark, a.system, a.path, a.noise, a.kind, seed=a.seed, blinded=a.blind)
    if a.command == "evaluate":
        truth, _ = readers.load_dataset(spark, f"{a.path}/hidden")
        system = SYSTEMS[a.system]
        return (scoring.evaluate if system.kind == "ode" else fields.evaluate_fields)(truth, system, json.loads(a.rhs))
    if a.command == "discover":
        out = discover(spark, a.path, branches=a.branches, report_to=a.report)
        return {"rhs": out["rhs"], "verdict": out["verdict"], "models": out["models"]}
    df, meta, card = ingest.ingest(spark, a.path, json.loads(getattr(a, "hints", "{}")))
    if a.command == "ingest":
        if a.to:
            readers.write_dataset(df, a.to, meta)
        return {"meta": meta, "assumptions": card.assumptions, "warnings": card.warnings, "review_first": card.review_first}
    if a.command == "intuit" and meta["kind"] == "pde":
        return field_intuition.intuit_fields(df, ingest.system_of(meta), meta["dt"])
    if a.command == "intuit":
        return diagnostics.intuit(df, meta["variables"], meta["dt"])
    if a.command == "symmetries":
        return symmetry.detect_symmetries(df, meta["variables"], meta["dt"], a.degree)
    if meta["kind"] == "pde":
        found = field_assess.assess_fields(df, ingest.system_of(meta), meta["dt"], json.loads(a.rhs))
    else:
        found = assess.assess(df, meta["variables"], meta["dt"], json.loads(a.rhs))
    return {"verdict": assess.verdict(found), "assessment": found}


if __name__ == "__main__":
    main()
