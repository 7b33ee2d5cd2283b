"""Command line: ingest, validate, curate, refresh."""

from __future__ import annotations

import argparse
import json
import time
from dataclasses import asdict, is_dataclass

from .plans import local
from .session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, needs in (("ingest", ["source", "ingest-date"]), ("validate", ["ingest-date"]), ("curate", ["ingest-date", "snapshot-date"]), ("refresh", [])):
        one = sub.add_parser(name)
        one.add_argument("--dataset", required=True)
        one.add_argument("--root", default="./data")
        for flag in needs:
            one.add_argument(f"--{flag}", required=True)
        if name == "refresh":
            one.add_argument("--snapshot-date")
            one.add_argument("--sql", help="a query over the views; its rows are printed")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    spark, began = spark or session(), time.time()
    if a.command == "ingest":
        out = local.ingest(spark, a.dataset, a.source, a.ingest_date, a.root)
    elif a.command == "validate":
        out = local.validate(spark, a.dataset, a.ingest_date, a.root)
    elif a.command == "curate":
        out = local.curate(spark, a.dataset, a.ingest_date, a.snapshot_date, a.root)
    else:
        out = {"views": local.refresh(spark, a.dataset, a.root, a.snapshot_date)}
        if a.sql:
            spark.sql(a.sql).show(100, False)
    print(json.dumps({**(asdict(out) if is_dataclass(out) else out), "seconds": round(time.time() - began, 3)}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
