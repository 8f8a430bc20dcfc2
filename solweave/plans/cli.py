"""Command line: ``python -m solweave.plans.cli [-i] [-f REGEX] [-d SOLSET/TABLE] [-q|-v] STORE [STEPS]``."""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import SparkSession

from solweave.plans.runner import run
from solweave.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description="Run a step file on a store of solutions.")
    p.add_argument("-i", "--info", action="store_true", help="report on the store's tables")
    p.add_argument("-f", "--filter", default="", help="only solution sets whose name matches")
    p.add_argument("-d", "--delete", help="delete the table SOLSET/TABLE")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("store")
    p.add_argument("steps", nargs="?")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.ERROR if a.quiet else logging.DEBUG if a.verbose else logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    store = Store(spark, a.store, "r" if a.info else "a")
    if a.info:
        print(store.info(a.filter, a.verbose))
    elif a.delete:
        store.delete_table(a.delete)
    elif a.steps:
        for step, table, seconds in run(Path(a.steps).read_text(), store):
            logging.info("%s on %s: %.1f s", step, table, seconds)
    else:
        p.error("give a step file, -i or -d")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
