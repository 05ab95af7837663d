"""What the jobs share: their config files, their log and their session."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def config_of(name: str, path: str | None = None) -> dict:
    """A job's settings: those of its own file, and over them those of another one."""
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        out = json.load(f)
    if path:
        with open(path, encoding="utf-8") as f:
            more = json.load(f)
        if unknown := set(more) - set(out):
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        out |= more
    return out


def arguments(what: str, argv: Sequence[str] | None, *required: str) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description=what)
    for name in required:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="a JSON file whose settings replace the job's own")
    return parser.parse_args(argv)


def session(name: str) -> SparkSession:
    """The command line's session; master and all else come from spark-submit."""
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(message)s")
    return SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
