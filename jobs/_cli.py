"""The jobs' command line: a config file, options that override it, and a session that lives as long as the job."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from dataclasses import fields

log = logging.getLogger("strandline.jobs")


def settings(kind: type, given: dict):
    """``given`` as the settings dataclass ``kind``; unknown names are an error."""
    unknown = set(given) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return kind(**given)


def main(about: str, paths: dict[str, str], kind: type, run: Callable) -> None:
    """Call ``run(spark, **paths, settings=...)`` with the config's and the command line's values."""
    from pyspark.sql import SparkSession

    parser = argparse.ArgumentParser(description=about)
    parser.add_argument("--config", required=True, help="JSON file with paths and settings")
    for name, text in paths.items():
        parser.add_argument(f"--{name}", help=text)
    args = parser.parse_args()
    with open(args.config, encoding="utf-8") as f:
        config = json.load(f)
    where = {name: getattr(args, name) or config.get("paths", {}).get(name) for name in paths}
    if missing := [name for name, path in where.items() if not path]:
        parser.error(f"no path for {', '.join(missing)}")
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(about.split(".")[0]).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, **where, settings=settings(kind, config.get("settings", {})))
    finally:
        spark.stop()
