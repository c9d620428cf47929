"""Command line: ``python -m corpusloom {verify,run,near-duplicates} CONFIG.json``; JSON on stdout, exit code 2 asks for review."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from corpusloom.pipeline import Config, LoomError, Pipeline, ReviewRequired

    parser = argparse.ArgumentParser(prog="corpusloom")
    parser.add_argument("command", choices=("verify", "run", "near-duplicates"))
    parser.add_argument("config", help="JSON file with pages, domains, output and parameters")
    args = parser.parse_args(argv)
    try:
        with open(args.config, encoding="utf-8") as file:
            config = Config(**json.load(file))
        spark = SparkSession.builder.appName("corpusloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        pipe = Pipeline(spark, config)
        result = {"verify": pipe.verify, "run": pipe.run, "near-duplicates": pipe.near_duplicates}[args.command]()
    except ReviewRequired as gate:
        print(json.dumps({"review": str(gate)}))
        return 2
    except (LoomError, OSError, TypeError, ValueError) as error:
        print(json.dumps({"error": str(error)}))
        return 1
    print(json.dumps(result, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
