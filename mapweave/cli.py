"""Command line: OSM XML or JSON in, GeoJSON out."""

from __future__ import annotations

import argparse
import json
import sys
import traceback


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="mapweave", description="Convert OpenStreetMap XML or JSON data to GeoJSON.")
    parser.add_argument("input", nargs="?", default="/dev/stdin")
    parser.add_argument("output", nargs="?", default="/dev/stdout")
    args = parser.parse_args(argv)
    try:
        with open(args.input, encoding="utf-8") as file:
            text = file.read()
        from pyspark.sql import SparkSession

        from mapweave.api import convert

        spark = SparkSession.builder.appName("mapweave").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
        made = convert(spark, text, {"completeFeature": True, "renderTagged": True})
        with open(args.output, "w", encoding="utf-8") as file:
            file.write(json.dumps(made, ensure_ascii=False, separators=(",", ":")) + "\n")
    except Exception:
        traceback.print_exc(file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
