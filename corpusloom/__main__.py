"""``python -m corpusloom --config FILE [--validate]``, ``--version`` and ``--info``."""

from __future__ import annotations

import argparse
import os
import sys

from corpusloom import __version__, config


def cores() -> int:
    """Physical cores where they can be told, else logical ones."""
    try:
        import psutil

        return psutil.cpu_count(logical=False) or os.cpu_count() or 1
    except ImportError:
        return os.cpu_count() or 1


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="corpusloom")
    parser.add_argument("--config")
    parser.add_argument("--validate", action="store_true", help="check the configuration only")
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--info", action="store_true", help="tell versions and cores")
    args = parser.parse_args(argv)
    if args.info:
        import pyspark

        print(f"corpusloom {__version__}, Spark {pyspark.__version__}, Python {sys.version.split()[0]}, {cores()} cores")
        return 0
    if not args.config:
        parser.error("--config is missing")
    read = config.read(args.config)
    if found := config.faults(read):
        print("\n".join(found), file=sys.stderr)
        return 1
    if args.validate:
        print("valid")
        return 0
    from pyspark.sql import SparkSession

    from corpusloom.operators import pipelines

    pipelines.RUN[read["task"]](SparkSession.builder.getOrCreate(), read)
    return 0


if __name__ == "__main__":
    sys.exit(main())
