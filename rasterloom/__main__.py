"""``python -m rasterloom --version | --worker | inspect FOLDER | dump CONTAINER OUT_FOLDER``."""

from __future__ import annotations

import sys

VERSION = "0.1.0"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()


def main(arguments: list[str]) -> int:
    if arguments == ["--version"]:
        print(VERSION)
        return 0
    if arguments == ["--worker"]:
        from .streaming.protocol import spark_worker

        spark_worker(session()).serve(sys.stdin)
        return 0
    if len(arguments) == 3 and arguments[0] == "dump":
        from .plans.dump import dump_container

        print(dump_container(session(), arguments[1], arguments[2]))
        return 0
    if len(arguments) == 2 and arguments[0] == "inspect":
        from .plans.batch import inspect_inputs

        spark = session()
        for line in inspect_inputs(spark, arguments[1]).orderBy("idx").toJSON().toLocalIterator():
            print(line)
        return 0
    print(__doc__, file=sys.stderr)
    return 2


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
