"""Command line: list the named queries, run one, or probe and dump media files.

python -m chronoreel.cli list | run NAME TABLES [--rows N] [--out FOLDER] | dump PATH | filter TABLES CHAIN
"""

from __future__ import annotations

import argparse


def build() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="chronoreel")
    sub = p.add_subparsers(dest="what", required=True)
    sub.add_parser("list")
    run = sub.add_parser("run")
    run.add_argument("name")
    run.add_argument("tables")
    run.add_argument("--rows", type=int, default=20)
    run.add_argument("--out")
    dump = sub.add_parser("dump")
    dump.add_argument("path")
    chain = sub.add_parser("filter")
    chain.add_argument("tables")
    chain.add_argument("chain")
    return p


def main(argv: list[str] | None = None) -> None:
    args = build().parse_args(argv)
    from . import plans

    if args.what == "list":
        print("\n".join(plans.QUERIES))
        return
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.getOrCreate()
    if args.what == "run":
        df = plans.QUERIES[args.name](spark, args.tables)
        if args.out:
            df.write.mode("overwrite").parquet(args.out)
        else:
            df.show(args.rows, truncate=60)
    elif args.what == "dump":
        from .functions import probe
        from .sources import boxes

        files = spark.read.format("binaryFile").load(args.path)
        files.select("path", "length", probe.detect(F.col("content")).alias("format")).show(truncate=False)
        boxes.read_boxes(spark, args.path).drop("payload").orderBy("path", "node").show(200, truncate=False)
    else:
        from .model import event_packets, table
        from .plans import virtual

        virtual.apply(event_packets(table(spark, args.tables, "events")), args.chain).show()


if __name__ == "__main__":
    main()
