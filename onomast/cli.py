"""Command line: ``parse NAME...``, ``parse -``, ``eq NAME NAME`` and ``eq - NAME``.

``-`` reads names from standard input, a line each.  Exit status: 0 for success or a
match, 1 for failure or no match, 64 for wrong usage.
"""

from __future__ import annotations

import sys
from itertools import islice

USAGE = "usage: onomast parse NAME... | parse - | eq NAME NAME | eq - NAME"


def _session():
    from pyspark.sql import SparkSession

    if (running := SparkSession.getActiveSession()) is not None:
        return running
    spark = SparkSession.builder.appName("onomast").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Lines of standard input that are handed over at once.
_LINES = 200_000


def _inputs(spark):
    """Standard input as frames (at, value) of so many lines, in line order: lines travel
    with the plan, no file of this machine is read by executors."""
    while lines := list(islice(sys.stdin, _LINES)):
        yield spark.createDataFrame([(i, line.rstrip("\r\n")) for i, line in enumerate(lines)], "at long, value string")


def main(args: list[str]) -> int:
    if not (len(args) > 1 and args[0] == "parse" or len(args) == 3 and args[0] == "eq"):
        print(USAGE, file=sys.stderr)
        return 64
    from onomast.functions import names_consistent, parse_name
    from onomast.operators import probe
    from onomast.sources import names_of, records_as_lines

    spark = _session()
    if args[0] == "parse":
        if args[1:] == ["-"]:
            for lines in _inputs(spark):
                rows = lines.withColumn("p", parse_name("value")).orderBy("at")
                for row in records_as_lines(rows).toLocalIterator():
                    print(row.value)
            return 0
        line = records_as_lines(names_of(spark, " ".join(args[1:])).withColumn("p", parse_name("value"))).first().value
        print(line)
        return 0 if line else 1
    if args[1] == "-":
        if names_of(spark, args[2]).select(parse_name("value").alias("p")).first().p is None:
            print(f"not a name: {args[2]!r}", file=sys.stderr)
            return 1
        for lines in _inputs(spark):
            found = probe(lines.withColumn("p", parse_name("value")), args[2])
            for row in found.orderBy("at").toLocalIterator():
                print(row.value.strip())
        return 0
    pair = spark.createDataFrame([(args[1], args[2])], "a string, b string").select(parse_name("a").alias("a"), parse_name("b").alias("b"))
    same = pair.select(names_consistent("a", "b")).first()[0]
    print("y" if same else "n")
    return 0 if same else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
