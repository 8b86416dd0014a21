"""python -m weftline run JOB.json | check JOB.json | split FILE N PREFIX | merge REDUCER OUT PART..."""

from __future__ import annotations

import sys
from pathlib import Path


def main(args: list[str]) -> int:
    from weftline.plans import compile as compiler
    from weftline.plans import spec

    from pyspark.sql import functions as F

    from weftline.operators import merge
    from weftline.sources import files, sinks

    enough = {"run": len(args) == 2, "check": len(args) == 2, "split": len(args) == 4, "merge": len(args) > 3}
    if not args or not enough.get(args[0]):
        print(__doc__, file=sys.stderr)
        return 2
    job = spec.load(Path(args[1]).read_text()) if args[0] in ("run", "check") else None
    if args[0] == "check":
        for i, wave in enumerate(spec.waves(job)):
            print(i, *[f"{n.id}:{n.kind}" for n in wave])
        return 0
    from pyspark.sql import SparkSession

    if args[0] == "split":
        spark = SparkSession.builder.appName("split").getOrCreate()
        print(*sinks.split_lines(files.ordered_lines(spark, args[1]), int(args[2]), args[3]), sep="\n")
        spark.stop()
        return 0
    if args[0] == "merge":
        spark = SparkSession.builder.appName("merge").getOrCreate()
        parts = [merge.key_values(files.text_lines(spark, p)) for p in args[3:]]
        out = merge.reducer(args[1])([p.withColumnRenamed("key", "word") for p in parts] if args[1] == "wordcount" else parts)
        line = F.concat_ws(": ", *[F.col(c).cast("string") for c in out.columns])
        print(sinks.write_lines(out.select(*out.columns, line.alias("value")), args[2], order=out.columns[:1]))
        spark.stop()
        return 0
    spark = SparkSession.builder.appName(job.name).getOrCreate()
    done = compiler.run(spark, job)
    for name, result in done.results.items():
        print(name, result)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
