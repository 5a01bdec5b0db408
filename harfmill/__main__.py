"""Command line.

python -m harfmill list                              the query catalogue
python -m harfmill run NAME SF_DIR [OUT]             run a query
python -m harfmill explain NAME SF_DIR               its plan
python -m harfmill train KIND PARQUET OUT [SIZE]     train and store a tokenizer
python -m harfmill intrinsic TOKENIZER PARQUET OUT   metrics of a stored tokenizer
python -m harfmill experiment CONFIG                 one experiment, or a sweep if the file has one
python -m harfmill compare OUT FOLDER...             a report over folders of results
python -m harfmill recompute FOLDER [--dry-run] [--no-reports]
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

from harfmill import plans

LEAST = {"list": 0, "run": 2, "explain": 2, "train": 3, "intrinsic": 3, "experiment": 1, "compare": 2, "recompute": 1}


def main(args: list[str]) -> int:
    flags, words = [a for a in args if a.startswith("--")], [a for a in args if not a.startswith("--")]
    if not words or len(words) - 1 < LEAST.get(words[0], 99):
        print(__doc__)
        return 2
    verb, rest = words[0], words[1:]
    if verb == "list":
        print(*sorted(plans.QUERIES), sep="\n")
        return 0
    from harfmill.operators import experiment

    if verb == "compare":
        runs = {Path(f).name: experiment.load_json(f"{f}/all_metrics.json") for f in rest[1:]}
        print(experiment.write_report(runs, rest[0]))
        return 0
    if verb == "recompute":
        for status, n in sorted(experiment.recompute(rest[0], "--dry-run" in flags, "--no-reports" not in flags).items()):
            print(f"{status}: {n}")
        return 0
    spark = SparkSession.builder.appName("harfmill").getOrCreate()
    if verb == "train":
        from harfmill.operators import tokenization

        tokenization.registry.get(rest[0])().train(spark.read.parquet(rest[1]), vocab_size=int(rest[3]) if len(rest) > 3 else None).save(spark, rest[2])
    elif verb == "intrinsic":
        from harfmill.operators import tokenization

        found = experiment.Evaluator(tokenization.Tokenizer.load(spark, rest[0]), rest[2], spark.read.parquet(rest[1])).run_intrinsic()
        print(found)
    elif verb == "experiment":
        from harfmill.sources.config import load_config

        config = load_config(None, rest[0])
        (experiment.run_sweep if "sweep" in config else experiment.run_experiment)(spark, config)
    else:
        frame = plans.QUERIES[rest[0]](spark, rest[1])
        if verb == "explain":
            frame.explain("formatted")
        elif len(rest) > 2:
            frame.write.mode("overwrite").parquet(rest[2])
        else:
            frame.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
