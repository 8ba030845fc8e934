"""python -m kinweave --config experiment.yaml: a whole experiment, its measures in the log."""

from __future__ import annotations

import argparse
import importlib

from kinweave.plans.pipeline import experiment
from kinweave.sources.config import load, run_logger


def main(argv: list[str] | None = None) -> dict[str, float]:
    parser = argparse.ArgumentParser(prog="kinweave", description="Collective entity matching of an experiment's splits.")
    parser.add_argument("--config", required=True, help="YAML or JSON file with the sections dataset, run, algo and, if wished, finetune")
    parser.add_argument("--scorer", help="module:function that takes the configuration and gives a scorer (kinweave.operators.scorers); with INLINE_ENCODE one of texts")
    given = parser.parse_args(argv)
    config, scorer = load(given.config), None
    if given.scorer:
        module, _, name = given.scorer.partition(":")
        scorer = getattr(importlib.import_module(module), name)(config)
    from pyspark.sql import SparkSession

    log = run_logger("kinweave", config.run.log_dir, config.algo.alpha, config.algo.threshold)
    return experiment(SparkSession.builder.appName("kinweave").getOrCreate(), config, log, scorer)


if __name__ == "__main__":
    main()
