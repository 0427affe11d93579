"""Runnable jobs over tables and files of arrays, and what they share: configuration, logging and sessions of command lines."""

from __future__ import annotations

import argparse
import logging
import sys
import tomllib
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repetend.operators import sequences

log = logging.getLogger("repetend.jobs")


def configured(kind: type, path: str | Path) -> Any:
    """A configuration of a dataclass from a TOML file; a name that it doesn't know is an error."""
    found = tomllib.loads(Path(path).read_text())
    if unknown := set(found) - {f.name for f in fields(kind)}:
        raise ValueError(f"{path}: unknown names {sorted(unknown)}")
    return kind(**found)


def symbols(text: Column, alphabet: str) -> Column:
    """Sequence of a text: dna takes it as it is, prose maps letters to the four symbols in turn and leaves out the rest."""
    if alphabet == "dna":
        return sequences.normalise(F.coalesce(text, F.lit("")))
    if alphabet == "prose":
        return sequences.from_text_column(text)
    raise ValueError(f"alphabet is dna or prose, not {alphabet}")


def arrays(table: DataFrame, key: str, text: str, alphabet: str, *more: Column) -> DataFrame:
    """record_id, seq and more columns of a table."""
    return table.select(F.col(key).cast("string").alias("record_id"), symbols(F.col(text), alphabet).alias("seq"), *more)


def command(description: str, names: dict[str, str], config: Path, run: Callable[[SparkSession, argparse.Namespace], None]) -> None:
    """A command line with the given paths and --config, its log on stderr, and a session that lasts as long as the job."""
    parser = argparse.ArgumentParser(description=description)
    for name, says in names.items():
        parser.add_argument(f"--{name}", required=True, help=says)
    parser.add_argument("--config", default=str(config), help=f"TOML file, {config.name} unless given")
    args = parser.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    log.setLevel(logging.INFO)
    spark = SparkSession.builder.appName(description.split(":")[0]).getOrCreate()
    try:
        run(spark, args)
    finally:
        spark.stop()
