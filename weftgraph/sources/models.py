"""Model and configuration files."""

from __future__ import annotations

import configparser
import dataclasses
import re

from pyspark.sql import DataFrame, SparkSession


def bayesian_model(spark: SparkSession, path: str) -> DataFrame:
    """(y, x, logp, prior) of a model file with the sections '>name', '>prior' and '>likelihood', comma-separated logs.

    A likelihood line holds log P(x | y) for x = 1, 2, ...; lines are y = 1, 2, ... Files are read through Spark, so any store will do.
    """
    lines = [x.strip() for x in spark.read.text(path, wholetext=True).first()["value"].split("\n")]
    sections: dict[str, list[str]] = {}
    name = ""
    for line in lines:
        if line.startswith(">"):
            name = line[1:].strip().lower()
            sections[name] = []
        elif line:
            sections.setdefault(name, []).append(line)
    prior = [float(x) for x in sections["prior"][0].split(",")]
    rows = [(y, x, float(p), prior[y - 1]) for y, line in enumerate(sections["likelihood"], 1) for x, p in enumerate(line.split(","), 1)]
    return spark.createDataFrame(rows, "y int, x int, logp double, prior double")


def parse_bases(text: str) -> int:
    """a number of bases with an optional unit: 120Gb, 3 Mbp, 50kb, 7."""
    m = re.fullmatch(r"\s*([0-9.]+)\s*([KkMGT]?)(?:b|bp)?\s*", text)
    if not m:
        raise ValueError(f"not a number of bases: {text}")
    return round(float(m[1]) * {"": 1, "K": 10**3, "M": 10**6, "G": 10**9, "T": 10**12}[m[2].upper()])


def read_options(path: str, *kinds: type) -> list:
    """Options objects from the sections of an INI file, one a dataclass, named like it; keys that it lacks are errors."""
    parser = configparser.ConfigParser()
    parser.optionxform = str
    with open(path, encoding="utf-8") as file:
        parser.read_file(file)
    out = []
    for kind in kinds:
        fields = {f.name: f for f in dataclasses.fields(kind)}
        values = dict(parser[kind.__name__]) if kind.__name__ in parser else {}
        unknown = set(values) - set(fields)
        if unknown:
            raise ValueError(f"unknown options of {kind.__name__}: {sorted(unknown)}")
        convert = {"int": int, "float": float, "str": str, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}
        out.append(kind(**{k: convert[str(fields[k].type)](v) for k, v in values.items()}))
    return out
