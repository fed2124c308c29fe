"""Directories of packs: YAML and JSON files, parsed where they are read."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files of local mappings, in the order in which they are merged into the vocabulary.
MAPPING_FILES = ("vocabularies", "patient_mappings", "medication_mappings", "provider_mappings", "device_mappings", "payer_mappings")


def _parsed(text: str, path: str) -> tuple[str | None, str | None]:
    """(content as JSON, problem) of a file; an empty YAML file is an empty object."""
    try:
        if path.endswith(".json"):
            content = json.loads(text)
        else:
            import yaml

            content = yaml.safe_load(text) or {}
        if not isinstance(content, dict):
            return None, f"{path} is not an object"
        return json.dumps(content, sort_keys=True, default=str), None
    except ImportError:
        return None, f"{path} needs a YAML library on the executors"
    except Exception as error:  # a parser's own error types: what it says is the problem
        return None, f"{path} is not {'JSON' if path.endswith('.json') else 'YAML'}: {error}"


def documents(spark: SparkSession, directory: str) -> DataFrame:
    """[S11, S12] (path, name, content, problem) of the YAML and JSON files under ``directory``, ``content`` as JSON."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,yaml,yml}").text(directory, wholetext=True)
    named = files.select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("_metadata.file_path", r"([^/]+)\.(json|yaml|yml)$", 1).alias("name"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_parsed(text, path) for text, path in zip(batch["value"], batch["path"])]
            yield pd.DataFrame({"path": batch["path"], "name": batch["name"], "content": [c for c, _ in found], "problem": [p for _, p in found]}, dtype=object)

    return named.mapInPandas(parse, "path string, name string, content string, problem string")


def contents(spark: SparkSession, directory: str) -> dict[str, tuple[str, dict]]:
    """(path, content) by name of the files of a pack directory, which configure a job; later paths win.

    A file with a problem is a ValueError.
    """
    found = {}
    for row in documents(spark, directory).orderBy("path").collect():
        if row.problem:
            raise ValueError(row.problem)
        found[row.name] = (row.path, json.loads(row.content))
    return found


def local_mappings(spark: SparkSession, directory: str) -> DataFrame:
    """[S11, R09, K14] (family, local_code, standard_system, standard_code, display, lookup) of a directory's mapping files.

    Each file has ``local_mappings``: lists of mappings by family.  The files are merged in the order of
    MAPPING_FILES; a family that a later file has too is the later one's.  Missing files are left out.  A mapping
    without a local code, or two of a family with one, is an error.
    """
    known, merged = contents(spark, directory), {}
    for name in MAPPING_FILES:
        merged |= known.get(name, (name, {}))[1].get("local_mappings") or {}
    rows = [(family, *[None if entry.get(f) is None else str(entry[f]) for f in ("local_code", "standard_system", "standard_code", "display")]) for family, entries in merged.items() for entry in entries]
    seen = set()
    for family, code, *_ in rows:
        if not code:
            raise ValueError(f"{family} has a mapping without a local code")
        if (family, code) in seen:
            raise ValueError(f"{family} has {code} twice")
        seen.add((family, code))
    made = spark.createDataFrame(rows, "family string, local_code string, standard_system string, standard_code string, display string")
    return made.withColumn("lookup", F.lower("local_code"))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the folder that the cluster shares."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
