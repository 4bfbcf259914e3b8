"""Stages that are run one after another and go on where a run stopped.

Every stage's result is written to a folder of its own, and then its manifest: a fingerprint
of what it was made from, the folder, and the number of rows.  The manifest is
written last, so what a killed run left behind is never read.  A stage whose manifest
has the present fingerprint is not run again; one that changed, or whose input files changed, is,
and so are those behind it.

Defined results: inputs are known by their files' names, sizes and times, stages by name and
``version``; ``only`` runs one stage anew on what the ones before it left, as a step of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termweave.sources.scratch import new_path


@dataclass(frozen=True)
class Stage:
    """``run`` gets the results of the stages and inputs that the stage needs, by name."""

    name: str
    needs: tuple[str, ...]
    run: Callable[[dict[str, DataFrame]], DataFrame]
    version: str = "1"


@dataclass(frozen=True)
class Manifest:
    fingerprint: str
    path: str
    schema: str
    rows: int


def _hashed(*parts: str) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def input_fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of an input; their contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.xxhash64("path", "modificationTime", "length").cast("decimal(38,0)").alias("h"))
    found = files.agg(F.sum("h").alias("h"), F.count("*").alias("n")).first()
    return _hashed(path, str(found["h"]), str(found["n"]))


class Runner:
    """Runs stages over Parquet inputs (name to path) and keeps their manifests in a folder."""

    def __init__(self, spark: SparkSession, folder: str, inputs: dict[str, str], stages: list[Stage]):
        names = [s.name for s in stages]
        known = set(inputs)
        for s in stages:
            if s.name in known or not set(s.needs) <= known:
                raise ValueError(f"stage {s.name}: its name is taken, or it needs what isn't there before it")
            known.add(s.name)
        self.spark, self.folder, self.inputs, self.stages, self.names = spark, folder, inputs, stages, names

    def manifest(self, name: str) -> Manifest | None:
        """What a stage left when it ended; None if it never did."""
        try:
            return Manifest(**json.loads(self.spark.read.text(f"{self.folder}/{name}/manifest").first()[0]))
        except AnalysisException as e:
            if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
            return None
        except TypeError:  # a manifest without its row: the run ended while writing it
            return None

    def result(self, name: str) -> DataFrame:
        found = self.manifest(name)
        if found is None:
            raise LookupError(f"stage {name} has not been run")
        return self.spark.read.schema(found.schema).parquet(found.path)

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.inputs[name]) if name in self.inputs else self.result(name)

    def run(self, only: str | None = None, ended: Callable[[str], None] | None = None) -> list[str]:
        """The names of the stages that were run, not found done; ``ended`` is called with each when its manifest is there."""
        prints = {name: input_fingerprint(self.spark, path) for name, path in self.inputs.items()}
        done = []
        for s in self.stages:
            now = _hashed(s.name, s.version, *[prints[n] for n in s.needs])
            found = self.manifest(s.name)
            if only is not None and s.name != only:
                if found is None and only in self.names[self.names.index(s.name) + 1 :]:
                    raise LookupError(f"stage {s.name} has not been run")
                prints[s.name] = found.fingerprint if found else now
                continue
            if only == s.name or found is None or found.fingerprint != now:
                self._make(s, now)
                done.append(s.name)
                if ended:
                    ended(s.name)
            prints[s.name] = now
        return done

    def _make(self, s: Stage, fingerprint: str) -> None:
        path = f"{self.folder}/{s.name}/{fingerprint[:16]}-{new_path(self.spark, 'run').rsplit('-', 1)[1]}"
        made = s.run({n: self._table(n) for n in s.needs})
        made.write.parquet(path)
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
        rows = self.spark.read.schema(schema).parquet(path).count()
        text = json.dumps({"fingerprint": fingerprint, "path": path, "schema": schema, "rows": rows})
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{s.name}/manifest")
