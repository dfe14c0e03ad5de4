"""Flows of tables with provenance."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantaloom.operators.graph import cut_lineage

PROVENANCE = "flow string, uri string, fingerprint string, start double, end double, inputs array<string>"


@dataclass
class Step:
    """A named table made from others by a function; `params` enter its fingerprint."""

    name: str
    make: Callable[..., DataFrame]
    inputs: list["Step"] = field(default_factory=list)
    params: dict = field(default_factory=dict)

    def fingerprint(self) -> str:
        told = [self.name, json.dumps(self.params, sort_keys=True, default=str), *[s.fingerprint() for s in self.inputs]]
        return hashlib.md5("\n".join(told).encode()).hexdigest()


def param(params: dict, name: str, kind: type):
    """A parameter of the asked type; KeyError or TypeError otherwise."""
    if not isinstance(params[name], kind):
        raise TypeError(f"{name} is no {kind.__name__}")
    return params[name]


class Flow:
    """Runs steps once each, in the order of their inputs, stores their tables under root and records where they came from."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.records, self.tables = spark, root.rstrip("/"), [], {}

    def run(self, step: Step) -> DataFrame:
        mark = step.fingerprint()
        if mark not in self.tables:
            inputs = [self.run(s) for s in step.inputs]
            start, path = time.time(), f"{self.root}/{step.name}-{mark}"
            jpath = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not jpath.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
                step.make(self.spark, *inputs, **step.params).write.mode("overwrite").parquet(path)
            self.tables[mark] = self.spark.read.parquet(path)
            self.records.append((step.name, path, mark, start, time.time(), [s.fingerprint() for s in step.inputs]))
        return self.tables[mark]

    def provenance(self) -> DataFrame:
        return self.spark.createDataFrame(self.records, PROVENANCE)


def ancestors(records: DataFrame, fingerprint: str) -> DataFrame:
    """The records a table depends on, itself included."""
    edges = records.select("fingerprint", F.explode_outer("inputs").alias("input"))
    fresh = found = cut_lineage(records.filter(F.col("fingerprint") == fingerprint).select("fingerprint").distinct())
    while not fresh.isEmpty():
        above = edges.join(fresh, "fingerprint").select(F.col("input").alias("fingerprint")).filter(F.col("fingerprint").isNotNull()).distinct()
        fresh = cut_lineage(above.join(found, "fingerprint", "left_anti"))
        found = found.unionByName(fresh)
    return records.join(found, "fingerprint", "left_semi")


def timing(records: DataFrame) -> DataFrame:
    """Runs and seconds by flow."""
    return records.groupBy("flow").agg(F.count("*").alias("runs"), F.sum(F.col("end") - F.col("start")).alias("seconds"))
