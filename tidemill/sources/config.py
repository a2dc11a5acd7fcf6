"""Deployment configuration: operations, participants and script revisions as small tables."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemill.functions.values import load

_SEMVER = re.compile(r"(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)")


@dataclass(frozen=True)
class Config:
    """Tables of one deployment; each is a few rows, so joins with them may broadcast."""

    operations: DataFrame
    scripts: DataFrame


def read_config(spark: SparkSession, text: str) -> Config:
    """A configuration from its JSON text; repeated keys, unknown participants and unsound versions are errors."""
    doc = load(text)
    deployment = doc["deployment"]
    participants = set(deployment["participants"])
    operations = []
    for name, own in deployment["operations"].items():
        if own["participant"] not in participants:
            raise ValueError(f"operation {name}: unknown participant {own['participant']}")
        back = own.get("compensation")
        if back is not None and back not in deployment["operations"]:
            raise ValueError(f"operation {name}: unknown compensation {back}")
        operations.append((name, own["participant"], back))
    scripts = []
    for s in doc.get("scripts", []):
        if not _SEMVER.fullmatch(s["version"]):
            raise ValueError(f"script {s['name']}: version {s['version']} is no semantic version")
        scripts.append((s["name"], s["version"], bool(s.get("active", True))))
    names = [s[0] for s in scripts if s[2]]
    if len(set(names)) < len(names):
        raise ValueError("a script has two active versions")
    return Config(
        spark.createDataFrame(operations, "operation_name string, participant string, compensation string"),
        spark.createDataFrame(scripts, "script_name string, version string, active boolean"),
    )
