"""Settings of a data set from YAML files: what to make, from which genomes, and where centromeres lie. Read by the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class DataConfig:
    """Genomes (with the number of graphs of each) for training and validation, steps to take, paths and parameters."""

    training: dict[str, int] = field(default_factory=dict)
    validation: dict[str, int] = field(default_factory=dict)
    steps: dict[str, bool] = field(default_factory=dict)
    paths: dict[str, str] = field(default_factory=dict)
    depth: int = 1
    diploid: bool = True
    real: bool = False
    seed: int = 0

    @property
    def whole(self) -> dict[str, int]:
        """Number of graphs of each genome, for both uses together."""
        names = [*self.training, *(n for n in self.validation if n not in self.training)]
        return {n: self.training.get(n, 0) + self.validation.get(n, 0) for n in names}


def _mapping(path: str) -> dict:
    import yaml

    with open(path, encoding="utf-8") as f:
        found = yaml.safe_load(f)
    if found is None:
        return {}
    if not isinstance(found, dict):
        raise ValueError(f"{path}: not a mapping")
    return found


def read_data_config(path: str) -> DataConfig:
    """A data set's settings: sections ``paths``, ``gen_config``, ``gen_steps``, ``training`` and ``validation``, any of which may be
    missing or empty."""
    found = _mapping(path)
    part = lambda name: found.get(name) or {}
    made = part("gen_config")
    counts = [{str(k): int(v) for k, v in part(name).items()} for name in ("training", "validation")]
    if any(v < 0 for c in counts for v in c.values()):
        raise ValueError(f"{path}: a number of graphs is negative")
    return DataConfig(
        *counts,
        {str(k): bool(v) for k, v in part("gen_steps").items()},
        {str(k): str(v) for k, v in part("paths").items()},
        int(made.get("depth", 1)),
        bool(made.get("diploid", True)),
        bool(made.get("real", False)),
        int(made.get("seed", 0)),
    )


def read_centromeres(spark: SparkSession, path: str) -> DataFrame:
    """Centromeres by chromosome, and by variant where the file tells them apart: chr, variant (null for both), start, end.

    The file maps a chromosome to [start, end], or to a mapping of variants to such pairs.
    """
    rows = []
    for name, place in _mapping(path).items():
        for variant, pair in place.items() if isinstance(place, dict) else [(None, place)]:
            if not isinstance(pair, list | tuple) or len(pair) != 2 or pair[0] > pair[1]:
                raise ValueError(f"{path}: {name} has no start and end")
            rows.append((str(name), variant, int(pair[0]), int(pair[1])))
    return spark.createDataFrame(rows, "chr string, variant string, start long, end long")
