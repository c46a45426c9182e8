"""Strata, regions and parameters."""

from __future__ import annotations

import logging
import os
import threading
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession

STRATA_SCHEMA = "stratum_ord int, stratum string, quota int"
REGION_SCHEMA = "stratum string, region_idx int, lat_lo double, lat_hi double, lon_lo double, lon_hi double"


@dataclass(frozen=True)
class SamplingParameters:
    quotas: dict[str, int]  # in the order in which strata are filled
    min_spacing_km: float = 1.0
    bbox_size_m: float = 256.0
    attempts_per_point: int = 150
    seed: int = 0
    log_level: str = "INFO"
    log_file: str | None = None
    other: dict = field(default_factory=dict)

    @property
    def total(self) -> int:
        return sum(self.quotas.values())


def load_config(path: str = "configs/config.yaml") -> dict:
    """The whole configuration tree; it may be empty."""
    import yaml

    with open(path) as f:
        return yaml.safe_load(f) or {}


def parameters(config: dict) -> SamplingParameters:
    s, log = config.get("sampling", {}), config.get("logging", {})
    return SamplingParameters(dict(s.get("strata", {})), float(s.get("min_spacing_km", 1.0)), float(s.get("bbox_size_m", 256)), int(s.get("attempts_per_point", 150)), int(s.get("seed", 0)), log.get("level", "INFO"), log.get("log_file"), other={k: v for k, v in config.items() if k not in ("sampling", "logging")})


def strata_frame(spark: SparkSession, quotas: Iterable[tuple[str, int]]) -> DataFrame:
    return spark.createDataFrame([(i, name, quota) for i, (name, quota) in enumerate(quotas, 1)], STRATA_SCHEMA)


def regions_frame(spark: SparkSession, regions: dict[str, list[tuple[float, float, float, float]]]) -> DataFrame:
    """regions: stratum -> boxes (lat_lo, lat_hi, lon_lo, lon_hi)."""
    rows = [(s, i, *map(float, box)) for s, boxes in regions.items() for i, box in enumerate(boxes)]
    if bad := [r for r in rows if r[2] > r[3] or r[4] > r[5]]:
        raise ValueError(f"inverted box: {bad[0]}")
    return spark.createDataFrame(rows, REGION_SCHEMA)


def regions(tree: dict) -> dict[str, list[tuple[float, float, float, float]]]:
    """stratum -> boxes, from a loaded file: a stratum's boxes, or a mapping that has them under `regions`.

    A box is [[lat_lo, lat_hi], [lon_lo, lon_hi]] or its four numbers.
    """
    out = {}
    for stratum, said in tree.items():
        boxes = said.get("regions", []) if isinstance(said, dict) else said or []
        out[stratum] = [tuple(float(x) for part in box for x in (part if isinstance(part, (list, tuple)) else [part])) for box in boxes]
        if bad := [b for b in out[stratum] if len(b) != 4]:
            raise ValueError(f"{stratum}: a box has four numbers, not {bad[0]}")
    return out


def load_regions(path: str) -> dict[str, list[tuple[float, float, float, float]]]:
    """Regions of a YAML or JSON file, of the whole tree or what it has under `strata`."""
    tree = load_config(path)
    return regions(tree.get("strata", tree))


def log_counts(logger: logging.Logger, df: DataFrame, name: str, **counts) -> DataFrame:
    """df, whose counts (columns of aggregates) are logged once some action has read it; no pass of its own is made."""
    seen = Observation(name)
    watched = df.observe(seen, *[c.alias(k) for k, c in counts.items()])
    threading.Thread(target=lambda: logger.info(f"{name}: " + ", ".join(f"{k} {v}" for k, v in seen.get.items())), daemon=True).start()
    return watched


def get_logger(name: str, level: str = "INFO", path: str | None = None) -> logging.Logger:
    """Console logger, and a file if a path is given; handlers are attached once for each name."""
    logger = logging.getLogger(name)
    logger.setLevel(level)
    if not logger.handlers:
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if path:
            os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
            handlers.append(logging.FileHandler(path))
        for h in handlers:
            h.setFormatter(logging.Formatter("%(asctime)s | %(name)s | %(levelname)s | %(message)s"))
            logger.addHandler(h)
    return logger
