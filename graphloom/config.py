"""Settings: paths, service endpoints and retrieval parameters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Retrieval:
    beam_size: int = 30
    top_k: int = 9
    max_hop: int = 100
    prefilter: int = 2048
    epsilon: float = 1e-5


@dataclass(frozen=True)
class Services:
    embed_urls: list[str] = field(default_factory=lambda: [f"http://localhost:{p}" for p in range(8000, 8004)])
    generate_urls: list[str] = field(default_factory=lambda: [f"http://localhost:{p}" for p in range(8000, 8004)])
    timeout_seconds: float = 15.0
    max_tokens: int = 4096
    temperature: float = 0.7
    top_p: float = 0.8


@dataclass(frozen=True)
class Paths:
    """Folders of a project; every table of the pipeline is a folder below `root`."""

    root: str

    def table(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"


def tuned(spark: SparkSession, settings: Retrieval = Retrieval()) -> SparkSession:
    """Top-k windows are cut early only up to a threshold below the prefilter's width."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(spark.conf.get(name)) < settings.prefilter:
        spark.conf.set(name, str(settings.prefilter))
    return spark
