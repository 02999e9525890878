"""Sessions by the options that a node of a cluster has."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class SessionOptions:
    """Where a session runs and what it may use; None leaves Spark's default.

    ``coordinator_host`` and ``coordinator_port``: the cluster's master, else this machine with
    ``cores`` threads.  ``host`` and ``port``: where the driver listens.  ``workers``: executors
    to ask for, of ``cores`` cores each, and to wait for ``join_timeout`` seconds at most.
    ``rpc_timeout``: seconds for network calls.  ``temp_dir``: where nodes put shuffled and
    spilled data.  ``shared_dir``: the folder that all nodes share, for intermediate tables.
    ``memory``: bytes that a node may use before it spills, 16 MiB at least.
    """

    coordinator_host: str | None = None
    coordinator_port: int = 7077
    host: str | None = None
    port: int | None = None
    workers: int | None = None
    cores: int | None = None
    join_timeout: float | None = None
    rpc_timeout: float | None = None
    temp_dir: str | None = None
    shared_dir: str | None = None
    memory: int | None = None

    def __post_init__(self) -> None:
        if self.memory is not None and self.memory < 16 << 20:
            raise ValueError("a node needs 16 MiB at least")
        if self.workers is not None and self.workers < 1:
            raise ValueError("a cluster needs one worker at least")

    def settings(self) -> dict[str, str]:
        """Spark's settings."""
        cores = "*" if self.cores is None else str(self.cores)
        out = {"spark.master": f"spark://{self.coordinator_host}:{self.coordinator_port}" if self.coordinator_host else f"local[{cores}]"}
        wanted = {
            "spark.driver.host": self.host,
            "spark.driver.port": self.port,
            "spark.executor.instances": self.workers,
            "spark.executor.cores": self.cores if self.coordinator_host else None,
            "spark.scheduler.maxRegisteredResourcesWaitingTime": None if self.join_timeout is None else f"{self.join_timeout:g}s",
            "spark.scheduler.minRegisteredResourcesRatio": None if self.join_timeout is None else 1.0,
            "spark.network.timeout": None if self.rpc_timeout is None else f"{self.rpc_timeout:g}s",
            "spark.local.dir": self.temp_dir,
            "spark.checkpoint.dir": self.shared_dir,
        }
        if self.memory is not None:  # Spark itself takes 300 MiB besides
            wanted["spark.executor.memory" if self.coordinator_host else "spark.driver.memory"] = f"{self.memory // (1 << 20) + 300}m"
        return out | {k: str(v) for k, v in wanted.items() if v is not None}

    def builder(self, name: str = "weirflow") -> SparkSession.Builder:
        return SparkSession.builder.appName(name).config(map=self.settings())
