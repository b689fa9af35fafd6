"""Session settings that stand in for the job-control constants of the engine."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: A task may fail ten times; the eleventh failure fails the job.
MAX_TASK_FAILURES = 11

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.scheduler.mode": "FAIR",
    "spark.speculation": "true",
    "spark.speculation.quantile": "0.6",
    "spark.speculation.multiplier": "3",
    "spark.speculation.interval": "2s",
    "spark.task.maxFailures": str(MAX_TASK_FAILURES),
    "spark.shuffle.io.maxRetries": "3",
    "spark.executor.heartbeatInterval": "3s",
    "spark.network.timeout": "120s",
}

#: Nodes on which tasks keep failing get no more of them. In local mode there is no other node to turn to.
CLUSTER_SETTINGS = {
    "spark.excludeOnFailure.enabled": "true",
    "spark.excludeOnFailure.task.maxTaskAttemptsPerNode": "5",
}


#: Priorities of jobs, from the lowest share of the cluster to the highest.
PRIORITIES = range(1, 11)


def fair_pools() -> str:
    """The text of an allocation file with a pool for each priority, its weight the priority."""
    pools = "".join(f'<pool name="priority-{p}"><schedulingMode>FAIR</schedulingMode><weight>{p}</weight></pool>' for p in PRIORITIES)
    return f'<?xml version="1.0"?><allocations>{pools}</allocations>'


def pools_file() -> str:
    """A file with the pools for this process; only the driver reads it."""
    path = Path(tempfile.mkdtemp(prefix="tessera-")) / "pools.xml"
    path.write_text(fair_pools())
    return path.as_uri()


def builder(app: str = "tessera", local_cores: int | None = None) -> SparkSession.Builder:
    """A session builder. ``local_cores`` asks for local mode, which needs the retry count in its master string."""
    out = SparkSession.builder.appName(app)
    if local_cores:
        out = out.master(f"local[{local_cores},{MAX_TASK_FAILURES}]")
    for key, value in (SETTINGS if local_cores else SETTINGS | CLUSTER_SETTINGS).items():
        out = out.config(key, value)
    return out.config("spark.scheduler.allocation.file", pools_file())
