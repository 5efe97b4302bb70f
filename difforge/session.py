"""What the engine asks of a session."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it isn't set, a temporary folder serves a local session; on a cluster that would lose data, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="difforge-"))
    return _own[0]


def bound_batches(spark: SparkSession) -> None:
    """Python workers of this session get at most 2000 rows and about 16 MB at once, or what the session asks for if that is less, so that their memory doesn't grow with a partition."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20)):
        was = re.match(r"(\d+)b?$", str(spark.conf.get(key)), re.IGNORECASE)
        spark.conf.set(key, str(min(most, int(was[1])) if was and int(was[1]) > 0 else most))
