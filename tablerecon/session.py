"""Session facts and settings the operators rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def recommended_conf(input_bytes: int, partition_bytes: int = 256 << 20, shuffled_bytes: int | None = None) -> dict[str, str]:
    """Settings for a job over ``input_bytes`` of input.

    Shuffles start with about one partition per ``partition_bytes`` so that
    sorts fit in executor memory; adaptive execution merges what turns out
    small and splits what turns out skewed.  ``shuffled_bytes`` says what is
    left of the input once columns are pruned, where that is known.
    """
    partitions = max(200, -(-(input_bytes if shuffled_bytes is None else shuffled_bytes) // partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.session.timeZone": "UTC",
        # Comparisons of many fields make long generated methods.  Beyond this
        # size the JVM would interpret them, while smaller functions compile.
        "spark.sql.codegen.hugeMethodLimit": "8000",
        # Call sites of Column expressions are only wanted when debugging.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the cluster names it.

    Only a local session without one gets a temporary folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tablerecon-")
    context.setCheckpointDir(folder)
    return folder
