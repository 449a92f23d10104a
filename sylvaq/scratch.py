"""Shared scratch space: reliable checkpoints for iterative and two-pass plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from sylvaq.ship import ship

SETTING = "spark.checkpoint.dir"


def _removed_at_exit(spark: SparkSession, path: str) -> None:
    """Removes a folder of this process in the shared scratch space when the process ends, if the session still lives."""

    def remove() -> None:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # noqa: BLE001  a session that is gone leaves its files to the cluster
            pass

    atexit.register(remove)


def scratch_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the cluster names in ``spark.checkpoint.dir``.

    Only where that setting is absent, in a local test session, is a temporary
    folder made; a cluster without the setting is refused, as its machines share no
    such folder. What this process writes is removed at its end.
    """
    named = spark.conf.get(SETTING, None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if named:
        if not current:
            sc.setCheckpointDir(named)
            _removed_at_exit(spark, sc.getCheckpointDir())  # a folder of its own below the named one
        return named
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        own = tempfile.mkdtemp(prefix="sylvaq-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
        current = own
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the scratch folder, removed at the end of the process."""
    path = f"{scratch_dir(spark)}/{name}-{uuid4().hex}"
    _removed_at_exit(spark, path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared scratch folder, with its lineage cut.

    Partitions and their order are kept, which the two-pass operators rely on. A
    checkpoint remembers the size Catalyst guessed for its plan, which for a join is
    the product of both sides; in a loop of joins these numbers double their digits
    every round until planning takes longer than the work. So the guess is
    forgotten where the session allows it, and sizes are those met at run time.
    """
    spark = df.sparkSession
    ship(spark)
    scratch_dir(spark)
    done = df.checkpoint(eager=True)
    try:
        plain = spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    except Exception:  # noqa: BLE001  another kind of session: the checkpoint as it is
        return done
    return DataFrame(plain, spark)
