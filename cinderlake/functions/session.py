"""Checkpoints for iterative operators, and this package on Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the session was started; once per application.

    Nothing to do where workers find it themselves: by PYTHONPATH, or in local mode by the working folder.
    """
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, sc = os.path.dirname(package), spark.sparkContext
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if sc.applicationId in _shipped or os.path.realpath(root) in known or (sc.master.startswith("local[") and os.path.realpath(os.getcwd()) == os.path.realpath(root)):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="cinderlake-code-"), f"{os.path.basename(package)}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably in the shared folder of ``spark.checkpoint.dir``; only a local session without one gets
    a temporary folder, a cluster without one is an error.

    The frame that comes back is a plain table of rows. A checkpoint alone keeps the constraints that the optimiser inferred from its
    plan; carried from round to round they multiply until planning takes all of the driver's memory.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="cinderlake-checkpoint-")
        sc.setCheckpointDir(named)
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(df.sparkSession._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), df.sparkSession)
