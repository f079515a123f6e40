"""Session set-up and the checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import TypeVar
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "millrace") -> SparkSession:
    """A single-machine session with the settings every plan here relies on (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; one of our own only in a local session that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    if not named and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="millrace-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable for the Python workers of the session, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="millrace-")) / "millrace.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(archive))
    # Workers that don't take files with them, such as those of stateful streams, find it where it is installed.
    sc.environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([*filter(None, sc.environment.get("PYTHONPATH", "").split(os.pathsep)), str(root.parent)]))
    _SHIPPED.add(sc.applicationId)


class TimedOut(RuntimeError):
    """An action was cancelled at its deadline."""


def bounded(spark: SparkSession, seconds: float, action: Callable[[], T]) -> T:
    """What ``action`` returns; its Spark jobs are cancelled after ``seconds``."""
    sc = spark.sparkContext
    tag, late = f"bounded-{uuid4().hex}", threading.Event()

    def cancel() -> None:
        late.set()
        sc.cancelJobsWithTag(tag)

    sc.addJobTag(tag)
    timer = threading.Timer(seconds, cancel)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"cancelled after {seconds} s") from e
        raise
    finally:
        timer.cancel()
        sc.removeJobTag(tag)
