"""A local session for tests, benches and trial runs; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("mediaplan")
             .config("spark.sql.shuffle.partitions", str(partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.driver.memory", memory)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Hand the library to the session's Python workers, once, unless they can import it where they are."""
    context = spark.sparkContext
    if context.master.startswith("local[") or context.master == "local":
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        if root not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
            os.environ["PYTHONPATH"] = os.pathsep.join([root, *filter(None, [os.environ.get("PYTHONPATH")])])
            context.environment["PYTHONPATH"] = os.environ["PYTHONPATH"]
        return
    if getattr(context, "_mediaplan_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="mediaplan-"), "mediaplan_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for package in ("mediaplan", "workload"):
            for folder, _, names in os.walk(os.path.join(root, package)):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._mediaplan_shipped = True
