"""Session defaults, and the package on the executors."""

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI casts; partitions follow the cluster unless given."""
    b = SparkSession.builder.appName("fathom")
    b = b.master(master) if master else b
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC"}
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return b.config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each context, so that Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_fathom_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="fathom-"), "fathom.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.join("fathom", os.path.relpath(os.path.join(folder, n), root)))
    sc.addPyFile(path)
    sc._fathom_shipped = True
