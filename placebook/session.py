"""Session settings and the shipping of this package to executors."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_MARK = "_placebook_shipped"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per context, so that Python functions import it there.

    The archive is a snapshot that Spark's own file service hands out; no path is shared.
    """
    context = spark.sparkContext
    if getattr(context, _MARK, None):
        return
    files = sorted(p for p in ROOT.rglob("*.py"))
    digest = hashlib.sha256(b"".join(str(p.relative_to(ROOT)).encode() + p.read_bytes() for p in files)).hexdigest()[:16]
    archive = Path(tempfile.mkdtemp(prefix="placebook-ship-")) / f"placebook-{digest}.zip"
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for p in files:
            z.write(p, Path(ROOT.name) / p.relative_to(ROOT))
    context.addPyFile(str(archive))
    setattr(context, _MARK, True)


def local_session(cores: str = "8", memory: str = "12g", **conf: str) -> SparkSession:
    """A local session as tests and the benchmark use it; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("placebook")
    fixed = {
        "spark.sql.shuffle.partitions": cores,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = builder.config(map=fixed | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Where none is set, a local session (tests) gets a temporary one; a cluster is told to
    name one, as its machines share no temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="placebook-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and every reading sees the same rows."""
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
