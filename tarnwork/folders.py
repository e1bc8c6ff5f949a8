"""Folders that driver and executors share, for tables that jobs write and read back."""

import tempfile
import uuid

_OWN = {}


def shared_dir(spark):
    """``spark.checkpoint.dir`` of the session.  A temporary folder stands in for it on one
    machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tarnwork-")
    return _OWN[app]


def fresh_dir(spark, label):
    return f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"


def stage(df, label, **options):
    """``df`` written below the shared folder, with the writer's ``options``, and read back."""
    path = fresh_dir(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
