"""Session defaults and durable intermediate tables."""

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_own_dirs: dict[str, str] = {}
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def build_session(app: str = "alertloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; callers may override any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``.  Only when that is unset (local
    tests) a temporary folder is made, and removed again when the process ends.
    """
    configured = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getConf().get(_DIR_KEY)
    configured = configured or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local"):
        raise ValueError(f"set {_DIR_KEY} to a shared folder when running on a cluster")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="alertloom-")
        atexit.register(shutil.rmtree, _own_dirs[app], True)
    return _own_dirs[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a frame once and hand back a scan of it.

    Used where several consumers read one expensive result: each then prunes
    columns on the written table, and a lost executor costs a re-read instead of
    a re-computation.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    if (held := _scratch.get()) is not None:
        held.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """Tables staged inside are removed at the end; nothing read from them may outlive it."""
    token = _scratch.set([])
    try:
        yield
    finally:
        paths = _scratch.get()
        _scratch.reset(token)
        remove(spark, *paths)


def _files(spark: SparkSession, text: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders, in whatever store they lie; missing ones do not matter."""
    for text in paths:
        path, files = _files(spark, text)
        files.delete(path, True)


def written(spark: SparkSession, text: str) -> bool:
    """Whether a table was written there to the end."""
    path, files = _files(spark, f"{text}/_SUCCESS")
    return files.exists(path)
