"""Session builder with the settings the library is tuned for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# UTC keeps month and day boundaries the same on every executor; AQE sizes the
# shuffles and splits skewed join partitions at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(
    app: str = "tabulight", master: str | None = None, checkpoint_dir: str | None = None, **conf: str
) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots.

    ``checkpoint_dir`` is the folder all executors share, for staged frames. A cluster
    needs it, unless its own settings name one.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if checkpoint_dir:
        settings["spark.checkpoint.dir"] = checkpoint_dir
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
