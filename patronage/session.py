"""Session settings the operators rely on."""

from __future__ import annotations

import weakref
from collections.abc import Mapping

from pyspark.sql import SparkSession

# Settings that can be changed on a running session. UTC keeps period truncation
# independent of the machine; the adaptive settings let Spark split a hot join
# partition even where that costs one more exchange afterwards. Aggregates go down to Parquet
# footers only for tables read by `sources.footers`.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.aggregatePushdown": "true",
}

# Start-up settings: no stack trace is kept for each column expression that is built.
START_CONF = {"spark.python.sql.dataFrameDebugging.enabled": "false"}


_CONFIGURED: weakref.WeakSet[SparkSession] = weakref.WeakSet()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, once, and return it."""
    if spark not in _CONFIGURED:
        for key, value in RUNTIME_CONF.items():
            if spark.conf.get(key, None) != value:
                spark.conf.set(key, value)
        _CONFIGURED.add(spark)
    return spark


def build_session(
    app: str = "patronage",
    master: str | None = None,
    conf: Mapping[str, str] | None = None,
) -> SparkSession:
    """Create a session; `master` and `conf` are for tests and local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **START_CONF, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
