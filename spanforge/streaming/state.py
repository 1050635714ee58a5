"""What both stateful streams need."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession

#: the store that keeps processor state and timers
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_store(spark: SparkSession) -> None:
    """Stateful processors run on this store only; a session that names another one keeps it."""
    key = "spark.sql.streaming.stateStore.providerClass"
    if spark.conf.get(key, "").rpartition(".")[2] in ("", "HDFSBackedStateStoreProvider"):
        spark.conf.set(key, STORE)


def to_ms(t: pd.Timestamp) -> int:
    return int(t.value // 1_000_000)
