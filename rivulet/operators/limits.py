"""A wall-clock deadline for an action."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

from rivulet.errors import DeadlineExceeded


def within(spark: SparkSession, seconds: float, action: Callable):
    """The action's result; its jobs are cancelled, and DeadlineExceeded raised, when the time is over."""
    tag, over = f"deadline-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        out = action()
    except Exception as e:
        if over.is_set():
            raise DeadlineExceeded(f"longer than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        spark.sparkContext.removeJobTag(tag)
    if over.is_set():
        raise DeadlineExceeded(f"longer than {seconds} s")
    return out
