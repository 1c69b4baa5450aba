"""A time limit for work that runs Spark jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import SparkSession

T = TypeVar("T")


def within(spark: SparkSession, seconds: float, work: Callable[[], T]) -> T:
    """The result of ``work``, whose jobs carry a tag of their own.  Past the limit they are
    cancelled, and so is every job it still starts, until it gives up; then
    ``TimeoutError`` is raised.  Jobs of other threads go on."""
    tag = f"limit-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    result: list = []
    failure: list[BaseException] = []

    def run() -> None:
        sc.addJobTag(tag)
        try:
            result.append(work())
        except BaseException as e:  # noqa: BLE001 - handed to the caller
            failure.append(e)
        finally:
            sc.removeJobTag(tag)

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    late = thread.is_alive()
    patience = threading.Event()
    while thread.is_alive():
        sc.cancelJobsWithTag(tag)
        patience.wait(0.2)
    if late:
        raise TimeoutError(f"not finished within {seconds:g} s")
    if failure:
        raise failure[0]
    return result[0]
