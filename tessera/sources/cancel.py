"""Work that can be called off: its jobs carry a tag, and between its steps it looks for a mark in a folder all can see."""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterator

from pyspark.sql import SparkSession

from tessera.sources.folders import exists, put, remove


class Cancelled(RuntimeError):
    """The work was called off; what its tables were before still counts."""


class Cancellation:
    """One for each thing that is worked on, by its path. call_off() stops the jobs of this session's work at once, and work
    of any other session at its next step."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.mark, self.tag = spark, f"{path}/.cancel", "work-" + hashlib.md5(path.encode()).hexdigest()

    def call_off(self) -> None:
        put(self.spark, self.mark)
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        """Between steps: an error if the work was called off."""
        if exists(self.spark, self.mark):
            raise Cancelled("called off")

    @contextlib.contextmanager
    def work(self) -> Iterator[Cancellation]:
        """Jobs begun inside carry the tag. What fails after a call is Cancelled; the mark goes at the end."""
        remove(self.spark, self.mark)
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            yield self
        except Cancelled:
            raise
        except Exception as e:
            if exists(self.spark, self.mark):
                raise Cancelled("called off") from e
            raise
        finally:
            self.spark.sparkContext.removeJobTag(self.tag)
            remove(self.spark, self.mark)
