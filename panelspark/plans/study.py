"""Studies of many fits: run side by side, each result kept as soon as it is there.

A study is a list of named pieces of work.  The record of a piece is written to shared
storage when it is done, so a study that was stopped, by a lost driver too, runs only
what is missing.  A few pieces run at a time, each in a scheduler pool of its own, so
that the tasks of small fits fill the cluster together.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.published import read_text, replace_text


def table_mark(df: DataFrame) -> str:
    """A mark of the content of a table, whatever the order of its rows."""
    row = df.select(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).alias("h"))
    seen = row.agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h") % 1_000_003).alias("s")
    ).first()
    return f"{seen.n}:{seen.x}:{seen.s}"


class Study:
    """Records by name in a folder that belongs to one description of the work."""

    def __init__(self, spark: SparkSession, path: str, about: Mapping):
        said = json.dumps(about, sort_keys=True, default=str)
        self.spark = spark
        self.path = f"{path.rstrip('/')}/{hashlib.sha256(said.encode()).hexdigest()[:24]}"
        if read_text(spark, f"{self.path}/about.json") is None:
            replace_text(spark, f"{self.path}/about.json", said)

    def record(self, name: str) -> dict | None:
        text = read_text(self.spark, f"{self.path}/{name}.json")
        return None if text is None else json.loads(text)

    def folder(self, name: str) -> str:
        """Where the tables of a piece of work are published."""
        return f"{self.path}/{name}"

    def run(self, names: Iterable[str], work: Callable[[str], dict], *, workers: int = 4) -> dict[str, dict]:
        """The records of all ``names``; ``work`` is called for those that are missing.

        If a piece fails, the others are still run and kept, then its error is raised.
        """
        names = list(names)
        found = {n: r for n in names if (r := self.record(n)) is not None}

        def one(name: str) -> dict:
            self.spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"study-{name}")
            record = work(name)
            # Last: a record says that everything before it is there.
            replace_text(self.spark, f"{self.path}/{name}.json", json.dumps(record))
            return record

        errors = []
        with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
            waiting = {pool.submit(inheritable_thread_target(one), n): n for n in names if n not in found}
            for done in as_completed(waiting):
                try:
                    found[waiting[done]] = done.result()
                except Exception as error:  # noqa: BLE001
                    errors.append(error)
        if errors:
            raise errors[0]
        return {n: found[n] for n in names}
