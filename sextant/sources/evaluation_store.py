"""Test cases and evaluation runs over Parquet: cases that can be added, changed and removed, and runs that stay."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sextant.operators import evaluation as E

CASES = "case_id string, question string, source string, reference_answer string, relevant array<long>, mode string"
RUNS = "id string, status string, config string, metrics string, n_cases long, at timestamp"


class EvaluationStore:
    """One writer at a time. Cases are a versioned table with a pointer to its state; runs are appended."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def cases(self) -> DataFrame:
        if not self._exists(f"{self.root}/CURRENT"):
            return self.spark.createDataFrame([], CASES)
        return self.spark.read.schema(CASES).parquet(f"{self.root}/cases/{self.spark.read.text(f'{self.root}/CURRENT').first()[0]}")

    def _put(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        rows.select(*(c.split(" ")[0] for c in CASES.split(", "))).write.parquet(f"{self.root}/cases/{version}")
        self.spark.createDataFrame([(version,)], "v string").coalesce(1).write.mode("overwrite").text(f"{self.root}/CURRENT")

    def create(self, question: str, relevant: Sequence[int], reference_answer: str | None = None, source: str = "manual", mode: str | None = None) -> str:
        if not question or not question.strip():
            raise ValueError("a case needs a question")
        key = uuid.uuid4().hex
        self._put(self.cases().unionByName(self.spark.createDataFrame([(key, question, source, reference_answer, list(relevant), mode)], CASES)))
        return key

    def add(self, cases: DataFrame) -> None:
        """Many cases at once, in place of those of the same ids."""
        new = cases.select(*((F.col(c) if c in cases.columns else F.lit(None)).cast(k).alias(c) for c, k in (x.split(" ") for x in CASES.split(", "))))
        self._put(self.cases().join(new.select("case_id"), "case_id", "left_anti").unionByName(new))

    def get(self, key: str) -> dict | None:
        rows = self.cases().where(F.col("case_id") == key).limit(1).collect()
        return rows[0].asDict() if rows else None

    def update(self, key: str, **changes: object) -> bool:
        """Whether there is such a case; its columns take the given values."""
        if self.get(key) is None:
            return False
        rows = self.cases()
        for column, value in changes.items():
            kind = dict(rows.dtypes)[column]
            new = F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
            rows = rows.withColumn(column, F.when(F.col("case_id") == key, new.cast(kind)).otherwise(F.col(column)))
        self._put(rows)
        return True

    def delete(self, key: str) -> bool:
        if self.get(key) is None:
            return False
        self._put(self.cases().where(F.col("case_id") != key))
        return True

    def run(self, retrieve: Callable[[DataFrame], DataFrame], config: dict | None = None) -> dict:
        """Evaluate retrieve(cases) -> (case_id, id, rank), one plan for all cases, and keep the run.

        A case that finds nothing is a miss. If the search as a whole fails, the run is kept as failed, without metrics.
        """
        key, n, cases = uuid.uuid4().hex, 0, self.cases()
        try:
            results = retrieve(cases.select("case_id", "question"))
            means = E.run_metrics(E.case_metrics(cases, results, cases.select("case_id", F.explode("relevant").alias("id")))).first().asDict()
            n, status = means.pop("n_cases"), "completed"
        except Exception as e:  # noqa: BLE001  a failed run stays on record
            means, status = {"error": str(e)[:1000]}, "failed"
        row = self.spark.createDataFrame([(key, status, json.dumps(config or {}), json.dumps(means), n)], "id string, status string, config string, metrics string, n_cases long")
        row.withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.root}/runs")
        return {"id": key, "status": status, "n_cases": n, "metrics": means}

    def runs(self, collections: Sequence[str] | None = None) -> DataFrame:
        """Runs, the newest first; with collections, only those whose recorded scope lies within."""
        rows = self.spark.read.schema(RUNS).parquet(f"{self.root}/runs") if self._exists(f"{self.root}/runs") else self.spark.createDataFrame([], RUNS)
        return E.runs_in_scope(rows, collections).orderBy(F.desc("at"), "id")
