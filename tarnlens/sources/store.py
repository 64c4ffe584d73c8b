"""Stored results and users as tables: append, latest, visible, owner-only changes."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlens.operators import rank

SCHEMA = "id bigint, user_id bigint, is_public boolean, analysis_id string, repository string, target_path string, language string, files_analyzed int, total_vulnerabilities int, result_json string, created_at timestamp, updated_at timestamp"


class ResultStore:
    """Versions of rows in one folder: a change appends a row with a later version, and reading keeps the last of each id.

    Appending never rewrites what others read, so a reader that is under way isn't disturbed, and a failed writer leaves nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _append(self, rows: DataFrame) -> None:
        rows.withColumn("version", F.expr("uuid()")).withColumn("written_at", F.current_timestamp()).write.mode("append").option("mergeSchema", "true").parquet(self.path)

    def table(self) -> DataFrame:
        try:
            every = self.spark.read.parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
                return self.spark.createDataFrame([], SCHEMA)
            raise
        return rank.latest(every, ["analysis_id"], F.struct("written_at", "version")).select(*[f.split()[0] for f in SCHEMA.split(", ")])

    def save(self, user_id: int | None, result_json: str, repository: str | None = None, files_analyzed: int = 0, total: int = 0, public: bool = False) -> str:
        """The new row's analysis id. Its number comes from the clock and the id, not from the greatest so far, so two writers
        at once don't take the same."""
        made = uuid.uuid4()
        number = time.time_ns() // 1000 << 10 | made.int & 1023
        row = self.spark.createDataFrame([(number, user_id, public, str(made), repository, None, "java", files_analyzed, total, result_json, None, None)], SCHEMA)
        self._append(row.withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp()))
        return str(made)

    def visible(self, user_id: int | None) -> DataFrame:
        return rank.visible(self.table(), F.col("user_id"), F.col("is_public"), F.lit(user_id).cast("bigint"))

    def get(self, analysis_id: str, user_id: int | None) -> DataFrame:
        return self.visible(user_id).filter(F.col("analysis_id") == analysis_id)

    def list_results(self, user_id: int | None, limit: int = 20) -> DataFrame:
        """Newest first; a limit of 0 or less gives none."""
        return rank.top_n(self.visible(user_id), [F.desc("created_at"), F.desc("id")], limit)

    def get_latest(self, user_id: int | None) -> DataFrame:
        return self.list_results(user_id, 1)

    def update(self, analysis_id: str, user_id: int, result_json: str) -> bool:
        """Only the owner's rows change."""
        mine = self.table().filter((F.col("analysis_id") == analysis_id) & (F.col("user_id") == user_id))
        return self._change(mine.withColumn("result_json", F.lit(result_json)))

    def set_visibility(self, analysis_id: str, public: bool) -> bool:
        return self._change(self.table().filter(F.col("analysis_id") == analysis_id).withColumn("is_public", F.lit(public)))

    def _change(self, rows: DataFrame) -> bool:
        if rows.isEmpty():
            return False
        self._append(rows.withColumn("updated_at", F.current_timestamp()))
        return True


def upsert_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Users by github_id with the latest particulars; a login or address of two ids is an error that is raised when read."""
    every = users.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    merged = rank.latest(every, ["github_id"], F.col("_new")).drop("_new")
    clashes = merged.groupBy("github_login").agg(F.count("*").alias("_n"))
    checked = merged.join(clashes, "github_login").withColumn("github_login", F.when(F.col("_n") == 1, F.col("github_login")).otherwise(F.raise_error(F.concat(F.lit("login in use: "), "github_login"))))
    return checked.drop("_n").select(*merged.columns)
