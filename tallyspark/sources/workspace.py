"""A run's named artifacts: tables as JSON lines, documents as text, through the cluster's file system."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallyspark.sources.readers import write_artifact

#: The artifacts of a run and their file names.
ARTIFACTS = {
    "task": "task.md",
    "task_spec": "task_spec.json",
    "plan": "plan.json",
    "retrieved_chunks": "retrieved_chunks.json",
    "reranked_chunks": "reranked_chunks.json",
    "evidence_table": "evidence_table.json",
    "evidence_coverage": "evidence_coverage.json",
    "query_rewrites": "query_rewrites.json",
    "numeric_facts": "numeric_facts.json",
    "numeric_claims": "numeric_claims.json",
    "numeric_verification": "numeric_verification.json",
    "evaluation_summary": "evaluation_summary.json",
    "critic_report": "critic_report.json",
    "trace_log": "trace_log.json",
    "final_answer": "final_answer.md",
    "memory_update": "memory_update.json",
}


@dataclass(frozen=True)
class Workspace:
    root: str
    run_id: str

    def path(self, name: str) -> str:
        """Where an artifact goes; an unknown name raises KeyError."""
        return f"{self.root}/{self.run_id}/{ARTIFACTS[name]}"

    def write_table(self, name: str, rows: DataFrame) -> None:
        write_artifact(rows, self.path(name))

    def write_document(self, spark: SparkSession, name: str, content: Any) -> None:
        """Text as it is, other content as JSON with sorted keys."""
        said = content if isinstance(content, str) else json.dumps(content, indent=2, sort_keys=True, ensure_ascii=False)
        spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(self.path(name))

    def read_document(self, spark: SparkSession, name: str) -> str:
        return spark.read.text(self.path(name), wholetext=True).first()["value"].removesuffix("\n")
