"""Declarative cleaning: a list of operations becomes one chain of transforms."""

from __future__ import annotations

import json
import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame

from veritab.operators import cleaning

OPERATIONS = {
    "null_removal": cleaning.remove_nulls,
    "null_filling": cleaning.fill_nulls,
    "outlier_removal": cleaning.remove_outliers,
    "scaling": cleaning.scale,
    "label_encoding": cleaning.label_encode,
    "one_hot_encoding": cleaning.one_hot_encode,
}


@dataclass
class CleaningResult:
    data: DataFrame
    log: list[dict[str, Any]] = field(default_factory=list)

    @property
    def completed(self) -> int:
        return sum(entry["status"] == "completed" for entry in self.log)

    @property
    def failed(self) -> int:
        return sum(entry["status"] == "failed" for entry in self.log)


def normalize(operation: dict[str, Any]) -> dict[str, Any]:
    """Bring the form ``{operation, method, columns}`` to ``{type, parameters}``."""
    if "type" in operation and "parameters" in operation:
        return operation
    method = operation.get("method") or None
    columns = list(operation.get("columns") or [])
    forms = {
        "handle_missing": (
            ("null_removal", {"method": "drop_rows"}) if method == "drop" else ("null_filling", {"strategy": "mean"})),
        "detect_outliers": ("outlier_removal", {"method": method or "iqr"}),
        "scale_features": ("scaling", {"method": method or "standard"}),
        "encode_categorical": ("one_hot_encoding" if method == "onehot" else "label_encoding", {}),
    }
    if operation.get("operation") not in forms:
        return operation
    kind, parameters = forms[operation["operation"]]
    return {"type": kind, "parameters": {**parameters, "columns": columns}}


def apply_operation(df: DataFrame, operation: dict[str, Any]) -> cleaning.Step:
    """Apply one operation; an unknown type or parameter is an error."""
    normal = normalize(operation)
    kind = normal.get("type")
    if kind not in OPERATIONS:
        raise ValueError(f"Unknown operation type: {kind}")
    parameters = dict(normal.get("parameters") or {})
    # An empty column list means every column.
    if not parameters.get("columns"):
        parameters.pop("columns", None)
    return OPERATIONS[kind](df, **parameters)


def _without(operation: dict[str, Any], df: DataFrame, protect: Sequence[str]) -> dict[str, Any]:
    """Name every other column where an operation means all of them."""
    parameters = operation.get("parameters") or {}
    if not protect or parameters.get("columns") or parameters.get("method") == "drop_columns":
        return operation
    return {**operation, "parameters": {**parameters, "columns": [c for c in df.columns if c not in protect]}}


def run_operations(
    df: DataFrame,
    operations: Sequence[dict[str, Any]],
    session_id: str = "",
    protect: Sequence[str] = (),
) -> CleaningResult:
    """Apply the operations in order, each to the output of the one before.

    A failing operation is logged and skipped. Row counts in the log come from
    the counts each operation already took, after one count of the input. An
    operation without columns leaves the ``protect`` columns alone.
    """
    if not operations:
        raise ValueError("no operations given")
    result = CleaningResult(df)
    rows = df.count()
    for operation in operations:
        normal = normalize(operation)
        started, clock = datetime.now(timezone.utc), time.monotonic()
        entry: dict[str, Any] = {
            "session_id": session_id,
            "timestamp": started.isoformat(),
            "operation_type": "preprocessing",
            "action": normal.get("type") or operation.get("operation") or "unknown",
            "parameters": json.dumps(normal.get("parameters") or {}, default=str),
            "rows_before": rows,
            "columns_before": len(result.data.columns),
        }
        try:
            data, details = apply_operation(result.data, _without(normal, result.data, protect))
        except Exception as error:  # one failing step must not stop the others
            entry.update(status="failed", error=str(error))
        else:
            result.data = data
            rows -= details.get("rows_removed", 0)
            entry.update(status="completed", details=details)
        entry.update(
            duration_ms=int((time.monotonic() - clock) * 1000),
            rows_after=rows,
            columns_after=len(result.data.columns),
        )
        result.log.append(entry)
    return result
