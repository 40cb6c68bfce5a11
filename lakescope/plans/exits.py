"""Exit codes of runs, and how a report's severity maps to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OK, WARNING, CRITICAL, PII, CONFIG, CONNECTION = range(6)


class Coded(Exception):
    """An error with the code that a run ends with."""

    def __init__(self, code: int, message: str = ""):
        super().__init__(message)
        self.code = code


def code_of(error: BaseException) -> int:
    return error.code if isinstance(error, Coded) else CONFIG


def exit_code(worst: Column, fail_on: str = "critical") -> Column:
    """2 for CRITICAL unless fail_on is never, 1 for WARNING if it is warn, else 0."""
    critical = F.when(worst == "CRITICAL", OK if fail_on == "never" else CRITICAL)
    return (critical.when(worst == "WARNING", WARNING) if fail_on == "warn" else critical).otherwise(OK)


def exit_from(worst: str, fail_on: str = "critical") -> int:
    if worst == "CRITICAL" and fail_on != "never":
        return CRITICAL
    return WARNING if worst == "WARNING" and fail_on == "warn" else OK
