"""Spark-native dataset and model diagnostics."""

import sys

from pyspark import cloudpickle

from .config import AuditConfig
from .plans.audit import AuditResult, audit, run_all_checks, run_audit
from .sources.csv import load_csv
from .sources.tables import table

__all__ = ["AuditConfig", "AuditResult", "audit", "load_csv", "run_all_checks", "run_audit", "table"]

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
