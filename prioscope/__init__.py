"""prioscope: priority auditing of support tickets on Spark DataFrames."""

from prioscope.config import AuditConfig, BoosterConfig

__all__ = ["AuditConfig", "BoosterConfig"]
