"""Plumbline: data-quality rules, profiling, drift and run history as Spark DataFrames."""

from plumbline.spec import Connection, Rule, RuleType, normalise_config, validate_config  # noqa: F401
