from __future__ import annotations

import pytest

from plumbline.operators.predicates import number_setting
from plumbline.plans.runner import tolerance
from plumbline.spec import RuleType, normalise_config, validate_config


def test_new_rule_needs_a_source():
    problems = validate_config(RuleType.NOT_NULL, {"column": "a"}, require_source=True)
    assert problems == ["Source connection is required.", "Source type is required."]


@pytest.mark.parametrize(
    "kind, expected",
    [
        ("csv_file", ["Source table or CSV file is required."]),
        ("oracle_sql", ["Source SQL is required for a custom SQL source."]),
        ("connection", []),
    ],
)
def test_source_kinds_need_their_setting(kind, expected):
    settings = {"column": "a", "source_connection_id": 1, "source_kind": kind}
    assert validate_config(RuleType.NOT_NULL, settings, require_source=True) == expected


def test_reference_rules_need_a_target():
    settings = {"source_connection_id": 1, "source_kind": "table", "source_name": "t", "source_key": "a", "target_key": "b"}
    problems = validate_config(RuleType.REFERENTIAL_INTEGRITY, settings, require_source=True)
    assert problems == ["Target connection is required.", "Target type is required."]
    assert "Target dataset is required." in validate_config(
        RuleType.REFERENTIAL_INTEGRITY, {"source_key": "a", "target_key": "b"}
    )


@pytest.mark.parametrize(
    "kind, settings, expected",
    [
        ("not_null", {}, "Missing required setting: column"),
        ("not_null", {"column": "a", "fail_threshold_count": -1}, "Fail threshold (rows) cannot be negative."),
        ("not_null", {"column": "a", "fail_threshold_count": "x"}, "Fail threshold (rows) must be a whole number."),
        ("not_null", {"column": "a", "fail_threshold_percent": 150}, "Fail threshold (%) must be between 0 and 100."),
        ("not_null", {"column": "a", "fail_threshold_percent": -5}, "Fail threshold (%) must be between 0 and 100."),
        ("not_null", {"column": "a", "fail_threshold_percent": "x"}, "Fail threshold (%) must be a number."),
        ("data_freshness", {"column": "a"}, "Missing required setting: max_age_days"),
        ("data_freshness", {"column": "a", "max_age_days": -1}, "Maximum age (days) cannot be negative."),
        ("data_freshness", {"column": "a", "max_age_days": "x"}, "Maximum age (days) must be a whole number."),
        ("date_validity", {"column": "a", "min_date": "01/01/2022"}, "Earliest allowed date must use YYYY-MM-DD format."),
        (
            "date_validity",
            {"column": "a", "min_date": "2022-02-01", "max_date": "2022-01-01"},
            "Earliest allowed date cannot be after the latest allowed date.",
        ),
        ("unique", {"columns": "a"}, 'The columns setting must be a JSON list, for example ["customer_id"].'),
        ("allowed_values", {"column": "a", "values": "x"}, "The values setting must be a JSON list."),
    ],
)
def test_each_problem_is_reported_once(kind, settings, expected):
    assert validate_config(RuleType(kind), settings) == [expected]


def test_one_column_stands_for_a_list():
    assert normalise_config(RuleType.UNIQUE, {"column": "a"})["columns"] == ["a"]
    assert validate_config(RuleType.DUPLICATE, {"column": "a"}) == []


def test_numbers_in_settings():
    assert number_setting("5.0", "min") == 5
    assert str(number_setting(0.1, "min")) == "0.1"
    for bad in ("x", "nan", float("inf")):
        with pytest.raises(ValueError):
            number_setting(bad, "min")


def test_unusable_tolerances_count_as_zero():
    assert tolerance({"fail_threshold_count": "x", "fail_threshold_percent": None}) == (0, 0.0)
    assert tolerance({"fail_threshold_count": "3", "fail_threshold_percent": "12.5"}) == (3, 12.5)
