"""Surviving values."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from patrika.llm.survivor import canonical, surviving_candidates, surviving_records

SCHEMA = "id string, job_id string, field_name string, value string, source_type string, confidence int, rejected boolean, created_at timestamp, vote string, winner int"
T = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(str(i), *r, None, None) for i, r in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize("field, value, fact", [
    ("application_end_date", " 5 March 2024 ", "2024-03-05"), ("application_end_date", "March 5, 2024", "2024-03-05"), ("application_end_date", "05/03/2024", "2024-03-05"),
    ("application_end_date", "31.02.2024", None), ("application_fee", "Rs. 1,200/-", "1200"), ("total_vacancies", "Total: 7", "7"), ("age_limit", "Min 18, Max 30", "18-30"),
    ("salary", "LEVEL 5 [29200/-]", "5-29200"), ("qualification", "Test & Trial.", "test and trial"), ("qualification", "  ", None), ("salary", None, None),
])
def test_canonical(spark, field, value, fact):
    row = spark.createDataFrame([(field, value)], "f string, v string").select(canonical(F.col("f"), F.col("v"))).first()
    assert row[0] == fact


CANDIDATES = [
    ("j", "application_fee", "Rs 100", "official_pdf", 90, False, T), ("j", "application_fee", "100/-", "llm", 70, False, T), ("j", "application_fee", "900", "aggregator", 40, False, T),
    ("k", "application_fee", "100", "official_pdf", 90, False, T), ("k", "application_fee", "250", "official_page", 85, False, T + timedelta(days=30)),
    ("l", "salary", "Level-5", "official_pdf", 95, False, T), ("l", "salary", "Level-5 (29200)", "llm", 60, False, T),
    ("m", "qualification", None, None, None, None, None), ("m", "qualification", "", "manual", 99, False, T), (None, "salary", "1", "manual", 9, False, T),
]


@pytest.mark.parametrize("hot", [100_000, 0])
def test_winners_on_either_path(spark, hot):
    rows = frame(spark, CANDIDATES)
    got = surviving_candidates(rows.unionByName(rows), hot_rows=hot)
    winners = {(r.job_id, r.field_name): r.winner for r in got.collect()}
    assert winners == {("j", "application_fee"): "100", ("k", "application_fee"): "250", ("l", "salary"): "5-29200", ("m", "qualification"): None}
    assert got.count() == len(CANDIDATES) - 1
    assert surviving_candidates(rows.limit(0), hot_rows=hot).count() == 0
    record = {r.job_id: r.application_fee for r in surviving_records(rows, hot_rows=hot).collect()}
    assert record["k"] == "250"


def test_paths_agree_on_tables(spark, folder):
    from patrika.sources.tables import read_table

    rows = read_table(spark, folder, "field_candidates")
    key = ["job_id", "field_name", "candidate_id", "fact", "winner", "ids"]
    a, b = (surviving_candidates(rows, hot_rows=n).select(*key) for n in (100_000, 0))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
