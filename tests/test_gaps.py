import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrerium.operators import gaps

ROWS = [("SysGap", "a", 10.0), ("SysGap", "b", 40.0), ("SysVal", "c", 10.0), ("SysVal", "d", 20.0), ("SysVal", "e", 40.0), ("One", "f", 5.0), (None, "g", 3.0), ("SysGap", "h", None), ("SysGap", "i", -1.0)]


@pytest.fixture
def catalog(spark):
    return spark.createDataFrame(ROWS, "hostname string, pl_name string, pl_orbper double")


def test_one_gap_one_candidate(catalog):
    found = gaps.candidate_gaps(catalog).collect()
    assert [(r.hostname, r.gap_ratio) for r in found] == [("SysGap", 4.0)]
    cand = gaps.expand(gaps.candidate_gaps(catalog)).collect()
    assert len(cand) == 1 and cand[0].candidate_period_days == pytest.approx(20.0) and cand[0].candidate_position_method == "geometric_interpolation"


def test_hidden_member_is_found(catalog):
    got = gaps.leave_one_out(catalog).collect()
    assert len(got) == 1 and got[0].removed_planet == "d" and got[0].abs_logP_error < 0.1 and got[0].within_0p1_dex
    assert gaps.recall(gaps.leave_one_out(catalog)).first().n_holdouts == 1


def test_gap_score_is_the_share_of_gaps_no_wider(catalog):
    assert gaps.candidate_gaps(catalog).first().gap_score == pytest.approx(1.0)


def test_neighbours_are_strict(spark, catalog):
    cand = spark.createDataFrame([("SysVal", 20.0, "x"), ("SysVal", 5.0, "y"), ("SysVal", 50.0, "z"), ("Gone", 1.0, "w")], "hostname string, candidate_period_days double, candidate_id string")
    got = {r.candidate_id: (r.inner_period, r.outer_period) for r in gaps.nearest_neighbours(cand, catalog).collect()}
    assert got == {"x": (10.0, 40.0), "y": (None, 10.0), "z": (40.0, None), "w": (None, None)}


def test_empty_catalogue(spark):
    empty = spark.createDataFrame([], "hostname string, pl_name string, pl_orbper double")
    assert gaps.expand(gaps.candidate_gaps(empty)).count() == 0


def test_priority_classes(spark):
    rows = spark.createDataFrame([("a", 1.0, 1.0, 1.0, 1.0, 1.0, "long_period", 5.0), ("b", 1.0, 0.0, 1.0, 0.0, 1.0, "unknown", 5.0), ("c", None, None, None, None, None, None, None)], "candidate_id string, gap_score double, topology_score double, analog_support_score double, missing_detectability_score double, data_quality_score double, likely_missing_due_to string, gap_period_ratio double")
    got = {r.candidate_id: (round(r.candidate_priority_score, 6), r.candidate_priority_class) for r in gaps.priority(rows).collect()}
    assert got == {"a": (1.0, "high"), "b": (0.6, "medium"), "c": (0.0, "low")}
    assert math.isclose(sum(gaps.WEIGHTS.values()), 1.0) and F is not None


def test_medians_of_gaps_are_exact_and_held_by_no_task(spark):
    rng = np.random.default_rng(3)
    rows = [(m, b, float(x)) for m, b, x in zip(rng.choice(["Transit", "Mixed"], 500), rng.choice(["low", "high", None], 500), rng.normal(size=500).round(2), strict=True)]
    pairs = spark.createDataFrame([(str(m), None if b is None else str(b), x) for m, b, x in rows], "dominant_method_group string, stellar_mass_bin string, gap_log_width double")
    stats = gaps.statistics(pairs)
    plan = stats._jdf.queryExecution().toString()
    assert "median(" not in plan and "percentile(" not in plan
    got = {tuple(r)[:3]: tuple(r)[3:] for r in stats.collect()}
    want = {("global", None, None): [x for _, _, x in rows]}
    for m, b, x in rows:
        want.setdefault(("method_group", m, None), []).append(x)
    for m, b, x in rows:
        want.setdefault(("method_plus_mass_bin", m, b), []).append(x)
    assert got == {k: (pytest.approx(float(np.median(v)), abs=1e-12), len(v)) for k, v in want.items()}
    assert gaps.statistics(pairs.limit(0)).count() == 0
