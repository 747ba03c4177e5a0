import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from daymart.functions import fixed_values as fixed
from daymart.operators import patterns
from daymart.plans import pattern_query
from tests.conftest import day


def runs(df, min_len=2):
    rows = patterns.rising_runs(df, "v", min_len).orderBy("country", "start_day").collect()
    return [(r.start_day.day, r.end_day.day, r.n_days, r.start_value, r.end_value, r.total_value) for r in rows]


def test_null_breaks_a_run_on_both_sides(make_series):
    df = make_series({"a": [1.0, 2.0, 3.0, None, 4.0, 5.0, 6.0]})
    assert runs(df) == [(2, 3, 2, 2.0, 3.0, 5.0), (6, 7, 2, 5.0, 6.0, 11.0)]


def test_equal_neighbours_are_no_rise(make_series):
    assert runs(make_series({"a": [1.0, 1.0, 2.0, 2.0, 3.0]}), 1) == [(3, 3, 1, 2.0, 2.0, 2.0), (5, 5, 1, 3.0, 3.0, 3.0)]


def test_missing_calendar_day_does_not_break_a_run(make_series):
    assert runs(make_series({"a": [1.0, 2.0, "skip", 3.0]})) == [(2, 4, 2, 2.0, 3.0, 5.0)]


def test_first_row_of_the_range_is_never_up(make_series):
    assert runs(make_series({"a": [5.0, 6.0, 7.0]}), 3) == []
    assert len(runs(make_series({"a": [5.0, 6.0, 7.0]}), 2)) == 1


def test_entities_do_not_mix(make_series):
    assert runs(make_series({"a": [1.0, 2.0], "b": [3.0, 4.0]}), 2) == []


def test_spikes(make_series):
    df = make_series({"a": [10.0, 15.0, 14.0, 0.0, 5.0, None, 9.0, 27.0]}, value="new_cases")
    rows = patterns.spike_days(df).orderBy("spike_day").collect()
    assert [(r.spike_day.day, r.prev_cases, r.spike_cases, r.pct_jump) for r in rows] == [
        (2, 10.0, 15.0, 50.0),
        (8, 9.0, 27.0, 200.0),
    ]


def test_dispatch_defaults_bounds_and_names(make_series):
    df = make_series({"a": [1.0, 2.0, 3.0, 4.0]}, value="new_cases")
    found = patterns.find_pattern(df, fixed.STREAKS)
    assert [r.streak_len for r in found.collect()] == [3]
    assert patterns.with_headings(found, fixed.STREAKS).columns == list(fixed.PATTERN_HEADINGS[fixed.STREAKS].values())
    with pytest.raises(ValueError):
        pattern_query.pattern_matches(df, fixed.STREAKS, min_len=1)
    with pytest.raises(ValueError):
        pattern_query.pattern_matches(df, fixed.SPIKES, multiplier=10.5)
    with pytest.raises(ValueError):
        patterns.find_pattern(df, "Unknown")


def test_tags_cover_exactly_the_runs(make_series):
    df = make_series({"a": [1.0, 2.0, 3.0, 1.0, 2.0]})
    rows = patterns.tag_runs(df, "v", 2).orderBy("d").collect()
    assert [r.span_start is not None for r in rows] == [False, True, True, False, False]
    assert rows[1].span_start == day("2024-01-02") and rows[1].span_end == day("2024-01-04")


def test_request_cuts_the_range_first_and_names_exactly(make_series, tmp_path):
    df = make_series({"a": [1.0, 2.0, 3.0, 4.0], "A": [1.0, 2.0, 3.0, 4.0]}, value="new_cases")
    assert pattern_query.pattern_matches(df, fixed.STREAKS, "2024-01-02", None, ["a"], 3).count() == 0
    matches = pattern_query.pattern_matches(df, fixed.STREAKS, "2024-01-01", "2024-01-04", ["a"], 3)
    assert [(r.country, r.streak_len) for r in matches.collect()] == [("a", 3)]
    overlay = pattern_query.pattern_overlay(df, fixed.STREAKS, entities=["a"])
    assert overlay.count() == 4 and overlay.where("span_start IS NOT NULL").count() == 3
    assert pattern_query.pattern_overlay(df, fixed.SPIKES, multiplier=2.0).where("spike_value IS NOT NULL").count() == 2
    pattern_query.write_matches(matches, fixed.STREAKS, str(tmp_path / "m"))
    assert df.sparkSession.read.option("header", True).csv(str(tmp_path / "m")).columns[0] == "Country"
    with pytest.raises(ValueError):
        pattern_query.pattern_overlay(df, fixed.SURGES, min_len=31)


values = st.lists(st.one_of(st.none(), st.integers(0, 3).map(float)), min_size=1, max_size=25)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(series=st.dictionaries(st.sampled_from("abc"), values, min_size=1), min_len=st.integers(1, 4))
def test_runs_are_the_maximal_ones(make_series, series, min_len):
    def expected(vs):
        up = [i > 0 and vs[i] is not None and vs[i - 1] is not None and vs[i] > vs[i - 1] for i in range(len(vs))]
        out, i = [], 0
        while i < len(vs):
            j = i
            while j < len(vs) and up[j]:
                j += 1
            if j - i >= min_len:
                out.append((i, j - 1, j - i))
            i = max(j, i + 1)
        return out

    got = patterns.rising_runs(make_series(series), "v", min_len).collect()
    start = datetime.date(2024, 1, 1)
    assert sorted((r.country, (r.start_day - start).days, (r.end_day - start).days, r.n_days) for r in got) == sorted(
        (name, *run) for name, vs in series.items() for run in expected(vs)
    )
