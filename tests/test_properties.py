"""Property checks on random frames: change feed round trip, upsert idempotence, split
completeness, and unique-key counts against a plain Python count (hot keys included)."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quarry.quality import engine
from quarry.quality.rules import NotNull, RunContext, UniqueKey, ValueRange
from quarry.sinks.merge import apply_changes, change_feed, merge_upsert

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
rows = st.dictionaries(st.integers(0, 30), st.one_of(st.none(), st.sampled_from(["a", "b", "c"])), max_size=25)


@SETTINGS
@given(old=rows, new=rows)
def test_change_feed_applies_back(spark, old, new):
    o = spark.createDataFrame(list(old.items()), "k int, v string")
    n = spark.createDataFrame(list(new.items()), "k int, v string")
    got = apply_changes(o, change_feed(o, n, ["k"]), ["k"])
    assert sorted(got.collect()) == sorted(n.collect())


@SETTINGS
@given(target=rows, source=rows)
def test_upsert_idempotent(spark, target, source):
    t = spark.createDataFrame(list(target.items()), "k int, v string")
    s = spark.createDataFrame(list(source.items()), "k int, v string")
    once = merge_upsert(t, s, ["k"])
    assert sorted(merge_upsert(once, s, ["k"]).collect()) == sorted(once.collect())
    want = dict(target)
    want.update(source)
    assert sorted(tuple(r) for r in once.collect()) == sorted(want.items())


@SETTINGS
@given(keys=st.lists(st.one_of(st.none(), st.integers(0, 5)), min_size=0, max_size=60),
       hot=st.integers(0, 40))
def test_unique_key_and_fused_rules_match_python(spark, keys, hot):
    data = [(k, float(i)) for i, k in enumerate(keys)] + [(99, None)] * hot   # one hot key
    df = spark.createDataFrame(data, "k int, v double")
    res = {r["rule_name"]: r for r in engine.evaluate(
        df, [UniqueKey("uk", ["k"]), NotNull("nn", column="v"), ValueRange("vr", "v", max=10)],
        RunContext(spark)).collect()}
    counts = Counter(k for k, _ in data)
    assert res["uk"]["affected_rows"] == sum(c - 1 for c in counts.values())
    assert res["nn"]["affected_rows"] == sum(1 for _, v in data if v is None)
    assert res["vr"]["affected_rows"] == sum(1 for _, v in data if v is not None and v > 10)
