import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.errors import DeclarationError, StateError
from tidemill.functions.natural import natural, natural_key
from tidemill.operators.selectors import PART, after_part, all_of, as_column, before_part, between, claimed, covers, matches, parts, same_part, select
from tidemill.sources.store import Shard, encode

value = st.text("ab019-", min_size=1, max_size=5)


def shard(**part):
    return Shard("d", encode(part), "", "f" * 16, ".parquet")


def test_natural_order_is_numeric():
    assert sorted(["10", "9", "2", "a10", "a9"], key=natural_key) == ["2", "9", "10", "a9", "a10"]


def test_column_order_agrees_with_driver(spark):
    values = ["10", "9", "02", "2", "a10", "a9", "-5", "-10", "7" * 45, "8" * 44]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r.v for r in df.orderBy(natural(F.col("v")), "v").collect()]
    assert got == sorted(values, key=lambda v: (natural_key(v), v))


@settings(max_examples=50, deadline=None)
@given(value, value, st.sampled_from(["lt", "le", "gt", "ge"]))
def test_range_rules_are_complete(a, b, op):
    opposite = {"lt": "ge", "le": "gt", "gt": "le", "ge": "lt"}[op]
    assert matches(a, {op: b}) != matches(a, {opposite: b})


def test_as_column_agrees_with_covers(spark):
    rows = [{"s": s, "t": t} for s in ("1", "9", "10", "x") for t in ("a", "b")]
    where = {"s": {"ge": "2", "lt": "x"}, "t": ["a"]}
    df = spark.createDataFrame([(r["s"], r["t"]) for r in rows], "s string, t string")
    got = {(r.s, r.t) for r in df.where(as_column(where, F.col)).collect()}
    assert got == {(r["s"], r["t"]) for r in rows if covers(where, r)}


def test_binding_and_where():
    assert same_part("d").bind(("a", "b")).where({"a": "1", "b": "2"}) == {"a": ["1"], "b": ["2"]}
    assert before_part("d").bind(("a",)).where({"a": "1"}) == {"a": {"lt": "1"}}
    two = before_part("d", key="a", inclusive=True).bind(("a", "b"))
    assert two.where({"a": "1", "b": "2"}) == {"a": {"le": "1"}, "b": ["2"]}
    assert before_part("d", key="a", preserve=()).bind(("a", "b")).where({"a": "1", "b": "2"}) == {"a": {"lt": "1"}}
    assert after_part("d").bind(("a",)).where({"a": "3"}) == {"a": {"gt": "3"}}
    assert between("d", key="a", ge="1", lt=PART).bind(("a",)).where({"a": "4"}) == {"a": {"ge": "1", "lt": "4"}}
    assert all_of("d").bind(()).where({}) == {}
    with pytest.raises(DeclarationError):
        before_part("d").bind(("a", "b"))
    with pytest.raises(DeclarationError):
        before_part("d", key="a", preserve=("c",)).bind(("a", "b"))
    with pytest.raises(DeclarationError):
        between("d", key="a")


def test_lists_are_claims_and_ranges_are_not():
    shards = [shard(s="1"), shard(s="10"), shard(s="9")]
    assert [x.part["s"] for x in select(shards, {})] == ["1", "9", "10"]
    assert select(shards, {"s": {"gt": "50"}}) == []
    with pytest.raises(StateError):
        select(shards, {"s": ["1", "2"]})
    assert select(shards, {"s": ["1", "2"]}, optional=True) == []
    assert claimed({"a": ["x", "y"], "b": ["1"]}, [{"a": "x", "b": "1"}]) == [("a", ["y"])]
    assert parts("d", s="1").where() == {"s": ["1"]}
