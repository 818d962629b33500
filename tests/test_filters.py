import datetime as dt

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.errors import LarkspurError, UnknownColumn
from larkspur.functions.columns import bound_sql, like_pattern
from larkspur.plans import filters as f
from larkspur.plans.compiler import where
from larkspur.urlquery import parse_url

ROWS = [(1, "Abc", 10, 1.5), (2, "a%c", None, -2.0), (3, None, 30, None), (4, "a\\b", 40, 0.0), (5, "ABd", 10, 7.25), (6, "", -5, 1.5)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "id int, s string, n long, d double").cache()


def ids(df, flt):
    return sorted(r[0] for r in where(df, flt).select("id").collect())


def test_simplification():
    assert f.and_() == f.TRUE and f.and_(f.TRUE, f.TRUE) == f.TRUE
    assert f.or_() == f.FALSE and f.or_(f.eq("a", 1), f.TRUE) == f.TRUE
    assert f.not_(f.TRUE) == f.FALSE
    assert f.and_(f.TRUE, f.eq("a", 1)) == f.eq("a", 1)
    assert f.as_filter({}) == f.TRUE and f.is_true(f.as_filter(None))
    assert f.merge({"a": 1}, None) == f.eq("a", 1)
    assert f.eq("a", 1) & f.eq("b", 2) == f.And((f.eq("a", 1), f.eq("b", 2)))


@pytest.mark.parametrize(
    ("flt", "want"),
    [
        (f.TRUE, [1, 2, 3, 4, 5, 6]), (f.FALSE, []), (f.eq("n", 10), [1, 5]), (f.eq("n", None), [2]), (f.ne("n", None), [1, 3, 4, 5, 6]), (f.ne("n", 10), [3, 4, 6]),
        (f.gt("n", "10"), [3, 4]), (f.in_("n", []), []), (f.nin("n", []), [1, 2, 3, 4, 5, 6]), (f.nin("n", [10]), [3, 4, 6]), (f.exists("s"), [1, 2, 4, 5, 6]), (f.is_null("s"), [3]),
        (f.like("s", "ab%"), [1, 5]), (f.like("s", "ab%", True), []), (f.like("s", "AB%", True), [5]), (f.contains("s", "%"), [2]), (f.contains("s", "\\"), [4]), (f.like("s", "a\\b"), [4]),
        (f.not_(f.gt("n", 20)), [1, 5, 6]), (f.raw("n + ? > ?", [5, 20]), [3, 4]), (f.raw("s = ? OR s = '?'", ["a%c"]), [2]), ({"s": "Abc", "n": 10}, [1]), (f.eq("d", 1.5), [1, 6]),
        (f.eq("n", 10.5), []), (f.lt("n", 2**70), [1, 3, 4, 5, 6]),
    ],
)
def test_nodes(df, flt, want):
    assert ids(df, flt) == want


def test_refusals(df):
    with pytest.raises(UnknownColumn):
        where(df, f.eq("nope", 1))
    with pytest.raises(LarkspurError):
        where(df, f.regex("s", "a.*"))
    assert ids(df, f.regex("s", "^a.*", allowed=True)) == [2, 4]
    with pytest.raises(LarkspurError):
        where(df, f.eq("n", "many"))
    for params in ([], [1, 2]):
        with pytest.raises(LarkspurError):
            bound_sql("a = ?", tuple(params))


def test_raw_strings_cannot_escape(df):
    assert ids(df, f.raw("s = ?", ["' OR 1=1 --"])) == []
    assert like_pattern("a\\x%\\%") == "a\\\\x%\\%"


def test_dates(spark):
    t = spark.sql("SELECT 1 AS id, timestamp_ntz'2024-01-02 03:04:05' AS at, date'2024-01-02' AS day")
    assert ids(t, f.eq("at", dt.datetime(2024, 1, 2, 3, 4, 5))) == [1]
    assert ids(t, f.gte("at", "2024-01-02")) == [1] and ids(t, f.lt("day", dt.date(2024, 1, 2))) == []


def test_pushdown(spark, tmp_path):
    spark.range(10).select("id", (F.col("id") * 2).alias("n")).write.parquet(str(tmp_path / "t"))
    plan = where(spark.read.parquet(str(tmp_path / "t")), f.gt("n", 5)).select("id")._jdf.queryExecution().toString()
    assert "GreaterThan(n,5)" in plan and "ReadSchema: struct<id:bigint,n:bigint>" in plan


def test_url():
    q = parse_url("https://h/p?age[gte]=18&role[in]=a,b&name[contains]=x&flag=true&sort=-age&page=2&limit=5&select=a,b&populate=d&search=t&after=c")
    assert q.filter == f.And((f.gte("age", "18"), f.in_("role", ["a", "b"]), f.contains("name", "x"), f.eq("flag", "true")))
    assert (q.sort, q.page, q.limit, q.select, q.populate, q.search, q.after) == ("-age", 2, 5, ["a", "b"], ["d"], "t", "c")
    for bad in ("a[what]=1", "page=x"):
        with pytest.raises(LarkspurError):
            parse_url(bad)


_leaf = st.one_of(
    st.tuples(st.sampled_from(["eq", "ne", "gt", "gte", "lt", "lte"]), st.just("n"), st.one_of(st.integers(-6, 41), st.none())).filter(lambda x: x[2] is not None or x[0] in ("eq", "ne")),
    st.tuples(st.sampled_from(["in_", "nin"]), st.just("n"), st.lists(st.integers(-6, 41), max_size=3)),
    st.tuples(st.just("exists"), st.sampled_from(["s", "n", "d"]), st.booleans()),
    st.tuples(st.just("gt"), st.just("d"), st.floats(-3, 8)),
)
_tree = st.recursive(_leaf, lambda t: st.one_of(st.tuples(st.just("and_"), st.lists(t, max_size=3)), st.tuples(st.just("or_"), st.lists(t, max_size=3)), st.tuples(st.just("not_"), t)), max_leaves=6)


def _node(t):
    if t[0] in ("and_", "or_"):
        return getattr(f, t[0])(*map(_node, t[1]))
    return f.not_(_node(t[1])) if t[0] == "not_" else getattr(f, t[0])(*t[1:])


def _as_sql(t):
    op = t[0]
    if op in ("and_", "or_"):
        return "(" + (" AND " if op == "and_" else " OR ").join(map(_as_sql, t[1])) + ")" if t[1] else ("true" if op == "and_" else "false")
    if op == "not_":
        return f"(NOT {_as_sql(t[1])})"
    if op == "exists":
        return f"({t[1]} IS {'NOT ' if t[2] else ''}NULL)"
    if op in ("in_", "nin"):
        return f"({t[1]} {'NOT ' if op == 'nin' else ''}IN ({', '.join(map(str, t[2]))}))" if t[2] else str(op == "nin").lower()
    if t[2] is None:
        return f"({t[1]} IS {'NOT ' if op == 'ne' else ''}NULL)"
    return f"({t[1]} {dict(eq='=', ne='<>', gt='>', gte='>=', lt='<', lte='<=')[op]} {t[2]!r}::DOUBLE)"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(tree=_tree)
def test_random_trees_agree_with_sql(df, tree):
    c = duckdb.connect()
    c.execute("CREATE TABLE t (id INT, s VARCHAR, n BIGINT, d DOUBLE)")
    c.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", ROWS)
    assert ids(df, _node(tree)) == [r[0] for r in c.execute(f"SELECT id FROM t WHERE {_as_sql(tree)} ORDER BY id").fetchall()]
