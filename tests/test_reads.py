import pytest

from larkspur.errors import LarkspurError, UnknownColumn, UnknownTable
from larkspur.operators.aggregate import AggRequest
from larkspur.operators.lookup import Lookup
from larkspur.operators.paging import decode_cursor, encode_cursor
from larkspur.plans import filters as f
from larkspur.repository import Repository
from larkspur.sources.store import MemoryStore
from larkspur.sources.tables import TableDef
from larkspur.sources.workspace import Workspace
from tests.fixtures import PEOPLE, user, workspace


@pytest.fixture(scope="module")
def people(spark):
    return Repository(workspace(spark, users=PEOPLE), "users")


def test_single_rows(people):
    assert people.get_by_id("u1")["name"] == "Alice" and people.get_by_id("zz") is None
    assert people.get_by_id("u1", scope={"role": "reader"}) is None
    assert people.get_one(f.like("name", "a%"))["id"] == "u1"
    assert people.get_one(sort="-age")["id"] == "u3"
    assert people.get_by_slug("Bob", "name")["id"] == "u2"
    with pytest.raises(UnknownColumn):
        people.get_by_slug("x")
    ids = [r.id for r in people.find_all(f.and_(f.gt("age", 28), f.not_(f.eq("role", "admin"))), sort="id").collect()]
    assert ids == ["u3", "u4"]
    assert people.count() == 4 and people.exists({"role": "admin"}) and not people.exists({"role": "x"})
    assert sorted(people.distinct("role")) == ["admin", "editor", "reader"]


def test_offset_pages(spark):
    r = Repository(workspace(spark, users=[user(f"u{i:02}") for i in range(25)]), "users")
    p = r.get_all(page=3, limit=10)
    assert (p.total, p.pages, p.has_next, p.has_prev) == (25, 3, False, True)
    assert [x["id"] for x in p.rows()] == [f"u{i}" for i in range(20, 25)]
    assert r.get_all(limit=5000).limit == 1000 and r.get_all().limit == 20 and r.get_all(page=-3).page == 1
    p = r.get_all(page=2, limit=10, count="none")
    assert (p.total, p.pages, p.has_next) == (0, 0, True) and len(p.rows()) == 10
    assert r.get_all({"role": "admin"}).pages == 0


def test_keyset_walk_has_no_gaps(spark):
    rows = [user(f"u{i:02}", age=[None, 1, 2][i % 3], role=["reader", "admin"][i % 2]) for i in range(13)]
    r = Repository(workspace(spark, users=rows), "users")
    for sort in ("id", "-id", "age,-role", "-age", "role"):
        walked = [x["id"] for page in r.stream(sort=sort, limit=5) for x in page.rows()]
        assert walked == [x["id"] for x in r.get_all(sort=sort, limit=100).rows()], sort
        assert len(walked) == 13


def test_cursors():
    assert decode_cursor(encode_cursor([1, None, "é"]), 3) == [1, None, "é"]
    for bad, n in (("!!", 1), (encode_cursor([1]), 2), (encode_cursor([1], version=0), 1), ("e30", 1)):
        with pytest.raises(LarkspurError):
            decode_cursor(bad, n)


def test_aggregation(spark):
    rows = [user("a", role="admin", age=30), user("b", role="admin", age=40), *(user(f"r{a}", age=a) for a in (25, 35, 45))]
    r = Repository(workspace(spark, users=rows), "users")
    req = dict(measures={"n": {"op": "count"}, "mean": {"op": "avg", "field": "age"}}, group_by="role", sort="role")
    assert [tuple(x) for x in r.aggregate(req).collect()] == [("admin", 2, 35.0), ("reader", 3, 35.0)]
    assert [tuple(x)[:2] for x in r.aggregate(req | {"filter": f.gt("age", 30)}).collect()] == [("admin", 1), ("reader", 2)]
    assert [x.role for x in r.aggregate(req | {"having": f.gt("n", 2)}).collect()] == ["reader"]
    assert r.aggregate({"measures": {"s": ("sum", "age"), "n": "count"}, "filter": f.FALSE}).collect() == [(None, 0)]
    for bad in ({"measures": {}}, {"measures": {"x": ("sum", "nope")}}, {"measures": {"x": ("median", "age")}}, {"measures": {"role": "count"}, "group_by": "role"}):
        with pytest.raises(LarkspurError):
            r.aggregate(bad)
    with pytest.raises(LarkspurError):
        r.aggregate(req | {"having": f.like("n", "1%")})


def test_aggregate_pages(spark):
    rows = [user(f"{r}{i}", name=r) for i, r in enumerate("aabbcdee")]
    r = Repository(workspace(spark, users=rows[:7]), "users")
    p = r.aggregate_paginate(AggRequest({"n": "count"}, "name"), page=2, limit=2)
    assert (p.total, p.pages) == (5, 3) and [x["name"] for x in p.rows()] == ["c", "d"]
    p = r.aggregate_paginate(AggRequest({"n": "count"}, "name", having=f.gt("n", 1)), limit=1)
    assert (p.total, p.pages, p.has_next) == (2, 2, True)
    p = r.aggregate_paginate(AggRequest({"n": "count"}, filter=f.FALSE))
    assert (p.total, p.pages) == (0, 1) and p.rows() == [{"n": 0}]


@pytest.fixture(scope="module")
def staff(spark):
    return workspace(
        spark,
        departments=[{"id": "d1", "name": "Eng"}, {"id": "d2", "name": "Ops"}, {"id": "d3", "name": "Old", "active": False}],
        employees=[{"id": f"e{i}", "name": f"E{i}", "departmentId": d} for i, d in enumerate(["d1", "d1", "d2", "d3", None], 1)],
        tasks=[{"id": f"t{i}", "employeeId": e, "title": f"T{i}", "status": s} for i, (e, s) in enumerate([("e1", "open"), ("e1", "done"), ("e1", "open"), ("e2", "open"), ("e4", "done"), ("e4", "open")])],
    )


def test_lookups(staff):
    r = Repository(staff, "employees")
    p = r.lookup_populate([Lookup("departments", "departmentId", "id", "dept", single=True), Lookup("tasks", "id", "employeeId", select=["id"])])
    rows = {x["id"]: x for x in p.rows()}
    assert p.total == 5 and rows["e1"]["dept"]["name"] == "Eng" and rows["e5"]["dept"] is None
    assert [len(rows[f"e{i}"]["tasks"]) for i in range(1, 6)] == [3, 1, 0, 2, 0]
    p = r.lookup_populate([{"from": "departments", "localField": "departmentId", "foreignField": "id", "single": True, "where": {"active": True}}], sort="-id", limit=2, page=1, select=["name"])
    assert [(x["name"], x["departments"]) for x in p.rows()] == [("E5", None), ("E4", None)] and p.pages == 3
    p = r.lookup_populate([Lookup("tasks", "id", "employeeId", "open", where={"status": "open"}), Lookup("tasks", "id", "employeeId", "done", where={"status": "done"})])
    assert {x["id"]: (len(x["open"]), len(x["done"])) for x in p.rows()}["e1"] == (2, 1)


def test_lookup_first_match_and_fan_out(staff):
    r = Repository(staff, "employees")
    one = r.lookup_frame([Lookup("tasks", "id", "employeeId", "t", single=True, select=["id"])])
    assert one.count() == 5 and {x.id: x.t and x.t.id for x in one.collect()}["e1"] == "t0"
    assert r.lookup_frame([Lookup("tasks", "id", "employeeId", "t", single=True, strict=False)]).count() == 8


def test_lookup_refusals(staff):
    r = Repository(staff, "employees")
    ok = Lookup("departments", "departmentId", "id")
    for bad in ([], [ok, ok], [{"localField": "a"}], [Lookup("departments", "x", "id")], [Lookup("departments", "departmentId", "x")], [Lookup("departments", "departmentId", "id", select={"name": 0})], [ok] * 11):
        with pytest.raises(LarkspurError):
            r.lookup_populate(bad).rows()
    with pytest.raises(UnknownTable):
        r.lookup_populate([Lookup("nowhere", "id", "id")])


def test_a_page_s_keys_reach_the_related_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id", "id % 7 AS d").write.parquet(str(tmp_path / "f"))
    spark.range(50).selectExpr("id", "concat('d', id) AS name").write.parquet(str(tmp_path / "d"))
    ws = Workspace(spark, MemoryStore(spark, {n: spark.read.parquet(str(tmp_path / n)) for n in "fd"}))
    ws.tables |= {n: TableDef.of(n, ws.frame(n), "id") for n in "fd"}
    p = Repository(ws, "f").lookup_populate([Lookup("d", "d", "id", "dept", single=True)], sort="-id", limit=2)
    assert [(x["id"], x["dept"]["name"]) for x in p.rows()] == [(999, "d5"), (998, "d4")] and p.total == 1000
    plan = p.docs._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id, [4,5]), IsNotNull(id)]" in plan or "In(id, [4,5])" in plan
    assert "HashAggregate" not in plan  # the key is declared unique


def test_prepared_and_explain(people):
    q = people.prepared("old", "SELECT id FROM {table} WHERE age > :least ORDER BY id")
    assert [x.id for x in q.execute(least=30).collect()] == ["u3", "u4"]
    assert people.prepared("f", lambda df, n: df.limit(n)).execute(n=2).count() == 2
    for name, build in (("", "SELECT 1"), ("x", ""), ("x", 3)):
        with pytest.raises(LarkspurError):
            people.prepared(name, build)
    rows = people.explain(f.eq("id", "u1"))
    assert rows and {*rows[0]} == {"id", "parent", "notused", "detail"}
