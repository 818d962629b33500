import random

import pytest

from larkspur.errors import ConflictError, ConstraintError, DuplicateKeyError, LarkspurError, ReadOnlyError
from larkspur.migrations import Migration, Migrator, create_index, drop_index, list_indexes, load_directory, reindex, split_statements, sql_migration
from larkspur.plans import filters as f
from larkspur.plans.compiler import Update
from larkspur.repository import Repository, is_duplicate_key_error, with_batch
from larkspur.sources.store import FileStore
from larkspur.sources.tables import TableDef
from larkspur.sources.workspace import Workspace
from tests.fixtures import PEOPLE, USERS, user, workspace


@pytest.fixture
def r(spark):
    return Repository(workspace(spark, users=PEOPLE, posts=[]), "users")


def ids(r):
    return sorted(x.id for x in r.df.select("id").collect())


def test_create(r):
    row = r.create({"id": "u9", "name": "Z", "email": "z@x"})
    assert row["role"] == "reader" and row["active"] is True and r.get_by_id("u9") == row
    assert r.create_many([]) == []
    for bad in ({"id": "u1", "name": "x", "email": "new"}, {"id": "n", "name": "x", "email": "u1@x"}):
        with pytest.raises(DuplicateKeyError) as e:
            r.create(bad)
        assert is_duplicate_key_error(e.value)
    for bad in ({"id": "n", "email": "q"}, {"id": "n", "name": "x", "email": "q", "role": "god"}):
        with pytest.raises(ConstraintError):
            r.create(bad)
    with pytest.raises(LarkspurError):
        r.create({"id": "n", "nope": 1})
    with pytest.raises(DuplicateKeyError):
        r.create_many([user("m1"), user("m1")])
    assert "m1" not in ids(r)


def test_autoincrement(r):
    posts = Repository(r.ws, "posts")
    assert [p["id"] for p in posts.create_many([{"slug": s, "title": "t", "body": "b"} for s in "ab"])] == [1, 2]
    assert posts.create({"slug": "c", "title": "t", "body": "b"})["id"] == 3


def test_upsert(r):
    assert r.upsert({"id": "u1", "name": "Al"})["name"] == "Al" and r.get_by_id("u1")["age"] == 30
    assert r.upsert(user("u8"))["id"] == "u8"
    with pytest.raises(DuplicateKeyError):
        r.upsert({"id": "u1"})


def test_update(r):
    assert r.update("u1", {"name": "Al", "id": "zz"})["id"] == "u1"
    assert r.update("nope", {"name": "x"}) is None and r.update("u1", {"id": "q"})["name"] == "Al"
    assert r.update("u1", {"name": "x"}, scope={"role": "reader"}) is None
    assert r.update_many({"role": "reader"}, Update(unset=["age"])) == {"acknowledged": True, "matched_count": 2, "modified_count": 2}
    assert r.increment("u3", "age", 5)["age"] == 5 and r.increment("u3", "age", 3)["age"] == 8 and r.increment("q", "age") is None
    for bad in (lambda: r.update_many({}, {"name": "x"}), lambda: r.update("u1", [{"$set": {}}]), lambda: r.increment("u1", "name"), lambda: r.update("u1", {"nope": 1})):
        with pytest.raises(LarkspurError):
            bad()
    with pytest.raises(ConstraintError):
        r.update("u1", {"name": None})
    with pytest.raises(DuplicateKeyError):
        r.update("u1", {"email": "u2@x"})


def test_null_predicates_match_nothing(r):
    r.update("u2", Update(unset=["age"]))
    assert r.delete_many(f.gt("age", 0))["deleted_count"] == 3
    assert ids(r) == ["u2"]


def test_find_one_and_update(r):
    assert r.find_one_and_update({"role": "reader"}, {"name": "claimed"}, sort="-age")["id"] == "u3"
    assert r.find_one_and_update({"role": "reader"}, {"name": "q"}, return_document="before")["name"] == "claimed"
    assert r.find_one_and_update({"role": "none"}, {"name": "q"}) is None
    new = r.find_one_and_update({"id": "n1", "email": "n1@x"}, Update({"name": "N"}, set_on_insert={"age": 1}), upsert=True)
    assert new["age"] == 1 and r.get_by_id("n1")["name"] == "N"
    with pytest.raises(LarkspurError):
        r.find_one_and_update({}, {"name": "q"})


def test_get_or_create(r):
    assert r.get_or_create({"id": "u1"}, {})["name"] == "Alice"
    assert r.get_or_create({"id": "g1"}, {"name": "G", "email": "g"})["id"] == "g1"


def test_delete(r):
    assert r.delete("u1")["success"] and not r.delete("u1")["success"]
    with pytest.raises(LarkspurError):
        r.delete_many({})
    assert r.delete_many(f.exists("deletedAt")) == {"acknowledged": True, "deleted_count": 1}


def test_bulk_write(r):
    out = r.bulk_write([{"insert_one": {"document": user("b1")}}, {"update_many": {"filter": f.exists("id"), "update": {"age": 1}}}, {"delete_one": {"filter": {"id": "u2"}}}])
    assert (out["inserted_count"], out["matched_count"], out["deleted_count"], out["inserted_ids"]) == (1, 5, 1, {0: "b1"})
    assert r.bulk_write([])["inserted_count"] == 0
    before = ids(r)
    with pytest.raises(DuplicateKeyError):
        r.bulk_write([{"delete_one": {"filter": {"id": "u3"}}}, {"insert_one": {"document": user("u1")}}])
    with pytest.raises(LarkspurError):
        r.bulk_write([{"delete_one": {"filter": {"id": "u3"}}}, {"what": {}}])
    assert ids(r) == before


def test_transactions(r):
    with pytest.raises(RuntimeError), r.transaction() as t:
        t.delete("u1")
        assert not t.exists({"id": "u1"})
        raise RuntimeError
    assert r.exists({"id": "u1"})
    with r.transaction():
        r.create(user("t1"))
        with pytest.raises(LarkspurError), r.transaction():
            pass
    assert r.exists({"id": "t1"})
    out = with_batch(r.ws, lambda b: (b.insert("users", user("t2")), b.delete("users", {"id": "u1"})))
    assert out[0]["id"] == "t2" and out[1]["deleted_count"] == 1
    with pytest.raises(LarkspurError):
        r.batch(lambda b: None)


def test_file_store(spark, tmp_path):
    root = f"file://{tmp_path}/db"
    r = Repository(workspace(spark, FileStore(spark, root), users=PEOPLE), "users")
    r.create(user("x1"))
    with pytest.raises(DuplicateKeyError), r.transaction():
        r.delete("u1")
        r.create(user("u2"))
    again = Repository(Workspace(spark, FileStore(spark, root), {"users": USERS}), "users")
    assert ids(again) == ["u1", "u2", "u3", "u4", "x1"]
    store = again.ws.store
    with pytest.raises(ConflictError):
        store.commit({"users": again.df}, store.version - 1)
    store.commit({"users": again.df}, store.version)
    assert store.compact()["removed"] >= 1 and again.count() == 5
    out = again.ws.backup(f"file://{tmp_path}/copy")
    assert out["files_copied"] >= 1 and spark.read.parquet(f"file://{tmp_path}/copy/users").count() == 5
    with pytest.raises(ReadOnlyError):
        Repository(Workspace(spark, store, {"users": USERS}, read_only=True), "users").delete("u1")


def test_statements(r):
    assert r.ws.get("SELECT count(*) AS n FROM {users} WHERE age > ?", [28])["n"] == 3
    assert r.ws.all("SELECT name FROM {users} WHERE id = :id", {"id": "u2"}).first().name == "Bob"


def test_indexes(r):
    create_index(r.ws, "users", ["name"], unique=True, where="`deletedAt` IS NULL", name="live_name")
    with pytest.raises(DuplicateKeyError):
        r.create(user("i1", "Alice"))
    r.create(user("i2", "Alice", deletedAt="2024"))
    with pytest.raises(DuplicateKeyError):
        create_index(r.ws, "users", ["role"], unique=True)
    create_index(r.ws, "users", ["age"])
    told = {i["name"]: i for i in list_indexes(r.ws, "users")}
    assert told["live_name"]["partial_where"] and told["auto_users_email"]["auto"] and not told["idx_users_age"]["unique"]
    assert reindex(r.ws, table="users") == ["users"] and r.count() == 5
    assert drop_index(r.ws, "live_name") and not drop_index(r.ws, "live_name")
    for bad in (lambda: create_index(r.ws, "users", []), lambda: create_index(r.ws, "users", ['a"b']), lambda: reindex(r.ws, table="a", index="b"), lambda: drop_index(r.ws, "q", if_exists=False)):
        with pytest.raises(LarkspurError):
            bad()


def test_migrations(r, tmp_path):
    ups = []
    ms = [Migration(f"{i:03}", lambda ws, i=i: ups.append(i), (lambda ws, i=i: ups.append(-i)) if i != 1 else None) for i in (1, 2, 3)]
    m = Migrator(r.ws, ms)
    assert m.latest() is None and m.up() == ["001", "002", "003"] and m.up() == [] and m.latest() == "003"
    assert [s["applied"] for s in m.status()] == [True] * 3
    assert m.down("001") == ["003", "002"] and ups[-2:] == [-3, -2]
    with pytest.raises(LarkspurError):
        m.down(None)
    broken = Migrator(r.ws, [*ms, Migration("004", lambda ws: (Repository(ws, "users").delete("u1"), 1 / 0))])
    with pytest.raises(ZeroDivisionError):
        broken.up()
    assert r.exists({"id": "u1"}) and broken.latest() == "003"
    assert split_statements("a; b 'x;y'; -- c;\n BEGIN p; q END; ") == ["a", "b 'x;y'", "BEGIN p; q END"]
    sql_migration("s", "SELECT 1; SELECT 2").up(r.ws)
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta/_journal.json").write_text('{"dialect": "spark", "entries": [{"idx": 1, "tag": "a"}, {"idx": 0, "tag": "b"}]}')
    for t in "ab":
        (tmp_path / f"{t}.sql").write_text("SELECT 1")
    assert [x.name for x in load_directory(str(tmp_path))] == ["b", "a"]
    with pytest.raises(LarkspurError):
        load_directory(str(tmp_path), dialect="other")


def test_layers_equal_a_store_in_memory(spark, tmp_path):
    rnd = random.Random(1)
    rows = [user(f"u{i}", f"n{i}", age=i) for i in range(30)]
    memory, files = (Repository(workspace(spark, store, users=rows), "users") for store in (None, FileStore(spark, f"file://{tmp_path}/db")))
    for step in range(8):
        kind, ages, new = rnd.choice(["insert", "update", "delete", "both"]), rnd.sample(range(30), 4), user(f"new{step}", age=rnd.randrange(30))
        for r in (memory, files):
            if kind == "insert":
                r.create(new)
            elif kind == "update":
                r.update_many(f.in_("age", ages), Update(set={"name": f"s{step}"}, inc={"age": 1}))
            elif kind == "delete":
                r.delete_many(f.in_("age", ages[:2]))
            else:
                with r.transaction():
                    r.create(new)
                    r.update(new["id"], {"name": "changed"})
                    r.delete_many(f.eq("age", ages[0]))
        same = [sorted(map(tuple, r.df.collect())) for r in (memory, files)]
        assert same[0] == same[1], (step, kind)
    assert files.ws.store.layers("users") > 2


def test_a_write_adds_a_layer_of_its_own_size(spark, tmp_path):
    r = Repository(workspace(spark, FileStore(spark, f"file://{tmp_path}/db"), users=[user(f"u{i}") for i in range(50)]), "users")
    base = {*(tmp_path / "db/tables/users").iterdir()}
    r.update("u3", {"name": "x"})
    new = {*(tmp_path / "db/tables/users").iterdir()} - base
    assert [spark.read.parquet(str(p)).count() for p in new] == [1, 1] and all(p.exists() for p in base)  # the row and its key
    assert r.get_by_id("u3")["name"] == "x" and r.count() == 50


def test_layers_need_a_unique_key_and_fold(spark, tmp_path, monkeypatch):
    from larkspur.sources import store

    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    ws = Workspace(spark, FileStore(spark, f"file://{tmp_path}/db"))
    r = Repository(ws, ws.register(TableDef.of("t", twice, "id"), twice))
    r.update_many({"v": "a"}, {"v": "x"})
    assert sorted(map(tuple, r.df.collect())) == [(1, "b"), (1, "x"), (2, "c")] and ws.store.layers("t") == 1
    monkeypatch.setattr(store, "MOST_LAYERS", 3)
    r = Repository(workspace(spark, FileStore(spark, f"file://{tmp_path}/more"), users=PEOPLE), "users")
    for i in range(5):
        r.create(user(f"x{i}"))
        r.update(f"x{i}", {"name": "y"})
    assert r.ws.store.layers("users") <= 3 and r.count({"name": "y"}) == 5 and r.count() == 9


def test_bulk_writes_by_key_are_folded(spark, monkeypatch):
    rnd = random.Random(2)
    some = [user(f"u{i}", f"n{i}") for i in range(8)]

    def ops():
        for i in range(25):
            key = f"u{rnd.randrange(10)}"
            yield rnd.choice([
                {"update_one": {"filter": {"id": key}, "update": {"name": f"a{i}"}}}, {"replace_one": {"filter": {"id": key}, "replacement": {"name": f"b{i}", "age": i}}},
                {"delete_one": {"filter": {"id": key}}}, {"update_one": {"filter": {"id": key}, "update": {"name": f"c{i}", "email": f"{i}@y"}, "upsert": True}}, {"insert_one": {"document": user(f"new{i}")}},
            ])

    todo = [*ops()]
    folded, single = (Repository(workspace(spark, users=some), "users") for _ in range(2))
    commits = folded.ws.store.version
    got = folded.bulk_write(todo)
    assert folded.ws.store.version == commits + 1
    monkeypatch.setattr(Repository, "_step", lambda self, i, op, old=Repository._step: (*old(self, i, op)[:3], None))
    want = single.bulk_write(todo)
    assert got == want and sorted(map(tuple, folded.df.collect())) == sorted(map(tuple, single.df.collect()))


def test_bulk_writes_keep_rows_of_equal_keys(spark):
    ws, df = Workspace(spark), spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "id int, v string")
    r = Repository(ws, ws.register(TableDef.of("t", df, "id"), df))
    assert r.bulk_write([{"update_one": {"filter": {"id": 1}, "update": {"v": "x"}}}])["matched_count"] == 1
    assert sorted(map(tuple, r.df.collect())) == [(1, "x"), (1, "x"), (2, "c")]


def test_plans_in_memory_are_cut(spark, monkeypatch):
    from larkspur.sources import store

    monkeypatch.setattr(store, "MOST_WRITES", 3)
    r = Repository(workspace(spark, users=PEOPLE), "users")
    for i in range(4):
        r.update("u1", {"age": i})
    assert r.df._jdf.queryExecution().logical().toString().count("CASE WHEN") < 30 and r.get_by_id("u1")["age"] == 3
