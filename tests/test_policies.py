import pytest
from pyspark.sql import functions as F

from larkspur.crudschema import crud_schemas
from larkspur.errors import LarkspurError
from larkspur.functions import columns
from larkspur.functions.stemming import stem
from larkspur.operators import fulltext as ft
from larkspur.plans import filters as f
from larkspur.plugins import Audit, Cache, Compaction, Expiry, FullText, SoftDelete, Tenancy, Timestamps, Vectors
from larkspur.repository import Repository
from larkspur.sources.store import FileStore
from larkspur.sources.workspace import configure
from tests.fixtures import NOW, PEOPLE, POSTS, USERS, user, workspace


def ids(rows):
    return sorted(x["id"] for x in rows)


def test_tenancy(spark):
    who = {"t": "a"}
    rows = [user("u1", organizationId="a"), user("u2", organizationId="b"), user("u3")]
    r = Repository(workspace(spark, users=rows), "users", [Tenancy("organizationId", lambda c: who["t"])])
    assert ids(r.get_all().rows()) == ["u1"] and r.get_by_id("u2") is None and r.count() == 1 and r.distinct("id") == ["u1"]
    assert r.aggregate({"measures": {"n": "count"}}).first().n == 1
    assert r.create(user("n1", organizationId="evil"))["organizationId"] == "a"
    assert r.update("u2", {"name": "x"}) is None and not r.delete("u2")["success"] and r.increment("u2", "age") is None
    # A scoped filter is no empty filter: that deletes the tenant's rows alone.
    assert r.delete_many({})["deleted_count"] == 2 and sorted(x.id for x in r.df.collect()) == ["u2", "u3"]
    assert r.find_one_and_update({"id": "n2", "email": "e"}, {"name": "x"}, upsert=True)["organizationId"] == "a"
    who["t"] = None
    for bad in (r.count, lambda: r.create(user("n3", organizationId="z"))):
        with pytest.raises(LarkspurError):
            bad()
    r = Repository(r.ws, "users", [Tenancy("organizationId", lambda c: None, allow_data_injection=True, skip_when=lambda c: c.op == "count")])
    assert r.count() == 3 and r.create(user("n4", organizationId="z"))["organizationId"] == "z"
    with pytest.raises(LarkspurError):
        r.create_many([user("n5", organizationId="z"), user("n6")])


def test_soft_delete(spark):
    r = Repository(workspace(spark, users=PEOPLE), "users", [SoftDelete(), a := Audit()])
    assert ids(r.get_all().rows()) == ["u1", "u2", "u3"] and r.count(include_deleted=True) == 4
    out = r.delete("u1")
    assert out["soft"] and r.get_by_id("u1") is None and r.get_by_id("u1", include_deleted=True)["deletedAt"] == NOW
    assert [e["action"] for e in a.entries] == ["update", "delete"]
    assert r.restore("u1")["deletedAt"] is None and r.restore("zz") is None
    assert r.delete_many({"role": "reader"})["deleted_count"] == 1
    assert ids(r.get_deleted().rows()) == ["u3", "u4"]
    r.delete("u2", mode="hard")
    assert not r.exists({"id": "u2"}, include_deleted=True)
    with pytest.raises(LarkspurError):
        r.delete_many({})


def test_timestamps(spark):
    r = Repository(workspace(spark, users=[user("u1", createdAt="1")]), "users", [Timestamps()])
    made = r.create(user("u2"))
    assert made["createdAt"] == made["updatedAt"] == NOW and r.create(user("u3", createdAt="5"))["updatedAt"] == "5"
    assert r.update("u1", {"name": "x"})["updatedAt"] == NOW and r.get_by_id("u1")["createdAt"] == "1"


def test_expiry(spark):
    rows = [{"id": i, "userId": "u", "expiresAt": e} for i, e in (("live", "2025-01-01T00:00:00Z"), ("old", "2024-01-01T00:00:00Z"), ("older", "2023-01-01T00:00:00.5Z"), ("never", None), ("odd", "soon"))]
    r = Repository(workspace(spark, sessions=rows), "sessions", [Expiry()])
    assert ids(r.get_all().rows()) == ["live", "never", "odd"] and r.count(include_expired=True) == 5
    assert ids(r.get_expired().rows()) == ["old", "older"]
    assert r.sweep_expired() == 2 and ids(r.df.collect()) == ["live", "never", "odd"]
    r = Repository(workspace(spark, sessions=rows), "sessions", [Expiry(mode="trigger", seconds=10)])
    r.create({"id": "new", "userId": "u"})
    assert ids(r.df.collect()) == ["live", "never", "new", "odd"]
    with pytest.raises(LarkspurError):
        Expiry(mode="x")


def test_cache(spark):
    c = Cache()
    r = Repository(workspace(spark, users=PEOPLE), "users", [c])
    assert r.count() == r.count() == 4 and c.hits == 1
    assert r.get_all(limit=2).rows() == r.get_all(limit=2).rows() and c.hits == 2
    r.count(skip_cache=True)
    r.delete("u1")
    assert c.hits == 2 and r.count() == 3


def test_audit(spark):
    told = []
    r = Repository(workspace(spark, users=PEOPLE), "users", [Audit(told.append, lambda: "me", lambda: "org")])
    r.create(user("a1"))
    r.update("a1", {"name": "x"})
    r.update("zz", {"name": "x"})
    r.delete("a1")
    assert [(e["action"], e["document_id"], e["actor_id"]) for e in told] == [("create", "a1", "me"), ("update", "a1", "me"), ("delete", "a1", "me")]
    assert r.audit_frame().count() == 3 and "after" not in told[2]
    few = Audit(most=2)
    r = Repository(workspace(spark, users=PEOPLE), "users", [few])
    for i in range(5):
        r.update("u1", {"age": i})
    assert r.audit_frame().count() == 5 and len(few.entries) <= 2


def test_compaction(spark, tmp_path):
    events = []
    r = Repository(workspace(spark, FileStore(spark, f"file://{tmp_path}/db"), users=PEOPLE), "users", [Compaction(on_event=events.append)])
    r.create(user("c1"))
    r.vacuum(1)
    assert [e["event"] for e in events] == ["started", "completed"] and events[0]["mode"] == "manual"
    assert r.ws.store.size("users")[0] <= 3 and r.count() == 5


def posts(spark, *texts, **more):
    return Repository(workspace(spark, posts=[{"id": i, "slug": s, "title": t, "body": b} for i, (s, t, b) in enumerate(texts, 1)]), "posts", **more)


def test_full_text(spark):
    r = posts(spark, ("cd", "cats and dogs", "pets"), ("co", "cats only", "felines are Càts"), ("do", "dogs only", "canines"), plugins=[FullText(["title", "body"])])
    find = lambda q: sorted(x.slug for x in r.search(q).collect())
    assert find("cats AND dogs") == find("cats dogs") == ["cd"]
    assert find("cats NOT dogs") == ["co"] and find("felines OR canines") == ["co", "do"]
    assert find("title:cats") == ["cd", "co"] and find('"cats and dogs"') == ["cd"] and find('"dogs cats"') == []
    assert find("cat*") == ["cd", "co"] and find("(cats OR dogs) NOT only") == ["cd"] and find("CATS") == ["cd", "co"]
    assert r.search("only", limit=1, offset=1).count() == 1
    for bad in ("", "AND", "(a", "a OR", "nope:x"):
        with pytest.raises(LarkspurError):
            r.search(bad)
    r.create_search_index()
    r.delete(1)
    assert find("cats") == ["co"]
    assert [x["id"] for x in r.get_all(search="cats").rows()] == [2]


def test_the_stored_index_follows_writes(spark, tmp_path):
    texts = [("a", "one", "red fish"), ("b", "two", "blue fish"), ("c", "three", "a red, red rose")]
    for store in (None, FileStore(spark, f"file://{tmp_path}/db")):
        rows = [{"id": i, "slug": s, "title": t, "body": b} for i, (s, t, b) in enumerate(texts, 1)]
        r = Repository(workspace(spark, store, posts=rows), "posts", [FullText(["title", "body"], prefix=(2,))])
        r.create_search_index()
        find = lambda q: sorted(x.slug for x in r.search(q).collect())  # noqa: B023, E731
        assert find("red") == ["a", "c"]
        r.create({"slug": "d", "title": "red", "body": "new"})
        r.update(2, {"body": "blue and red"})
        r.delete(1)
        assert find("red") == ["b", "c", "d"] and find("fish") == [] and find('"red rose"') == ["c"] and find("re* NOT three") == ["b", "d"]
        with r.transaction():
            r.update_many({"slug": "d"}, {"title": "green"})
            assert find("green") == ["d"]
        r.bulk_write([{"update_one": {"filter": {"id": 3}, "update": {"body": "white"}}}, {"insert_one": {"document": {"id": 50, "slug": "e", "title": "t", "body": "red red red"}}}])
        assert find("red") == ["b", "e"] and find("white OR green") == ["c", "d"]
        stored = {x.id: round(x.rank, 9) for x in r.search_hits("red OR blue").collect()}
        r.drop_search_index()
        plain = Repository(r.ws, "posts", [FullText(["title", "body"])])
        assert stored == {x.id: round(x.rank, 9) for x in plain.search_hits("red OR blue").collect()}


def test_patterns_count_as_tokens_do(spark):
    texts = ["a a a", "A-a_a1 a", "Cafe\u0301s cafe\u0301 CAFÉ", "\u0301a e\u0301e", "x2y x 2y", "", "ab.ab ab,  ab!", "ÀÈ àè ae", "İstanbul istanbul"]
    df = spark.createDataFrame([*enumerate(texts)], "id int, body string")
    words = [("a",), ("a", "a"), ("cafe",), ("ab", "ab"), ("ee",), ("x",), ("istanbul",), ("ae", "ae")]
    for w in words:
        for prefix in (False, True):
            by_pattern = F.regexp_count(F.lower("body"), F.lit(ft._pattern([*w], prefix)))
            by_token = ft._frequency([*w], prefix, columns.tokens(F.col("body")))
            got = df.select("id", by_pattern.alias("p"), by_token.alias("t"), F.regexp_count(F.lower("body"), F.lit(ft._WORD)).alias("n"), F.size(columns.tokens(F.col("body"))).alias("m")).collect()
            assert all(r.p == r.t and r.n == r.m for r in got), (w, prefix, got)


def test_full_text_ranks(spark):
    r = posts(spark, ("a", "one", "a cat sat"), ("b", "two", " ".join(["cat"] * 7)), ("c", "three", "my cat and me and them"), ("d", "x", "y"), ("e", "x", "z"), ("f", "x", "z"), ("g", "x", "z"), plugins=[FullText(["title", "body"])])
    assert [x.slug for x in r.search("cat").collect()][0] == "b" and r.search("cat").count() == 3
    t = posts(spark, ("a", "t", "hello"), ("b", "t", "world"), plugins=[FullText(["body"], "trigram")])
    assert [x.slug for x in t.search("ell").collect()] == ["a"]


def test_porter(spark):
    words = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "hopefulness": "hope", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "rate": "rate", "sky": "sky", "oscillators": "oscil", "generalizations": "gener"}
    assert {w: stem(w) for w in words} == words
    r = posts(spark, ("a", "t", "Running relations"), ("b", "t", "a cat"), plugins=[FullText(["body"], "porter", prefix=(2, 3))])
    assert [x.slug for x in r.search("relational runs").collect()] == ["a"]
    for bad in (lambda: FullText(["a"], prefix=(0,)), lambda: FullText([]), lambda: FullText(["a;b"]), lambda: FullText(["a"], "x")):
        with pytest.raises(LarkspurError):
            bad()


def test_vectors(spark):
    r = posts(spark, *[(s, s, s) for s in "abc"], plugins=[Vectors(4)])
    r.upsert_embeddings([(1, [1, 0, 0, 0]), (2, [0, 1, 0, 0]), (3, [1, 0.1, 0, 0])])
    hits = r.similarity_search([1, 0, 0, 0], k=2)
    assert [h["doc"]["slug"] for h in hits] == ["a", "c"] and hits[0]["distance"] < hits[1]["distance"]
    r.upsert_embedding(2, [-1, 0, 0, 0])
    assert abs(r.similarity_search([1, 0, 0, 0])[-1]["distance"] - 2) < 1e-9
    r.delete_embedding(1)
    r.delete_embedding(99)
    assert [h["rowid"] for h in r.similarity_search([1, 0, 0, 0])] == [3, 2]
    for bad in (lambda: r.upsert_embedding("x", [1] * 4), lambda: r.upsert_embedding(1, [1]), lambda: r.similarity_search([1]), lambda: Vectors(0), lambda: Vectors(4, "cos"), lambda: Vectors(4, store="a;b")):
        with pytest.raises(LarkspurError):
            bad()


def test_hooks(spark):
    r = Repository(workspace(spark, users=PEOPLE), "users")
    seen = []
    r.hooks.on("before:count", lambda c: seen.append("late"))
    r.hooks.on("before:count", lambda c: (seen.append("early"), c.narrow(f.eq("id", "u1"))), priority=1)
    r.hooks.on("error:get_all", lambda c, e: seen.append(type(e).__name__))
    assert r.count() == 1 and seen == ["early", "late"]
    with pytest.raises(LarkspurError):
        r.get_all(f.eq("nope", 1))
    assert seen[-1] == "UnknownColumn"


def test_crud_schemas(spark):
    s = crud_schemas(USERS, {"field_rules": {"organizationId": {"immutable": True}, "deletedAt": {"system_managed": True}, "name": {"optional": True}}, "strict": True, "update": {"require_at_least_one": True}, "query": {"filterable": {"role": {"type": "string", "enum": ["a"]}, "age": True}}})
    make, change = s["create_body"], s["update_body"]
    assert make["required"] == ["id", "email"] and make["properties"]["role"]["enum"] == ["reader", "admin", "editor"] and make["additionalProperties"] is False
    assert "deletedAt" not in make["properties"] and "organizationId" in make["properties"] and "organizationId" not in change["properties"]
    assert "required" not in change and change["minProperties"] == 1
    assert s["params"]["properties"]["id"] == {"type": "string"} and s["list_query"]["properties"]["age"] == {"type": "string"}
    p = crud_schemas(POSTS, {"create": {"omit_fields": ["body"], "required": ["slug"], "overrides": {"slug": {"type": "string", "format": "x"}}}})
    assert "id" not in p["create_body"]["properties"] and p["params"]["properties"]["id"]["pattern"] == r"^-?\d+$"
    assert p["create_body"]["properties"]["slug"]["format"] == "x" and "body" not in p["create_body"]["properties"]


def test_presets(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    configure(spark, "test")
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and before == "4"
