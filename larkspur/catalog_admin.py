"""More registered queries: refusals, schemas, indexes, migrations, stores, plugins and search by index."""

from __future__ import annotations

import json
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur import migrations as mig
from larkspur.catalog import _MARKED, NOW, _frame, _marked_repo, _nation, _probe_vector, _tokens_sql, _vector_repo, _written, query, repo, workspace
from larkspur.crudschema import crud_schemas
from larkspur.errors import LarkspurError
from larkspur.operators.aggregate import AggRequest
from larkspur.operators.lookup import Lookup
from larkspur.plans import filters as f
from larkspur.plugins import Cache, Compaction, Expiry, FullText, SoftDelete, Tenancy, Timestamps, Vectors
from larkspur.repository import Repository, is_duplicate_key_error
from larkspur.sources.shared import shared_folder
from larkspur.sources.store import FileStore
from larkspur.sources.tables import ColumnDef, TableDef
from larkspur.sources.workspace import Workspace, configure


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/larkspur/catalog-{uuid.uuid4().hex}"


def _stored(spark, sf_dir, *names: str) -> Workspace:
    """A workspace over a store of files, with tables of the data folder."""
    ws, data = Workspace(spark, FileStore(spark, _folder(spark)), clock=lambda: NOW), workspace(spark, sf_dir, *names)
    for n in names:
        ws.register(data.tables[n], data.frame(n))
    return ws


PEOPLE = TableDef("people", {"id": ColumnDef(T.LongType(), False), "name": ColumnDef(T.StringType(), False), "role": ColumnDef(T.StringType(), False, "reader", enum=("reader", "admin")), "note": ColumnDef(T.StringType())}, "id", unique=(("name",),), autoincrement=True)


def _people(spark) -> Repository:
    ws = Workspace(spark, clock=lambda: NOW)
    ws.register(PEOPLE, PEOPLE.frame(spark, [PEOPLE.complete({"id": 1, "name": "ann", "role": "admin"}), PEOPLE.complete({"id": 2, "name": "bob"})]))
    return Repository(ws, "people")


# ---------------------------------------------------------------- refusals


def _cases(spark, sf_dir) -> dict:
    r, p, base = repo(spark, sf_dir, "nation", "region"), _people(spark), spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(1)
    vectors = Repository(workspace(spark, sf_dir, items=base.select("vec_id", "label")), "items", [Vectors(4)])
    read_only = Workspace(spark, r.ws.store, dict(r.ws.tables), read_only=True)

    def nested():
        with r.ws.transaction(), r.ws.transaction():
            pass

    region = lambda **more: Lookup("region", "n_regionkey", "r_regionkey", **more)
    return {
        "aggregate without measures": lambda: r.aggregate(AggRequest({})),
        "batch without operations": lambda: r.batch(lambda b: None),
        "cursor that is broken": lambda: r.get_all(after="!!", keyset=True),
        "delete_many without a filter": lambda: r.delete_many({}),
        "duplicate key": lambda: r.create(_nation(1, "x", 0)),
        "duplicate unique value": lambda: p.create({"name": "ann"}),
        "enum value": lambda: p.create({"name": "eve", "role": "owner"}),
        "lookup without fields": lambda: r.lookup_frame([{"from": "region"}]),
        "lookups to one key": lambda: r.lookup_frame([region(), region()]),
        "missing value": lambda: p.create({"role": "admin"}),
        "nested transaction": nested,
        "pipeline update": lambda: r.update(1, [{"$set": {"n_name": "x"}}]),
        "prepared without text": lambda: r.prepared("p", " "),
        "read-only workspace": lambda: Repository(read_only, "nation").delete(1),
        "regex": lambda: r.find_all(f.regex("n_name", "a.*")),
        "search of no column": lambda: repo(spark, sf_dir, "nation", plugins=[FullText(["n_name"])]).search("r_name:x"),
        "select that excludes": lambda: r.lookup_frame([region(select={"r_name": 0})]),
        "sort by no column": lambda: r.get_all(sort="-nope"),
        "table that isn't there": lambda: r.lookup_frame([Lookup("nope", "n_regionkey", "x")]),
        "tenant that is missing": lambda: repo(spark, sf_dir, "nation", plugins=[Tenancy("n_regionkey", lambda c: None)]).count(),
        "tokenizer": lambda: FullText(["a"], "nope"),
        "unknown column": lambda: r.find_all({"nope": 1}),
        "update of no column": lambda: r.update(1, {"nope": 1}),
        "vector dimensions": lambda: Vectors(0),
        "vector metric": lambda: Vectors(4, "nope"),
        "vector of another length": lambda: vectors.upsert_embedding(1, [1.0]),
    }


@query("SELECT unnest(['aggregate without measures', 'batch without operations', 'cursor that is broken', 'delete_many without a filter', 'duplicate key', 'duplicate unique value', 'enum value', 'lookup without fields', 'lookups to one key', 'missing value', 'nested transaction', 'pipeline update', 'prepared without text', 'read-only workspace', 'regex', 'search of no column', 'select that excludes', 'sort by no column', 'table that isn''t there', 'tenant that is missing', 'tokenizer', 'unknown column', 'update of no column', 'vector dimensions', 'vector metric', 'vector of another length']) AS op, 'refused' AS outcome")
def refusals(spark, sf_dir):
    """Each operation that must be refused, and what became of it."""
    rows = []
    for name, run in _cases(spark, sf_dir).items():
        try:
            run()
            rows.append((name, "done"))
        except LarkspurError as e:
            right = is_duplicate_key_error(e) == name.startswith("duplicate")
            rows.append((name, "refused" if right else f"refused as {type(e).__name__}"))
    return _frame(spark, rows, "op string, outcome string")


@query("SELECT * FROM (VALUES ('before', 'create'), ('error', 'DuplicateKeyError'), ('before', 'update'), ('after', 'update')) t(event, what)")
def error_hooks(spark, sf_dir):
    """Events around a write that fails and one that succeeds."""
    told, r = [], repo(spark, sf_dir, "nation")
    for op in ("create", "update"):
        r.hooks.on(f"before:{op}", lambda ctx: told.append(("before", ctx.op)))
        r.hooks.on(f"after:{op}", lambda ctx: told.append(("after", ctx.op)))
        r.hooks.on(f"error:{op}", lambda ctx, e: told.append(("error", type(e).__name__)))
    try:
        r.create(_nation(1, "x", 0))
    except LarkspurError:
        r.update(1, {"n_name": "x"})
    return _frame(spark, told, "event string, what string")


# ---------------------------------------------------------------- reads and lookups


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^[a-m].*e')")
def filter_regex(spark, sf_dir):
    return repo(spark, sf_dir, "part").find_all(f.regex("p_name", "^[a-m].*e", allowed=True)).select("p_partkey", "p_name")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'it''s ? -- /* '")
def filter_raw_lexed(spark, sf_dir):
    """Question marks in strings with escapes, in names and in comments take no parameter."""
    raw = f.raw("c_mktsegment <> 'it\\'s ? -- /* ' AND c_acctbal > ? /* really? */ AND \"?\" = r'?' -- ?", [5000])
    return repo(spark, sf_dir, "customer").find_all(raw).select("c_custkey")


@query("SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey LIMIT 5 OFFSET 3")
def distinct_page(spark, sf_dir):
    return _frame(spark, [(v,) for v in repo(spark, sf_dir, "customer").distinct("c_nationkey", limit=5, offset=3)], "c_nationkey int")


@query("SELECT count(*)::BIGINT AS total, ceil(count(*) / 10.0)::BIGINT AS pages, true AS has_next, true AS has_prev FROM orders WHERE o_orderstatus = 'F'")
def lookup_page_total(spark, sf_dir):
    p = repo(spark, sf_dir, "orders", "customer").lookup_populate([Lookup("customer", "o_custkey", "c_custkey", "c", single=True)], {"o_orderstatus": "F"}, page=2, limit=10)
    return _frame(spark, [(p.total, p.pages, p.has_next, p.has_prev)], "total bigint, pages bigint, has_next boolean, has_prev boolean")


_LINES = "string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey)"


@query(f"SELECT o_orderkey, coalesce({_LINES} FILTER (WHERE l_orderkey IS NOT NULL), '') AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def lookup_many_elements(spark, sf_dir):
    """All elements of the arrays, in their order."""
    out = repo(spark, sf_dir, "orders", "lineitem").lookup_frame([Lookup("lineitem", "o_orderkey", "l_orderkey", "lines", select=["l_linenumber", "l_partkey"])], select=["o_orderkey"])
    return out.select("o_orderkey", F.array_join(F.transform("lines", lambda x: F.concat(x["l_linenumber"].cast("string"), F.lit(":"), x["l_partkey"].cast("string"))), ",").alias("lines"))


@query("SELECT c_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey, arg_min(o_totalprice, o_orderkey) AS o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def lookup_one_first(spark, sf_dir):
    """One of many matches: the first by the related table's key."""
    out = repo(spark, sf_dir, "customer", "orders").lookup_frame([Lookup("orders", "c_custkey", "o_custkey", "o", single=True, select=["o_orderkey", "o_totalprice"])], select=["c_custkey"])
    return out.select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("SELECT o_orderkey, o_totalprice, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 250000")
def lookup_registry(spark, sf_dir):
    """A related table that the repository alone knows."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    r = Repository(workspace(spark, sf_dir, "orders"), "orders", registry={"buyers": customers})
    out = r.lookup_frame([Lookup("buyers", "o_custkey", "c_custkey", single=True, select=["c_name"])], f.gt("o_totalprice", 250000))
    return out.select("o_orderkey", "o_totalprice", "buyers.c_name")


# ---------------------------------------------------------------- writes


@query("SELECT id::BIGINT AS id, name, role, note FROM (VALUES (1, 'ann', 'admin', NULL), (2, 'bob', 'reader', NULL), (3, 'eve', 'reader', NULL), (10, 'kim', 'admin', 'x'), (11, 'lee', 'reader', NULL)) t(id, name, role, note)")
def create_defaults(spark, sf_dir):
    """Defaults of what isn't given, and keys counted on from the greatest."""
    r = _people(spark)
    r.create({"name": "eve"})
    r.create_many([{"id": 10, "name": "kim", "role": "admin", "note": "x"}, {"name": "lee"}])
    return r.df


_written(
    "nation", "bulk_replace", "SELECT n_nationkey, CASE n_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE n_name END AS n_name, CASE n_nationkey WHEN 2 THEN 9 ELSE n_regionkey END::INT AS n_regionkey FROM nation WHERE n_nationkey <> 3 UNION ALL VALUES (600, 'again', 1), (601, 'made', NULL)",
    lambda r: r.bulk_write([
        {"replace_one": {"filter": {"n_nationkey": 1}, "replacement": {"n_name": "one"}}}, {"update_one": {"filter": {"n_nationkey": "2"}, "update": {"n_name": "two", "n_regionkey": "9"}}},
        {"delete_one": {"filter": {"n_nationkey": 3}}}, {"insert_one": {"document": _nation(600, "first", 1)}}, {"update_one": {"filter": {"n_nationkey": 600}, "update": {"n_name": "again"}}},
        {"replace_one": {"filter": {"n_nationkey": 601}, "replacement": {"n_name": "made"}, "upsert": True}}, {"update_one": {"filter": {"n_nationkey": 602}, "update": {"n_name": "no"}}},
        {"delete_many": {"filter": {"n_nationkey": 602}}},
    ]),
)

_AFTER = "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (1, 5) AND o_orderpriority <> '1-URGENT' UNION ALL VALUES (900000001, 'N', 1.0), (900000002, 'M', 2.0)"


def _changed_orders(spark, sf_dir) -> Repository:
    r = Repository(_stored(spark, sf_dir, "orders"), "orders")
    row = lambda k, s, p: {"o_orderkey": k, "o_custkey": 1, "o_orderstatus": s, "o_totalprice": p}
    r.update_many(f.lt("o_totalprice", 50000), {"o_orderstatus": "Z"})
    r.delete_many({"o_orderpriority": "1-URGENT"})
    r.create_many([row(900000001, "N", 1.0), row(900000002, "N", 2.0)])
    with r.transaction():
        r.update(900000002, {"o_orderstatus": "M"})
        for k in (1, 5):
            r.delete(k)
    return r


@query(_AFTER)
def store_layers(spark, sf_dir):
    """Writes to a store of files, read back from its layers."""
    r = _changed_orders(spark, sf_dir)
    return Repository(Workspace(spark, FileStore(spark, r.ws.store.root), dict(r.ws.tables)), "orders").df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(_AFTER)
def vacuum_store(spark, sf_dir):
    """The same after compaction, which leaves one layer."""
    r = _changed_orders(spark, sf_dir)
    Compaction().apply(r)
    r.vacuum()
    if r.ws.store.layers("orders") != 1:
        raise AssertionError("layers are left")
    return r.df.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT * FROM region")
def backup_copy(spark, sf_dir):
    at = f"{_folder(spark)}/backup"
    _stored(spark, sf_dir, "region").backup(at)
    return spark.read.parquet(f"{at}/region")


@query("SELECT n_regionkey, count(*)::BIGINT AS n FROM nation WHERE n_name <> 'a;b' GROUP BY 1")
def script(spark, sf_dir):
    """A script of several statements with semicolons in strings and comments."""
    ws, view = workspace(spark, sf_dir, "nation"), f"v_{uuid.uuid4().hex}"
    ws.frame("nation").createOrReplaceTempView(view)
    ws.exec(f"-- one; two\nCREATE OR REPLACE TEMP VIEW {view}_a AS SELECT * FROM {view} WHERE n_name <> 'a;b'; /* ; */ CREATE OR REPLACE TEMP VIEW {view}_b AS SELECT n_regionkey, count(*) AS n FROM {view}_a GROUP BY 1;")
    return spark.table(f"{view}_b")


@query("SELECT * FROM (VALUES ('production', 'true', 'UTC'), ('read_only', 'true', 'UTC'), ('test', 'true', 'UTC')) t(preset, adaptive, zone)")
def presets(spark, sf_dir):
    rows, before = [], {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")}
    for name in ("production", "read_only", "test"):
        configure(spark, name)
        rows.append((name, spark.conf.get("spark.sql.adaptive.enabled"), spark.conf.get("spark.sql.session.timeZone")))
    for k, v in before.items():
        spark.conf.set(k, v)
    return _frame(spark, rows, "preset string, adaptive string, zone string")


# ---------------------------------------------------------------- policies


@query(f"SELECT o_orderkey, tenant, CASE WHEN tenant = 'F' AND o_orderkey = 4 THEN 1.0 ELSE o_totalprice END AS o_totalprice FROM {_MARKED} WHERE NOT (tenant = 'F' AND (o_totalprice < 20000 OR o_orderkey = 3)) UNION ALL VALUES (900000001, 'F', 5.0)")
def tenant_writes(spark, sf_dir):
    """A tenant's writes reach its own rows alone, and are stamped with it."""
    r = _marked_repo(spark, sf_dir, Tenancy("tenant", lambda ctx: "F"))
    r.delete_many(f.lt("o_totalprice", 20000))
    r.delete(3)
    r.update(4, {"o_totalprice": 1.0})
    r.update(r.df.where("tenant <> 'F'").first()["o_orderkey"], {"o_totalprice": 0.0})
    r.create({"o_orderkey": 900000001, "tenant": "O", "o_totalprice": 5.0})
    return r.df.select("o_orderkey", "tenant", "o_totalprice")


@query(f"SELECT o_orderkey, \"deletedAt\" FROM {_MARKED} WHERE \"deletedAt\" IS NOT NULL AND o_orderkey <> (SELECT min(o_orderkey) FROM {_MARKED} WHERE \"deletedAt\" IS NOT NULL)")
def soft_delete_restore(spark, sf_dir):
    r = _marked_repo(spark, sf_dir, SoftDelete())
    r.restore(r.deleted_frame().agg(F.min("o_orderkey")).first()[0])
    return r.deleted_frame().select("o_orderkey", "deletedAt")


@query(f'SELECT o_orderkey FROM {_MARKED} WHERE o_orderkey <> 1 AND NOT ("deletedAt" IS NULL AND o_totalprice > 200000)')
def soft_delete_hard(spark, sf_dir):
    r = _marked_repo(spark, sf_dir, SoftDelete())
    r.delete(1, mode="hard")
    r.delete_many(f.and_(f.gt("o_totalprice", 200000), f.is_null("deletedAt")), mode="hard")
    return r.df.select("o_orderkey")


@query(f"SELECT count(*)::BIGINT AS live, (SELECT count(*) FROM {_MARKED})::BIGINT AS every FROM {_MARKED} WHERE \"deletedAt\" IS NULL")
def soft_delete_counts(spark, sf_dir):
    r = _marked_repo(spark, sf_dir, SoftDelete())
    return _frame(spark, [(r.count(), r.count(include_deleted=True))], "live bigint, every bigint")


@query(f"SELECT o_orderkey FROM {_MARKED} WHERE \"expiresAt\" IS NULL OR \"expiresAt\" > '{NOW}' UNION ALL SELECT 900000001")
def ttl_trigger(spark, sf_dir):
    """What has expired goes when a row is added."""
    r = _marked_repo(spark, sf_dir, Expiry(mode="trigger"))
    r.create({"o_orderkey": 900000001})
    return r.df.select("o_orderkey")


@query(f"SELECT * FROM (VALUES (2, 'b', '2020', '{NOW}'), (3, 'c', '2020', '2020')) t(id, name, \"createdAt\", \"updatedAt\")")
def timestamp_touch(spark, sf_dir):
    """Increments and bulk updates touch the rows that they change alone."""
    rows = [(2, "a", "2020", "2020"), (3, "c", "2020", "2020")]
    r = repo(spark, sf_dir, "s", s=spark.createDataFrame(rows, "id int, name string, createdAt string, updatedAt string"), plugins=[Timestamps()])
    r.update_many({"id": 2}, {"name": "b"})
    return r.df


@query("SELECT * FROM (VALUES ('first', 25, 0), ('again', 25, 1), ('skipped', 26, 1), ('after a write', 27, 1), ('a page', 5, 1), ('the page again', 5, 2)) t(step, n, hits)")
def cache_reads(spark, sf_dir):
    """Counts through a cache, past it, and after a write has emptied it."""
    c, rows = Cache(), []
    r = repo(spark, sf_dir, "nation", plugins=[c])
    tell = lambda step, n: rows.append((step, n, c.hits))
    tell("first", r.count())
    r.ws.put({"nation": r.df.unionByName(_frame(spark, [(700, "x", 1)], r.df.schema))})  # behind its back
    tell("again", r.count())
    tell("skipped", r.count(skip_cache=True))
    r.create(_nation(701, "y", 1))
    tell("after a write", r.count())
    for step in ("a page", "the page again"):
        tell(step, r.get_all(limit=5).docs.count())
    return _frame(spark, rows, "step string, n int, hits int")


# ---------------------------------------------------------------- schemas, indexes and migrations


@query("SELECT * FROM (VALUES ('auto_people_id', true, true, 'id', ''), ('auto_people_name', true, true, 'name', ''), ('idx_people_role_note', false, false, 'role,note', ''), ('idx_people_live_name', false, false, 'name', '`note` IS NULL'), ('idx_people_note_ttl', false, false, 'note', '`note` IS NOT NULL')) t(name, is_unique, auto, columns, predicate)")
def index_list(spark, sf_dir):
    ws = _people(spark).ws
    mig.create_index(ws, "people", ["role", "note"])
    mig.create_index(ws, **mig.soft_delete_index("people", ["name"], "note"))
    mig.create_index(ws, **mig.ttl_index("people", "note"))
    mig.create_index(ws, "people", ["note"], name="gone")
    mig.drop_index(ws, "gone")
    rows = [(i["name"], i["unique"], i["auto"], ",".join(c["name"] for c in i["columns"]), i.get("partial_where", "")) for i in mig.list_indexes(ws, "people")]
    return _frame(spark, rows, "name string, is_unique boolean, auto boolean, columns string, predicate string")


@query("SELECT id::BIGINT AS id, name, note FROM (VALUES (1, 'ann', 'n1'), (2, 'bob', NULL), (3, 'eve', NULL), (4, 'kim', 'n2')) t(id, name, note)")
def index_unique(spark, sf_dir):
    """A unique index over the rows that have a note: two without one are let in, two alike aren't."""
    r = _people(spark)
    r.update(1, {"note": "n1"})
    mig.create_index(r.ws, "people", ["note"], unique=True, where="note IS NOT NULL")
    for name, note in (("eve", None), ("lee", "n1"), ("kim", "n2")):
        try:
            r.create({"name": name, "note": note})
        except LarkspurError as e:
            if not is_duplicate_key_error(e):
                raise
    return r.df.select("id", "name", "note")


@query("SELECT o_orderkey, o_totalprice, true AS apart FROM orders")
def reindex_layout(spark, sf_dir):
    """A table rewritten by its index: files whose ranges of the column don't overlap."""
    ws = _stored(spark, sf_dir, "orders")
    mig.create_index(ws, "orders", ["o_totalprice"])
    mig.reindex(ws, "orders")
    spans = ws.frame("orders").groupBy(F.input_file_name().alias("file")).agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi")).orderBy("lo").collect()
    apart = all(a["hi"] <= b["lo"] for a, b in zip(spans[:-1], spans[1:], strict=True))
    return ws.frame("orders").select("o_orderkey", "o_totalprice", F.lit(apart).alias("apart"))


def _rename(ws: Workspace) -> None:
    Repository(ws, "nation").update_many({"n_regionkey": 1}, {"n_name": "west"})


def _drop_rows(ws: Workspace) -> None:
    Repository(ws, "nation").delete_many({"n_regionkey": 2})


def _restore_rows(ws: Workspace) -> None:
    Repository(ws, "nation").create(_nation(800, "restored", 2))


@query(f"SELECT * FROM (VALUES ('001', true, '{NOW}'), ('002', false, ''), ('003', false, '')) t(name, applied, applied_at)")
def migration_status(spark, sf_dir):
    """Two of three migrations applied, the second undone."""
    ws = workspace(spark, sf_dir, "nation")
    some = [mig.Migration("001", _rename), mig.Migration("002", _drop_rows, _restore_rows)]
    mig.Migrator(ws, some).up()
    mig.Migrator(ws, some).down("001")
    status = mig.Migrator(ws, [*some, mig.Migration("003", _rename)]).status()
    return _frame(spark, [(s["name"], s["applied"], s.get("applied_at", "")) for s in status], "name string, applied boolean, applied_at string")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'west' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL VALUES (800, 'restored', 2)")
def migration_rows(spark, sf_dir):
    ws = workspace(spark, sf_dir, "nation")
    m = mig.Migrator(ws, [mig.Migration("001", _rename), mig.Migration("002", _drop_rows, _restore_rows)])
    m.up()
    m.down("001")
    return ws.frame("nation")


@query("SELECT * FROM (VALUES ('0001_second', 1), ('0000_first', 0)) t(name, place), (SELECT count(*)::BIGINT AS n FROM region)")
def migration_directory(spark, sf_dir):
    """Migrations of a journal, in its order; each is a script."""
    ws, view = workspace(spark, sf_dir, "region"), f"m_{uuid.uuid4().hex}"
    ws.frame("region").createOrReplaceTempView(view)
    with tempfile.TemporaryDirectory() as folder:
        at = Path(folder)
        (at / "meta").mkdir()
        (at / "meta/_journal.json").write_text(json.dumps({"dialect": "spark", "entries": [{"idx": 1, "tag": "0001_second"}, {"idx": 0, "tag": "0000_first"}]}))
        (at / "0000_first.sql").write_text(f"CREATE OR REPLACE TEMP VIEW {view}_0 AS SELECT count(*) AS n FROM {view};")
        (at / "0001_second.sql").write_text(f"CREATE OR REPLACE TEMP VIEW {view}_1 AS SELECT n FROM {view}_0;")
        applied = mig.Migrator(ws, mig.load_directory(folder)).up()
    n = spark.table(f"{view}_1").first()[0]
    return _frame(spark, [(name, i, n) for i, name in enumerate(applied)], "name string, place int, n bigint")


@query("SELECT * FROM (VALUES ('create_body', 'name', 'string', true), ('create_body', 'note', 'string', false), ('create_body', 'role', 'string', false), ('update_body', 'name', 'string', false), ('update_body', 'note', 'string', false), ('update_body', 'role', 'string', false), ('params', 'id', 'string', true)) t(schema, property, type, required)")
def crud_schema(spark, sf_dir):
    made = crud_schemas(PEOPLE)
    rows = [(s, k, v["type"], k in made[s].get("required", ())) for s in ("create_body", "update_body", "params") for k, v in made[s]["properties"].items()]
    return _frame(spark, rows, "schema string, property string, type string, required boolean")


# ---------------------------------------------------------------- search

_DE, _VON = "list_contains(w, 'nicht')", "list_contains(w, 'von')"
_TOKENS = f"(SELECT doc_id, lang, source, {_tokens_sql()} AS w FROM documents)"
_BM25 = f"""c AS (SELECT doc_id, lang, len(w) AS dl, len(list_filter(w, lambda x: x = 'nicht'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'von'))::DOUBLE AS b FROM {_TOKENS}),
g AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM c),
r AS (SELECT doc_id, lang, a, b,
  greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM c, g)"""


def _documents(spark, sf_dir, **options) -> Repository:
    return repo(spark, sf_dir, "documents", plugins=[FullText(["text"], **options)])


@query(f"WITH {_BM25} SELECT doc_id, lang FROM r WHERE a > 0 OR b > 0 ORDER BY score DESC, doc_id LIMIT 7 OFFSET 3")
def fts_search(spark, sf_dir):
    """Documents, best first, a page of them."""
    return _documents(spark, sf_dir).search("nicht OR von", limit=7, offset=3).select("doc_id", "lang")


@query(f"WITH {_BM25} SELECT doc_id, round(-score, 6) AS rank FROM r WHERE a > 0 OR b > 0")
def fts_index_bm25(spark, sf_dir):
    """Ranks from the stored index."""
    r = _documents(spark, sf_dir)
    r.create_search_index()
    return r.search_hits("nicht OR von").select("doc_id", F.round("rank", 6).alias("rank"))


@query(f"WITH t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM {_TOKENS}) SELECT doc_id FROM t WHERE (contains(j, ' and the ') OR len(list_filter(w, lambda x: starts_with(x, 'nich') OR starts_with(x, 'lico'))) > 0) AND NOT {_VON}")
def fts_index_grammar(spark, sf_dir):
    """Phrases, prefixes of a stored length and of another, and operators over the stored index."""
    r = _documents(spark, sf_dir, prefix=(3, 4))
    r.create_search_index()
    return r.search_hits('("and the" OR nich* OR lico*) NOT von').select("doc_id")


@query(f"SELECT term, count(DISTINCT doc_id)::BIGINT AS docs, count(*)::BIGINT AS times FROM (SELECT doc_id, unnest(w) AS term FROM {_TOKENS}) GROUP BY 1 HAVING count(DISTINCT doc_id) > 100")
def fts_index_terms(spark, sf_dir):
    r = _documents(spark, sf_dir)
    r.create_search_index()
    return r.ws.frame("documents_fts").groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("tf").alias("times")).where("docs > 100")


@query(f"SELECT doc_id FROM {_TOKENS} WHERE {_DE} AND doc_id NOT IN (5, 6) UNION ALL SELECT unnest([6, 900000001])")
def fts_synced(spark, sf_dir):
    """The stored index after a row was added, one changed and one deleted, in a store of files."""
    r = Repository(_stored(spark, sf_dir, "documents"), "documents", [FullText(["text"])])
    r.create_search_index()
    r.create({"doc_id": 900000001, "text": "Gewiß NICHT"})
    r.update(6, {"text": "nicht mehr"})
    r.delete(5)
    return r.search_hits("nicht").select("doc_id")


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 't ge') OR contains(lower(p_name), 'blu')")
def fts_trigram(spark, sf_dir):
    return repo(spark, sf_dir, "part", plugins=[FullText(["p_name"], "trigram")]).search_hits('"t ge" OR BLU').select("p_partkey")


def _texts(spark, *texts: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(texts, 1)], "id int, body string")


@query("SELECT unnest([1, 3]) AS id")
def fts_porter(spark, sf_dir):
    t = _texts(spark, "Running relations", "a cat", "he runs, in relation to cats", "relate")
    return repo(spark, sf_dir, "t", t=t, plugins=[FullText(["body"], "porter")]).search_hits("relational AND run").select("id")


@query("SELECT * FROM (VALUES ('cafe', 1), ('cafe', 2), ('αθηνα', 3), ('и', 4), ('elite', 5)) t(query, id)")
def fts_marks(spark, sf_dir):
    """Letters with marks, as one character or two, in Latin, Greek and Cyrillic."""
    t = _texts(spark, "Café!", "cafés? café", "η Αθήνα", "й", "Élite")
    r = repo(spark, sf_dir, "t", t=t, plugins=[FullText(["body"])])
    out = [r.search_hits(q).select(F.lit(q).alias("query"), "id") for q in ("cafe", "αθηνα", "и", "elite")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("SELECT vec_id AS rowid, label FROM (SELECT vec_id, label, list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), lambda x: abs(x[1] - x[2]))) AS d FROM embeddings) ORDER BY d, rowid LIMIT 6")
def vec_search(spark, sf_dir):
    """Similar rows with their documents."""
    out = _vector_repo(spark, sf_dir, "l1").similarity_search(_probe_vector(spark, sf_dir), 6)
    return _frame(spark, [(x["rowid"], x["doc"]["label"]) for x in out], "rowid bigint, label int")


@query("SELECT rowid, distance::DOUBLE AS distance FROM (VALUES ('b', 0.0), ('c', 1.0)) t(rowid, distance)")
def vec_string_keys(spark, sf_dir):
    ws = workspace(spark, sf_dir, items=spark.createDataFrame([("a",), ("b",), ("c",)], "name string"))
    r = Repository(ws, "items", [Vectors(2, "l2", key=T.StringType())])
    r.upsert_embeddings([("a", [9.0, 9.0]), ("b", [1.0, 1.0]), ("c", [1.0, 2.0])])
    return r.similarity_hits([1.0, 1.0], 2)

