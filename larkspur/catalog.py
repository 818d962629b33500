"""The registered queries of the data API, each with the SQL that gives the same rows.

Queries return plain columns. Where an operation's result is an envelope or a nested value,
the query projects it: a page's rows, a page's figures, an array's size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.operators.aggregate import AggRequest
from larkspur.operators.lookup import Lookup
from larkspur.operators.paging import keyset_frame
from larkspur.plans import filters as f
from larkspur.plans.compiler import Update, sort_keys
from larkspur.plugins import Audit, Expiry, FullText, SoftDelete, Tenancy, Timestamps, Vectors
from larkspur.repository import Repository, with_batch
from larkspur.sources.store import MemoryStore
from larkspur.sources.tables import TableDef
from larkspur.sources.workspace import Workspace
from larkspur.urlquery import parse_url

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "labels": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
NOW = "2024-06-01T00:00:00Z"

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (spark, sf_dir) under its name, with its SQL."""

    def add(run):
        _queries[run.__name__] = run
        if sql is not None:
            _sql[run.__name__] = sql
        return run

    return add


def workspace(spark: SparkSession, sf_dir: str, *names: str, **derived: DataFrame) -> Workspace:
    """A workspace in memory over tables of the data folder; lineitem gets a key of its own kind."""
    frames = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names} | derived
    ws = Workspace(spark, MemoryStore(spark, frames), clock=lambda: NOW)
    for n, df in frames.items():
        ws.tables[n] = TableDef.of(n, df, KEYS.get(n, df.columns[0]))
    return ws


def repo(spark, sf_dir, name, *others, plugins=(), **derived) -> Repository:
    return Repository(workspace(spark, sf_dir, *([name] if name not in derived else []), *others, **derived), name, plugins)


def _frame(spark, rows, schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---------------------------------------------------------------- filters


def _filter(name: str, table: str, flt, sql: str, columns: tuple[str, ...]):
    def run(spark, sf_dir):
        return repo(spark, sf_dir, table).find_all(flt() if callable(flt) else flt).select(*columns)

    run.__name__ = name
    query(f"SELECT {', '.join(columns)} FROM {table} WHERE {sql}")(run)


_O = ("o_orderkey", "o_orderstatus", "o_totalprice")
_C = ("c_custkey", "c_mktsegment", "c_nationkey")
_filter("filter_eq", "orders", f.eq("o_orderstatus", "F"), "o_orderstatus = 'F'", _O)
_filter("filter_ne", "orders", f.ne("o_orderstatus", "F"), "o_orderstatus <> 'F'", _O)
_filter("filter_gt", "orders", f.gt("o_totalprice", 200000), "o_totalprice > 200000", _O)
_filter("filter_lt", "orders", f.lt("o_totalprice", "30000"), "o_totalprice < 30000", _O)
_filter("filter_range", "lineitem", f.and_(f.gte("l_quantity", 10), f.lte("l_quantity", 12)), "l_quantity >= 10 AND l_quantity <= 12", ("l_orderkey", "l_partkey", "l_quantity"))
_filter("filter_between_and", "orders", lambda: f.and_(f.TRUE, f.gte("o_orderdate", "1995-01-01"), f.lt("o_orderdate", "1996-01-01")), "o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'", ("o_orderkey",))
_filter("filter_in", "customer", f.in_("c_mktsegment", ["BUILDING", "MACHINERY"]), "c_mktsegment IN ('BUILDING', 'MACHINERY')", _C)
_filter("filter_in_empty", "customer", f.in_("c_mktsegment", []), "false", _C)
_filter("filter_nin", "customer", f.nin("c_nationkey", [1, 2, 3]), "c_nationkey NOT IN (1, 2, 3)", _C)
_filter("filter_nin_empty", "customer", f.nin("c_nationkey", []), "true", _C)
_filter("filter_like_ci", "part", f.like("p_name", "%RED _i%"), "lower(p_name) LIKE '%red _i%'", ("p_partkey", "p_name"))
_filter("filter_like_sensitive", "documents", f.like("text", "The %", sensitive=True), "text LIKE 'The %'", ("doc_id",))
_filter("filter_like_escape", "documents", f.like("text", "%\\%\\%%"), "contains(text, '%%')", ("doc_id",))
_filter("filter_contains", "documents", f.contains("text", "$$$"), "contains(lower(text), '$$$')", ("doc_id", "lang"))
_filter("filter_or", "orders", f.or_(f.eq("o_orderstatus", "P"), f.gt("o_totalprice", 250000)), "o_orderstatus = 'P' OR o_totalprice > 250000", _O)
_filter("filter_or_true", "orders", f.or_(f.eq("o_orderstatus", "P"), f.TRUE), "true", _O)
_filter("filter_not", "orders", f.not_(f.eq("o_orderstatus", "O")), "NOT (o_orderstatus = 'O')", _O)
_filter("filter_not_true", "orders", f.not_(f.TRUE), "false", _O)
_filter("filter_false", "orders", f.FALSE, "false", _O)
_filter("filter_nested", "orders", f.and_(f.or_(f.eq("o_orderstatus", "F"), f.eq("o_orderstatus", "P")), f.not_(f.or_(f.lt("o_totalprice", 50000), f.gt("o_totalprice", 150000)))), "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT (o_totalprice < 50000 OR o_totalprice > 150000)", _O)
_filter("filter_raw", "customer", f.raw("length(c_name) > 5 AND c_acctbal > 9000"), "length(c_name) > 5 AND c_acctbal > 9000", _C)
_filter("filter_raw_params", "customer", f.raw("c_acctbal > ? AND c_mktsegment <> ? AND '?' = '?'", [5000, "O'; --"]), "c_acctbal > 5000", _C)
_filter("filter_flat_record", "customer", {"c_mktsegment": "BUILDING", "c_nationkey": "7"}, "c_mktsegment = 'BUILDING' AND c_nationkey = 7", _C)
_filter("filter_url", "events", lambda: parse_url("?event_type[in]=click,view&value[gte]=50&user_id[ne]=3").filter, "event_type IN ('click', 'view') AND value >= 50 AND user_id <> 3", ("event_id", "event_type", "value"))


def _nullable(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"), F.expr("nullif(c_nationkey, 5)").alias("nat"))


_NULLABLE = "(SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS seg, nullif(c_nationkey, 5) AS nat FROM customer)"


def _nulls(name: str, flt, sql: str):
    def run(spark, sf_dir):
        return repo(spark, sf_dir, "t", t=_nullable(spark, sf_dir)).find_all(flt)

    run.__name__ = name
    query(f"SELECT * FROM {_NULLABLE} WHERE {sql}")(run)


_nulls("filter_eq_null", f.eq("seg", None), "seg IS NULL")
_nulls("filter_ne_null", f.ne("seg", None), "seg IS NOT NULL")
_nulls("filter_exists", f.exists("nat"), "nat IS NOT NULL")
_nulls("filter_exists_null", f.exists("nat", False), "nat IS NULL")
_nulls("filter_ne_three_valued", f.ne("seg", "MACHINERY"), "seg <> 'MACHINERY'")
_nulls("filter_nin_three_valued", f.nin("nat", [1, 2]), "nat NOT IN (1, 2)")
_nulls("filter_not_three_valued", f.not_(f.gt("nat", 10)), "NOT (nat > 10)")
_nulls("filter_tenant_scope", f.tenant_scope({"seg": "MACHINERY"}, "nat", 7), "seg = 'MACHINERY' AND nat = 7")


# ---------------------------------------------------------------- reads


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def get_by_id(spark, sf_dir):
    r = repo(spark, sf_dir, "orders")
    row = r.get_by_id(7)
    return _frame(spark, [tuple(row.values())] if row else [], r.df.schema)


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY c_custkey LIMIT 1")
def get_one(spark, sf_dir):
    row = repo(spark, sf_dir, "customer").get_one({"c_mktsegment": "BUILDING"})
    return _frame(spark, [(row["c_custkey"], row["c_name"])], "c_custkey bigint, c_name string")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_name = (SELECT max(n_name) FROM nation)")
def get_by_slug(spark, sf_dir):
    r = repo(spark, sf_dir, "nation")
    row = r.get_by_slug(r.get_one(sort="-n_name")["n_name"], "n_name")
    return _frame(spark, [(row["n_nationkey"], row["n_name"])], "n_nationkey int, n_name string")


@query("SELECT * FROM nation")
def find_all(spark, sf_dir):
    return repo(spark, sf_dir, "nation").find_all()


@query("SELECT count(*)::BIGINT AS n, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F')::BIGINT AS finished, true AS some, false AS none FROM orders")
def count_and_exists(spark, sf_dir):
    r = repo(spark, sf_dir, "orders")
    return _frame(spark, [(r.count(), r.count({"o_orderstatus": "F"}), r.exists({"o_orderstatus": "O"}), r.exists(f.lt("o_totalprice", 0)))], "n bigint, finished bigint, some boolean, none boolean")


@query(f"SELECT DISTINCT seg FROM {_NULLABLE}")
def distinct(spark, sf_dir):
    return repo(spark, sf_dir, "t", t=_nullable(spark, sf_dir)).distinct_frame("seg")


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3")
def view_source(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/customer.parquet").createOrReplaceTempView("larkspur_customer_view")
    ws = workspace(spark, sf_dir)
    ws.view("v", spark.table("larkspur_customer_view"), "c_custkey")
    return Repository(ws, "v").find_all({"c_nationkey": 3}).select("c_custkey", "c_name")


@query("SELECT o_orderstatus, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 100000 GROUP BY 1")
def statement(spark, sf_dir):
    return workspace(spark, sf_dir, "orders").all("SELECT o_orderstatus, count(*) AS n FROM {orders} WHERE o_totalprice > ? GROUP BY 1", [100000.0])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 110000")
def prepared(spark, sf_dir):
    handle = repo(spark, sf_dir, "orders").prepared("by_price", "SELECT o_orderkey, o_totalprice FROM {table} WHERE o_totalprice BETWEEN :lo AND :hi")
    return handle.execute(lo=100000.0, hi=110000.0)


# ---------------------------------------------------------------- pages


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 180")
def page_offset(spark, sf_dir):
    return repo(spark, sf_dir, "orders").get_all(sort="-o_totalprice", page=10, limit=20).docs.select("o_orderkey", "o_totalprice")


@query("SELECT count(*)::BIGINT AS total, ceil(count(*) / 7.0)::BIGINT AS pages, false AS has_next, count(*) > 7 AS has_prev, (count(*) - 7 * (ceil(count(*) / 7.0) - 1))::BIGINT AS rows FROM customer WHERE c_nationkey = 4")
def page_last_partial(spark, sf_dir):
    r = repo(spark, sf_dir, "customer")
    pages = r.get_all({"c_nationkey": 4}, limit=7).pages
    p = r.get_all({"c_nationkey": 4}, page=pages, limit=7)
    return _frame(spark, [(p.total, p.pages, p.has_next, p.has_prev, p.docs.count())], "total bigint, pages bigint, has_next boolean, has_prev boolean, rows bigint")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
def page_nocount(spark, sf_dir):
    return repo(spark, sf_dir, "orders").get_all(page=3, count="none").docs.select("o_orderkey")


def _third_keyset_page(r: Repository, sort: str) -> DataFrame:
    cursor = None
    for _ in range(2):
        cursor = r.get_all(sort=sort, limit=30, after=cursor, keyset=True).next
    return keyset_frame(r.df, sort_keys(sort, r.id_field), r.id_field, cursor, 30)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate NULLS FIRST, o_orderkey LIMIT 30 OFFSET 60")
def page_keyset_asc(spark, sf_dir):
    return _third_keyset_page(repo(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 30 OFFSET 60")
def page_keyset_desc(spark, sf_dir):
    return _third_keyset_page(repo(spark, sf_dir, "orders"), "-o_totalprice").select("o_orderkey", "o_totalprice")


@query(f"SELECT * FROM {_NULLABLE} ORDER BY nat NULLS FIRST, seg DESC NULLS LAST, c_custkey LIMIT 30 OFFSET 60")
def page_keyset_mixed(spark, sf_dir):
    return _third_keyset_page(repo(spark, sf_dir, "t", t=_nullable(spark, sf_dir)), "nat,-seg")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 5")
def page_url(spark, sf_dir):
    q = parse_url("https://x/orders?o_orderstatus=F&sort=-o_totalprice&page=2&limit=5&select=o_orderkey")
    return repo(spark, sf_dir, "orders").get_all(q.filter, q.sort, q.page, q.limit, select=q.select).docs


# ---------------------------------------------------------------- aggregation


def _agg(name: str, table: str, req: AggRequest, sql: str, rounded: tuple[str, ...] = ()):
    def run(spark, sf_dir):
        out = repo(spark, sf_dir, table).aggregate(req)
        return out.withColumns({c: F.round(c, 4) for c in rounded}) if rounded else out

    run.__name__ = name
    query(sql)(run)


_agg("agg_scalar", "lineitem", AggRequest({"n": {"op": "count"}, "qty": {"op": "sum", "field": "l_quantity"}, "mean": {"op": "avg", "field": "l_discount"}}), "SELECT count(*)::BIGINT AS n, sum(l_quantity) AS qty, round(avg(l_discount), 4) AS mean FROM lineitem", ("mean",))
_agg("agg_scalar_empty", "lineitem", AggRequest({"n": "count", "qty": ("sum", "l_quantity")}, filter=f.FALSE), "SELECT count(*)::BIGINT AS n, sum(l_quantity) AS qty FROM lineitem WHERE false")
_agg("agg_group", "orders", AggRequest({"n": "count", "total": ("sum", "o_totalprice")}, "o_orderstatus"), "SELECT o_orderstatus, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
_queries["agg_group"] = lambda spark, sf_dir, run=_queries["agg_group"]: run(spark, sf_dir).withColumn("total", F.round("total", 2))
_agg("agg_group_multi", "lineitem", AggRequest({"n": "count", "avg_qty": ("avg", "l_quantity")}, ["l_returnflag", "l_linestatus"]), "SELECT l_returnflag, l_linestatus, count(*)::BIGINT AS n, round(avg(l_quantity), 4) AS avg_qty FROM lineitem GROUP BY 1, 2", ("avg_qty",))
_agg("agg_count_distinct", "lineitem", AggRequest({"parts": ("countDistinct", "l_partkey")}, "l_returnflag"), "SELECT l_returnflag, count(DISTINCT l_partkey)::BIGINT AS parts FROM lineitem GROUP BY 1")
_agg("agg_min_max", "events", AggRequest({"lo": ("min", "value"), "hi": ("max", "value"), "first": ("min", "ts")}, "event_type"), "SELECT event_type, min(value) AS lo, max(value) AS hi, min(ts) AS first FROM events GROUP BY 1")
_agg("agg_where", "orders", AggRequest({"n": "count"}, "o_orderpriority", filter=f.gt("o_totalprice", 150000)), "SELECT o_orderpriority, count(*)::BIGINT AS n FROM orders WHERE o_totalprice > 150000 GROUP BY 1")
_agg("agg_having_gt", "orders", AggRequest({"n": "count"}, "o_custkey", having=f.gt("n", 14)), "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 14")
_agg("agg_having_in", "orders", AggRequest({"n": "count"}, "o_custkey", having=f.in_("n", [3, 4])), "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) IN (3, 4)")
_agg("agg_having_empty_in", "orders", AggRequest({"n": "count"}, "o_custkey", having=f.in_("n", [])), "SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING false")
_agg("agg_having_key_and_measure", "customer", AggRequest({"n": "count", "top": ("max", "c_acctbal")}, "c_nationkey", having=f.and_(f.gte("n", 2), f.lt("c_nationkey", 10))), "SELECT c_nationkey, count(*)::BIGINT AS n, max(c_acctbal) AS top FROM customer GROUP BY 1 HAVING count(*) >= 2 AND c_nationkey < 10")
_agg("agg_sort_measure", "orders", AggRequest({"n": "count", "top": ("max", "o_totalprice")}, "o_custkey", sort="-n", limit=10, offset=5), "SELECT o_custkey, count(*)::BIGINT AS n, max(o_totalprice) AS top FROM orders GROUP BY 1 ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 5")


@query(f"SELECT nat, count(seg)::BIGINT AS segs, count(*)::BIGINT AS n FROM {_NULLABLE} GROUP BY 1")
def agg_count_field(spark, sf_dir):
    return repo(spark, sf_dir, "t", t=_nullable(spark, sf_dir)).aggregate(AggRequest({"segs": ("count", "seg"), "n": ("count", "*")}, "nat"))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 ORDER BY 1 LIMIT 20 OFFSET 20")
def agg_paginate(spark, sf_dir):
    return repo(spark, sf_dir, "orders").aggregate_paginate(AggRequest({"n": "count"}, "o_custkey"), page=2).docs


@query("SELECT count(*)::BIGINT AS total, greatest(1, ceil(count(*) / 6.0))::BIGINT AS pages FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 12)")
def agg_paginate_having(spark, sf_dir):
    p = repo(spark, sf_dir, "orders").aggregate_paginate(AggRequest({"n": "count"}, "o_custkey", having=f.gt("n", 12)), limit=6)
    return _frame(spark, [(p.total, p.pages)], "total bigint, pages bigint")


# ---------------------------------------------------------------- lookups


@query("SELECT o_orderkey, c_name, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_one(spark, sf_dir):
    out = repo(spark, sf_dir, "orders", "customer").lookup_frame([Lookup("customer", "o_custkey", "c_custkey", "c", single=True)], select=["o_orderkey"])
    return out.select("o_orderkey", "c.c_name", "c.c_nationkey")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey")
def lookup_one_where(spark, sf_dir):
    out = repo(spark, sf_dir, "orders", "customer").lookup_frame([{"from": "customer", "localField": "o_custkey", "foreignField": "c_custkey", "as": "c", "single": True, "where": f.gt("c_acctbal", 5000)}])
    return out.select("o_orderkey", "c.c_name")


@query("SELECT n_nationkey, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_one_select(spark, sf_dir):
    out = repo(spark, sf_dir, "nation", "region").lookup_frame([Lookup("region", "n_regionkey", "r_regionkey", single=True, select={"r_name": 1})], select={"n_nationkey": 1})
    return out.select("n_nationkey", "region.*")


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS lines, coalesce(sum(l_quantity), 0.0) AS qty FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def lookup_many(spark, sf_dir):
    out = repo(spark, sf_dir, "orders", "lineitem").lookup_frame([Lookup("lineitem", "o_orderkey", "l_orderkey", "lines", select=["l_linenumber", "l_quantity"])], select=["o_orderkey"])
    return out.select("o_orderkey", F.size("lines").cast("long").alias("lines"), F.aggregate("lines", F.lit(0.0), lambda s, x: s + x["l_quantity"]).alias("qty"))


@query("SELECT o_orderkey, count(l_orderkey)::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R' GROUP BY 1")
def lookup_many_where(spark, sf_dir):
    out = repo(spark, sf_dir, "orders", "lineitem").lookup_frame([Lookup("lineitem", "o_orderkey", "l_orderkey", "r", where={"l_returnflag": "R"}, select=["l_linenumber"])])
    return out.select("o_orderkey", F.size("r").cast("long").alias("n"))


@query("SELECT c_custkey, n_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey)::BIGINT AS orders, (SELECT count(*) FROM supplier WHERE s_nationkey = c_nationkey)::BIGINT AS suppliers FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def lookup_multi(spark, sf_dir):
    out = repo(spark, sf_dir, "customer", "nation", "orders", "supplier").lookup_frame([Lookup("nation", "c_nationkey", "n_nationkey", "n", single=True), Lookup("orders", "c_custkey", "o_custkey", "o", select=["o_orderkey"]), Lookup("supplier", "c_nationkey", "s_nationkey", "s", select=["s_suppkey"])])
    return out.select("c_custkey", "n.n_name", F.size("o").cast("long").alias("orders"), F.size("s").cast("long").alias("suppliers"))


@query("SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag = 'A')::BIGINT AS a, count(l_orderkey) FILTER (WHERE l_returnflag = 'N')::BIGINT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def lookup_same_table_twice(spark, sf_dir):
    out = repo(spark, sf_dir, "orders", "lineitem").lookup_frame([Lookup("lineitem", "o_orderkey", "l_orderkey", x.lower(), where={"l_returnflag": x}, select=["l_linenumber"]) for x in "AN"])
    return out.select("o_orderkey", F.size("a").cast("long").alias("a"), F.size("n").cast("long").alias("n"))


@query("SELECT o_orderkey, o_totalprice, c_name, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey)::BIGINT AS lines FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def lookup_page(spark, sf_dir):
    p = repo(spark, sf_dir, "orders", "customer", "lineitem").lookup_populate([Lookup("customer", "o_custkey", "c_custkey", "c", single=True), Lookup("lineitem", "o_orderkey", "l_orderkey", "l", select=["l_linenumber"])], {"o_orderstatus": "F"}, "-o_totalprice", page=2, limit=10)
    return p.docs.select("o_orderkey", "o_totalprice", "c.c_name", F.size("l").cast("long").alias("lines"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def lookup_empty_array(spark, sf_dir):
    out = repo(spark, sf_dir, "orders", "lineitem").lookup_frame([Lookup("lineitem", "o_orderkey", "l_orderkey", "l", select=["l_linenumber"])])
    return out.where(F.size("l") == 0).select("o_orderkey")


@query(f"SELECT c_custkey, n_name FROM {_NULLABLE} LEFT JOIN nation ON nat = n_nationkey")
def lookup_null_key(spark, sf_dir):
    r = repo(spark, sf_dir, "t", "nation", t=_nullable(spark, sf_dir))
    return r.lookup_frame([Lookup("nation", "nat", "n_nationkey", "n", single=True, select=["n_name"])]).select("c_custkey", "n.n_name")


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def lookup_labels(spark, sf_dir):
    out = repo(spark, sf_dir, "documents", "labels").lookup_frame([Lookup("labels", "doc_id", "doc_id", "l", single=True)], select=["doc_id"])
    return out.select("doc_id", "l.quality", "l.toxic")


# ---------------------------------------------------------------- writes


def _written(table: str, name: str, sql: str, change: Callable[[Repository], object], *others: str):
    def run(spark, sf_dir):
        r = repo(spark, sf_dir, table, *others)
        change(r)
        return r.df

    run.__name__ = name
    query(sql)(run)


def _nation(key, name, region):
    return {"n_nationkey": key, "n_name": name, "n_regionkey": region}


_S = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"
_written("nation", "create_many", "SELECT * FROM nation UNION ALL VALUES (100, 'NEW ONE', 1), (101, 'NEW TWO', NULL)", lambda r: (r.create(_nation(100, "NEW ONE", 1)), r.create_many([_nation(101, "NEW TWO", None)]), r.create_many([])))
_written("supplier", "update_by_id", "SELECT s_suppkey, CASE WHEN s_suppkey = 3 THEN 'renamed' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier", lambda r: r.update(3, {"s_name": "renamed", "s_suppkey": 999}))
_written("supplier", "update_many_set", "SELECT s_suppkey, s_name, CASE WHEN s_acctbal < 0 THEN 1 ELSE s_nationkey END AS s_nationkey, s_acctbal FROM supplier", lambda r: r.update_many(f.lt("s_acctbal", 0), Update(set={"s_nationkey": 1})))
_written("supplier", "update_many_inc", "SELECT s_suppkey, s_name, CASE WHEN s_nationkey IN (1, 2) THEN s_nationkey + 100 ELSE s_nationkey END::INT AS s_nationkey, s_acctbal FROM supplier", lambda r: r.update_many(f.in_("s_nationkey", [1, 2]), Update(inc={"s_nationkey": 100})))
_written("supplier", "update_many_unset", "SELECT s_suppkey, s_name, s_nationkey, CASE WHEN s_nationkey > 10 THEN NULL ELSE s_acctbal END AS s_acctbal FROM supplier", lambda r: r.update_many(f.gt("s_nationkey", 10), Update(unset=["s_acctbal"])))
_written("supplier", "delete_many", f"{_S} WHERE NOT (s_nationkey > 10)", lambda r: r.delete_many(f.gt("s_nationkey", 10)))
_written("supplier", "delete_by_id", f"{_S} WHERE s_suppkey <> 5", lambda r: (r.delete(5), r.delete(-1)))
_written("nation", "upsert", "SELECT n_nationkey, CASE WHEN n_nationkey = 2 THEN 'two' ELSE n_name END AS n_name, n_regionkey FROM nation UNION ALL VALUES (200, 'added', 0)", lambda r: (r.upsert({"n_nationkey": 2, "n_name": "two"}), r.upsert(_nation(200, "added", 0))))
_written("supplier", "find_one_and_update", "SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT s_suppkey FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 1) THEN 'richest' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier", lambda r: r.find_one_and_update(f.exists("s_acctbal"), {"s_name": "richest"}, sort="-s_acctbal"))
_written("nation", "find_one_and_update_upsert", "SELECT * FROM nation UNION ALL VALUES (300, 'made', 4)", lambda r: r.find_one_and_update({"n_nationkey": 300}, Update({"n_name": "made"}, set_on_insert={"n_regionkey": 4}), upsert=True))
_written("nation", "increment", "SELECT n_nationkey, n_name, CASE WHEN n_nationkey = 6 THEN n_regionkey + 3 ELSE n_regionkey END::INT AS n_regionkey FROM nation", lambda r: (r.increment(6, "n_regionkey", 3), r.increment(-1, "n_regionkey")))
_written("nation", "get_or_create", "SELECT * FROM nation UNION ALL VALUES (400, 'fresh', 2)", lambda r: (r.get_or_create({"n_nationkey": 1}, {"n_name": "unused"}), r.get_or_create({"n_nationkey": 400}, {"n_name": "fresh", "n_regionkey": 2})))
_written(
    "nation", "bulk_write", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'west' WHEN n_nationkey = 0 THEN 'zero' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (4) AND n_regionkey <> 3 UNION ALL VALUES (500, 'bulk', 0), (501, 'up', NULL)",
    lambda r: r.bulk_write([
        {"insert_one": {"document": _nation(500, "bulk", 0)}}, {"update_many": {"filter": {"n_regionkey": 1}, "update": {"n_name": "west"}}}, {"delete_one": {"filter": {"n_nationkey": 4}}},
        {"delete_many": {"filter": {"n_regionkey": 3}}}, {"update_one": {"filter": {"n_nationkey": 501}, "update": {"n_name": "up"}, "upsert": True}}, {"replace_one": {"filter": {"n_nationkey": 0}, "replacement": {"n_name": "zero"}}},
    ]),
)


@query("SELECT 'nation' AS t, count(*)::BIGINT AS n FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 'region', count(*) + 1 FROM region")
def batch_multi(spark, sf_dir):
    ws = workspace(spark, sf_dir, "nation", "region")

    def build(b):
        b.insert("region", {"r_regionkey": 9, "r_name": "nine"})
        b.update("region", {"r_regionkey": 0}, {"r_name": "zero"})
        b.delete("nation", {"n_regionkey": 2})

    with_batch(ws, build)
    return ws.frame("nation").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nation").alias("t"), "n").unionByName(ws.frame("region").agg(F.count(F.lit(1)).alias("n")).select(F.lit("region").alias("t"), "n"))


@query("SELECT * FROM nation")
def transaction_rollback(spark, sf_dir):
    r = repo(spark, sf_dir, "nation")
    try:
        with r.transaction():
            r.delete_many(f.gte("n_nationkey", 0))
            r.create_many([_nation(1, "a", 0), _nation(1, "b", 0)])
    except ValueError:
        pass
    return r.df


# ---------------------------------------------------------------- policies


def _marked(spark, sf_dir) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", "o_totalprice", F.expr("CASE WHEN o_orderstatus = 'P' THEN '2024-01-01T00:00:00Z' END").alias("deletedAt"), F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN '2024-05-01T00:00:00Z' WHEN '2-HIGH' THEN '2024-07-01T00:00:00Z' END").alias("expiresAt"), F.col("o_orderstatus").alias("tenant"))


_MARKED = "(SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN '2024-01-01T00:00:00Z' END AS \"deletedAt\", CASE o_orderpriority WHEN '1-URGENT' THEN '2024-05-01T00:00:00Z' WHEN '2-HIGH' THEN '2024-07-01T00:00:00Z' END AS \"expiresAt\", o_orderstatus AS tenant FROM orders)"


def _marked_repo(spark, sf_dir, *plugins) -> Repository:
    return repo(spark, sf_dir, "m", m=_marked(spark, sf_dir), plugins=plugins)


@query(f"SELECT o_orderkey FROM {_MARKED} WHERE tenant = 'F' AND o_totalprice > 100000")
def tenant_scope(spark, sf_dir):
    return _marked_repo(spark, sf_dir, Tenancy("tenant", lambda ctx: "F")).find_all(f.gt("o_totalprice", 100000)).select("o_orderkey")


@query(f"SELECT count(*)::BIGINT AS n, max(o_totalprice) AS top FROM {_MARKED} WHERE tenant = 'F'")
def tenant_aggregate(spark, sf_dir):
    return _marked_repo(spark, sf_dir, Tenancy("tenant", lambda ctx: "F")).aggregate(AggRequest({"n": "count", "top": ("max", "o_totalprice")}))


@query(f'SELECT o_orderkey FROM {_MARKED} WHERE "deletedAt" IS NULL')
def soft_delete_live(spark, sf_dir):
    return _marked_repo(spark, sf_dir, SoftDelete()).find_all().select("o_orderkey")


@query(f'SELECT o_orderkey FROM {_MARKED} WHERE "deletedAt" IS NOT NULL')
def soft_delete_deleted(spark, sf_dir):
    return _marked_repo(spark, sf_dir, SoftDelete()).deleted_frame().select("o_orderkey")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey = 1 OR \"deletedAt\" IS NULL AND o_totalprice > 300000 THEN '{NOW}' ELSE \"deletedAt\" END AS \"deletedAt\" FROM {_MARKED}")
def soft_delete_bury(spark, sf_dir):
    r = _marked_repo(spark, sf_dir, SoftDelete())
    r.delete(1)
    r.delete_many(f.gt("o_totalprice", 300000))
    return r.df.select("o_orderkey", "deletedAt")


@query(f"SELECT o_orderkey FROM {_MARKED} WHERE \"expiresAt\" IS NULL OR \"expiresAt\" > '{NOW}'")
def ttl_live(spark, sf_dir):
    return _marked_repo(spark, sf_dir, Expiry()).find_all().select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_MARKED} WHERE \"expiresAt\" <= '{NOW}'")
def ttl_expired(spark, sf_dir):
    return _marked_repo(spark, sf_dir, Expiry()).expired_frame().select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_MARKED} WHERE \"expiresAt\" IS NULL OR \"expiresAt\"::TIMESTAMP + INTERVAL 86400 SECOND > TIMESTAMP '2024-06-01 00:00:00'")
def ttl_sweep(spark, sf_dir):
    r = _marked_repo(spark, sf_dir, Expiry(seconds=86400))
    r.sweep_expired()
    return r.df.select("o_orderkey")


@query(f"SELECT * FROM (VALUES (1, 'a', '{NOW}', '{NOW}'), (2, 'z', '2020', '{NOW}')) t(id, name, \"createdAt\", \"updatedAt\")")
def timestamp_stamp(spark, sf_dir):
    r = repo(spark, sf_dir, "s", s=spark.createDataFrame([(2, "b", "2020", "2020")], "id int, name string, createdAt string, updatedAt string"), plugins=[Timestamps()])
    r.create({"id": 1, "name": "a"})
    r.update(2, {"name": "z"})
    return r.df


@query(f"SELECT * FROM (VALUES ('nation', 'create', '900', '{NOW}'), ('nation', 'update', '900', '{NOW}'), ('nation', 'delete', '900', '{NOW}')) t(resource, action, document_id, timestamp)")
def audit_entries(spark, sf_dir):
    r = repo(spark, sf_dir, "nation", plugins=[Audit()])
    r.create(_nation(900, "x", 1))
    r.update(900, {"n_name": "y"})
    r.delete(900)
    return r.audit_frame().select("resource", "action", "document_id", "timestamp")


# ---------------------------------------------------------------- search

_FOLD = "list_filter(regexp_split_to_array(regexp_replace(translate(lower(coalesce(text, '')), '{a}', '{b}'), '[\\x{{0300}}-\\x{{036f}}]+', '', 'g'), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _tokens_sql() -> str:
    from larkspur.functions.columns import MARKED, PLAIN_

    return _FOLD.format(a=MARKED, b=PLAIN_)


def _fts(name: str, q: str, condition: str):
    def run(spark, sf_dir):
        r = repo(spark, sf_dir, "documents", plugins=[FullText(["text", "source"])])
        return r.search_hits(q).select("doc_id")

    run.__name__ = name
    query(f"WITH t AS (SELECT doc_id, source, {_tokens_sql()} AS w FROM documents), s AS (SELECT *, array_to_string(w, ' ') AS j FROM t) SELECT doc_id FROM s WHERE {condition}")(run)


_has = lambda w: f"list_contains(w, '{w}')"
_fts("fts_term", "Nicht", _has("nicht"))
_fts("fts_and", "the von", f"{_has('the')} AND {_has('von')}")
_fts("fts_or", "nicht OR leur", f"{_has('nicht')} OR {_has('leur')}")
_fts("fts_not", "the NOT with", f"{_has('the')} AND NOT {_has('with')}")
_fts("fts_phrase", '"and the"', "contains(' ' || j || ' ', ' and the ')")
_fts("fts_prefix", "nich* OR lico*", "len(list_filter(w, lambda x: starts_with(x, 'nich') OR starts_with(x, 'lico'))) > 0")
_fts("fts_column", "source:src3 the", f"source = 'src3' AND {_has('the')}")
_fts("fts_grammar", "(nicht OR the) AND (von OR with) NOT to", f"({_has('nicht')} OR {_has('the')}) AND ({_has('von')} OR {_has('with')}) AND NOT {_has('to')}")


@query(f"""
WITH t AS (SELECT doc_id, {_tokens_sql()} AS w FROM documents),
c AS (SELECT doc_id, len(w) AS dl, len(list_filter(w, lambda x: x = 'nicht'))::DOUBLE AS a, len(list_filter(w, lambda x: x = 'von'))::DOUBLE AS b FROM t),
g AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (WHERE a > 0) AS na, count(*) FILTER (WHERE b > 0) AS nb FROM c),
r AS (SELECT doc_id, a, b,
  greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * dl / mean)) + greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * dl / mean)) AS score FROM c, g)
SELECT doc_id, round(-score, 6) AS rank FROM r WHERE a > 0 OR b > 0
""")
def fts_bm25(spark, sf_dir):
    r = repo(spark, sf_dir, "documents", plugins=[FullText(["text"])])
    return r.search_hits("nicht OR von").select("doc_id", F.round("rank", 6).alias("rank"))


def _probe_vector(spark, sf_dir) -> list[float]:
    return list(spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id = 7").first()["embedding"])


_VEC = {
    "cosine": "1 - list_sum(list_transform(list_zip(e, q), lambda x: x[1] * x[2])) / (sqrt(list_sum(list_transform(e, lambda x: x * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x))))",
    "l2": "sqrt(list_sum(list_transform(list_zip(e, q), lambda x: (x[1] - x[2]) * (x[1] - x[2]))))",
    "l1": "list_sum(list_transform(list_zip(e, q), lambda x: abs(x[1] - x[2])))",
    "hamming": "list_sum(list_transform(list_zip(e, q), lambda x: CASE WHEN x[1] <> x[2] THEN 1.0::DOUBLE ELSE 0 END))",
}


def _vector_repo(spark, sf_dir, metric: str) -> Repository:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    ws = workspace(spark, sf_dir, embeddings_vec=e.select(F.col("vec_id").alias("rowid"), "embedding"), items=e.select("vec_id", "label"))
    return Repository(ws, "items", [Vectors(64, metric, "embeddings_vec")])


def _vec(metric: str):
    def run(spark, sf_dir):
        out = _vector_repo(spark, sf_dir, metric).similarity_hits(_probe_vector(spark, sf_dir), 10)
        return out.select("rowid", F.round("distance", 6).alias("distance"))

    run.__name__ = f"vec_{metric}"
    query(f"SELECT rowid, round(d, 6) AS distance FROM (SELECT vec_id AS rowid, {_VEC[metric]} AS d FROM (SELECT vec_id, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM embeddings)) ORDER BY d, rowid LIMIT 10")(run)


for _metric in _VEC:
    _vec(_metric)


@query(f"SELECT rowid, round(d, 6) AS distance FROM (SELECT rowid, {_VEC['l2']} AS d FROM (SELECT CASE vec_id WHEN 7 THEN 3 ELSE vec_id END AS rowid, embedding::DOUBLE[] AS e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7) AS q FROM embeddings WHERE vec_id <> 3)) ORDER BY d, rowid LIMIT 5")
def vec_after_changes(spark, sf_dir):
    r, q = _vector_repo(spark, sf_dir, "l2"), _probe_vector(spark, sf_dir)
    r.upsert_embedding(3, q)
    r.delete_embedding(7)
    return r.similarity_hits(q, 5).select("rowid", F.round("distance", 6).alias("distance"))


# ---------------------------------------------------------------- the rest


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def live_stream(spark, sf_dir):
    """The filter language over a stream, drained into memory."""
    import uuid

    from larkspur.streaming import live

    name = f"live_{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/nation.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "nation*.parquet").parquet(sf_dir)
    q = live(stream, {"n_regionkey": 1}).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@query("SELECT * FROM (VALUES ('Scan', 1), ('Filter', 1), ('HashAggregate', 2), ('Exchange', 1), ('pushed equality', 1), ('column read', 2), ('apart from the tree', 0)) t(what, n)")
def explain_plan(spark, sf_dir):
    """Operators of the plan of a filtered count by group, and what reaches its scan."""
    r = repo(spark, sf_dir, "orders")
    rows = r.explain(f.eq("o_orderstatus", "F"), AggRequest({"n": "count"}, "o_custkey"))
    of = lambda kind: sum(kind in x["detail"].split("(")[0].split("[")[0].split(" ") for x in rows)
    scan = next(x["detail"] for x in rows if "Scan" in x["detail"])
    known = {0} | {x["id"] for x in rows}
    odd = sum(x["parent"] not in known or x["parent"] >= x["id"] or x["notused"] != 0 for x in rows)
    out = [("Scan", sum("Scan parquet" in x["detail"] for x in rows)), *((k, of(k)) for k in ("Filter", "HashAggregate", "Exchange"))]
    out += [("pushed equality", scan.count("EqualTo(o_orderstatus,F)")), ("column read", scan.split("ReadSchema: struct<")[-1].split(">")[0].count(":")), ("apart from the tree", odd)]
    return _frame(spark, out, "what string, n int")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over 100,000 by status: count, sum and mean, of statuses with more than ten, largest first."""
    req = AggRequest({"n": "count", "total": ("sum", "o_totalprice"), "mean": ("avg", "o_totalprice")}, "o_orderstatus", f.gt("o_totalprice", 100000), f.gt("n", 10), "-n")
    return repo(spark, sf_dir, "orders").aggregate(req)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import larkspur.catalog_admin  # noqa: F401  registers its own

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    import larkspur.catalog_admin  # noqa: F401

    return dict(_sql)


__all__ = ["flagship", "oracle_sql", "queries"]
