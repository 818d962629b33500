"""Small tables with the constraints that the scenarios need."""

from pyspark.sql import types as T

from larkspur.sources.store import MemoryStore
from larkspur.sources.tables import ColumnDef, TableDef
from larkspur.sources.workspace import Workspace

S, B, L, D = T.StringType(), T.BooleanType(), T.LongType(), T.DoubleType()

USERS = TableDef(
    "users",
    {
        "id": ColumnDef(S, False), "name": ColumnDef(S, False), "email": ColumnDef(S, False), "role": ColumnDef(S, False, "reader", enum=("reader", "admin", "editor")), "age": ColumnDef(L),
        "active": ColumnDef(B, False, True), "deletedAt": ColumnDef(S), "createdAt": ColumnDef(S), "updatedAt": ColumnDef(S), "organizationId": ColumnDef(S),
    },
    "id", unique=(("email",),),
)
SESSIONS = TableDef("sessions", {"id": ColumnDef(S, False), "userId": ColumnDef(S, False), "expiresAt": ColumnDef(S)}, "id")
POSTS = TableDef("posts", {"id": ColumnDef(L, False), "slug": ColumnDef(S, False), "title": ColumnDef(S, False), "body": ColumnDef(S, False)}, "id", unique=(("slug",),), autoincrement=True)
DEPARTMENTS = TableDef("departments", {"id": ColumnDef(S, False), "name": ColumnDef(S, False), "active": ColumnDef(B, False, True)}, "id")
EMPLOYEES = TableDef("employees", {"id": ColumnDef(S, False), "name": ColumnDef(S, False), "departmentId": ColumnDef(S)}, "id")
TASKS = TableDef("tasks", {"id": ColumnDef(S, False), "employeeId": ColumnDef(S, False), "title": ColumnDef(S, False), "status": ColumnDef(S, False, "open")}, "id")
NOW = "2024-06-01T00:00:00Z"


def user(i, name="N", role="reader", age=None, **more):
    return {"id": i, "name": name, "email": f"{i}@x", "role": role, "age": age, **more}


def workspace(spark, store=None, **rows):
    """rows: by table name, of the definitions above."""
    ws = Workspace(spark, store or MemoryStore(spark), clock=lambda: NOW)
    for t in (USERS, SESSIONS, POSTS, DEPARTMENTS, EMPLOYEES, TASKS):
        if t.name in rows:
            ws.register(t, t.frame(spark, [t.complete(r) for r in rows[t.name]]))
    return ws


PEOPLE = [
    user("u1", "Alice", "admin", 30), user("u2", "Bob", "editor", 25), user("u3", "Carol", "reader", 40, active=False),
    user("u4", "Dave", "reader", 35, deletedAt="2024-01-01T00:00:00Z"),
]
