import datetime as dt
import time

import pytest

from corvella.errors import ClosedError, EngineError, QueryError, SchemaError, TransactionError, UniqueIndexError
from corvella.functions.predicates import field
from corvella.schema import CollectionSchema, Field, Index, Link
from corvella.sources.backup import export_backup, import_backup
from corvella.sources.migration import Plan, Step
from corvella.sources.store import Database
from corvella.sources.sync import SyncConfig
from corvella.streaming import watch

ID = Field("dbId", "int", False, True)
ACCOUNTS = CollectionSchema("accounts", (ID, Field("user_name", "string", index=Index(unique=True, replace=True)), Field("display_label", "string")))
MEMBERS = CollectionSchema("members", (ID, Field("username", "string", index=Index(unique=True)), Field("age", "int")))
ARTISTS = CollectionSchema("artists", (ID, Field("name", "string")), links=(Link("songs", "songs", backlink_of="featured"),))
SONGS = CollectionSchema("songs", (ID, Field("title", "string")), links=(Link("featured", "artists"), Link("primary", "artists", many=False)))


@pytest.fixture()
def db(spark, tmp_path):
    out = Database.open(spark, str(tmp_path / "db"), [ACCOUNTS, MEMBERS, ARTISTS, SONGS])
    yield out
    out.close()


def rows(db, name):
    return [tuple(r) for r in db.collection(name).all().find_all()]


def test_put_delete_ids(db, spark):
    assert db.put("members", {"username": "a", "age": 3}) == 1
    assert db.put_all("members", [{"username": "b", "age": 4}, {"dbId": 9, "username": "c", "age": 5}]) == 2
    assert db.put("members", {"username": "d"}) == 10
    assert db.delete("members", 10) and not db.delete("members", 10)
    assert db.put("members", {"username": "e"}) == 11
    with pytest.raises(ValueError):
        db.put_all("members", [{"dbId": 5, "username": "x"}, {"dbId": 5, "username": "y"}])
    with pytest.raises(UniqueIndexError):
        db.put("members", {"username": "a"})
    db.put("members", {"dbId": 1, "username": "a", "age": 30})
    assert rows(db, "members")[0] == (1, "a", 30) and len(rows(db, "members")) == 4
    before = rows(db, "members")
    db.compact()
    assert rows(db, "members") == before and not db.manifest()["collections"]["members"]["layers"]
    again = Database.open(spark, db.root, [MEMBERS])
    assert rows(again, "members") == before
    db.close()
    db.close()
    with pytest.raises(ClosedError):
        db.manifest()


def test_replace_and_natural_keys(db):
    db.put("accounts", {"user_name": "ana", "display_label": "A"})
    db.put_all_by("accounts", ("user_name",), [{"user_name": "ana", "display_label": "B"}, {"user_name": "ben", "display_label": "C"}])
    assert [r[1:] for r in rows(db, "accounts")] == [("ana", "B"), ("ben", "C")] and rows(db, "accounts")[0][0] == 1
    db.put("accounts", {"dbId": 50, "user_name": "ana", "display_label": "D"})
    assert sorted(r[1:] for r in rows(db, "accounts")) == [("ana", "D"), ("ben", "C")]
    with pytest.raises(QueryError):
        db.put_all_by("members", ("username",), [])


def test_transactions(db):
    with pytest.raises(RuntimeError):
        with db.write_txn():
            assert db.put("members", {"username": "a"}) == 1
            assert len(rows(db, "members")) == 1
            raise RuntimeError
    assert rows(db, "members") == [] and db.put("members", {"username": "a"}) == 1
    with db.read_txn(), pytest.raises(TransactionError):
        db.put("members", {"username": "b"})
    with db.write_txn(), pytest.raises(TransactionError):
        with db.write_txn():
            pass
    other = Database.open(db.spark, db.root)
    with pytest.raises(TransactionError):
        with db.write_txn():
            db.put("members", {"username": "x"})
            other.put("members", {"username": "y"})


def test_query_mutations(db):
    db.put_all("members", [{"dbId": i, "username": f"u{i}", "age": i} for i in range(1, 6)])
    q = db.collection("members").filter(field("age").greater_than(2))
    assert db.update_query(q, {"age": 99}) == 3 and db.update_query(q, {}) == 0
    assert [r[2] for r in rows(db, "members")] == [1, 2, 99, 99, 99]
    assert db.update_first(db.collection("members").all().sort_by("dbId", True), {"age": 7})
    assert db.delete_first(db.collection("members").all()) and db.delete_query(q) == 3
    assert [r[0] for r in rows(db, "members")] == [2]
    for bad in ({"dbId": 3}, {"age": object()}):
        with pytest.raises(ValueError):
            db.update_query(q, bad)


def test_links(db):
    db.put("artists", {"dbId": 1, "name": "Ana"})
    db.put("artists", {"dbId": 2, "name": "Ben"})
    db.put("songs", {"dbId": 10, "title": "Ship It"})
    db.save_links("songs", "featured", 10, [2, 1, 2])
    assert [r.name for r in db.load_links("songs", "featured", 10).collect()] == ["Ana", "Ben"]
    assert [r.title for r in db.load_links("artists", "songs", 1).collect()] == ["Ship It"]
    db.save_links("songs", "primary", 10, [1])
    db.save_links("songs", "primary", 10, [])
    assert db.load_links("songs", "primary", 10).collect() == []
    for call in (lambda: db.save_links("songs", "featured", 10, [404]), lambda: db.save_links("artists", "songs", 1, [10])):
        with pytest.raises(QueryError):
            call()
    db.delete("artists", 1)
    assert [r.name for r in db.load_links("songs", "featured", 10).collect()] == ["Ben"]


def test_backup(db, spark, tmp_path):
    db.put_all("members", [{"username": "a", "age": None}, {"username": "b", "age": 2}])
    export_backup(db, str(tmp_path / "dump"), gzip=True)
    fresh = Database.open(spark, str(tmp_path / "other"))
    assert import_backup(fresh, str(tmp_path / "dump")) == 2 and rows(fresh, "members") == rows(db, "members")
    with pytest.raises(EngineError):
        import_backup(fresh, str(tmp_path / "dump"))


def test_migration(spark, tmp_path):
    root = str(tmp_path / "m")
    v1 = CollectionSchema("people", (ID, Field("name", "string")))
    v2 = CollectionSchema("people", (ID, Field("full", "string")))
    old = Database.open(spark, root, [v1])
    old.put("people", {"name": "Ana"})
    with pytest.raises(SchemaError):
        Database.open(spark, root, [v2])
    step = Step(0, 2, lambda m: m.import_documents("people", m.export_documents("people").withColumnRenamed("name", "full"), v2))
    new = Database.open(spark, root, [v2], migration=Plan(2, (step,)))
    assert rows(new, "people") == [(1, "Ana")] and new.migration_version == 2 and new.schema_version("people") == 2
    assert Database.open(spark, str(tmp_path / "fresh"), [v2], migration=Plan(2, (step,))).migration_version == 2
    with pytest.raises(SchemaError):
        Database.open(spark, root, [v2], migration=Plan(5, (step,)))


class Adapter:
    def __init__(self, accept=lambda m: True):
        self.got, self.accept = [], accept

    def push(self, request):
        self.got.append(request)
        return {"accepted": [m["mutation_id"] for m in request["mutations"] if self.accept(m)]}

    def pull(self, request):
        n = (request["checkpoint"] or 0) + 1
        return {"checkpoint": n, "changes": [{"kind": "upsert", "collection": "members", "documents": [{"dbId": 70, "username": "remote", "age": n}]}]}


def test_sync(spark, tmp_path):
    a = Adapter()
    db = Database.open(spark, str(tmp_path / "s"), [MEMBERS], sync=a)
    db.put("members", {"username": "mine"})
    assert db.sync.pending_count() == 1 and db.sync.cycle() == "idle" and db.sync.pending() == []
    m = a.got[0]["mutations"][0]
    assert (m["operation"], m["document_id"], m["document"]["username"], m["mutation_id"]) == ("upsert", 1, "mine", f"{db.sync.client}:1")
    assert a.got[0]["schema_versions"] == {"members": 1}
    assert [r[1] for r in rows(db, "members")] == ["mine", "remote"]
    with pytest.raises(QueryError):
        db.update_query(db.collection("members").all(), {"age": 1})
    a.pull = lambda c: (_ for _ in ()).throw(ConnectionError())
    assert db.sync.cycle() == "offline"


def test_sync_sends_batches_of_documents(spark, tmp_path):
    a = Adapter(lambda m: m["document_id"] != 2)  # never accepts document 2
    db = Database.open(spark, str(tmp_path / "s"), [MEMBERS], sync=SyncConfig(a, client="me", auto_start=False, batch=3))
    db.put_all("members", [{"username": f"u{i}", "age": i} for i in range(7)])
    db.delete("members", 5)
    for _ in range(4):
        db.compact()  # files that the outbox needs stay
        assert db.sync.cycle() == "idle"
    sent = [[m["sequence"] for m in r["mutations"]] for r in a.got]
    assert sent == [[1, 2, 3], [2, 4, 5], [2, 6, 7], [2, 8]] and a.got[3]["mutations"][1]["operation"] == "delete"
    assert [m["mutation_id"] for m in db.sync.pending()] == ["me:2"] and Database.open(spark, db.root).manifest()["sync"]["client"] == "me"


def test_sync_runs_in_the_background(spark, tmp_path):
    a, phases = Adapter(), []
    db = Database.open(spark, str(tmp_path / "s"), [MEMBERS], sync=SyncConfig(a, interval=0.05, on_status=lambda s: phases.append(s["phase"])))
    db.put("members", {"username": "mine", "age": 1})
    until = time.time() + 60
    while db.sync.pending_count() and time.time() < until:
        time.sleep(0.1)
    db.close()
    assert any(r["mutations"] for r in a.got) and not db.sync.thread.is_alive() and {"syncing", "idle"} <= {*phases} and phases[-1] == "idle"


# faults of earlier versions

TAGS = CollectionSchema("tags", (ID, Field("key", "string", index=Index(unique=True, replace=True)), Field("code", "int", index=Index(unique=True)), Field("n", "int")))


def test_updates_keep_replace_keys_unique(db):
    db.register(TAGS)
    db.put_all("tags", [{"dbId": i, "key": f"k{i}", "n": i} for i in (1, 2, 3)])
    assert db.update_query(db.collection("tags").filter(field("n").at_least(2)), {"key": "k1"}) == 2
    assert rows(db, "tags") == [(3, "k1", None, 3)]  # one after the other, the last update holds the key
    with pytest.raises(UniqueIndexError):
        db.put_all("tags", [{"key": "x", "code": 1}, {"key": "y", "code": 1}])
    db.put("tags", {"key": "x", "code": 1})
    with pytest.raises(UniqueIndexError):
        db.update_query(db.collection("tags").filter(field("key").equal_to("k1")), {"code": 1})
    assert [r[2] for r in rows(db, "tags")] == [None, 1]


def test_replace_keys_of_one_batch_go_in_order(db, spark):
    db.put_all("accounts", [{"user_name": "a", "display_label": "1"}, {"user_name": "b", "display_label": "2"}, {"user_name": "a", "display_label": "3"}])
    assert [r[1:] for r in rows(db, "accounts")] == [("b", "2"), ("a", "3")]
    # a row of the base that the batch writes and then replaces is gone
    (b, _, _), (a, _, _) = rows(db, "accounts")
    db.put_all("accounts", [{"dbId": b, "user_name": "c", "display_label": "4"}, {"user_name": "c", "display_label": "5"}])
    assert [r[1:] for r in rows(db, "accounts")] == [("a", "3"), ("c", "5")]
    frame = spark.createDataFrame([(None, "z", str(i)) for i in range(20)], "dbId long, user_name string, display_label string").coalesce(1)
    db.put_all("accounts", frame)
    assert [r[1:] for r in rows(db, "accounts")] == [("a", "3"), ("c", "5"), ("z", "19")]


def test_negative_ids_are_refused_and_new_ones_are_whole(db, spark):
    for batch in ([{"dbId": -5, "username": "a"}, {"username": "b"}], spark.createDataFrame([(-5, "a", 1), (None, "b", 2)], "dbId long, username string, age long")):
        with pytest.raises(ValueError):
            db.put_all("members", batch)
    assert rows(db, "members") == []
    frame = spark.range(100).selectExpr("cast(null as long) as dbId", "concat('u', id) as username", "id as age").repartition(7)
    assert db.put_all("members", frame) == 100 and [r[0] for r in rows(db, "members")] == [*range(1, 101)]
    mixed = spark.createDataFrame([(101, "m1", 0), (None, "m2", 0), (-1, "m3", 0), (103, "m4", 0)], "dbId long, username string, age long")
    assert db.put_all("members", mixed) == 4 and len({r[0] for r in rows(db, "members")}) == 104
    assert not db.files.names(f"{db.root}/staging")


def test_migration_changes_types(spark, tmp_path):
    v1 = CollectionSchema("people", (ID, Field("age", "string"), Field("old", "string")))
    v2 = CollectionSchema("people", (ID, Field("age", "int"), Field("new", "string")))
    for name, steps in (("import", (Step(0, 2, lambda m: m.import_documents("people", m.export_documents("people").where("age <> 'x'").selectExpr("dbId", "int(age) as age", "upper(old) as new"), v2)),)), ("cast", (Step(0, 2, lambda m: None, (v2,)),))):
        old = Database.open(spark, str(tmp_path / name), [v1])
        old.put_all("people", [{"age": "7", "old": "a"}, {"age": "x", "old": "b"}])
        old.put("people", {"dbId": 1, "age": "8", "old": "c"})
        new = Database.open(spark, old.root, [v2], migration=Plan(2, steps))
        assert rows(new, "people") == ([(1, 8, "C")] if name == "import" else [(1, 8, None), (2, None, None)])
        assert new.put("people", {"age": 3}) == 3


def test_backup_keeps_microseconds_at_any_depth(spark, tmp_path):
    time_ = lambda n: Field(n, "datetime")
    schema = CollectionSchema("visits", (ID, time_("at"), Field("o", "object", fields=(time_("x"), Field("many", "list", item=time_("item"))))))
    t = dt.datetime(2024, 5, 6, 7, 8, 9, 678901)
    one, two = Database.open(spark, str(tmp_path / "a"), [schema]), Database.open(spark, str(tmp_path / "b"))
    one.put_all("visits", spark.createDataFrame([(1, t, (t, [t, None])), (2, None, None), (3, t, (None, None))], schema.struct()))
    export_backup(one, str(tmp_path / "dump"))
    assert import_backup(two, str(tmp_path / "dump")) == 3 and rows(two, "visits") == rows(one, "visits") and rows(two, "visits")[0][2].many[0] == t


def test_compact_frees_space(db):
    for i in range(3):
        db.put("members", {"dbId": 1, "username": f"u{i}"})
    db.put("artists", {"dbId": 1, "name": "Ana"})
    db.put("songs", {"dbId": 2, "title": "T"})
    db.save_links("songs", "featured", 2, [1])
    db.save_links("songs", "primary", 2, [1])
    db.save_links("songs", "featured", 2, [])
    before = db.relations().collect()
    db.compact()
    assert len(db.files.names(f"{db.root}/manifest")) == 1 and all(len(db.files.names(f"{db.root}/data/{c}")) == 1 for c in ("members", "artists", "songs"))
    assert len(db.files.names(f"{db.root}/relations")) == 1 and db.relations().collect() == before and len(before) == 1
    again = Database.open(db.spark, db.root)
    assert rows(again, "members") == [(1, "u2", None)] and again.put("members", {"username": "next"}) == 2


def test_in_memory_goes_with_close(spark):
    db = Database.open_in_memory(spark, [MEMBERS])
    db.put("members", {"username": "a"})
    files, root = db.files, db.root
    assert files.names(root)
    db.close()
    assert not files.names(root)


def test_watchers(db):
    db.put("members", {"dbId": 1, "username": "a", "age": 1})
    seen, objects, lazy = [], [], []
    q = db.collection("members").filter(field("age").greater_than(5))
    w = watch.watch_query(db, q, lambda r: seen.append([x.username for x in r]))
    o = watch.watch_object(db, "members", 1, lambda r: objects.append(r and r.age))
    z = watch.watch_collection_lazy(db, "members", lazy.append)
    db.put("members", {"dbId": 2, "username": "b", "age": 9})
    db.put("members", {"dbId": 3, "username": "c", "age": 2})
    for x in (w, o, z):
        x.settle()
    db.put("members", {"dbId": 1, "username": "a", "age": 4})
    db.delete("members", 2)
    for x in (w, o, z):
        x.settle()
    assert seen[0] == [] and ["b"] in seen and seen[-1] == [] and objects[0] == 1 and objects[-1] == 4 and lazy
    assert db.changes().where("collection = 'members'").count() == 5


def test_collection_watchers_give_equal_states_once(db):
    seen, frames = [], []
    w = watch.watch_collection(db, "members", lambda r: seen.append([x.username for x in r]))
    f = watch.watch_query(db, db.collection("members").all(), frames.append, frames=True)
    db.put("members", {"dbId": 1, "username": "a"})
    w.settle()
    db.put("members", {"dbId": 1, "username": "a"})
    w.settle()
    db.compact()  # the files of the last result are gone
    db.put("members", {"dbId": 2, "username": "b"})
    for x in (w, f):
        x.settle()
    assert seen == [[], ["a"], ["a", "b"]] and [r.username for r in frames[-1].collect()] == ["a", "b"]
