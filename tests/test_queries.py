"""Golden lists of small fixtures: order is part of each."""

import datetime as dt

import pytest

from corvella.errors import QueryError, SchemaError
from corvella.functions.predicates import All, Any, Custom, Leaf, Not, field, path
from corvella.functions.text import split_words, tokens
from corvella.plans.query import Collection
from corvella.schema import CollectionSchema, Composite, Field, Index

META = Field("metadata", "object", fields=(Field("label", "string"),))
RECIPIENT = (Field("name", "string"), Field("address", "string"), META)
USERS = CollectionSchema(
    "users",
    (
        Field("dbId", "int", False, True), Field("name", "string"), Field("email", "string", index=Index()),
        Field("displayName", "string", index=Index(case_sensitive=False)), Field("accessToken", "string", index=Index("hash")),
        Field("bio", "string", index=Index("words", case_sensitive=False)), Field("active", "bool"), Field("createdAt", "datetime", index=Index()),
        Field("tags", "list", item=Field("item", "string"), index=Index("multiEntry", case_sensitive=False)),
        Field("primaryRecipient", "object", fields=RECIPIENT), Field("recipients", "list", item=Field("item", "object", fields=RECIPIENT)),
    ),
    (Composite("email_active", ("email", "active")),),
)


def users(spark, rows):
    def full(r):
        r = {"active": True, "createdAt": dt.datetime(2024, 1, r["dbId"]), "tags": [], "primaryRecipient": {"address": r["email"], "metadata": {"label": "seeded"}}} | r
        return tuple(r.get(f.name) for f in USERS.fields)

    return Collection(USERS, spark.createDataFrame([full(r) for r in rows], USERS.struct()))


@pytest.fixture(scope="module")
def seeded(spark):
    return users(spark, [
        {"dbId": 1, "name": "Ana", "email": "team@example.com", "accessToken": "token-team", "bio": "Flutter database", "tags": ["flutter", "database"]},
        {"dbId": 2, "name": "Ben", "email": "solo@example.com", "displayName": "same"},
        {"dbId": 3, "name": "Cid", "email": "team@example.com", "active": False, "accessToken": "token-team", "displayName": "same"},
        {"dbId": 4, "name": "Dee", "email": "team-alpha@example.com", "accessToken": "token-dee", "bio": "Flutter todo", "displayName": "same", "tags": ["Flutter", "todo"]},
    ])


def names(q):
    return q.property("name").find_all()


TEAM = lambda c: c.where().string_starts_with("email", "team")
CASES = [
    (lambda c: c.where().equal("email", "team@example.com"), ["Ana", "Cid"]),
    (TEAM, ["Dee", "Ana", "Cid"]),
    (lambda c: c.where().range("email", "solo@example.com", "team-alpha@example.com"), ["Ben", "Dee"]),
    (lambda c: c.where().composite_equal("email_active", ["team@example.com", True]), ["Ana"]),
    (lambda c: c.where().composite_equal("email_active", ["team@example.com", False]), ["Cid"]),
    (lambda c: c.where().equal("tags", "FLUTTER"), ["Ana", "Dee"]),
    (lambda c: c.where().equal("accessToken", "token-team"), ["Ana", "Cid"]),
    (lambda c: c.where().equal("displayName", "SAME"), ["Ben", "Cid", "Dee"]),
    (lambda c: c.where().equal("bio", "database"), ["Ana"]),
    (lambda c: c.where().words_start_with("bio", "flut"), ["Ana", "Dee"]),
    (lambda c: c.where().equal("bio", "!!!"), []),
    (lambda c: c.where().words_start_with("bio", "---"), []),
    (lambda c: c.filter(field("tags").is_empty()), ["Ben", "Cid"]),
    (lambda c: c.filter(field("tags").is_not_empty()), ["Ana", "Dee"]),
    (lambda c: c.filter(field("tags").length_equal_to(2)), ["Ana", "Dee"]),
    (lambda c: c.filter(field("tags").length_less_than(2)), ["Ben", "Cid"]),
    (lambda c: c.filter(field("tags").length_between(1, 2, include_upper=False)), []),
    (lambda c: c.filter(field("tags").element_equal_to("database")), ["Ana"]),
    (lambda c: c.filter(field("name").contains("e")), ["Ben", "Dee"]),
    (lambda c: c.filter(field("name").starts_with("A")), ["Ana"]),
    (lambda c: c.filter(field("name").ends_with("n")), ["Ben"]),
    (lambda c: c.filter(field("dbId").greater_than(2)), ["Cid", "Dee"]),
    (lambda c: c.filter(field("dbId").between(2, 3)), ["Ben", "Cid"]),
    (lambda c: TEAM(c).where_matches(Any((field("name").starts_with("A"), field("name").starts_with("D")))).where_matches(Not(field("active").equal_to(False))), ["Dee", "Ana"]),
    (lambda c: c.all().any_of(["Ana", "Dee"], lambda q, n: q.where_matches(field("name").equal_to(n))), ["Ana", "Dee"]),
    (lambda c: c.all().any_of([], lambda q, n: q), []),
    (lambda c: TEAM(c).all_of(["team", "example"], lambda q, n: q.where_matches(field("email").contains(n))).sort_by("dbId"), ["Ana", "Cid", "Dee"]),
    (lambda c: TEAM(c).all_of([], lambda q, n: q).sort_by("dbId"), ["Ana", "Cid", "Dee"]),
    (lambda c: c.all().sort_by("name", True).offset(1).limit(2), ["Cid", "Ben"]),
    (lambda c: c.filter(path("primaryRecipient", "metadata", "label").equal_to("seeded")).sort_by("displayName").then_by("active"), ["Ana", "Cid", "Ben", "Dee"]),
    (lambda c: c.all().sort_by("name").offset(10), []),
    (lambda c: c.filter(Not(field("displayName").equal_to("same"))), ["Ana"]),
    (lambda c: c.filter(field("missing").equal_to(1)), []),
    (lambda c: c.filter(Custom(lambda r: r["name"] == "Ben", python=True)), ["Ben"]),
    (lambda c: c.filter(field("createdAt").at_least(dt.datetime(2024, 1, 3))), ["Cid", "Dee"]),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_golden(seeded, k):
    make, expected = CASES[k]
    q = make(seeded)
    assert names(q) == expected
    assert q.count() == len(expected)


def test_projections_and_aggregates(seeded):
    q = seeded.all()
    assert q.limit(2).properties(["name", "active"]).find_all() == [{"name": "Ana", "active": True}, {"name": "Ben", "active": True}]
    p = q.property("dbId")
    assert (p.count(), p.min(), p.max()) == (4, 1, 4)
    a = seeded.filter(field("active").equal_to(True)).property("dbId")
    assert a.sum() == 7.0 and isinstance(a.sum(), float) and a.average() == pytest.approx(7 / 3)
    assert q.property("createdAt").min() == dt.datetime(2024, 1, 1) and q.property("name").max() == "Dee"
    none = seeded.filter(field("dbId").greater_than(9)).property("dbId")
    assert (none.sum(), none.average(), none.min(), none.count()) == (None, None, None, 0)
    for bad in (lambda: q.property("active").min(), lambda: q.property("name").sum()):
        with pytest.raises(QueryError):
            bad()
    assert q.property("displayName").find_all() == [None, "same", "same", "same"] and q.property("displayName").count() == 3
    assert seeded.filter(field("active").equal_to(True)).limit(2).count() == 2


def test_sort_distinct(spark):
    c = users(spark, [{"dbId": 1, "name": "Ana", "email": "z@example.com", "active": False}, {"dbId": 2, "name": "Ben", "email": "b@example.com"}, {"dbId": 3, "name": "Ana", "email": "a@example.com"}])
    email = lambda q: [e[0] for e in q.property("email").find_all()]
    assert email(c.all().sort_by("name").then_by("email", True)) == ["z", "a", "b"]
    assert email(c.all().sort_by("email").distinct_by("name")) == ["a", "b"]
    assert email(c.all().sort_by("email").distinct_by_fields(["name", "active"])) == ["a", "b", "z"]
    q = c.filter(field("active").equal_to(True)).sort_by("name").distinct_by("name").offset(1).limit(1)
    assert (names(q), q.count(), q.property("dbId").sum()) == (["Ben"], 1, 2.0)


def test_execution_order(spark):
    rows = [(1, "Bob", "team-a", True), (2, "Ana", "team-a", True), (3, "Cid", "team-c", True), (4, "Dee", "team-d", True), (5, "Eli", "solo", True), (6, "Fox", "team-f", False)]
    c = users(spark, [{"dbId": i, "name": n, "email": f"{e}@example.com", "active": a} for i, n, e, a in rows])
    q = c.all().limit(2).offset(1).distinct_by("email").sort_by("name").where_matches(field("active").equal_to(True)).string_starts_with("email", "team")
    assert names(q) == ["Cid", "Dee"]


def test_reads_by_id(seeded):
    assert [r and r.name for r in seeded.get_all([4, 9, 1, 4])] == ["Dee", None, "Ana", "Dee"]
    assert seeded.get(2).name == "Ben" and seeded.get(9) is None
    assert [r[0] for r in seeded.document_ids_page(1, 2).collect()] == [2, 3]
    assert [r[0] for r in seeded.project_ids([3, 9, 1], "name").collect()] == ["Cid", "Ana"]
    assert seeded.aggregate_ids([], "dbId", "count").first()[0] == 0


def test_predicates(spark):
    from pyspark.sql import Row

    df = spark.createDataFrame([Row(id=1, profile=Row(name="Ana", scores=[1, 2, 3], labels=[Row(value="admin", rank=1), Row(value="owner", rank=2)]), count=4, title="release notes", flag=True, tags=["dart", "flutter"], empty=[None][:0] or ["x"][:0], nothing=None)], "id long, profile struct<name:string,scores:array<long>,labels:array<struct<value:string,rank:long>>>, count long, title string, flag boolean, tags array<string>, empty array<string>, nothing string")
    yes = lambda p: df.where(p.compile(df.schema)).count() == 1
    for p in (path("profile", "name").equal_to("Ana"), path("profile", "labels", "value").equal_to("owner"), field("count").at_most(4), field("title").contains("notes"), field("tags").contains("dart"), field("empty").is_empty(), All(()), Not(field("flag").equal_to(False)), path("profile", "labels").contains({"value": "admin", "rank": 1}), path("profile", "scores").equal_to([1, 2, 3]), field("nothing").is_null(), All((path("profile", "labels", "value").equal_to("admin"), path("profile", "labels", "rank").equal_to(2)))):
        assert yes(p), p
    for p in (path("profile", "labels", "missing").equal_to("owner"), field("title").greater_than(1), field("flag").contains("true"), Any(()), field("title").length_equal_to(13), path("profile", "scores").equal_to([1, 2]), field("nothing").starts_with(""), field("nothing").less_than(3), path("profile", "labels").contains({"value": "admin"})):
        assert not yes(p), p
    with pytest.raises(ValueError):
        field("a").between()
    with pytest.raises(ValueError):
        field("a").equal_to(float("nan"))
    assert Leaf(("a",), "equal_to", 1) == Leaf(("a",), "equal_to", 1)


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "cast(id as string) s", "id * 2 as other").write.parquet(str(tmp_path / "t"))
    from corvella.schema import schema_of

    df = spark.read.parquet(str(tmp_path / "t"))
    q = Collection(schema_of("t", df.schema, "id"), df).filter(All((field("s").starts_with("1"), field("id").greater_than(0)))).compile().select("id")
    plan = q._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "StringStartsWith(s,1)" in plan and "GreaterThan(id,0)" in plan and "other" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_words(spark):
    text = "Café-rápido, café! Alpha ALPHA 42."
    assert split_words(text) == ["café", "rápido", "alpha", "42"]
    assert split_words("Alpha alpha ALPHA", True) == ["Alpha", "alpha", "ALPHA"]
    df = spark.createDataFrame([(text,), (None,)], "t string")
    assert [r[0] for r in df.select(tokens(df.t)).collect()] == [split_words(text), None]


def test_wrong_use(seeded):
    with pytest.raises(QueryError):
        seeded.where().string_starts_with("accessToken", "t")
    with pytest.raises(QueryError):
        seeded.where().equal("email", "a").equal("email", "b")
    with pytest.raises(QueryError):
        seeded.all().any_of([1], lambda q, i: q.limit(1))
    with pytest.raises(SchemaError):
        seeded.all().sort_by("missing")
    for bad in (lambda: seeded.all().limit(-1), lambda: seeded.where().range("email"), lambda: seeded.all().distinct_by_fields([]), lambda: seeded.all().properties([]), lambda: seeded.where().range("createdAt", True)):
        with pytest.raises(ValueError):
            bad()


def test_schema_rules():
    ok = USERS
    assert CollectionSchema.from_json(ok.to_json()) == ok
    ident = Field("id", "int", False, True)
    for fields in ((Field("a", "string"),), (ident, Field("a", "string"), Field("a", "int")), (ident, Field("a", "int", index=Index(case_sensitive=False))), (ident, Field("a", "int", index=Index("words"))), (ident, Field("a", "string", index=Index(replace=True))), (ident, Field("a", "string", index=Index("multiEntry")))):
        with pytest.raises(SchemaError):
            CollectionSchema("c", fields)
    old = CollectionSchema("c", (ident, Field("a", "string")))
    CollectionSchema("c", (ident, Field("a", "string"), Field("b", "int"))).compatible_with(old)
    for fields in ((ident,), (ident, Field("a", "int")), (ident, Field("a", "string", index=Index()))):
        with pytest.raises(SchemaError):
            CollectionSchema("c", fields).compatible_with(old)
