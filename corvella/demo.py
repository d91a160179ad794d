"""The registered queries of the collection engine over the driver's tables, each with SQL for a second engine."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvella.functions.predicates import All, Any, Custom, Not, field, path
from corvella.functions.text import tokens
from corvella.operators import mutations, relations
from corvella.plans.query import Collection
from corvella.schema import CollectionSchema, Composite, Field, Index, schema_of

IDS = {"orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "part": "p_partkey", "supplier": "s_suppkey", "nation": "n_nationkey", "events": "event_id", "embeddings": "vec_id", "pages": "page_id"}
INDEXES = {
    "orders": ({"o_orderstatus": Index("hash"), "o_totalprice": Index(), "o_orderdate": Index(), "o_custkey": Index(), "o_orderpriority": Index(case_sensitive=False)}, (Composite("status_priority", ("o_orderstatus", "o_orderpriority")),)),
    "part": ({"p_name": Index(), "p_brand": Index(case_sensitive=False)}, ()),
    "documents": ({"text": Index("words", case_sensitive=False), "lang": Index()}, ()),
    "customer": ({"c_name": Index(unique=True, replace=True)}, ()),
}
DAY = dt.datetime(1995, 6, 1)
TOKENS = r"list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'))"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def collection(spark: SparkSession, sf: str, name: str, frame: DataFrame | None = None) -> Collection:
    df = table(spark, sf, name) if frame is None else frame
    indexes, composites = INDEXES.get(name, ({}, ()))
    indexes = {k: v for k, v in indexes.items() if k in df.columns}
    return Collection(schema_of(name, df.schema, IDS[name], indexes, composites), df)


def baskets(spark: SparkSession, sf: str) -> Collection:
    """Orders with their line items as a list of objects."""
    item = F.struct(F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"))
    df = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("items"))
    return Collection(schema_of("baskets", df.schema, "l_orderkey"), df)


def catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """Word prefix, equality, a numeric filter, a descending sort and a page: the flagship query."""
    docs = collection(spark, sf, "documents")
    q = docs.where().words_start_with("text", "th").where_matches(field("lang").equal_to("en")).where_matches(field("n_chars").greater_than(100))
    return q.sort_by("n_chars", True).then_by("doc_id").offset(0).limit(20).properties(["doc_id", "source", "n_chars"]).frame()


def _orders(s, d):
    return collection(s, d, "orders")


def _items(s, d):
    df = table(s, d, "lineitem").withColumn("l_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return Collection(schema_of("items", df.schema, "l_id"), df)


def _keys(name, make):
    return lambda s, d: make(collection(s, d, name)).compile().select(IDS[name])


def _nullable_orders(s, d):
    df = table(s, d, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')")).withColumn("price", F.expr("case when o_custkey % 3 = 0 then null else o_totalprice end"))
    return collection(s, d, "orders", df)


def _aggregates(s, d):
    p = _orders(s, d).filter(field("o_orderstatus").equal_to("F"))
    price, key = p.property("o_totalprice"), p.property("o_custkey")
    parts = [key.aggregate_frame("count"), key.aggregate_frame("min"), key.aggregate_frame("max"), key.aggregate_frame("sum"), price.aggregate_frame("average").select(F.round("average", 4).alias("average"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))  # one row each
    return out


def _links(s, d):
    """Orders as documents that link to their customer."""
    rel = table(s, d, "orders").select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("source_id"), F.lit("customer").alias("link"), F.lit("customer").alias("target"), F.col("o_custkey").alias("target_id"))
    return rel


def _upsert_by_key(s, d):
    c = collection(s, d, "customer")
    new = c.frame().where("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("c_custkey"), "c_name", "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    fixed = mutations.reuse_ids(c.frame(), new, c.schema, ("c_name",))
    return mutations.upsert(c.frame(), fixed, "c_custkey").select("c_custkey", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


def _replace_unique(s, d):
    c = collection(s, d, "customer")
    new = c.frame().where("c_custkey % 10 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000)
    kept, gone = mutations.enforce_unique(c.frame(), new.withColumn("__n", F.col("c_custkey")), c.schema)
    return mutations.upsert(mutations.delete_ids(c.frame(), gone, "c_custkey"), kept, "c_custkey").select("c_custkey", "c_name")


def _words(s, d):
    return table(s, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), F.get(tokens(F.col("text")), 0).alias("first"))


def _update_window(s, d):
    q = _orders(s, d).where().sort_by("o_totalprice", True).limit(25)
    return mutations.update_all(q, {"o_orderpriority": "top"}).groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def _word_lists(s, d):
    """Parts with the words of their name as a list: empty for every seventh, with a null for every fifth."""
    df = table(s, d, "part").withColumn("words", F.expr("case when p_partkey % 7 = 0 then array() when p_partkey % 5 = 0 then array_append(split(p_name, ' '), null) else split(p_name, ' ') end"))
    return Collection(schema_of("part", df.schema, "p_partkey"), df)


WORD_LISTS = "(SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN [] WHEN p_partkey % 5 = 0 THEN list_append(string_split(p_name, ' '), NULL) ELSE string_split(p_name, ' ') END AS words FROM part)"


def _lists(test):
    return lambda s, d: _word_lists(s, d).filter(test).compile().select("p_partkey")


def _property_first(s, d):
    first = _orders(s, d).all().sort_by("o_totalprice", True).property("o_custkey").find_first()
    none = _orders(s, d).filter(field("o_custkey").equal_to(-1)).property("o_custkey").find_first()
    return s.createDataFrame([(first, none is None)], "first long, missing boolean")


def _first(s, d):
    row = _orders(s, d).filter(field("o_orderstatus").equal_to("F")).sort_by("o_totalprice").find_first()
    return s.createDataFrame([(row.o_orderkey, row.o_custkey)], "o_orderkey long, o_custkey long")


def _update_first(s, d):
    q = _orders(s, d).filter(field("o_orderstatus").equal_to("F")).sort_by("o_totalprice", True).limit(5).capped(1)
    return mutations.update_all(q, {"o_orderpriority": "first"}).select("o_orderkey", "o_orderpriority")


def _enum_names(s, d):
    df = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    status = Field("o_orderstatus", "enum", enum=(("finished", "F"), ("open", "O"), ("partial", "P")))
    orders = Collection(CollectionSchema("orders", (Field("o_orderkey", "int", False, True), status)), df)
    return orders.all().property("o_orderstatus", decode="enum").frame()


QUERIES = {
    "scan_all": (lambda s, d: _orders(s, d).all().compile().select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders"),
    "document_ids": (lambda s, d: _orders(s, d).document_ids(), "SELECT o_orderkey FROM orders"),
    "ids_page": (lambda s, d: _orders(s, d).document_ids_page(100, 1000), "SELECT o_orderkey FROM orders WHERE o_orderkey > 100 ORDER BY o_orderkey LIMIT 1000"),
    "get_one": (lambda s, d: (lambda r: s.createDataFrame([(r.o_orderkey, r.o_custkey)], "o_orderkey long, o_custkey long"))(_orders(s, d).get(7)), "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7"),
    "get_all": (lambda s, d: _orders(s, d).get_all_frame([5, 1, 999_999_999, 1]).select("pos", "o_orderkey", "o_custkey"), "SELECT pos::INT AS pos, o_orderkey, o_custkey FROM (VALUES (0, 5), (1, 1), (2, 999999999), (3, 1)) v(pos, id) LEFT JOIN orders ON id = o_orderkey"),
    "project_ids": (lambda s, d: _orders(s, d).project_ids([5, 1, 999_999_999], "o_custkey"), "SELECT o_custkey FROM orders WHERE o_orderkey IN (5, 1)"),
    "aggregate_ids": (lambda s, d: _orders(s, d).aggregate_ids([5, 1, 7], "o_custkey", "sum"), "SELECT sum(o_custkey)::DOUBLE AS sum FROM orders WHERE o_orderkey IN (5, 1, 7)"),
    "filter_ids": (lambda s, d: _orders(s, d).filter_ids([1, 2, 3, 4, 5, 6, 7, 8], field("o_totalprice").greater_than(100_000)), "SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 1 AND 8 AND o_totalprice > 100000"),
    "catalogue": (catalogue, rf"SELECT doc_id, source, n_chars FROM documents WHERE len(list_filter({TOKENS}, lambda t: starts_with(t, 'th'))) > 0 AND lang = 'en' AND n_chars > 100 ORDER BY n_chars DESC, doc_id LIMIT 20"),
    "index_equal": (_keys("orders", lambda c: c.where().equal("o_custkey", 37)), "SELECT o_orderkey FROM orders WHERE o_custkey = 37"),
    "index_equal_folded": (_keys("orders", lambda c: c.where().equal("o_orderpriority", "1-urgent")), "SELECT o_orderkey FROM orders WHERE lower(o_orderpriority) = '1-urgent'"),
    "index_hash": (_keys("orders", lambda c: c.where().equal("o_orderstatus", "P")), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "index_range": (_keys("orders", lambda c: c.where().range("o_totalprice", 50_000, 60_000.5)), "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000.5"),
    "index_date_range": (_keys("orders", lambda c: c.where().range("o_orderdate", DAY, None)), "SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01'"),
    "string_prefix": (_keys("part", lambda c: c.where().string_starts_with("p_name", "sm")), "SELECT p_partkey FROM part WHERE starts_with(p_name, 'sm')"),
    "string_prefix_folded": (_keys("part", lambda c: c.where().string_starts_with("p_brand", "BRAND#1")), "SELECT p_partkey FROM part WHERE starts_with(lower(p_brand), 'brand#1')"),
    "composite_equal": (_keys("orders", lambda c: c.where().composite_equal("status_priority", ["F", "1-URGENT"])), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'"),
    "words_equal": (_keys("documents", lambda c: c.where().equal("text", "The!")), rf"SELECT doc_id FROM documents WHERE list_contains({TOKENS}, 'the')"),
    "words_prefix": (_keys("documents", lambda c: c.where().words_start_with("text", "da")), rf"SELECT doc_id FROM documents WHERE len(list_filter({TOKENS}, lambda t: starts_with(t, 'da'))) > 0"),
    "words_none": (_keys("documents", lambda c: c.where().equal("text", "!!!")), "SELECT doc_id FROM documents WHERE false"),
    "token_count": (_words, rf"SELECT doc_id, len({TOKENS}) AS n_tokens, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')[1] AS first FROM documents"),
    "multi_entry": (lambda s, d: (lambda df: Collection(schema_of("part", df.schema, "p_partkey", {"words": Index("multiEntry", case_sensitive=False)}), df).where().equal("words", "RING").compile().select("p_partkey"))(table(s, d, "part").withColumn("words", F.split("p_name", " "))), "SELECT p_partkey FROM part WHERE list_contains(string_split(lower(p_name), ' '), 'ring')"),
    "compare_greater": (_keys("orders", lambda c: c.filter(field("o_totalprice").greater_than(250_000))), "SELECT o_orderkey FROM orders WHERE o_totalprice > 250000"),
    "compare_at_least": (_keys("orders", lambda c: c.filter(field("o_custkey").at_least(1000))), "SELECT o_orderkey FROM orders WHERE o_custkey >= 1000"),
    "compare_less_null": (lambda s, d: _nullable_orders(s, d).filter(field("price").less_than(50_000)).compile().select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0 AND o_totalprice < 50000"),
    "compare_at_most": (lambda s, d: _nullable_orders(s, d).filter(field("price").at_most(20_000)).compile().select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_custkey % 3 <> 0 AND o_totalprice <= 20000"),
    "between": (_keys("orders", lambda c: c.filter(field("o_custkey").between(10, 20))), "SELECT o_orderkey FROM orders WHERE o_custkey BETWEEN 10 AND 20"),
    "is_null": (lambda s, d: _nullable_orders(s, d).filter(field("status").equal_to(None)).compile().select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "get_none": (lambda s, d: s.createDataFrame([(_orders(s, d).get(-1) is None,)], "missing boolean"), "SELECT NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = -1) AS missing"),
    "get_many": (lambda s, d: _orders(s, d).get_all_frame([*range(3000, 0, -2)]).select("pos", "o_orderkey", "o_custkey"), "SELECT i::INT AS pos, o_orderkey, o_custkey FROM range(1500) t(i) LEFT JOIN orders ON o_orderkey = 3000 - 2 * i"),
    "contains": (_keys("part", lambda c: c.filter(field("p_name").contains("in"))), "SELECT p_partkey FROM part WHERE contains(p_name, 'in')"),
    "list_contains": (_lists(field("words").contains("ring")), f"SELECT p_partkey FROM {WORD_LISTS} WHERE list_contains(words, 'ring')"),
    "list_contains_null": (_lists(field("words").contains(None)), f"SELECT p_partkey FROM {WORD_LISTS} WHERE len(list_filter(words, lambda x: x IS NULL)) > 0"),
    "list_empty": (_lists(field("words").is_empty()), f"SELECT p_partkey FROM {WORD_LISTS} WHERE len(words) = 0"),
    "list_length_equal": (_lists(field("words").length_equal_to(3)), f"SELECT p_partkey FROM {WORD_LISTS} WHERE len(words) = 3"),
    "id_filter": (_keys("orders", lambda c: c.filter(All((field("o_orderkey").greater_than(500), Not(field("o_orderkey").at_least(600)))))), "SELECT o_orderkey FROM orders WHERE o_orderkey > 500 AND o_orderkey < 600"),
    "property_first": (_property_first, "SELECT (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) AS first, NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = -1) AS missing"),
    "find_first": (_first, "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice, o_orderkey LIMIT 1"),
    "enum_names": (_enum_names, "SELECT CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'partial' END AS o_orderstatus FROM orders"),
    "update_first": (_update_first, "SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderstatus <> 'F', o_totalprice DESC, o_orderkey) = 1 THEN 'first' ELSE o_orderpriority END AS o_orderpriority FROM orders"),
    "delete_first": (lambda s, d: mutations.delete_all(_orders(s, d).filter(field("o_orderstatus").equal_to("O")).sort_by("o_totalprice").capped(1)).select("o_orderkey"), "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderstatus <> 'O', o_totalprice, o_orderkey) > 1"),
    "links_replaced": (lambda s, d: relations.replace_links(_links(s, d), "orders", "customer", "customer", s.createDataFrame([(1, 5), (1, 6), (1, 6)], "source_id long, target_id long"), s.createDataFrame([(1,), (2,)], "source_id long")).select("source_id", "target_id"), "SELECT o_orderkey AS source_id, o_custkey AS target_id FROM orders WHERE o_orderkey NOT IN (1, 2) UNION ALL VALUES (1, 5), (1, 6)"),
    "ends_with": (_keys("pages", lambda c: c.filter(field("url").ends_with("1"))), "SELECT page_id FROM pages WHERE ends_with(url, '1')"),
    "starts_with": (_keys("pages", lambda c: c.filter(field("url").starts_with("https"))), "SELECT page_id FROM pages WHERE starts_with(url, 'https')"),
    "list_length": (lambda s, d: baskets(s, d).filter(field("items").length_between(3, 5, True, False)).compile().select("l_orderkey"), "SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3 AND count(*) < 5"),
    "list_not_empty": (_lists(field("words").is_not_empty()), f"SELECT p_partkey FROM {WORD_LISTS} WHERE len(words) > 0"),
    "list_any": (_keys("embeddings", lambda c: c.filter(Custom(lambda r: F.exists(r.embedding, lambda x: x > F.lit(0.3).cast("float"))))), "SELECT vec_id FROM embeddings WHERE len(list_filter(embedding, lambda x: x > 0.3::FLOAT)) > 0"),
    "nested_path": (lambda s, d: baskets(s, d).filter(path("items", "quantity").equal_to(50.0)).compile().select("l_orderkey"), "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity = 50"),
    "nested_independent": (lambda s, d: baskets(s, d).filter(All((path("items", "flag").equal_to("R"), path("items", "quantity").equal_to(50.0)))).compile().select("l_orderkey"), "SELECT DISTINCT l_orderkey FROM lineitem l WHERE l_quantity = 50 AND EXISTS (SELECT 1 FROM lineitem m WHERE m.l_orderkey = l.l_orderkey AND m.l_returnflag = 'R')"),
    "not_two_valued": (lambda s, d: _nullable_orders(s, d).filter(Not(field("status").equal_to("F"))).compile().select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_orderstatus, 'P') = 'F', false)"),
    "any_filter": (_keys("orders", lambda c: c.filter(Any((field("o_custkey").equal_to(7), field("o_totalprice").less_than(3000))))), "SELECT o_orderkey FROM orders WHERE o_custkey = 7 OR o_totalprice < 3000"),
    "any_of": (_keys("orders", lambda c: c.all().any_of([3, 8, 11], lambda q, k: q.where_matches(field("o_custkey").equal_to(k)))), "SELECT o_orderkey FROM orders WHERE o_custkey IN (3, 8, 11)"),
    "any_of_none": (_keys("orders", lambda c: c.all().any_of([], lambda q, k: q)), "SELECT o_orderkey FROM orders WHERE false"),
    "all_of": (_keys("part", lambda c: c.all().all_of(["a", "e"], lambda q, k: q.where_matches(field("p_name").contains(k)))), "SELECT p_partkey FROM part WHERE contains(p_name, 'a') AND contains(p_name, 'e')"),
    "optional_on": (_keys("part", lambda c: c.all().optional(True, lambda q: q.where_matches(field("p_size").equal_to(1)))), "SELECT p_partkey FROM part WHERE p_size = 1"),
    "optional_off": (_keys("part", lambda c: c.all().optional(False, lambda q: q.where_matches(field("p_size").equal_to(1)))), "SELECT p_partkey FROM part"),
    "unknown_field": (_keys("orders", lambda c: c.filter(field("nothing").equal_to(1))), "SELECT o_orderkey FROM orders WHERE false"),
    "sort_window": (lambda s, d: _orders(s, d).all().sort_by("o_totalprice", True).offset(5).limit(10).properties(["o_orderkey", "o_totalprice"]).frame(), "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 10 OFFSET 5"),
    "sort_then": (lambda s, d: _nullable_orders(s, d).all().sort_by("status").then_by("o_totalprice", True).limit(15).properties(["o_orderkey"]).frame(), "SELECT o_orderkey FROM orders ORDER BY nullif(o_orderstatus, 'P') NULLS FIRST, o_totalprice DESC, o_orderkey LIMIT 15"),
    "distinct_first": (lambda s, d: _orders(s, d).all().sort_by("o_totalprice", True).distinct_by("o_custkey").compile().select("o_orderkey", "o_custkey"), "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "distinct_fields": (lambda s, d: _orders(s, d).all().sort_by("o_orderdate").distinct_by_fields(["o_custkey", "o_orderstatus"]).compile().select("o_orderkey"), "SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate, o_orderkey) = 1"),
    "range_order_limit": (_keys("orders", lambda c: c.where().range("o_totalprice", 100_000, None).limit(9)), "SELECT o_orderkey FROM orders WHERE o_totalprice >= 100000 ORDER BY o_totalprice, o_orderkey LIMIT 9"),
    "count_windowed": (lambda s, d: _orders(s, d).all().offset(3).limit(7).count_frame(), "SELECT count(*) AS count FROM (SELECT 1 FROM orders LIMIT 7 OFFSET 3)"),
    "property": (lambda s, d: _orders(s, d).filter(field("o_orderstatus").equal_to("P")).property("o_custkey").frame(), "SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'"),
    "property_distinct": (lambda s, d: _orders(s, d).all().distinct_by("o_orderpriority").property("o_orderpriority").frame(), "SELECT DISTINCT o_orderpriority FROM orders"),
    "property_aggregates": (_aggregates, "SELECT count(o_custkey) AS count, min(o_custkey) AS min, max(o_custkey) AS max, sum(o_custkey)::DOUBLE AS sum, round(avg(o_totalprice), 4) AS average FROM orders WHERE o_orderstatus = 'F'"),
    "aggregate_windowed": (lambda s, d: _items(s, d).all().sort_by("l_quantity", True).limit(100).property("l_quantity").aggregate_frame("sum"), "SELECT sum(l_quantity) AS sum FROM (SELECT l_quantity FROM lineitem ORDER BY l_quantity DESC LIMIT 100)"),
    "group_by": (lambda s, d: _orders(s, d).group("o_orderstatus", n=F.count(F.lit(1)), keys=F.sum("o_custkey").cast("long")), "SELECT o_orderstatus, count(*) AS n, sum(o_custkey)::BIGINT AS keys FROM orders GROUP BY 1"),
    "link_load": (lambda s, d: relations.load_links(_links(s, d), "orders", "customer", table(s, d, "customer"), "c_custkey").select("source_id", "c_custkey", "c_name"), "SELECT o_orderkey AS source_id, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "link_one": (lambda s, d: relations.load_one(_links(s, d), "orders", "customer", table(s, d, "customer"), "c_custkey").select("source_id", "c_name"), "SELECT o_orderkey AS source_id, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "backlink_load": (lambda s, d: relations.load_backlinks(_links(s, d), "orders", "customer", table(s, d, "orders"), "o_orderkey").select("target_id", "o_orderkey"), "SELECT o_custkey AS target_id, o_orderkey FROM orders"),
    "update_all": (lambda s, d: mutations.update_all(_orders(s, d).filter(field("o_totalprice").less_than(10_000)), {"o_orderstatus": "X"}).select("o_orderkey", "o_orderstatus"), "SELECT o_orderkey, CASE WHEN o_totalprice < 10000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders"),
    "update_window": (_update_window, "SELECT CASE WHEN nth <= 25 THEN 'top' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) GROUP BY 1"),
    "delete_all": (lambda s, d: mutations.delete_all(_orders(s, d).filter(field("o_orderstatus").equal_to("F"))).select("o_orderkey"), "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'"),
    "delete_window": (lambda s, d: mutations.delete_all(_orders(s, d).all().limit(10)).select("o_orderkey"), "SELECT o_orderkey FROM orders ORDER BY o_orderkey OFFSET 10"),
    "upsert_by_key": (_upsert_by_key, "SELECT c_custkey, c_name, round(CASE WHEN c_custkey % 10 = 0 THEN c_acctbal + 1 ELSE c_acctbal END, 2) AS c_acctbal FROM customer"),
    "replace_unique": (_replace_unique, "SELECT CASE WHEN c_custkey % 10 = 0 THEN c_custkey + 10000000 ELSE c_custkey END AS c_custkey, c_name FROM customer"),
}
