import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators.documents import DocumentCollection, check_document, index_changes, latest, parse_aggregate, parse_documents, to_body
from tidemark.operators.request import answer, key_of_path, parse_request
from tidemark.types import BadRequest, EmptyDocument, InvalidAggregate, InvalidJSON, InvalidOption, MethodNotAllowed


def collection(spark, docs):
    rows = [(k, json.dumps(d)) for k, d in docs.items()]
    return DocumentCollection(spark.createDataFrame(rows, "_id string, body string").select("_id", F.try_parse_json("body").alias("doc")))


def ids(df):
    return [r["_id"] for r in df.select("_id").collect()]


def test_text_equality(spark):
    docs = collection(spark, {"a": {"n": 22}, "b": {"n": "22"}, "c": {"n": 22.0}, "d": {"n": "22.0"}, "e": {"n": True}, "f": {"n": "true"}, "g": {"n": None}, "h": {"n": {"x": 1}}, "i": {"n": [1]}, "j": {"m": 1}, "k": {"n": 1000000}})
    assert ids(docs.find("n", "22")) == ["a", "b", "c"]
    assert ids(docs.find("n", 22)) == ["a", "b", "c"]
    assert ids(docs.find("n", "22.0")) == ["d"]
    assert ids(docs.find("n", True)) == ["e", "f"]
    assert ids(docs.find("n", None)) == ["g"]
    assert ids(docs.find("n", "1000000")) == []
    assert ids(docs.find("n", "1e+06")) == ["k"]
    assert ids(docs.find("n", "map[x:1]")) == []
    assert ids(docs.find("_id", "a")) == []


def test_nested_fields_are_not_indexed(spark):
    docs = collection(spark, {"d": {"meta": {"k": "v"}, "tags": ["a", "b"], "active": True}})
    assert [r["field"] for r in docs.indexed_fields().collect()] == ["active"]
    assert ids(docs.find("active", "true")) == ["d"]


def test_fields_are_sorted_and_index_finds_the_same(spark):
    docs = collection(spark, {"1": {"zebra": 1, "alpha": 2, "middle": 3.5}, "2": {"alpha": 2, "middle": None}})
    assert [r["field"] for r in docs.indexed_fields().orderBy("field").collect()] == ["alpha", "middle", "zebra"]
    pairs = docs.pairs()
    for field, value in (("alpha", 2), ("middle", 3.5), ("middle", None), ("zebra", "1"), ("zebra", 9)):
        assert ids(docs.find_by_index(pairs, field, value)) == ids(docs.find(field, value))


def test_pagination(spark):
    docs = collection(spark, {f"d{k}": {"city": "Chennai", "rank": k} for k in range(5)})
    page = lambda limit, offset: ids(docs.find("city", "Chennai", limit, offset))
    assert page(2, 0) == ["d0", "d1"]
    assert page(-1, 3) == ["d3", "d4"]
    assert page(2, 1) == ["d1", "d2"]
    assert page(10, 0) == [f"d{k}" for k in range(5)]
    assert page(2, 10) == [] and page(0, 0) == []
    assert ids(docs.find_one("city", "Chennai")) == ["d0"] and ids(docs.find_one("city", "x")) == []


def test_sorting_puts_missing_last(spark):
    docs = collection(spark, {"1": {"c": 1, "name": "bravo", "age": 30, "on": True}, "2": {"c": 1, "name": "alpha", "age": 10, "on": False}, "3": {"c": 1, "name": "charlie", "age": 20, "on": True}, "4": {"c": 1, "age": None}})
    expected = {"name": "2134", "-name": "3124", "age": "2314", "-age": "1324", "on": "2134", "-on": "1324", "nope": "1234", "-nope": "1234"}
    for sort, order in expected.items():
        assert "".join(ids(docs.find("c", 1, sort=sort))) == order, sort


def test_sorting_is_stable_and_mixed_types_have_an_order(spark):
    docs = collection(spark, {"a": {"c": 1, "s": 10}, "b": {"c": 1, "s": 10}, "c": {"c": 1, "s": 5}})
    assert ids(docs.find("c", 1, sort="s", limit=1, offset=1)) == ["a"]
    mixed = collection(spark, {"a": {"c": 1, "s": "x"}, "b": {"c": 1, "s": 2}, "c": {"c": 1, "s": True}, "d": {"c": 1, "s": [1]}, "e": {"c": 1}})
    assert ids(mixed.find("c", 1, sort="s")) == ["c", "b", "a", "d", "e"]
    assert ids(mixed.find("c", 1, sort="-s")) == ["d", "a", "b", "c", "e"]


def test_aggregates_use_numbers_only(spark):
    docs = collection(spark, {"1": {"city": "C", "age": 10}, "2": {"city": "C", "age": 20}, "3": {"city": "C", "age": "7"}, "4": {"city": "C"}, "5": {"city": "B", "age": 100}})
    run = lambda spec, city="C": docs.aggregate("city", city, spec).first().asDict()
    assert run("count") == {"count": 4}
    assert run("sum:age") == {"field": "age", "sum": 30.0}
    assert run("avg:age") == {"field": "age", "average": 15.0}
    assert run("min:age") == {"field": "age", "minimum": 10.0}
    assert run("max:age") == {"field": "age", "maximum": 20.0}
    assert run("sum:nope") == {"field": "nope", "sum": None}
    assert run("count", "nowhere") == {"count": 0}


def test_aggregate_grammar():
    assert parse_aggregate("sum:a:b") == ("sum", "a:b")
    for spec in ("count:x", "sum", "sum:", "median:a", ""):
        with pytest.raises(InvalidAggregate):
            parse_aggregate(spec)


def test_typed_columns_behave_like_variants(spark):
    data = [("a", "x", 1, True), ("b", "y", 2, False), ("c", None, None, None), ("d", "2", 2, True)]
    typed = DocumentCollection(spark.createDataFrame(data, "_id string, s string, n long, b boolean"), ["s", "n", "b"])
    body = collection(spark, {i: {"s": s, "n": n, "b": b} for i, s, n, b in data})
    for field, value in (("s", "2"), ("n", "2"), ("n", 2.0), ("b", "true"), ("s", None), ("n", None), ("n", "x"), ("zz", "1")):
        assert ids(typed.find(field, value)) == ids(body.find(field, value)), (field, value)
    for sort in ("s", "-s", "n", "-n", "b", "-b"):
        everything = lambda c, sort=sort: ids(c.df.orderBy(*c.order(sort)))
        assert everything(typed) == everything(body), sort
    assert sorted(map(tuple, typed.pairs().collect())) == sorted(map(tuple, body.pairs().collect()))


def test_filters_reach_the_scan(spark, sf_dir):
    from tidemark.plans.catalog import event_documents

    plan = event_documents(spark, sf_dir).find("event_type", "click", limit=5, offset=2, sort="value")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "TakeOrderedAndProject" in plan


def test_options():
    docs = object.__new__(DocumentCollection)
    for options in ({"limit": -2}, {"limit": "1"}, {"offset": -1}, {"offset": 1.5}, {"sort": 3}, {"limit": True}):
        with pytest.raises(InvalidOption):
            docs.find("a", 1, **options)


def test_validation(spark):
    bodies = {"{": "invalid json", "[1,2,3]": "invalid json", '"hello"': "invalid json", "42": "invalid json", "{}": "empty document", "": "empty document", "null": "empty document", '{"a":1}': None, '{"a":1}}': "invalid json", '{"a":1} x': "invalid json", '{"a":1},{"b":2}': "invalid json", ' {"a":1} ': None, '{"a":1e400}': "invalid json", '{"a":1,"a":2}': None}
    rows = parse_documents(spark.createDataFrame([(b,) for b in bodies], "body string")).collect()
    assert {r["body"]: r["problem"] for r in rows} == bodies
    with pytest.raises(EmptyDocument):
        check_document("{}")
    with pytest.raises(InvalidJSON):
        check_document("[1]")
    assert check_document('{"a": 1}') == {"a": 1}


def test_requests(spark):
    docs = collection(spark, {"a": {"city": "C", "age": 10}, "b": {"city": "C", "age": 20}})
    assert answer(docs, "field=city&value=C&aggregate=count&limit=bad&offset=-1").first()["count"] == 2
    assert ids(answer(docs, "field=city&value=C&sort=-age&limit=1&offset=1")) == ["a"]
    assert parse_request("field=&value=").value == ""
    for bad in ("limit=-1", "limit=abc", "offset=-1", "offset=abc", "aggregate=median:a"):
        with pytest.raises(BadRequest):
            parse_request(f"field=city&value=C&{bad}")
    for bad in ("field=a", "value=b"):
        with pytest.raises(BadRequest):
            parse_request(bad)
    with pytest.raises(MethodNotAllowed):
        parse_request("limit=1")
    assert key_of_path("/v1/kv/a/b/") == "a/b"
    with pytest.raises(BadRequest):
        key_of_path("/v1/kv//")


def test_feeds_and_index_changes(spark):
    feed = spark.createDataFrame([(1, 1, "create", "a", "Chennai"), (2, 2, "update", "a", "Bengaluru"), (3, 3, "create", "b", "Chennai"), (4, 4, "delete", "b", None)], "seq long, ts long, op string, _id string, city string")
    assert [tuple(r) for r in latest(feed).collect()] == [("a", "Bengaluru")]
    before = DocumentCollection(latest(feed.where("seq <= 1")), ["city"]).pairs()
    after = DocumentCollection(latest(feed), ["city"]).pairs()
    assert sorted(tuple(r) for r in index_changes(before, after).collect()) == [("add", "city", "Bengaluru", "a"), ("remove", "city", "Chennai", "a")]


def test_bodies(spark):
    docs = collection(spark, {"a": {"_id": "other", "x": 1}, 'q"': {"y": "z"}})
    assert {r["_id"]: json.loads(r["body"]) for r in to_body(docs.df).collect()} == {"a": {"_id": "a", "x": 1}, 'q"': {"_id": 'q"', "y": "z"}}
