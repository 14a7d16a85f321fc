import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators import jsonindex, nested


def walk(o, path="", under=False):
    """Brute force: paths of non-null array elements."""
    if isinstance(o, dict):
        for f, v in o.items():
            p = f"{path}.{f}" if path else f
            if (f in nested.LIST_FIELDS or under) and v is not None and not isinstance(v, list):
                yield p + "[0]"
                yield from walk(v, p + "[0]", f in nested.LIST_PARENTS)
            else:
                yield from walk(v, p, f in nested.LIST_PARENTS)
    elif isinstance(o, list):
        for i, v in enumerate(o):
            if v is not None:
                yield f"{path}[{i}]"
                yield from walk(v, f"{path}[{i}]")


def found(text):
    ix = jsonindex.index(jsonindex.unwrap(pa.array([text], pa.string())))
    if not ix["valid"][0]:
        return None
    paths, case, _ = jsonindex.item_paths(ix, nested.LIST_FIELDS, nested.LIST_PARENTS)
    return paths.filter(pa.array(case)).to_pylist()


leaf = st.none() | st.booleans() | st.integers(-9, 9) | st.floats(allow_nan=False, allow_infinity=False) | st.text(alphabet='a"\\{}[]:, é\n', max_size=6)
key = st.sampled_from(["works", "ids", "identifiers", "a", "b", 'q"', "links", "é"])
value = st.recursive(leaf, lambda x: st.lists(x, max_size=3) | st.dictionaries(key, x, max_size=3), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(key, value, max_size=4), st.sampled_from([None, 0, 2]), st.booleans(), st.booleans())
def test_index_equals_parser(o, indent, ascii_only, wrapped):
    text = json.dumps(o, indent=indent, ensure_ascii=ascii_only)
    assert sorted(found(json.dumps(text) if wrapped else f" {text}\n")) == sorted(walk(o))


@pytest.mark.parametrize(
    "text", ["", " ", "null", "[1]", "3", '"x"', "{", "}", '{"a"}', '{"a":}', '{"a":1,}', '{"a" 1}', '{"a":[1,]}', '{"a":[1 2]}', '{"a":01}', '{"a":"\\x"}', '{"a":"\\u12"}', '{"a":1}}', 'x{"a":1}', '{"a":1}x', '{"a":[1}', '{"a":tru}', '{"a":"b}', "<html>502</html>", '{"a":"\n"}', '{"a":1}{"b":2}', '{1:2}', '{"a":"b"c}']
)
def test_unreadable_is_no_object(text):
    assert found(text) is None


def test_newest_revision_ties_nulls_and_extra_columns(spark):
    rows = [
        ("k1", "9", '{"works":[1]}', "x"), ("k1", "10", '{"works":[1,null,{"ids":"z"}]}', "x"), ("k1", "10", '{"works":[1,null,{"ids":"z"}]}', "x"), ("k1", "11", "<html>", "x"),
        ("k2", None, '{"ids":"q"}', "x"), ("k3", "1", None, "x"), (None, "1", '{"works":[1]}', "x"), ("k4", "1", "{}", "x"),
    ]
    df = spark.createDataFrame(rows, "rec_key string, revision string, js string, item_path string")
    got = sorted(tuple(r) for r in nested.newest_elements(df).collect())
    assert got == [("k1", "works[0]"), ("k1", "works[2]"), ("k1", "works[2].ids[0]"), ("k2", "ids[0]")]
    assert nested.newest_elements(df.limit(0)).count() == 0


def test_nodes_keep_parent_position_and_value(spark):
    df = spark.createDataFrame([("k", "1", '{"a":{"b":[{"c":"\\u00e9"},null]},"works":{"key":"w"}}')], "rec_key string, revision string, js string")
    got = {r["node_path"]: r for r in nested.flat_nodes(df).collect()}
    assert got["a.b[0].c"]["value"] == "é" and got["a.b[0].c"]["parent_path"] == "a.b[0]"
    assert got["a.b[1]"]["kind"] == "null" and got["a.b[1]"]["position"] == 1
    assert got["works[0]"]["position"] == 0 and got["works[0].key"]["parent_path"] == "works[0]"


def test_very_long_record(spark):
    js = json.dumps({"works": list(range(20000)), "t": "x" * 100000})
    df = spark.createDataFrame([("k", "1", js)], "rec_key string, revision string, js string")
    assert nested.newest_elements(df).count() == 20000
