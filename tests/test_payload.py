import json

import pytest

from vexel.functions.payload import Payload

ROWS = [
    {"a": 5, "b": 1, "s": "x"}, {"a": 5.5, "s": "5"}, {"a": "5"}, {"a": None}, {"b": True}, {"a": {"b": 5}}, {"a.b": 5}, {"a": 1e20}, {"a": [5]},
]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, json.dumps(r)) for i, r in enumerate(ROWS)] + [(len(ROWS), None), (len(ROWS) + 1, "not json")]
    return spark.createDataFrame(data, "i int, payload string")


def ids(rows, test):
    return sorted(r.i for r in rows.where(test).collect())


P = Payload()


@pytest.mark.parametrize("test, want", [
    (lambda: P.eq("a", 5), [0]),
    (lambda: P.eq("a", "5"), [2]),
    (lambda: P.ne("a", 5), [1, 2, 3, 4, 5, 6, 7, 8, 10]),
    (lambda: P.gt("a", 5), [1, 7]),
    (lambda: P.ge("a", 5), [0, 1, 7]),
    (lambda: P.lt("a", 5.5), [0]),
    (lambda: P.le("a", 5.5), [0, 1]),
    (lambda: P.isin("a", [5, "5"]), [0, 2]),
    (lambda: P.eq("b", True), [4]),
    (lambda: P.eq("b", 1), [0]),
    (lambda: P.eq("a.b", 5), [6]),
    (lambda: P.eq("a", 5) | P.eq("a", 5.5) & P.eq("s", "none"), [0]),
    (lambda: (P.eq("a", 5) | P.eq("a", 5.5)) & P.eq("s", "5"), [1]),
    (lambda: P.gt("s", "4") & P.lt("s", "6"), [1]),
    (lambda: P.eq("it's", 1), []),
])
def test_conditions(rows, test, want):
    assert ids(rows, test()) == want


def test_empty_list_is_an_error():
    with pytest.raises(ValueError):
        P.isin("a", [])
