import pytest

from lectern.sources.cursor import canonical_request, follow_pages, request_key
from lectern.sources.replay import request_hash

PAGES = {"*": ("a", "c1"), "c1": ("b", "c2"), "c2": ("c", None)}


def service(fail=0):
    calls = []

    def fetch(endpoint, params):
        calls.append(params["cursor"])
        if len(calls) <= fail:
            raise ConnectionError
        record, following = PAGES[params["cursor"]]
        return {"meta": {"next_cursor": following}, "results": [record]}

    return fetch, calls


def test_pages_are_followed_stored_and_asked_again():
    fetch, calls = service(fail=2)
    stored, waits = {}, []
    got = list(follow_pages(fetch, "works", {"api_key": "x"}, stored=stored, sleep=waits.append))
    assert [p["results"] for _, p in got] == [["a"], ["b"], ["c"]] and waits == [1.0, 2.0] and len(calls) == 5 and len(stored) == 3
    assert list(follow_pages(fetch, "works", {"api_key": "y"}, stored=stored)) == got and len(calls) == 5
    assert [c for c, _ in follow_pages(fetch, "works", {}, start="c1", stored=stored)] == ["c1", "c2"]
    with pytest.raises(ConnectionError):
        list(follow_pages(service(fail=9)[0], "works", {}, tries=3, sleep=waits.append))


def test_cycles_and_broken_pages_are_errors():
    with pytest.raises(ValueError, match="cycle"):
        list(follow_pages(lambda e, p: {"meta": {"next_cursor": "*"}, "results": []}, "works", {}))
    for bad in ({}, {"meta": {}, "results": None}, []):
        with pytest.raises(ValueError, match="no page"):
            list(follow_pages(lambda e, p, bad=bad: bad, "works", {}))


def test_requests_are_told_by_what_they_ask_for():
    assert request_key("w", {"b": 1, "a": "x", "mailto": "m", "c": None}) == request_key("w", {"a": "x", "b": 1}) != request_key("v", {"a": "x", "b": 1})
    with pytest.raises(TypeError):
        canonical_request("w", {"a": [1]})
    one, two = '{"request": {"a": 1, "b": 2}, "results": []}', '{"results": [1], "request": {"b": 2, "a": 1}}'
    assert request_hash(one) == request_hash(two) != request_hash('{"results": []}') and request_hash("no json") != request_hash("other")
