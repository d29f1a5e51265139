"""Driver-side helpers."""

import pytest

from lodestone.plans import requests as r


def test_policies():
    assert [r.embed_timeout(n) for n in (1, 500, 5000)] == [120.0, 500.0, 900.0]
    assert [r.worth_a_retry(s) for s in (None, 503, 400)] == [True, True, False]
    assert r.without_meta("a" * 90 + "\n## Meta\nx") == "a" * 90
    assert r.without_meta("\n## Meta\n" + "a" * 90).endswith("a" * 90)


def test_projects():
    opened = []
    p = r.Projects({"a": "/a", "b": "/b"}, lambda folder: opened.append(folder) or folder)
    assert p.get("a") == "/a" and p.get("a") == "/a" and opened == ["/a"]
    with pytest.raises(ValueError):
        p.get()
    with pytest.raises(ValueError):
        p.get("c")
    assert r.Projects({"a": "/a"}, str).get() == "/a"
