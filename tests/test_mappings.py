import json

import pytest

from pagequarry.sources import mappings as M


def test_formats(tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"b": null}}')
    (tmp_path / "a").write_text('{"a": 1}')
    assert M.read_mapping(tmp_path / "a.json") == {"a": {"b": None}} and M.read_mapping(tmp_path / "a") == {"a": 1}
    for name, body in (("b.json", "[1]"), ("c.json", "{"), ("d", "{")):
        (tmp_path / name).write_text(body)
        with pytest.raises(M.InvalidInput):
            M.read_mapping(tmp_path / name)
    with pytest.raises(M.InvalidInput):
        M.read_mapping(tmp_path / "none.json")


def test_yaml(tmp_path):
    pytest.importorskip("yaml")
    assert M.parse_mapping("a:\n  b: 2\n", ".yml") == {"a": {"b": 2}}
    with pytest.raises(M.InvalidInput):
        M.parse_mapping("a: [", ".yaml")


def test_dig_tells_absent_from_null():
    gone = object()
    assert M.dig({"a": {"b": None}}, "a.b", gone) is None
    assert M.dig({"a": {"b": None}}, "a.c", gone) is gone and M.dig({"a": 1}, "a.b", gone) is gone


def test_inside(tmp_path):
    assert M.inside(tmp_path, "x/y.json") == tmp_path.resolve() / "x/y.json"
    for path in ("../x", "/etc/passwd"):
        with pytest.raises(M.InvalidInput):
            M.inside(tmp_path, path)
