import pytest

from tessera.functions import ranges as r


def test_parse():
    assert r.parse("a,:,b,c,") == [r.Range("a", "b"), r.Range("c", "c")]
    assert r.parse(":,g,") == [r.Range(None, "g")]
    assert r.parse("a,:,") == [r.Range("a", None)]
    assert r.parse(":,") == [r.Range(None, None)] == r.parse(None)
    assert r.parse("") == []
    assert r.parse("b;a;") == [r.Range("a", "a"), r.Range("b", "b")]


@pytest.mark.parametrize("bad", [":,:,", "a,:,:,", "b,:,a,"])
def test_malformed(bad):
    with pytest.raises(ValueError):
        r.parse(bad)


def test_merge_and_back():
    assert r.merge(r.parse("a,:,c,b,:,d,x,")) == [r.Range("a", "d"), r.Range("x", "x")]
    assert r.unparse(r.parse("a,:,b,c,")) == "a,:,b,c,"
    assert r.prefixed("a,:,b,", "out|") == "out|a,:,out|b,"
    assert r.count_items("a,b,c,") == 3 and r.has_range("a,:,b,") and not r.has_range("a,")
