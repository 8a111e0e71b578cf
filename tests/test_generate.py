import pytest

from sedimark.generate import Unavailable, with_retries


def test_retries_and_fallback():
    calls, waits = [], []

    def busy(prompt):
        calls.append("busy")
        raise Unavailable("429")

    def broken(prompt):
        calls.append("broken")
        raise ValueError("no key")

    generate = with_retries([busy, broken, lambda p: p.upper()], 3, 0.5, waits.append)
    assert generate("x") == "X" and calls == ["busy"] * 3 + ["broken"] and waits == [0.5, 1.0]
    with pytest.raises(ValueError):
        with_retries([busy, broken], 1, 0, waits.append)("x")
    with pytest.raises(Unavailable):
        with_retries([])("x")
