import pytest

from barloom.plans.languages import infix, postfix


def test_infix_rejects_what_is_not_in_the_language():
    for text in ("__import__('os')", "returns ** 2", "unknown + 1", "max(returns)"):
        with pytest.raises(ValueError):
            infix(text)


def test_postfix_needs_exactly_one_value_left():
    assert postfix("RET RET") is None
    assert postfix("ADD") is None
    assert postfix("RET NEG") is not None
    with pytest.raises(ValueError):
        postfix("RET NOPE")
