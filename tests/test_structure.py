import pytest

from lectern.functions.annotate import annotate
from lectern.functions import structure as S

T3, T4 = "```", "````"


@pytest.mark.parametrize(
    "text, line, stack",
    [
        (f'{T4}markdown\n{T3}json\n{{"a":1}}\n{T3}\n{T4}', "ok", True),
        (f"{T3}markdown\nx\n{T3}\ny\n{T3}", "early_outer_fence_close_at_line_3", False),
        (f"{T3}markdown\n{T3}json\n{{}}\n{T4}\n{T3}", "inner_fence_can_conflict_with_outer_at_line_2", False),
        (f"{T4}\n{T3}\n{T4}", "ok", False),
        ("~~~\nx\n~~~~", "missing_or_wrong_outer_closing_fence", True),
        (f"{T3}\na\n{T3}json", "missing_or_wrong_outer_closing_fence", True),
        (f"{T3}python\nx\n{T3}", "unexpected_outer_fence_suffix: python", True),
        (T3, "markdown_too_short", False),
        ("hello\nworld", "missing_outer_opening_fence", True),
    ],
)
def test_two_dialects_of_fences(text, line, stack):
    assert S.markdown_reason(text) == line
    assert S.balanced(text) == stack


def test_mixed():
    good = f'{T4}markdown\n{T3}json\n{{"a":1}}\n{T3}\n{T4}'
    assert S.mixed_reason(good) == "ok"
    assert S.mixed_reason("~~~\nx\n~~~") == "mixed_no_json_block_found"
    assert S.mixed_reason(good.replace('{"a":1}', "{a}")).startswith("mixed_inner_json_invalid_block_0")
    assert S.json_blocks(f"{T3}JSON\n1\n{T3}\n{T3}json\nnever closed") == ["1"]


@pytest.mark.parametrize("text, ok", [('{"a":1}', True), ("[1,2]", True), ("3", True), ('"s"', True), ("NaN", True), ('{"a":1,}', False), ("{'a':1}", False), ("01", False), ("", False), ('{"a":1} x', False), ('"a\nb"', False)])
def test_json(text, ok):
    assert (S.json_error(text) is None) == ok


@pytest.mark.parametrize(
    "tokens, depth, state",
    [
        (["{", '"', "a", '"', ":", " ", "[", "1", "]", "}"], [0, 1, 1, 1, 1, 1, 1, 2, 2, 1], [0, 1, 3, 3, 1, 1, 1, 2, 2, 1]),
        (['"', "a", '\\"', "b", '"'], [0] * 5, [0, 3, 4, 3, 3]),
        (["```json", "\n", "x", "\n", "```", "\n", "y"], [0, 1, 1, 1, 1, 0, 0], [0, 6, 6, 6, 6, 5, 0]),
        (["~~~~", "\n", "```", "\n", "x"], [0, 1, 1, 2, 2], [0, 6, 6, 7, 7]),
        (["say", " ", '"', "hi", '"', " ", "ok"], [0] * 7, [0, 5, 5, 3, 3, 5, 5]),
    ],
)
def test_annotator(tokens, depth, state):
    assert annotate(tokens) == (depth, state)


def test_mojibake():
    assert S.repaired("中文".encode().decode("latin1")) == "中文"
    assert S.repaired("机器学习模型".encode().decode("gbk")) == "机器学习模型"
    for t in ("数据清洗", "测试"):
        garbled = t.encode().decode("gbk")
        assert S.repaired(garbled) == garbled
    assert S.repaired("plain") == "plain" and S.repaired("") == ""
