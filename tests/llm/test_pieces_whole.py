import pytest

from castgraph.llm.pieces import split_text


@pytest.mark.parametrize("gap", [" " * 4000, "y" * 2000 + " " * 2000, "e" + "\u0301" * 4000])
def test_long_runs_stay_local(gap):
    words = "lantern market " * 700
    text = words + gap + " " + words
    got = split_text(text)
    assert all(e - s <= 3000 for s, e in got) and got[0][0] == 0 and got[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(got, got[1:]))
    for _, e in got[:-1]:
        assert len(words) <= e <= len(words) + len(gap) + 1 or text[e - 1] == " "


def test_blank_run_at_the_end():
    text = "lantern market " * 700 + " " * 5000
    assert all(text[e - 1] == " " for _, e in split_text(text))


def test_every_position_of_a_long_word():
    assert split_text("x" * 5000) == [(0, 2600), (2400, 5000)]
