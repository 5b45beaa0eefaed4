"""A sign that opens no tag is text."""

from marketlens.llm import language


def test_less_than_signs_in_text():
    assert language.visible("<p>if 5 < 7 then more text<br>end").split() == ["if", "5", "7", "then", "more", "text", "end"]
    assert language.visible("x <3 all > that <!-- no --> rest").split() == ["x", "3", "all", ">", "that", "rest"]
    assert language.visible("a<script>if (i < 3) no</script>b").split() == ["a", "b"]
