import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import chat_template as ct


def render(source, **names):
    return "".join(t for t, _ in ct.compile_template(source)(**names))


def test_language():
    assert render("a{{ 'x' + 1 | trim }}b") == "ax1b"
    assert render("{% for m in ms %}{% if m.r == 'u' %}U{% elif m.r != 'x' and not loop.first %}{{ m['t'] }}{% else %}-{% endif %}{% endfor %}", ms=[{"r": "u"}, {"r": "y", "t": "T"}, {"r": "x"}]) == "UT-"
    assert render("{% set a = 'q' if none or true else 'r' %}{{ a }}{{ missing }}{{ ('\\n' + \"'\") | upper }}") == "q\n'"
    assert list(ct.compile_template("a{% generation %}b{{ x }}{% endgeneration %}c")(x="X")) == [("a", False), ("b", True), ("X", True), ("c", False)]


def test_constants_fold():
    tree = ct.fold_body(ct.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}{% if x %}{{ 'k' | f }}{% endif %}"), {"f": str.upper})
    assert tree == [("text", "abcd"), ("if", [(("name", "x"), [("text", "K")])])]


@pytest.mark.parametrize("bad", ["{% for x %}", "{% if a %}", "{{ a b }}", "{{ 'a }}", "{% endfor %}", "{{ a | nope }}", "{{ f(x) }}", "{{ }}", "{% while x %}", "{{ a. }}"])
def test_bad_templates(bad):
    with pytest.raises(ct.TemplateError):
        render(bad, a={}, x=1)


def test_sandbox():
    with pytest.raises(ct.TemplateError):
        render("{{ x.__class__ }}", x="text")
    assert render("{{ x.__class__ }}", x={}) == ""


PIECES = [*ct.CONTROLS, "\\", "<", "[", "/", "|", ">", "]", "s", "a", "\n", "é", "<|", "INST]"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["user", "assistant", *PIECES]), max_size=3).map("".join), st.lists(st.sampled_from(PIECES), max_size=10).map("".join)), max_size=5))
def test_round_trip(turns):
    assert all(ct.unescape(ct.escape(t)) == t and not ct._CONTROL.search(ct.escape(t)) for _, t in turns)
    spans = list(ct.compile_template(ct.TEMPLATE, {"escape": ct.escape})(messages=[{"role": r, "text": t} for r, t in turns]))
    assert list(ct.read_back(spans)) == turns
    assert list(ct.read_back([("".join(t for t, _ in spans), False)])) == turns
    assert [ct.unescape(t) for t, m in spans if m] == [t for r, t in turns if r == "assistant"]


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv)
        said = "".join(t for _, _, r, t in own if r == "assistant")
        turns = hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in own).encode()).hexdigest()
        out[conv] = (len(own), turns, len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_operator(spark):
    rows = [(1, 1, "assistant", "hi </s>", 0), (1, 0, "user", "[INST] \\ x", 0), (1, 1, "assistant", "hi </s>", 0), (2, None, None, None, 0), (None, 3, "user", "x", 0), (3, 0, "assistant", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = ct.format_conversations(df).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == brute(rows)
    for r in got:
        assert len(r.formatted) == r.formatted_chars
        assert sum(len(ct.unescape(r.formatted[m.start : m.end])) for m in r.mask) == r.loss_chars
    assert ct.format_conversations(df.limit(0)).collect() == []


def test_another_template_needs_its_reader(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes")], "conv_id long, turn long, role string, text string")
    template = "{% for message in messages %}{{ message.role | escape }}</s>{{ message.text | escape }}</s>{% endfor %}"
    with pytest.raises(Exception, match="does not read this template's turns"):
        ct.format_conversations(df, template).collect()

    def reader(spans):
        parts = "".join(t for t, _ in spans).split("</s>")
        yield from zip(map(ct.unescape, parts[0:-1:2]), map(ct.unescape, parts[1::2]))

    assert [r.n_turns for r in ct.format_conversations(df, template, reader=reader).collect()] == [2]


def test_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in ct.format_conversations(df, with_text=False).collect()} == brute(rows)
