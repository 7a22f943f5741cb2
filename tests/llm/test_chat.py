"""Templates, and an exact round trip of conversations."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from haulmark.llm.chat_formatting import DEFAULT, format_conversations, read_back, read_turns
from haulmark.llm.chat_template import Output, Parser, Template, TemplateError, Text, escape, fold_body, unescape

SCHEMA = "conv_id long, turn long, role string, text string, position int"


@given(st.text("\\<[]/ INSTANROLEs>ab\n", max_size=40))
def test_escape(text):
    assert unescape(escape(text)) == text and not any(x in escape(text).replace("\\\\", "").replace("\\<", "").replace("\\[", "") for x in "<[")


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "x] y"]), st.text("\\<[]/ INSTANROLEs>\n", max_size=30)), min_size=1, max_size=5))
def test_round_trip(turns):
    text, spans = Template(DEFAULT).render([{"role": r, "text": t} for r, t in turns])
    assert read_turns(text) == turns
    assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_language():
    t = Template("{# note #}A{{ 'x' ~ 1 }}{% for m in messages %}{% if not first and (m.a == 'b' or none) %}<{{ m.a|upper }}>{% elif false %}no{% else %}-{% endif %}{% endfor %}{{ m }}Z")
    assert t.render([{"a": "b"}, {"a": "b"}, {"a": "c"}])[0] == "Ax1-<B>-Z"
    folded = fold_body(Parser("a{{ 'b' }}{% if 1 == 1 %}c{% else %}d{% endif %}{{ e or 'f' }}").body(())[0])
    assert folded[0] == Text("abc") and isinstance(folded[1], Output) and len(folded) == 2
    for bad in ("{{ m.__class__ }}{% for m in messages %}{% endfor %}", "{{ f(1) }}", "{% for m in range %}{% endfor %}", "{% if x %}", "{{ x | eval }}", "no loop", "{% import os %}"):
        with pytest.raises(TemplateError):
            Template(bad)


def test_digests(spark):
    rows = [(c, t, r, x) for c in range(9) for t, (r, x) in enumerate([("user", "</s>[INST] ok [/INST]"), ("assistant", f"a {c} \\"), ("system", "s"), ("assistant", None), (None, "é🙂"), ("user", "long " * 3000)][: c + 1])]
    rows += [(3, 1, "assistant", "tie"), (3, 1, "assistant", "tie"), (4, None, "user", "first"), (None, 0, "user", "x")]
    got = {r.conv_id: tuple(r)[1:] for r in read_back(format_conversations(spark.createDataFrame([(*r, 5) for r in rows], SCHEMA))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((-1 if t is None else t), r or "", x or "") for k, t, r, x in rows if k == c)
        said = [x for _, r, x in own if r == "assistant"]
        whole = Template(DEFAULT).render([{"role": r, "text": x} for _, r, x in own])[0]
        assert got[c] == (len(own), hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest(), len("".join(said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(whole))


def test_empty_table(spark):
    assert read_back(format_conversations(spark.createDataFrame([], SCHEMA))).collect() == []
