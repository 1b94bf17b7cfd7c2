import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import chat as C

PARTS = ["<", "\\", "|turn|>", "/s>", "s>", "[", "INST]", "/INST]", "<|end|>", "\n", "x", "<SYS>>", "</SYS>>", "<<SYS>>", "é", " "]
TEXT = st.lists(st.sampled_from(PARTS), max_size=10).map("".join)


@given(TEXT)
@settings(max_examples=1500, deadline=None)
def test_escaping_is_reversible_and_hides_control_strings(text):
    out = C.escape(text)
    assert C.unescape(out) == text and not any(c in out for c in C.CONTROLS)
    assert C.unescape(C.unline(C.line(out))) == text and "\n" not in C.line(out)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", "a\nb"]), TEXT), TEXT), max_size=5))
@settings(max_examples=400, deadline=None)
def test_a_conversation_reads_back_as_it_was(turns):
    render = C.compile_template(C.TEMPLATE)
    full, reader = C.Sink(), C.Reader()
    messages = [{"role": r, "text": t} for r, t in turns]
    render(messages, full)
    render(iter(messages), reader)
    loss = "".join(t for r, t in turns if r == "assistant")
    assert reader.n_turns == len(turns) and reader.size == len(full.text)
    assert reader.turns.hexdigest() == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert reader.loss.hexdigest() == hashlib.sha256(loss.encode()).hexdigest() and reader.loss_chars == len(loss)
    assert "".join(C.unescape(full.text[a:b]) for a, b in full.spans) == loss


@pytest.mark.parametrize("source, want", [
    ("a{{ 'b' + 'c' | upper }}d", "abCd"),
    ("{% if 1 == 2 %}x{% elif not false %}y{% else %}z{% endif %}", "y"),
    ("{% for m in messages %}{{ m['role'] }}{% if not loop.last %},{% endif %}{% endfor %}", "u,a"),
    ("{% for m in messages %}{% if loop.first and m.text == 't1' or m.text != 't1' %}{{ m.text | trim }}{% endif %}{% endfor %}", "t1t2"),
    ("{{ nothing }}{{ nothing.at.all }}{% for m in nothing %}x{% endfor %}", ""),
])
def test_template_language(source, want):
    out = C.Sink()
    C.compile_template(source)([{"role": "u", "text": "t1"}, {"role": "a", "text": "t2"}], out)
    assert out.text == want


def test_constants_are_folded():
    assert C.fold(C.parse("a{{ 'b' + 'c' }}{% if 'x' == 'y' %}{{ m.text }}{% else %}d{% endif %}")) == ("block", [("text", "abcd")])


@pytest.mark.parametrize("source", ["{{ f() }}", "{{ m.__class__.x() }}", "{% import os %}", "{{ m | eval }}", "{% if x %}", "{{ }}",
                                    "{% for m in f() %}{% endfor %}", "{{ 'a' + }}"])
def test_what_the_sandbox_refuses(source):
    with pytest.raises(C.TemplateError):
        C.compile_template(source)


def test_objects_have_no_attributes():
    out = C.Sink()
    C.compile_template("{{ m.__class__ }}{{ messages.append }}")([], out)
    assert out.text == ""


CONV = [(1, 1, "assistant", "b"), (1, 0, "user", None), (2, 0, None, "<|end|>\n"), (None, 0, "user", "x"), (None, 0, "user", "x"),
        (3, None, "assistant", "late"), (3, 0, "assistant", "é" * 300_000), (1, 1, "assistant", "a")]
KIND = "conv_id bigint, turn bigint, role string, text string, _turn string, mask string"


def test_edge_cases(spark):
    conv = spark.createDataFrame([(*r, "clash", "clash") for r in CONV], KIND)
    got = {r["conv_id"]: r for r in C.digests(conv).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("ab")
    assert got[2]["turns_sha256"] == sha("\n<|end|>\n\n") and got[2]["loss_chars"] == 0
    assert got[None]["n_turns"] == 2 and got[3]["loss_sha256"] == sha("late" + "é" * 300_000)
    full = {r["conv_id"]: r for r in C.format_conversations(conv).collect()}
    assert set(full) == set(got) and all(len(full[c]["text"]) == got[c]["formatted_chars"] for c in got)
    assert C.digests(conv.limit(0)).count() == 0 and C.format_conversations(conv.limit(0)).count() == 0
