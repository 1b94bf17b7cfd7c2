import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shoal.llm import pii as P
from tests.llm.fixtures import LONG, edge_docs

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile("[0-9]([\x20-]?[0-9])+")
PHONE = re.compile("\\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub("[^0-9]", "", s)


def luhn(s):
    total = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain(t):
    return {"email": [m.span() for m in EMAIL.finditer(t)],
            "ip": [m.span() for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))],
            "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
            "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]}


PIECES = ["1", "2", "55", "4111111111111111", "4111 1111-1111 1111", ".", "..", " ", "  ", "-", "@", "a", "b.c", "+", "(", ")",
          "é", "256", "%", "x@y.z", "1.2.3.4", "٣", "\n", "+44 20 7946 0958", "at", "dot", "one"]


@given(st.lists(st.sampled_from(PIECES), max_size=30).map("".join))
@settings(max_examples=1500, deadline=None)
def test_plain_spans_match_the_patterns(text):
    base, more = P.spans_of(text)
    assert base == plain(text)
    for spans in more.values():
        assert all(0 <= a < b <= len(text) for a, b in spans)


@pytest.mark.parametrize("text, kind, found", [
    ("mail john [at] example [dot] com now", "email", "john [at] example [dot] com"),
    ("a(at)b(dot)org", "email", "a(at)b(dot)org"),
    ("john at example dot com", "email", "john at example dot com"),
    ("user&#64;host&#46;net", "email", "user&#64;host&#46;net"),
    ("see j\u043ehn@example.com pls", "email", "j\u043ehn@example.com"),
    ("see ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ pls", "email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
    ("jo\u200bhn@ex\u200bample.com", "email", "jo\u200bhn@ex\u200bample.com"),
    ("call plus four four two zero seven nine four six zero nine five eight ok", "phone",
     "plus four four two zero seven nine four six zero nine five eight"),
    ("card four " + "one " * 14 + "one end", "card", "four " + "one " * 14 + "one"),
    ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("ip one nine two dot one six eight dot one dot one here", "ip", "one nine two dot one six eight dot one dot one"),
    ("ip 10[.]0[.]0[.]1 here", "ip", "10[.]0[.]0[.]1"),
    ("mail john @ example . com now", "email", "john @ example . com"),
    ("ip 192.168.O.l ok", "ip", "192.168.O.l"),
    ("card 4111 1111 1111 l111 end", "card", "4111 1111 1111 l111"),
    ("call +44 2O 7946 O958 now", "phone", "+44 2O 7946 O958"),
])
def test_disguises_map_back_to_their_source(text, kind, found):
    _, more = P.spans_of(text)
    assert [text[a:b] for a, b in more[kind]] == [found]
    assert P.redacted(text) == text.replace(found, f"[{kind.upper()}]")


# Without a trigger of their own: found in a text with nothing else to rewrite, and the same beside an unrelated trigger.
PHRASES = [("write to john.smith at example.com", "email", "john.smith at example.com"),
           ("call:plus 49 30 1234567", "phone", "plus 49 30 1234567"),
           ("plus 49 30 1234567", "phone", "plus 49 30 1234567"),
           ("(plus 49 30 1234567)", "phone", "plus 49 30 1234567"),
           ("john@example. com", "email", "john@example. com"),
           ("mail john [at] mail . example. com", "email", "john [at] mail . example. com"),
           ("john at mail.example.com. It is", "email", "john at mail.example.com"),
           ("john@example.com. It is", None, None), ("john@example.com. it is", None, None),
           ("John at example. com", None, None), ("He lives @ home. Com is", None, None)]


@pytest.mark.parametrize("text, kind, found", PHRASES)
@pytest.mark.parametrize("trigger", ["", " / one", " / a dot b", " / 3l", " / a .", " / x\u200by", " / @"])
def test_an_unrelated_trigger_changes_no_spans(text, kind, found, trigger):
    _, more = P.spans_of(text + trigger)
    assert {k: [text[a:b] for a, b in v] for k, v in more.items()} == ({kind: [found]} if kind else {})


SEEDS = ["at", "dot", "plus", "AT", ".", "@", " ", "\n", "\u2003", "[", ")", "<", "&#", "&#064;", "&commat;", "46;", "com", "example", "It",
         "one", "Seven", "o", "l", "|", "İ", "ı", "ſ", "0", "7", "a", "-", ",", "\u200b", "é"]


@given(st.lists(st.sampled_from(SEEDS), max_size=12).map("".join))
@settings(max_examples=5000, deadline=None)
def test_a_text_without_a_trigger_has_nothing_to_rewrite(text):
    assert P.may_rewrite(text) or not P._DISGUISE.search(text)


@pytest.mark.parametrize("text", ["look at the dot on one page", "meet at noon dot. at home", "one two three", "a [dot] b", LONG,
                                  "He lives at home. Com is", "see 5l of 2O. I am", "John at example. com"])
def test_plain_prose_has_no_spans(text):
    base, more = P.spans_of(text)
    assert not any(base.values()) and not more


def test_edge_cases(spark):
    docs = edge_docs(spark, [(1, "x@y.zz and +44 20 7946 0958, é 10.0.0.1", "en", "a"), (2, None, None, None), (None, "", "en", "a"),
                             (2, "b (at) c (dot) com", "en", "a"), (3, LONG, "en", "a")])
    got = sorted((str(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["spans"], r["base_sha256"])
                 for r in P.detect(docs).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = "email:0:6,ip:31:39,phone:11:27"
    assert got == sorted([("1", 1, 1, 0, 1, one, sha(one)), ("2", 0, 0, 0, 0, "", sha("")), ("None", 0, 0, 0, 0, "", sha("")),
                          ("2", 0, 0, 0, 0, "email:0:18", sha("")), ("3", 0, 0, 0, 0, "", sha(""))])
    masked = P.redact(docs)
    assert masked.columns == docs.columns
    assert {r["text"] for r in masked.collect()} == {"[EMAIL] and [PHONE], é [IP]", None, "", "[EMAIL]", LONG}
    assert P.detect(edge_docs(spark, [])).count() == 0
