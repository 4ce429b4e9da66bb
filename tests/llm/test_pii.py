import re

import pytest

from cutline.llm import pii
from cutline.llm.pii import KINDS, detect, find, redact

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == "ip" and any(int(p) > 255 for p in match[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((kind, *match.span()))
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


@pytest.mark.parametrize(
    "text",
    [
        "", "a@b.c.@d.e", "x@@y.z a.b@c-d.e.f, 1.2.3.4.5.6.7.8 256.1.1.1 00255.1.1.01",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 1 2 3", "+49 (30) 1234567-89 +1 2 +12345678901234567890 +4+49 151 2345678",
        "@@@ a@ @b a@b a@b. a@b.c", "1.1.1.1@1.1.1.1+4912345678901 é@a.b",
    ],
)
def test_base_is_what_the_patterns_find(text):
    assert detect(text) == brute(text)


@pytest.mark.parametrize("text", ["a." * 50_000, "1" * 50_000, "+1" * 30_000, "1 " * 30_000, "@" * 50_000, "four " * 20_000, "a at b " * 9_000,
     "a at b.c " * 9_000, "a" * 90_000 + " at b.de", "a.b at c.d at " * 5_000, "a [dot] " * 9_000, "a [dot] b (at) c.de " * 5_000])
def test_long_runs_take_linear_time(text):
    find(text)


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail jane (at) host [dot] org now", "email", "jane (at) host [dot] org"),
        ("mail jane at host dot org now", "email", "jane at host dot org"),
        ("mail jane.roe at host.org now", "email", "jane.roe at host.org"),
        ("mail roe77 at mail.host.info.", "email", "roe77 at mail.host.info"),
        ("mail jane @ host.org now", "email", "jane @ host.org"),
        ("mail jane [dot] roe (at) host.org now", "email", "jane [dot] roe (at) host.org"),
        (f"mail {'verylong' * 9} [dot] {'name_' * 9}x [dot] roe (at) host.org now", "email",
         f"{'verylong' * 9} [dot] {'name_' * 9}x [dot] roe (at) host.org"),
        ("a (at) b [dot] c (at) d.org", "email", "a (at) b [dot] c"),
        ("mail jаne@hоst.org now", "email", "jаne@hоst.org"),
        ("call plus four nine one five one two three four five six seven please", "phone",
         "plus four nine one five one two three four five six seven"),
        ("ip １９２.１６８.１.１ ok", "ip", "１９２.１６８.１.１"),
        ("ip 10[.]0[.]0[.]1 ok", "ip", "10[.]0[.]0[.]1"),
        ("card 4111​1111​1111​1111 ok", "card", "4111​1111​1111​1111"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, span):
    base, finds = find(text)
    assert (kind, text.index(span), text.index(span) + len(span)) in finds
    assert set(base) <= set(finds)
    assert span not in redact(text)


@pytest.mark.parametrize("text", ["meet me at noon. dot your i", "one two buckle my shoe", "look at this dot", "größer at home", "see us at host.org", "ten apples @ 3.50 each",
     "meet @ noon.then go", "version 2.0 at host.org", "it is 3 at best.So be it", "sie ist eins", "a – b"])
def test_prose_is_left_alone(text):
    assert find(text) == ([], [])
    assert redact(text) == text


@pytest.mark.parametrize(
    "text, clean",
    [
        ("to jane@mail.host [dot] org now", "to [email] now"),
        ("to jane [dot] roe@host.org now", "to [email] now"),
        ("jane@host.org, 10.0.0.1", "[email], [ip]"),
    ],
)
def test_redaction_covers_what_any_find_covers(text, clean):
    assert redact(text) == clean


def test_base_finds_stay():
    text = "jane@host.org and jane (at) host.org and 10.0.0.1"
    base, finds = find(text)
    assert [f for f in finds if f in base] == base == brute(text)
    assert len(finds) == 3


def test_rows(docs, no_docs, rows):
    found = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    assert pii.spans(docs).count() == len(rows)
    assert found[14]["finds"] == [] and pii.spans(docs).columns == ["doc_id", "base", "finds"]
    assert pii.spans(no_docs).count() == 0
    clean = pii.redacted(docs)
    assert clean.schema == docs.schema
    assert clean.where("text IS NULL").count() == docs.where("text IS NULL").count()
    assert pii.redacted(no_docs).count() == 0
