import random
import re

import pytest

from flowspark.llm import pii, queries

from .helpers import SCHEMA, awkward


def base_spans(text):
    """The contract's patterns as they are written."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = digits(m.group())
        total = sum(int(x) if k % 2 == 0 else sum(map(int, str(2 * int(x)))) for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m.group())) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_base_spans_against_the_patterns():
    rng = random.Random(4)
    pieces = ["a.b", "@", "x", ".com", ".", "1", "255", "256", "00", "+1", "(2)", "-", " ", "4111 1111 1111 1111", "4929348385146330", "é", "\n", "%+", "٣", "-a", "@b.c", "+"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14)))
        assert pii.identifiers(text) == base_spans(text), text


# each disguise, with what of it is the identifier
DISGUISED = [
    ("email", "jane.doe7 [at] mail [dot] example (dot) com"), ("email", "jane dot doe at example dot com"), ("email", "jane_d at mail7.example.com"), ("email", "jаne@exаmple.com"), ("email", "jane＠example．com"),
    ("email", "ja​ne@example.com"), ("email", "jane&#64;mail&#46;org"), ("email", "jane@mail dot example dot org"), ("email", "JANE {AT} Example {DOT} COM"), ("email", "ana arroba correo punto es"), ("email", "\U0001d423ane@mail.com"),
    ("ip", "192[.]168[.]1[.]10"), ("ip", "192 dot 168 dot 1 dot 10"), ("ip", "one two seven dot zero dot zero dot one"), ("ip", "１９２.168.1.1"), ("ip", "l92.168.1O.1"),
    ("card", "four nine two nine three four eight three eight five one four six three three zero"), ("card", "4929–3483–8514–6330"), ("card", "4929 3483 85l4 633O"), ("card", "vier neun zwei neun 3483 8514 6330"), ("card", "4929 3483 8514 6330"),
    ("phone", "plus one nine seven four five five five three four three six"), ("phone", "+1 (974) triple five 3436".replace("triple five", "five five five")), ("phone", "+49 30–123–4567"), ("phone", "plus un neuf sept quatre cinq cinq cinq trois quatre trois six"), ("phone", "+1 (2O3) 555-l234"),
]


@pytest.mark.parametrize("kind, text", DISGUISED)
def test_disguises_are_seen_through(kind, text):
    for before, after in (("", ""), ("Schön \U0001f600 word ", " und so."), ("x\n", "\ny")):
        base, added = pii.find(before + text + after)
        assert (len(before), len(before) + len(text), kind) in added
        assert base == base_spans(before + text + after)


@pytest.mark.parametrize("text", ["Look at the dot com boom, at last.", "Meet us at example.com or at home.", "One, two, three and four of them.", "Un dos tres.", "Point at the dot in it.", "10 l of oil at 20 point 5 degrees", "A 1990s song at 7.30", "m² and 3–4 of 5·6", "See (at) the end (.) of it", "он пришёл в 10.20", "<at> {dot}"])
def test_plain_prose_stays(text):
    assert pii.find(text) == ([], [])


def test_added_spans_leave_base_ones(spark):
    text = "a@b.com, 4929348385146330, nаme@x.org"
    base, added = pii.find(text)
    assert base == base_spans(text) and (27, 37, "email") in added
    assert pii.redacted(text, sorted(base + added)) == "<email>, <card>, <email>"


def test_query_and_operator(spark, tmp_path):
    rows = awkward() + [(900 + k, f"x {t} y a@b.co +1 (974) 555-3436", "", "", 0) for k, (_, t) in enumerate(DISGUISED)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = sorted((r.doc_id, r.text, [tuple(s) for s in r.spans]) for r in pii.find_pii(docs).collect() if r.doc_id is not None)
    want = sorted((r[0], r[1], sorted([(k, a, b, True) for a, b, k in pii.find(r[1])[0]] + [(k, a, b, False) for a, b, k in pii.find(r[1])[1]], key=lambda s: (s[1], pii.KINDS.index(s[0]), s[2]))) for r in rows if r[0] is not None)
    assert str(out) == str(want)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    import hashlib

    got = {str(r.doc_id) + str(r.base_sha256): r for r in queries.op12_pii(spark, str(tmp_path)).collect()}
    for r in rows:
        base = base_spans(r[1])
        found = got[str(r[0]) + hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()]
        assert [found.n_email, found.n_ip, found.n_card, found.n_phone] == [sum(k == kind for *_, k in base) for kind in pii.KINDS]
    assert pii.find_pii(docs.limit(0)).collect() == []


def test_any_text_is_linear():
    import time

    n = 300_000
    began = time.time()
    for text in ["a" * n, "1 " * n, "1" * n, "1." * n, "+1(" * n, "@" * n, "a@" * n, " " * n, "\t[ " * n, " dot " * n, "a at b." * n, "x at " + "b dot " * n, "b dot " * n + " at x dot com", "<" * n, "one " * n, "O1" * n, "&#64;" * n]:
        pii.find(text)
    assert time.time() - began < 90
