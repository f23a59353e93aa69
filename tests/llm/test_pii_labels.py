"""Planted personal data that no base pattern covers, and clean texts beside it."""

import random

import pytest

from lumafind.llm import pii

SECRETS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def token(rnd, n=32):
    while True:
        t = "".join(rnd.choice(SECRETS) for _ in range(n))
        changes = sum(("0" <= a <= "9", a.isupper()) != ("0" <= b <= "9", b.isupper()) for a, b in zip(t, t[1:]))
        if changes >= 0.4 * n and min(sum(map(f, t)) for f in (str.isdigit, str.isupper, str.islower)) >= 2:
            return t


def phone(rnd, mark="-"):
    return f"{rnd.randint(201, 989)}{mark}{rnd.randint(201, 989)}{mark}{rnd.randint(1000, 9999)}"


def planted(seed=1, n=60):
    """id -> (text, kind, planted part); kind None where the text is clean."""
    rnd = random.Random(seed)
    docs = []
    for k in range(n):
        docs += [
            (f"they sat with {phone(rnd)} and left", "phone"),
            (f"the man gave ({rnd.randint(201, 989)}) {rnd.randint(201, 989)}-{rnd.randint(1000, 9999)} there", "phone"),
            (f"an old line {phone(rnd, ' ')} was heard", "phone"),
            (f"please mail to bob{k} at example dot com soon", "email"),
            (f"then ann at host{k} dot org was seen", "email"),
            (f"we saw jo.li{k} at mail dot host dot org here", "email"),
            (f"in the log {token(rnd)} was left", "secret"),
            (f'api_key = "{token(rnd, 24)}" is set', "secret"),
            (f"on 2024-06-{rnd.randint(10, 28)} at noon, report-of-the-{k}-group-meeting went out", None),
            (f"the row {rnd.randint(100, 199)} {rnd.randint(100, 999)} {rnd.randint(1000, 9999)} of a table", None),
            (f"look at the dot com boom{k}, or go at nine dot thing", None),
            (f"a sum of {rnd.randint(1, 9)} 000 000 000 was paid on +1 (743) 555-{rnd.randint(1000, 9999)}", "base"),
        ]
    return docs


def found(spark, docs):
    rows = [(k, d[0]) for k, d in enumerate(docs)]
    return {r.doc_id: ([tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}


def test_what_no_base_pattern_covers(spark):
    docs = planted()
    spans = found(spark, docs)
    for k, (text, kind) in enumerate(docs):
        base, every = spans[k]
        if kind in (None, "base"):
            assert every == base and len(base) == (kind == "base"), text
        else:
            assert base == [] and [s[0] for s in every] == [kind], (text, every)
            hidden = text[every[0][1] : every[0][2]]
            assert text.startswith(hidden.split()[0], every[0][1]) and len(hidden) >= 12
            if " at " in text and kind == "email":
                assert hidden.endswith(("dot com", "dot org"))


@pytest.mark.parametrize("text, kind", [("mail bob at example dot com", "email"), ("they sat with 743-555-3824 there", "phone"), ("it is " + token(random.Random(3)), "secret")])
def test_alone(spark, text, kind):
    """Evidence needs no other documents."""
    assert [s[0] for s in found(spark, [(text,)])[0][1]] == [kind]


def test_rare_generator_beside_many_others(spark, monkeypatch):
    """The bounded sample only fits the trees: thresholds come from all labelled proposals, so a rare generator
    isn't lost among the others."""
    monkeypatch.setattr(pii, "SAMPLE", 80)
    rnd = random.Random(5)
    docs = [(f"token: {token(rnd)} report-of-the-{k}-group-meeting 2024-06-{rnd.randint(10, 28)} end",) for k in range(400)]
    docs += [(f"please mail to {a} at {b} dot com soon",) for a in ("bob", "joan", "eli") for b in ("example", "host")]
    docs += [(f"look at {a} dot com boom",) for a in ("the", "every", "your", "this")]
    docs += [("then ann at host dot org was seen",)]
    spans = found(spark, docs)
    assert [s[0] for s in spans[len(docs) - 1][1]] == ["email"]
    assert spans[len(docs) - 2][1] == []
    assert all([s[0] for s in spans[k][1]] == ["secret"] for k in range(400))
