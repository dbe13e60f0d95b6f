"""Secrets against plain regular expressions, links against all pairs."""

import hashlib
import re
import time

import pytest

from touchline.llm.secret_spans import KINDS, REACH, find_secrets, redact, secret_report

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
IDENT = re.compile(r"""(?:username|user|login|account|client_id|access_key_id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]+""", re.I | re.A)
ENDPOINT = re.compile(r"""(?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|s3)://[^\x20\x09-\x0D"'<>]+""")


def brute(text):
    """All spans as (start, kind, end): base ones by the contract's own patterns, weak ones where complements are near."""
    text = text or ""
    parts = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    parts += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    parts += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = sorted(parts)
    parts += [(m.start(), 3, m.end()) for m in IDENT.finditer(text)]
    parts += [(m.start(), 4, m.end()) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text)
              if all(re.search(c, m[0]) for c in ("[0-9]", "[A-Z]", "[a-z]"))]
    parts += [(m.start(), 5, m.end()) for m in ENDPOINT.finditer(text)]

    def near(p, kinds):
        return any(q[1] in kinds and q[0] <= p[2] + REACH and p[0] <= q[2] + REACH for q in parts)

    who, what = (1, 3), (0, 2, 4)
    kept = [p for p in parts if p[1] < 3 or (p[1] == 3 and near(p, what)) or (p[1] == 4 and near(p, who))
            or (p[1] == 5 and near(p, who) and near(p, what))]
    return base, sorted(kept)


KEY = "AKIA" + "ABCDEFGH12345678"
MIXED = "aB3" * 10
TEXTS = [
    None, "", "nothing", "password=token: abcdefgh12", "PassWord = 'abc.defg'", "token=short", "api_key:12345678 apikey : \"123456789",
    KEY + "X", "AKIA1234", "AKIAAKIA" + "A" * 12, "f" * 31, "f" * 32 + "g" + "0" * 40, "é😀 secret=" + "x" * 8 + " ü", "AKIA" * 5,
    f"user=bob {MIXED}", MIXED, "user=bob", f"user: bob{' ' * 600}{MIXED}", f"user: bob{' ' * 300}{MIXED}", "https://a.b/c",
    f"https://a.b/c {KEY} secret={'q' * 9}", f"{'w ' * 5000}login=al token={'z' * 12} s3://bucket/{'k' * 9} {'v ' * 5000}",
    "password=" + "a" * 32, "secret = \n12345678", "x" * 300_000, "token=" + "9" * 100_000, "a" * 200_000 + " " + KEY,
    "password=abcdefgh " * 300,
]


def test_equals_regular_expressions(frame):
    got = secret_report(frame(list(enumerate(TEXTS)))).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        base, spans = brute(TEXTS[r.doc_id])

        def text(found):
            return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)

        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in base) for i in range(3)], r.doc_id
        assert r.base_sha256 == hashlib.sha256(text(base).encode()).hexdigest(), r.doc_id
        assert r.spans == text(spans), r.doc_id


def test_weak_parts_need_their_complements(frame):
    got = {r.doc_id: r.spans for r in secret_report(frame(list(enumerate(TEXTS)))).collect()}
    assert got[14] == "ident:0:8,token:9:39" and got[15] == got[16] == got[17] == got[19] == ""
    assert [s.split(":")[0] for s in got[20].split(",")] == ["endpoint", "access", "assign"]


@pytest.mark.parametrize("mark", ["[SECRET]", "'\\1"])
def test_masking(frame, mark):
    docs = frame([(i, t) for i, t in enumerate(TEXTS)] * 2)
    out = redact(docs, mark=mark)
    assert out.columns == docs.columns and out.count() == 2 * len(TEXTS)
    for r in out.collect():
        text, at, want = TEXTS[r.doc_id], 0, ""
        for a, _, b in brute(text)[1]:
            if b > at:
                want += text[at:a] + mark if a >= at else ""
                at = b
        assert r.text == (text if text is None else want + text[at:]), r.doc_id
    assert find_secrets(frame([])).count() == 0


LONG = "aB3" * 234  # 702 characters, three steps


@pytest.mark.parametrize("text, masked", [
    (f"{LONG} login: bob", "[SECRET] [SECRET]"), (f"login: {'b' * 700} {MIXED}", "[SECRET] [SECRET]"),
    (f"https://a.b/{'c' * 700} {KEY} {MIXED}", "[SECRET] [SECRET] [SECRET]"),
    (f"{LONG}{' ' * 600}login: bob", f"{LONG}{' ' * 600}login: bob"), (f"user: bob{' ' * 600}{MIXED}", f"user: bob{' ' * 600}{MIXED}")])
@pytest.mark.parametrize("lead", [0, 100, 255])
def test_parts_are_linked_by_all_they_cover(frame, text, masked, lead):
    spans = secret_report(frame([(1, "." * lead + text)])).first().spans
    assert bool(spans) == ("[" in masked)
    assert redact(frame([(1, "." * lead + text)])).first().text == "." * lead + masked


@pytest.mark.parametrize("gap, linked", [(256, True), (257, False)])
@pytest.mark.parametrize("lead", [0, 1, 255])
def test_reach_does_not_depend_on_the_place(frame, gap, linked, lead):
    for text in (f"user:bob{' ' * gap}{MIXED}", f"{MIXED}{' ' * gap}user:bob"):
        got = secret_report(frame([(1, "." * lead + " " + text)])).first().spans
        assert bool(got) == linked and got == (brute("." * lead + " " + text)[1] and ",".join(
            f"{KINDS[k]}:{a}:{b}" for a, k, b in brute("." * lead + " " + text)[1]) or "")


def test_many_matches_in_one_text(frame):
    text = "é token=abcdefgh user=bob " * 8000
    docs = frame([(1, text)])
    began = time.time()
    report, masked = secret_report(docs).first(), redact(docs).first()
    assert report.n_assign == 8000 and report.spans.count("ident") == 8000
    assert masked.text == "é [SECRET] [SECRET] " * 8000 and time.time() - began < 20


def test_columns_with_any_name(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh", 5)], "doc_id long, text string, `a.b` int")
    assert redact(docs).columns == docs.columns and redact(docs).first().text == "[SECRET]"
