from __future__ import annotations

import hashlib
import random
import re

import pytest

from gradeflow.llm import pii


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


# the contract's patterns as they are given, and its checks
PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 14 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and plain_luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 10 <= len(re.sub("[^0-9]", "", s)) <= 15),
}


def brute(text):
    found = [(m.start(), list(PLAIN).index(k), k, m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text or "") if ok(m[0])]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a", "b.c", "@", "@", ".", ".", "-", "+", "+1", "12", "7", "255", "256", "001", " ", " ", "(", ")", "x@y.z", "4111111111111111", "4111-1111-1111-1111", "1.2.3.4", "é", "_", "%", "\n", "555", "743", "١", "0", "²", "٣.٤"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        spans = pii.identifiers(text)
        assert [s[:3] for s in spans if s[3]] == brute(text), text
        assert len({s[:3] for s in spans}) == len(spans) and all(0 <= a < b <= len(text) for _, a, b, _ in spans)


DISGUISED = [
    ("email", "john.smith@mail5.example.com", ["john.smith (at) mail5 (dot) example (dot) com", "john dot smith at mail5 dot example dot com", "john.smith[@]mail5[.]example[.]com", "john.smith&#64;mail5&#46;example&#46;com", "john.smith @ mail5 . example . com",
     "john.smith＠mail5．example．com", "jоhn.smith@mаil5.example.cоm", "john.smith AT mail5 DOT example DOT com", "john.smith {at} mail5 {dot} example.com", "jo​hn.smith@mail5.example.com", "𝐣𝐨𝐡𝐧.smith@mail5.example.com", "john.smith arroba mail5 punto example punto com", "john.smith arobase mail5 point example point com"]),
    ("ip", "192.168.1.10", ["192[.]168[.]1[.]10", "192 dot 168 dot 1 dot 10", "one nine two dot one six eight dot one dot one zero", "١٩٢.١٦٨.١.١٠", "l92.l68.1.1O", "192（.）168（.）1（.）10"]),
    ("card", "4041894974608795", ["four zero four one eight nine four nine seven four six zero eight seven nine five", "4041 8949 7460 eight seven nine five", "4O4l 8949 746O 8795", "４０４１-８９４９-７４６０-８７９５", "4041–8949–7460–8795", "vier null vier eins acht neun vier neun sieben vier sechs null acht sieben neun fünf",
     "quatre zéro quatre un huit neuf quatre neuf sept quatre six zéro huit sept neuf cinq", "cuatro cero cuatro uno ocho nueve cuatro nueve siete cuatro seis cero ocho siete nueve cinco"]),
    ("phone", "+17435553824", ["plus one seven four three triple five three eight two four", "+1 seven four three, five five five, three eight two four", "+１ (７４３) ５５５-３８２４", "+1 (743) 5S5-38Z4".replace("Z", "2"), "＋1 743 555 3824"]),
]


@pytest.mark.parametrize("kind,want,text", [(k, w, t) for k, w, ts in DISGUISED for t in ts])
def test_disguises_map_back_to_their_source(kind, want, text):
    for before, after in (("", ""), ("Größe; сорок: ", " und so weiter"), ("ｗｉｄｅ​ text:\n", "\nnext"), ("x (at) (dot) ", ", yes")):
        whole = before + text + after
        found = [(k, a, b) for k, a, b, base in pii.identifiers(whole) if not base]
        assert (kind, len(before), len(before) + len(text)) in found, (whole, found)
        assert [s[:3] for s in pii.identifiers(whole) if s[3]] == brute(whole)


def test_what_failed_matches_hold_is_added():
    text = "+1 (269) 555-3296 4524132264652876 4465758382889437 4465758382889437"
    found = [(k, text[a:b], base) for k, a, b, base in pii.identifiers(text)]
    assert found == [("phone", "+1 (269) 555-3296", False), ("card", "4524132264652876", False), ("card", "4465758382889437", False), ("card", "4465758382889437", False)]


def test_prose_and_numbers_are_left_alone():
    for text in ("look at some point we go", "one of the two at the one time", "He was at home. dot com boom", "I am at three point five percent", "see (at) the end (dot) of", "v1.2.3 and 10.5.3", "un point important à dix-sept", "Привет мир, это текст", "12,345,678 of 9 876 543 210 items", "a @ b", "1.2.3", "the SOS 8OB Il sign"):
        assert pii.identifiers(text) == [], text


def test_edits_trace_places_back():
    rng = random.Random(9)
    for _ in range(500):
        source = "".join(rng.choice("abcdef") for _ in range(rng.randint(1, 30)))
        cuts = sorted(rng.sample(range(len(source) + 1), min(len(source) + 1, 2 * rng.randint(0, 4))))
        edits = [(a, b, rng.choice(["", "X", "YZ"])) for a, b in zip(cuts[::2], cuts[1::2], strict=False)]
        done = pii.Rewritten(source, edits)
        for a in range(len(done.text)):
            for b in range(a + 1, len(done.text) + 1):
                s, e = done.source(a, b)
                inner = [x for x in edits if s <= x[0] and x[1] <= e]
                made, at = "", s
                for start, end, new in inner:
                    made, at = made + source[at:start] + new, end
                assert done.text[a:b] in made + source[at:e]


def test_long_runs_take_linear_time():
    import time

    for piece in ("a", "1", "1.", "a.", "@", "a@", "+1", "1-", "one ", "(at) ", "O", " dot", "\t", "x at y dot ", "é1", "&#64;", "[", "+1(", "o1 "):
        text = piece * (400_000 // len(piece))
        began = time.perf_counter()
        pii.identifiers(text)
        assert time.perf_counter() - began < 10, piece


def test_operator_and_query_columns(spark, odd, empty):
    rows = [(1, "mail a@b.co or a (at) b (dot) co"), (2, None), (3, ""), (None, "+1 (743) 555-3824"), (3, "1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pii.report(pii.find_identifiers(df)).collect()
    assert len(out) == 5
    one = next(r for r in out if r.doc_id == 1)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone, one.n_added) == (1, 0, 0, 0, 1)
    assert one.spans == "email:5:11,email:15:32" and one.base_sha256 == hashlib.sha256(b"email:5:11").hexdigest()
    assert next(r for r in out if r.doc_id is None).spans == "phone:0:17"
    assert next(r for r in out if r.doc_id == 2).base_sha256 == hashlib.sha256(b"").hexdigest()
    masked = {r.text for r in pii.redact(df).collect()}
    assert masked == {"mail <EMAIL> or <EMAIL>", None, "", "<PHONE>", "<IP>"}
    assert pii.find_identifiers(odd).count() == odd.count() and pii.redact(odd).schema == odd.schema
    assert pii.find_identifiers(empty).collect() == [] and pii.redact(empty).collect() == []


def test_documents_equal_the_patterns(docs):
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = pii.find_identifiers(docs).collect()
    assert {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.base] for r in out} == {i: brute(t) for i, t in texts.items()}
    assert any(r.spans for r in out)
