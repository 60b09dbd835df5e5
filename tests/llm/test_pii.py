import random
import re
from hashlib import sha256

from cairnflow.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        d = re.sub(r"[ -]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


PIECES = ["a@b.c", "@", "x.y@mail-1.example.com", "é", " ", "1.2.3.4", "1.2.3.4.5.6", "256.1.1.1", "0001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+", "+1", "+49.30.1234567-", "...", "-", "12", "a@b.c_d@e.f.", "٣", "😀", "\n", "(", "99999999999999"]


def test_base_equals_patterns():
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
        assert pii.base_spans(text) == brute(text), repr(text)


def test_long_texts_take_linear_time():
    for text in ("1" * 300000, "a" * 300000 + "@", "1." * 150000 + "x", "+1" + "(" * 300000, "@" * 300000, "a@" * 150000, "1 " * 150000, "a at b dot " * 30000):
        spans = pii.base_spans(text)
        pii.candidates(text, spans[:10])
        pii.candidates(text, spans)
    before = pii.Contexts("a@b.co," * 40000).before  # one word
    assert len([before(s) for s, _, _ in pii.base_spans("a@b.co," * 40000)]) == 40000
    text = "a@b.co 030 555 4477 " * 20000  # as many candidates as base spans
    spans = pii.base_spans(text)
    before = pii.Contexts(text).before
    assert len(spans) == len(pii.candidates(text, spans)) == 20000 and len([before(s) for s, _, _ in spans]) == 20000


def test_contexts():
    before = lambda text, mark: pii.Contexts(text).before(text.index(mark))
    long = "y" * 5000
    assert before("one Two3 +1", "+1") == ["two0", "one two0"] and before("+1", "+1") == []
    assert before("call tel:+1", "+1") == ["tel:" + pii.GLUED, "call tel:" + pii.GLUED]
    assert before(f"{long} {long} +1", "+1") == [long, f"{long} {long}"]
    assert before("\u00e9a@b.c", "a@") == []  # no sign stands before it
    assert before("on x=1;tel::+1", "+1") == ["tel::" + pii.GLUED] and before("a (+1", "+1") == ["(" + pii.GLUED, "a (" + pii.GLUED]
    assert before("x\n\ty +1", "+1") == ["y", "x y"]


def test_scan_and_discovery(spark):
    rows = [(i, f"Some words {i % 7} mobile: +1 (555) 010-{1000 + i} and more", "x") for i in range(20)]
    rows += [(100, "Reach me, mobile: 030 555 4477 today", "x"), (101, "serial 030 555 9999 was sold", "x")]
    rows += [(200 + i, f"contact: user{i}@mail.example.com thanks", "x") for i in range(10)] + [(300, "contact: jane at mail dot org thanks", "x"), (301, "contact: jane at mail dot org thanks", "x")]
    rows += [(400 + i, f"of the +1 (555) 020-{1000 + i} and of the end of the day", "x") for i in range(10)] + [(450, "of the 040 111 2222 end", "x")]
    rows += [(500, None, "x"), (501, "", None), (None, "4111 1111 1111 1111", "x"), (7, rows[7][1], "x"), (600, "word " * 40000 + "a@b.co", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = pii.scan(docs).collect()
    assert len(got) == len(rows)
    want = []
    for i, text, _ in rows:
        spans = brute(text or "")
        line = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        more = {100: [(18, 3, 30)], 300: [(9, 0, 29)], 301: [(9, 0, 29)]}.get(i, [])
        full = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans + more))
        want.append((i, *[sum(k == x for _, k, _ in spans) for x in range(4)], sha256(line.encode()).hexdigest(), full))
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
    assert pii.scan(docs.limit(0)).count() == 0


def test_discovery_reaches_a_fixed_point(spark):
    rows = [(i, f"w{i}a mobile: +1 (555) 010-{1000 + i} and", "x") for i in range(5)]
    rows += [(100 + i, f"{a} 030 555 {1000 + i} today", "x") for i in range(4) for a in ("mobile:", "fon")]  # known by their first context
    rows += [(200 + i, f"{a} 040 666 {1000 + i} today", "x") for i in range(4) for a in ("fon", "ring")]  # by one that those induce
    rows += [(300 + i, f"ring 050 777 {1000 + i} today", "x") for i in range(40)]  # by the third, and more than those known
    rows += [(400 + i, f"tel:+1 (555) 020-{1000 + i} and", "x") for i in range(5)] + [(450, "tel:060 888 1234 or", "x"), (451, "the 060 888 1234 or", "x")]
    rows += [(500 + i, f"no:+1 (555) 030-{1000 + i} and no:thing no:body no:one", "x") for i in range(5)] + [(550, "no:070 999 1234 or", "x")]
    rows += [(600, "serial 080 999 1234 of", "x")]
    got = {(r["doc_id"], r["spans"]) for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()}
    bare = {i for i, spans in got if not spans}
    assert len(got) == len(rows) and bare == {550, 600}


def test_long_contexts_and_many_patterns(spark, monkeypatch):
    """Words of any length are patterns; a small bitmap and a small counter change nothing."""
    long = "z" * 700
    rows = [(i, f"{long} +1 (555) 010-{1000 + i} and", "x") for i in range(6)] + [(50, f"{long} 030 555 4477 today", "x"), (51, "other 030 555 9999 today", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    for bitmap, counter in ((1 << 24, 1 << 19), (8, 2)):
        monkeypatch.setattr(pii, "BITMAP", bitmap)
        monkeypatch.setattr(pii, "COUNTER", counter)
        got = {r["doc_id"]: r["spans"] for r in pii.scan(docs).collect()}
        assert got[50] == "phone:701:713" and got[51] == ""


def test_redact_keeps_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or +1 (555) 010-9999.", "x", 33), (2, None, "y", None), (None, "clean", "z", 5)], "doc_id long, text string, more string, n_chars long")
    got = sorted((tuple(r) for r in pii.redact(docs).collect()), key=repr)
    assert got == sorted([(1, "mail [EMAIL] or [PHONE].", "x", 24), (2, None, "y", None), (None, "clean", "z", 5)], key=repr)
