import random
import re

from pyspark.sql import functions as F

from galecast.llm import pii
from . import cases

#: The contract's patterns.
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def sound(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(x) <= 255 for x in v.split("."))
    if kind == "card":
        total = sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(int(c) for c in reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return kind != "phone" or 8 <= len(d) <= 15


def plain(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in PLAIN.items() for m in re.finditer(p, text or "") if sound(k, m.group()))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(3)
    texts = [None, "", "a@b.c+d@e.f@g.h", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004 99999999999999999999.1.1.1",
             "4111 1111 1111 1111 4111-1111-1111-1111-1 41111111111111111111111 5 4111111111111111",
             "+1 (017) 555-7713 +12 +1--------2345678 ++49 30 123456 +1 234567890123456", "日é😀 a@b.co +1 555 010 9999 x", "9" * 3000,
             "a" * 3000, "a.b-c_d%e+f@x..y@z.w.v-", "1-2 3--4 4-9 9 8"]
    texts += ["".join(rng.choice("0123456789999 .-+()@aB_%日\n") for _ in range(rng.randrange(120))) for _ in range(1500)]
    texts += ["".join(rng.choice("ab.@+-") for _ in range(40)) for _ in range(800)]
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(1, texts[1], "en", "a", 1), (None, "x@y.z", "en", "a", 1)]
    got = pii.find_pii(cases.frame(spark, rows, clashing=True)).select("doc_id", pii.joined(F.col("base")).alias("s")).collect()
    want = [(i, plain(t)) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"filler number {i} of common words here\nplease ask Quaxolotl in room {i} at q@x.org today", "en", "a", 1) for i in range(6)]
    rows += [(100 + i, "please ask common people here today in the room of filler words number", "en", "a", 1) for i in range(300)]
    docs = cases.frame(spark, rows, clashing=True)
    found = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    text = rows[0][1]
    spans = [(s["kind"], text[s["start"]:s["end"]]) for s in found[0]["terms"]]
    assert spans == [("removed", "Quaxolotl")]
    assert not any(found[100 + i]["terms"] or found[100 + i]["base"] for i in range(300))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[0] == "filler number 0 of common words here\nplease ask  in room 0 at [EMAIL] today"
    assert clean[100] == rows[6][1]


def test_copies_are_one_context(spark):
    rows = [(i, "ask Quaxolotl at q@x.org", "en", "a", 1) for i in range(20)] + [(50 + i, f"more words {i} here", "en", "a", 1) for i in range(50)]
    assert not any(r["terms"] for r in pii.find_pii(cases.frame(spark, rows)).collect())


def test_sanitise_overlaps_nulls_and_empty(spark):
    rows = [(1, None, "en", "a", 1), (2, "", "en", "a", 1), (3, "1.2.3.4@x.org!", "en", "a", 1), (3, "1.2.3.4@x.org!", "en", "a", 1)]
    got = [r["text"] for r in pii.sanitise(cases.frame(spark, rows)).orderBy("doc_id").collect()]
    assert len(got) == 4 and got[:2] == [None, ""] and got[2] == got[3] and "1.2.3.4" not in got[2]
    assert pii.find_pii(cases.frame(spark, [])).collect() == [] and pii.sanitise(cases.frame(spark, [])).collect() == []


def test_disclosing_terms_go_wherever_their_entity_is_held(spark):
    far = "common filler words without any meaning " * 5
    tail = f"\n{far}\nQUAXOLOTL was here, quaxolotl@y.org too"
    rows = [(i, f"ask Quaxolotl in room {i} at q@x.org now" + (tail if i < 2 else ""), "en", "a", 1) for i in range(30)]
    rows += [(50 + i, f"number {i}: Brimbleton\nb@x.org is the way", "en", "a", 1) for i in range(6)]
    rows += [(99, f"q@x.org\n{far} Quaxolotl", "en", "a", 1), (100, "Quaxolotl and Brimbleton", "en", "a", 1), rows[0], (None, rows[1][1], "en", "a", 1)]
    rows += [(200 + i, f"{far} number here meaning", "en", "a", 1) for i in range(300)]
    docs = cases.frame(spark, rows, clashing=True)
    clean = sorted((r["doc_id"] or 0, r["text"]) for r in pii.sanitise(docs).collect())
    assert len(clean) == len(rows)
    text = dict(clean)
    assert all("quaxolotl" not in text[i].lower() for i in (0, 1, 5, 99)) and text[0].endswith(" was here, [EMAIL] too")
    assert all("Brimbleton" not in text[50 + i] for i in range(6))
    assert text[100] == "Quaxolotl and Brimbleton" and text[200] == rows[-1][1]
