import random

from galecast.llm import licenses
from . import cases


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def test_alignment_rises_matches_and_is_no_longer_than_the_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(9) for _ in range(rng.randrange(25))]
        b = [rng.randrange(9) for _ in range(rng.randrange(15))]
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
        assert len(pairs) <= lcs(a, b) and bool(pairs) == bool(set(a) & set(b))


def test_longest_rising_run():
    rng = random.Random(3)
    for _ in range(100):
        places = rng.sample(range(20), 10)
        run = licenses.rising([(x, j) for j, x in enumerate(places)])
        assert all(p < q for (p, _), (q, _) in zip(run, run[1:]))
        assert len(run) == lcs(places, sorted(places))


def test_finds_notices_whole_texts_and_repeats(spark):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, f"some words before it. {mit} and after", "en", "a", 1),
            (2, "x " + mit.replace("Software", "Program").replace(",", "\n"), "en", "a", 1),
            (3, "Released under the MIT License.\nReleased under the MIT License.", "en", "a", 1),
            (4, "the under of released and license to version", "en", "a", 1),
            (5, None, "en", "a", 1), (6, "", "en", "a", 1),
            (7, "long " * 50_000 + "Licensed under the Apache License, Version 2.0. " + "tail " * 50_000, "en", "a", 1)]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(cases.frame(spark, rows, clashing=True)).collect()}
    best = {i: (r["lic_found"][0]["license"] if r["lic_found"] else None) for i, r in out.items()}
    assert best == {1: "MIT", 2: "MIT", 3: "MIT notice", 4: None, 5: None, 6: None, 7: "Apache-2.0 notice"}
    assert out[1]["lic_found"][0]["coverage"] == 1 and out[1]["lic_found"][0]["first_word"] == 4
    assert 0.8 <= out[2]["lic_found"][0]["coverage"] < 1
    assert out[7]["lic_found"][0]["first_word"] == 50_000
    assert licenses.scan_licenses(cases.frame(spark, [])).collect() == []


def test_equals_alignment_of_every_pair(spark):
    rows = cases.documents(6, 30, vocabulary=8)
    texts = {f"t{k}": " ".join(cases.words(rows[k][1])[:12]) for k in (2, 9, 14)} | {"none": "..."}
    for r in licenses.scan_licenses(cases.frame(spark, rows), texts, 0.7).collect():
        w = cases.words(r["text"], cases.ALNUM, True)
        want = {}
        for name, t in texts.items():
            g = cases.words(t, cases.ALNUM, True)
            n = len(licenses.align([x for x in w if x in set(g)], g))
            if g and n and n >= 0.7 * len(g):
                want[name] = n
        assert {f["license"]: f["matched"] for f in r["lic_found"]} == want


def windows(text, template, words):
    """The best common subsequence in a window of ``words`` words."""
    return max(lcs(text[i:i + words], template) for i in range(max(1, len(text) - words + 1)))


def test_alignment_equals_the_best_window():
    rng = random.Random(7)
    for size in (5, 12, 40):
        for _ in range(25):
            template = [rng.randrange(size) for _ in range(size)]
            text = [rng.randrange(size + 2) for _ in range(300)]
            text[rng.randrange(250):] = [x for x in template if rng.random() < 0.9] + text[:40]
            width = size + size // 2 + 4
            pairs = licenses.align(text, template)
            assert all(text[i] == template[j] for i, j in pairs)
            assert all(x < u and y < v for (x, y), (u, v) in zip(pairs, pairs[1:]))
            assert len(pairs) == windows(text, template, width)


def test_long_texts_that_repeat_the_words_of_a_template(spark):
    stray = "mit released under the released under the license "
    notice = "Released under the MIT License. "
    far = " filler" * 40 + " "
    rows = [(1, stray + notice + "the", "en", "a", 1), (2, (stray + far) * 200 + notice + (far + stray) * 200, "en", "a", 1),
            (3, far.join(["released", "under", "the", "mit", "license"]), "en", "a", 1),
            (4, far.join(["released", "license", "the", "mit", "under"] * 100), "en", "a", 1)]
    found = {}
    for r in licenses.scan_licenses(cases.frame(spark, rows)).collect():
        found[r["doc_id"]] = {f["license"]: f for f in r["lic_found"]}.get("MIT notice")
    assert found[3] is None and found[4] is None
    assert found[1]["coverage"] == found[2]["coverage"] == 1
    assert (found[1]["first_word"], found[1]["last_word"]) == (8, 12)
    assert found[2]["first_word"] == 200 * 48


def test_common_licences_by_text_and_notice(spark):
    pad = "some words of a document "
    wanted = {**licenses.TEMPLATES, **licenses.texts()}
    rows = [(i, pad * 3 + t + " " + pad * 3, "en", "a", 1) for i, t in enumerate(wanted.values())]
    rows.append((1000, f"{pad} Licensed under CC BY-NC 4.0. {pad * 9} Licensed under CC BY 4.0.", "en", "a", 1))
    found = {r["doc_id"]: [f["license"] for f in r["lic_found"]] for r in licenses.scan_licenses(cases.frame(spark, rows)).collect()}
    assert {n: found[i] for i, n in enumerate(wanted)} == {n: [n] for n in wanted}
    assert sorted(found[1000]) == ["CC-BY-4.0 notice", "CC-BY-NC-4.0 notice"]
