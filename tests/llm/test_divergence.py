import re
from collections import Counter, defaultdict

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from galecast.llm import divergence, kernels
from . import cases

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, min_df, top=50):
    docs = [((r[2] or ""), (r[3] or ""), TERM.findall((r[1] or "").translate(cases.LOWER))) for r in rows]
    held, groups, counts = defaultdict(Counter), defaultdict(set), defaultdict(Counter)
    for lang, source, words in docs:
        held[lang].update(set(words))
        groups[lang].add(source)
        counts[lang, source].update(words)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in held[lang].items() if n >= min_df]
        share = lambda c, n: 1 + 1_000_000_000 * (c + 5) // (n + 5 * len(kept))  # noqa: E731, B023
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: share(counts[lang, s][t], total[s]) for t in kept} for s in sources}
        q = {t: share(sum(counts[lang, s][t] for s in sources), sum(total.values())) for t in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources - {s}]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, limit in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(found[:limit])]
    return sorted(out)


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def awkward():
    rows = cases.documents(n=90)
    langs = ["en", "de", None, "", "x\x01y"]
    rows = [(i, t, langs[k % 5], s, n) for k, (i, t, _, s, n) in enumerate(rows)]
    return rows + [(500, "Alone Ünd alone", "one", "only", 0), (501, None, "de", "empty", 0), (502, "q", "none", "a", 0), (503, "", "none", "b", 0)]


@pytest.mark.parametrize("max_terms", [divergence.MAX_TERMS, -1])
@pytest.mark.parametrize("clashing", [False, True])
def test_equals_plain_counts(spark, max_terms, clashing):
    rows = awkward()
    got = rows_of(divergence.audit(cases.frame(spark, rows, clashing), min_df=3, top_terms=5, max_terms=max_terms))
    assert got == plain(rows, 3, 5) and any(r[2] == "term" for r in got)


def test_blocks_of_terms_add_up(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 4)
    rows = awkward()
    assert rows_of(divergence.audit(cases.frame(spark, rows), min_df=2)) == plain(rows, 2)


def test_no_kept_terms_and_empty_table(spark):
    rows = awkward()
    got = rows_of(divergence.audit(cases.frame(spark, rows), min_df=1000))
    assert got == plain(rows, 1000) and {r[4] for r in got} == {0}
    assert divergence.audit(spark.createDataFrame([], cases.SCHEMA)).collect() == []


@pytest.mark.parametrize("entries", [1 << 20, 40])
def test_vectoriser_gets_bundles(monkeypatch, entries):
    monkeypatch.setattr(divergence, "ENTRIES", entries)
    monkeypatch.setattr(divergence, "STRINGS", 7)
    monkeypatch.setattr(divergence, "row_slices", lambda text: kernels.row_slices(text, 200))
    rows = [(t or "", lang or "", source or "") for _, t, lang, source, _ in awkward()] + [("Common common rare", "en", "s")] * 100
    batch = pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows], "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    held, used = Counter(), Counter()
    for t, lang, source in rows:
        words = TERM.findall(t.translate(cases.LOWER))
        held.update({f"{lang}\x01{w}" for w in words})
        used.update((lang, source, f"{lang}\x01{w}") for w in words)
    fitted = [r["terms"] for b in divergence._presences(3)(iter([batch])) for r in b.to_pylist()]
    assert all(len(set(terms)) == len(terms) and terms.count("") == 1 for terms in fitted) and len(fitted) >= 3
    got = Counter(t for terms in fitted for t in terms if t)
    assert {t for t, n in got.items() if n >= 3} == {t for t, n in held.items() if n >= 3} and got.keys() == held.keys()
    bags = Counter()
    for b in divergence._bags(iter([batch])):
        for r in b.to_pylist():
            bags.update({(r["lang"], r["source"], t): r["weight"] for t in r["terms"]})
    assert bags == used
    if entries > 40:
        # Handed on once a bundle, not once a text.
        assert got["en\x01common"] == 3 and sum(len(t) for t in fitted) < sum(held.values())


def test_texts_are_split_once_for_fit_and_vectors(spark, monkeypatch, tmp_path):
    """Each text is split once besides the sampled ones, and the vectoriser gets a term at most ``min_df`` times in all."""
    rows = [(k, "common Common words", "en", f"s{k % 3}", 0) for k in range(200)]
    seen = spark.sparkContext.accumulator(0)
    split = divergence._counted

    def counted(batches):
        def watched():
            for b in batches:
                seen.add(len(b))
                yield b
        return split(watched())

    monkeypatch.setattr(divergence, "_counted", counted)
    fitted = []
    fit = divergence.CountVectorizer.fit
    monkeypatch.setattr(divergence.CountVectorizer, "fit", lambda self, df: fitted.append([r["terms"] for r in df.collect()]) or fit(self, df))
    docs = cases.frame(spark, rows).repartition(7)
    assert rows_of(divergence.audit(docs, min_df=3)) == plain(rows, 3)
    assert seen.value == len(rows)
    got = Counter(t for terms in fitted[0] for t in terms if t)
    assert got == {"en\x01common": 3, "en\x01words": 3}


def test_stored_bundles_come_back(monkeypatch):
    rows = [(t or "", lang or "", source or "") for _, t, lang, source, _ in awkward()]
    batch = pa.RecordBatch.from_pydict({"lang": [r[1] for r in rows], "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    held = Counter((lang, w) for t, lang, _ in rows for w in set(TERM.findall(t.translate(cases.LOWER))))
    for entries in (1 << 20, 40):
        monkeypatch.setattr(divergence, "ENTRIES", entries)
        stored = list(divergence._counted(iter([batch])))
        for make in (divergence._bags, divergence._presences(3)):
            assert [b.to_pylist() for b in make(iter(stored))] == [b.to_pylist() for b in make(iter([batch]))]
        parts = pa.Table.from_batches(list(divergence._parted(iter(stored))))
        found = Counter()
        for p in range(divergence.PARTS):
            own = parts.filter(pc.equal(parts["part"], p)).select(divergence._STORED)
            for bundle in divergence._restored(divergence._whole_bundle(own)):
                langs = list(dict.fromkeys(lang for lang, _ in bundle.groups))
                terms = [(langs[k], t.decode()) for k, t in zip(bundle.tongue, bundle.terms.to_pylist(), strict=True)]
                assert not found.keys() & set(terms) and len(set(terms)) == len(terms)
                found.update(dict(zip(terms, bundle.held.tolist(), strict=True)))
        assert found == held
