import pytest

from galecast.llm import decontam
from . import cases


def plain(text, items, window=10):
    w = cases.words(text, cases.ALNUM, True)
    hit, found = [False] * len(w), set()
    for item, t in items:
        g = cases.words(t, cases.ALNUM, True)
        n = min(window, len(g))
        for a in range(len(g) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p:p + n] == g[a:a + n]:
                    found.add(item)
                    hit[p:p + n] = [True] * n
    return len(w), sum(hit), {str(i) if i is not None else None for i in found}


@pytest.mark.parametrize("block_bytes", [1 << 22, 60])
def test_equals_plain_search(spark, block_bytes):
    rows = cases.documents(7, 40, vocabulary=6)
    passage = " ".join(cases.words(rows[3][1])[:25])
    items = [(1, passage), (2, "CHANGED"), (2, "CHANGED"), (3, None), (4, "..."), (None, "ab  ab"),
             (5, " ".join(cases.words(rows[-3][1])[100:140]).upper()), (6, passage)]
    rows.append((900, f"x {passage.replace(' ', ', ')}! y", "en", "a", 1))
    found = decontam.find_contamination(cases.frame(spark, rows, clashing=True),
                                        spark.createDataFrame(items, "item_id long, text string"), block_bytes)
    for r in found.collect():
        n, hit, ids = plain(r["text"], items)
        assert (r["bench_words"], r["bench_hits"], set(r["bench_items"])) == (n, hit, ids)
        assert len(r["bench_items"]) == len(ids)
        spans = r["bench_spans"]
        assert sum(b - a for a, b in zip(spans[::2], spans[1::2])) == hit


def test_nothing_to_search_for_or_in(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontam.find_contamination(cases.frame(spark, cases.documents(2, 5)), none).collect()
    assert len(out) == 12 and not any(r["bench_hits"] or r["bench_items"] for r in out)
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontam.find_contamination(cases.frame(spark, []), some).collect() == []
