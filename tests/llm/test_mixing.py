import pytest

from galecast.llm import mixing
from . import cases


def water(sizes, ratio=1.5, epochs=2, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cap = ratio * sum(sizes.values()), {s: epochs * n for s, n in sizes.items()}
    target, open_ = {}, set(order)
    while open_:
        level = (total - sum(target.values())) / sum(w[s] for s in open_)
        full = {s for s in open_ if w[s] * level >= cap[s]}
        if not full:
            target |= {s: w[s] * level for s in open_}
            break
        target |= {s: cap[s] for s in full}
        open_ -= full
    return target


def test_targets_taken_words_and_reruns(spark):
    rows = cases.documents(3, 90)
    docs = cases.frame(spark, rows, clashing=True)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 0)], "doc_id long, quality int")
    plan = mixing.mix_plan(docs, labels).collect()
    assert len(plan) == len(rows)
    sizes, biggest = {}, {}
    for _, t, _, s, _ in rows:
        n = len(cases.words(t))
        sizes[s] = sizes.get(s, 0) + n
        biggest[s] = max(biggest.get(s, 0), n)
    target, taken = water(sizes), dict.fromkeys(sizes, 0)
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= biggest[s] / 2 + 1e-6
    again = mixing.mix_plan(docs.repartition(7), labels).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, plan))


@pytest.mark.parametrize("sort_rows", [mixing.SORT_ROWS, 3])
def test_equal_rows_are_cut_one_by_one(spark, monkeypatch, sort_rows):
    monkeypatch.setattr(mixing, "SORT_ROWS", sort_rows)
    ten = "one two three four five six seven eight nine ten"
    rows = [(1, ten, "en", "b", 0)] * 400 + [(k, "w " * (1 + k % 7), "en", "a", 0) for k in range(2, 500)] + [(k, "", "en", None, 0) for k in range(9)]
    docs = cases.frame(spark, rows).repartition(5)
    plan = mixing.mix_plan(docs).collect()
    target = water({"b": 4000, "a": sum(1 + k % 7 for k in range(2, 500)), None: 0})
    for source, slack in (("b", 5), ("a", 3.5)):
        assert abs(sum(r["taken"] for r in plan if r["source"] == source) - target[source]) <= slack
    mixed = mixing.mix(docs).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in mixed} == {s: sum(r["copies"] for r in plan if r["source"] == s) for s in ("a", "b")}


def test_mix_repeats_rows_and_keeps_columns(spark):
    docs = cases.frame(spark, cases.documents(4, 40), clashing=True)
    plan = {}
    for r in mixing.mix_plan(docs).collect():
        plan.setdefault((r["doc_id"], r["source"]), []).append(r["copies"])
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(sum(c) for c in plan.values())


def test_no_rows_no_words(spark):
    empty = cases.frame(spark, [])
    assert mixing.mix_plan(empty).collect() == [] and mixing.mix(empty).collect() == []
    nothing = mixing.mix_plan(cases.frame(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in nothing] == [(0, 0, 0)] * 2
