import zlib

from galecast.llm import sharding
from . import cases


def check(rows, out, shards, slack):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out) == sorted((r[0] is None, r[0] or 0) for r in rows)
    size, slots = [0] * shards, {}
    for r in out:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(size) - min(size) <= slack, size


def test_sizes_slots_and_checksums(spark):
    rows = cases.documents(5, 200, words=30)
    rows = [r for r in rows if len(r[1] or "") < 1000]
    texts = {}
    for r in rows:
        texts.setdefault(r[0], set()).add((zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 16))
    for rows_per_range in (1_000_000, 4):
        out = sharding.shard_digest(cases.frame(spark, rows, clashing=True), shards=5, rows_per_range=rows_per_range).collect()
        assert all((r["text_crc32"], r["size"]) in texts[r["doc_id"]] for r in out)
        check(rows, out, 5, 2 * max(s for v in texts.values() for _, s in v))


def test_hot_text_and_repeated_rows_are_split(spark):
    rows = [(i, "the same text", "en", "a", 0) for i in range(400)] + [(7, "one row", "en", "a", 0)] * 400
    out = sharding.shard_digest(cases.frame(spark, rows), shards=8)
    check(rows, out.collect(), 8, 100)


def test_few_rows_and_none(spark):
    assert sharding.shard_digest(cases.frame(spark, []), shards=4).collect() == []
    out = sharding.shard_documents(cases.frame(spark, [(None, None, None, None, None)]), shards=4).collect()
    assert len(out) == 1 and out[0]["slot"] == 0 and 0 <= out[0]["shard"] < 4
