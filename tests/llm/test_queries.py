"""The registered queries on the smallest tables, against SQL or plain versions."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import duckdb
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from galecast.llm.oracle import llm_oracle  # noqa: E402
from galecast.llm.queries import llm_queries  # noqa: E402
from tools.oracle_check import frame_hash  # noqa: E402
from . import cases  # noqa: E402
from .test_near_dup import plain as near_plain  # noqa: E402
from .test_pii import plain as pii_plain  # noqa: E402
from .test_repeats import plain_bytes  # noqa: E402

SF = "/root/testdata/sf0.001"


def rows():
    return [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]


def result(spark, name):
    return {r["doc_id"]: r for r in llm_queries()[name](spark, SF).collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(llm_oracle()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = llm_queries()[name](spark, SF).toPandas(), con.execute(llm_oracle()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    assert frame_hash(got) == frame_hash(want)


def test_shards(spark):
    docs, out = rows(), result(spark, "op2_shard")
    assert len(out) == len(docs)
    for i, t in docs:
        b = (t or "").encode()
        assert (out[i]["size"], out[i]["text_crc32"], out[i]["law"], out[i]["grown_shard"]) == (len(b) + 16, zlib.crc32(b), "bytes", None)
    slots = {}
    for r in out.values():
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pii(spark):
    out = result(spark, "op6_pii")
    for i, t in rows():
        base = pii_plain(t)
        assert out[i]["base_sha256"] == sha(base) and out[i]["spans"].startswith(base)
        assert [out[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [
            len(re.findall(f"(?:^|,){k}:", base)) for k in ("email", "ip", "card", "phone")]


def test_suffix_removal(spark):
    out = result(spark, "op7_suffix_dedup")
    for i, n, removed, spans, kept in plain_bytes(rows(), 50):
        r = out[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (n, removed, spans, sha(kept))


def test_near_duplicates(spark):
    out = result(spark, "op10_near_dedup")
    for i, n, component, kept in near_plain(rows(), 4, 80):
        assert tuple(out[i]) == (i, n, component, kept)


def test_licenses(spark):
    out = result(spark, "op4_license_scan")
    notice = re.compile("Released under the MIT License|Licensed under the Apache License, Version 2.0|Licensed under CC BY-NC 4.0"
                        "|This work is licensed under the GNU General Public License, version 3")
    for i, t in rows():
        if notice.search(t or ""):
            assert out[i]["license"] is not None
        if not re.search("(?i)licen[sc]e", t or ""):
            assert out[i]["license"] is None
        assert out[i]["n_words"] == len(cases.words(t, cases.ALNUM, True))


def test_toxicity(spark):
    out = result(spark, "op5_toxicity")
    assert len(out) == len(rows())
    for i, r in out.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == (r["score"] >= 0.5)


def test_lm_scores(spark):
    docs, out = rows(), result(spark, "op11_lm_score")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    tokens = {i: [*cases.words(t, lower=True), None] for i, t in docs}
    count = Counter(w for i, _ in docs if not held[i] for w in tokens[i])
    n, v = sum(count.values()), len(count)
    for i, _ in docs:
        r = out[i]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[i])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(tokens[i]), sum(count[w] > 0 for w in tokens[i]), n)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0
    # The model predicts texts that it has not seen better than single counts do.
    assert sum(out[i]["score"] for i in held if held[i]) > sum(out[i]["base_score"] for i in held if held[i])
