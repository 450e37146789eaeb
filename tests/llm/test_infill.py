import hashlib
import re

import pytest
from pyspark.sql import functions as F

from galecast.llm import infill
from . import cases


def plain(doc_id, text):
    """The transformation unit by unit."""
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


AWKWARD = ["", None, "<P>", "a<P>b", "x<", "<S", "<S>", "a < b > c", "<<<", ">M><M", "é日本\n😀z", "\x00a\x00", "a" * 70_000, " \n\t", "M><S", "<M"]


@pytest.mark.parametrize("clashing", [False, True])
def test_every_row_equals_the_plain_one_and_is_restored(spark, clashing):
    rows = cases.documents() + [(1000 + 20 * k + j, t, "en", "s", 0) for k, t in enumerate(AWKWARD) for j in range(20)]
    out = infill.fill_in_middle(cases.frame(spark, rows, clashing)).withColumn(
        "back", infill.restore(F.col("fim_output"), F.col("fim_form"))).collect()
    assert len(out) == len(rows)
    for r in out:
        assert tuple(r[c] for c in infill.RESULT.names) == plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["fim_form"] for r in out} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert infill.fill_in_middle(spark.createDataFrame([], cases.SCHEMA)).collect() == []


def test_seed_and_shares_are_parameters(spark):
    docs = cases.frame(spark, cases.documents())
    assert {r["fim_form"] for r in infill.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
    assert {r["fim_form"] for r in infill.fill_in_middle(docs, plain_percent=0, spm_percent=100).where("text <> ''").collect()} == {"spm"}
    one, two = ([r["fim_output"] for r in infill.fill_in_middle(docs, seed=k).orderBy("doc_id").collect()] for k in (1, 2))
    assert one != two
