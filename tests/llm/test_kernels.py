import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from galecast.llm import kernels as k
from . import cases

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t.9é日\x00\x0b", max_size=30)), max_size=8)


@settings(max_examples=150, deadline=None)
@given(TEXTS)
def test_words_equal_the_patterns(texts):
    buf, offsets = k.text_bytes(pa.array(texts, pa.string()))
    for kind, pattern, lower in ((k.SPACED, cases.WORD, False), (k.ALNUM, cases.ALNUM, True)):
        found = k.Words(buf, offsets, kind, lower)
        for i, t in enumerate(texts):
            own = [found.joined(w, w + 1).decode() for w in range(found.first[i], found.first[i + 1])]
            assert own == cases.words(t, pattern, lower)


def test_hashes_depend_on_content_only():
    texts = pa.array(["x aa bb cc", "aa  bb\ncc", None, "aa bb c"], pa.string())
    found = k.Words(*k.text_bytes(texts), k.SPACED, False)
    sums = k.word_run_sums(found.hashes())
    runs = k.word_run_hash(sums, np.array([1, 4, 7]), 3)
    assert runs[0] == runs[1] != runs[2]
    assert list(found.counts()) == [4, 3, 0, 3]


def test_slices_cover_all_rows_and_sliced_arrays():
    array = pa.array(["a" * 10, "b" * 30, None, "", "c" * 5] * 3, pa.string()).slice(2, 11)
    assert sum(n for _, n in k.row_slices(array, 25)) == 11
    buf, offsets = k.text_bytes(array)
    assert bytes(buf[offsets[1]:offsets[2]]) == b"" and offsets[-1] == len(buf)
    assert list(k.row_slices(pa.array([], pa.string()))) == []


def test_covered_and_runs_stop_at_texts():
    mask = k.covered(8, np.array([1, 2, 6]), np.array([3, 4, 8]))
    assert mask.tolist() == [False, True, True, True, False, False, True, True]
    a, b = k.runs(mask, np.array([0, 2, 8]))
    assert list(zip(a, b)) == [(1, 2), (2, 4), (6, 8)]
