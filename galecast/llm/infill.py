"""Fill-in-middle transformation by repeated-capture matching.

One ``fullmatch`` of a repeated unit (a run of Latin letters, or any other one
character) with the ``regex`` library keeps every repetition of its group, so
``ends(1)`` is at once the number of units and every place a text can be cut
at.  Two hashes of the document's id choose the cuts, a third the share that
stays plain, a fourth between the two orders of the parts.  ``restore`` turns
an output back into its text with DataFrame functions.  No text holds one of
the markers in a form other than plain, and a marker can't arise where parts
meet (it begins with its only ``<``), so the parts are found again exactly.

The unit is matched possessively: a repetition once captured is final, as no
other reading of the text exists, so the match needs no way back and its memory
is one span per unit of one text.

Defined results.  Null text is empty; an empty text has no units and is plain.
A null id is hashed as empty.  Equal rows get equal results.  Other columns are
kept and may have any name but those that begin with ``fim_``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .kernels import row_slices

UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PLAIN_PERCENT, SPM_PERCENT = 1, 10, 20

RESULT = T.StructType([
    T.StructField("fim_units", T.LongType()), T.StructField("fim_form", T.StringType()),
    T.StructField("fim_prefix_chars", T.LongType()), T.StructField("fim_middle_chars", T.LongType()),
    T.StructField("fim_output", T.StringType())])


def choices(doc_id: int | None, seed: int = SEED) -> tuple[int, ...]:
    """Four numbers below 2**32 that the id and the seed decide."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def transform(text: str, chosen: tuple[int, ...], plain_percent: int = PLAIN_PERCENT,
              spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """``(units, form, characters of the prefix, of the middle, output)`` of one text."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not n or PREFIX in text or SUFFIX in text or MIDDLE in text or chosen[2] % 100 >= 100 - plain_percent:
        return n, "plain", None, None, text
    first, second = sorted((chosen[0] % (n + 1), chosen[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if chosen[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def _transformed(seed: int, plain_percent: int, spm_percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for lo, n in row_slices(batch.column(names.index("text"))):
                part = batch.slice(lo, n)
                ids, texts = (part.column(names.index(c)).to_pylist() for c in ("doc_id", "text"))
                rows = [transform(t or "", choices(i, seed), plain_percent, spm_percent) for i, t in zip(ids, texts, strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                new = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], [*names, *RESULT.names])
    return run


def fill_in_middle(docs: DataFrame, seed: int = SEED, plain_percent: int = PLAIN_PERCENT,
                   spm_percent: int = SPM_PERCENT) -> DataFrame:
    """``docs`` (doc_id, text, ...) plus ``fim_units``, ``fim_form`` (``plain``, ``psm`` or ``spm``), ``fim_prefix_chars``
    and ``fim_middle_chars`` (code points, null if plain) and ``fim_output``."""
    return docs.mapInArrow(_transformed(seed, plain_percent, spm_percent), T.StructType([*docs.schema.fields, *RESULT.fields]))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of."""
    skip = len(PREFIX) + 1

    def parts(second: str) -> tuple[Column, Column, Column]:
        one, two = F.locate(second, output, 1), F.locate(MIDDLE, output, 1)
        between = lambda a, b: F.substring(output, a, b - a)
        return (between(F.lit(skip), one), between(one + F.lit(len(second)), two),
                F.substring(output, two + F.lit(len(MIDDLE)), F.length(output)))

    psm, spm = parts(SUFFIX), parts(PREFIX)
    return (F.when(form == "psm", F.concat(psm[0], psm[2], psm[1]))
            .when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output))
