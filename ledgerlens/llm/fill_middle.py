"""Fill-in-the-middle: texts cut into prefix, middle and suffix at unit ranks.

A text's units (runs of ASCII letters, single other code points) are indexed
by a skip list that carries both unit and code point widths, so both cut
ranks are found without a table of all units (:mod:`ledgerlens.llm.skiplist`).
The draws come from a hash of the row's id, so a task that runs again gives
the same output.

Output by form: ``plain`` the text; ``psm`` <P>prefix<S>suffix<M>middle;
``spm`` <S>suffix<P>prefix<M>middle. A text that holds a marker stays plain,
so :func:`restored` gets every text back exactly.

Defined cases: a null text is empty; an empty text is plain with ``n`` 0; a
null id hashes as an empty one; rows that repeat an id get the same draws;
texts of any length are cut whole; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import ship, skiplist, words
from ledgerlens.llm.common import small_batches, text_of

ship(__name__, skiplist.__name__, words.__name__)

# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
# Of 100 texts, how many are transformed; of 100 of these, how many suffix first.
RATE = 90
SUFFIX_FIRST = 20
# Bytes of text handed on in one batch (a longer text is a batch of its own).
BATCH_BYTES = 4 << 20

_SCHEMA = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
           "output string")


def draws(row_id, seed: int) -> list[int]:
    """The first four 32-bit numbers of the id's hash."""
    digest = hashlib.sha256(f"{seed}:{'' if row_id is None else row_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in (0, 8, 16, 24)]


def transform(text: str, h: list[int], rate: int, suffix_first: int) -> tuple:
    """(units, form, code points of prefix and middle, output) of one text."""
    index = skiplist.SkipList(text)
    n = index.n_units
    if not text or h[2] % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = index.cut(low), index.cut(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        form, out = "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    else:
        form, out = "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle
    return n, form, a, b - a, out


def _run(seed: int, rate: int, suffix_first: int):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")

    def run(batches):
        for batch in batches:
            ids = batch.column("_id").to_pylist()
            texts = batch.column("_text").to_pylist()
            for a, b in words.chunks(texts, BATCH_BYTES):
                rows = [(i, *transform(t, draws(i, seed), rate, suffix_first))
                        for i, t in zip(ids[a:b], texts[a:b])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], list(names))
        words.release()
    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   seed: int = 1, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """One row per document: ``doc_id, n, form, prefix_chars, middle_chars,
    output`` (``n`` units; the code points are null for plain texts)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(_run(seed, rate, suffix_first), _SCHEMA)


def restored(output: str = "output", form: str = "form") -> Column:
    """The original text, from output and form alone."""
    out = F.col(output)

    def between(left: str, right: str) -> Column:
        start = F.locate(left, out) + len(left)
        return F.substr(out, start, F.locate(right, out) - start)

    middle = F.substr(out, F.locate(MIDDLE, out) + len(MIDDLE), F.length(out))
    return (F.when(F.col(form) == "psm", F.concat(between(PREFIX, SUFFIX), middle,
                                                  between(SUFFIX, MIDDLE)))
            .when(F.col(form) == "spm", F.concat(between(PREFIX, MIDDLE), middle,
                                                 between(SUFFIX, PREFIX)))
            .otherwise(out))
