"""Word patterns the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: words end at ASCII white space alone
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


#: elements a chunk of ``appended`` holds
CHUNK = 64


def appended(done: Column, last: Column, item: Column) -> tuple[Column, Column]:
    """(done, last) with one more item: an array in chunks, for folds over long arrays, where appending to one array would copy it each time.

    ``F.flatten(F.array_append(done, last))`` is the whole.
    """
    full = F.size(last) >= CHUNK
    return F.when(full, F.array_append(done, last)).otherwise(done), F.when(full, F.array(item)).otherwise(F.array_append(last, item))
