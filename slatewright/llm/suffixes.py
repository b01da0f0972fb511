"""Removal of repeated byte strings by difference-cover anchors and window fingerprints.

No suffix array is built: no suffixes are ordered and no ranks computed. Of each text the
64-byte anchors at difference-cover positions are asked whether they occur elsewhere; a window
of ``width`` bytes that repeats holds such an anchor, so windows without one leave. The rest
are compared by 64-bit fingerprints of their ``width`` bytes (the bucket adds further bits), not
byte by byte. The README says why this stands in place of blockwise suffix sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from slatewright.llm import batches as B
from slatewright.llm.substrings import removal


class Bytes:
    per_byte = 1.0

    def __call__(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return data, ends


def _join_bytes(data: np.ndarray, ends: np.ndarray, gone: np.ndarray, _ends: np.ndarray) -> Iterator[bytes]:
    a = 0
    for b in ends.tolist():
        yield data[a:b][~gone[a:b]].tobytes()
        a = b


def remove_repeated_bytes(docs: DataFrame, width: int = 400, keep_text: bool = True) -> DataFrame:
    """Bytes covered by a string of ``width`` bytes that also starts anywhere else are removed.

    Matches lie within documents, in the same one included; strings are judged on the
    input, and all their copies go. Null texts are empty; repeated rows count as
    documents, so both lose what they share. Returns doc_id, n_elements (bytes),
    n_removed, n_spans (maximal removed runs), kept and its sha256; an empty table gives
    no rows. Other columns are ignored.
    """
    return removal(docs, Bytes(), width, min(64, width), B.repeated, keep_text, "bytes", _join_bytes)
