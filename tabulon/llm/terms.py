"""Terms of whole texts: maximal runs of 0-9, a-z and non-ASCII characters, with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from tabulon.llm.shared import text_buffers

#: Byte to byte: A-Z to a-z, 0-9, a-z and bytes of non-ASCII characters stay, all else is a space.
TERM_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def term_lists(column: pa.Array) -> Iterator[list[bytes]]:
    """The terms of each text of an Arrow string column, in order; null has none."""
    offsets, raw = text_buffers(column)
    plain = raw.tobytes().translate(TERM_BYTES)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield plain[start:end].split()
