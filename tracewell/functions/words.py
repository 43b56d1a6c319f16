"""Words of texts in Arrow: those that ``text.tokens`` finds, cut a whole batch at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Every byte but those of [a-z0-9] becomes a blank.
_BLANKS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else 32 for c in range(256))


def blanked(text: pa.Array) -> pa.Array:
    """Lower-case texts with blanks for all that is not of [a-z0-9]: as ``text.tokens``
    does, only that a wide character leaves more than one blank, which part words the same."""
    _, offsets, data = text.buffers()
    data = pa.py_buffer((data.to_pybytes() if data is not None else b"").translate(_BLANKS))
    return pa.Array.from_buffers(text.type, len(text), [None, offsets, data], offset=text.offset)


def cut_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of blanked texts, in order, and the text that each stands in."""
    parts = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(text))
    word, owner = parts.flatten(), pc.list_parent_indices(parts)
    real = pc.greater(pc.binary_length(word), 0)
    if not pc.all(real).as_py():  # a blank text has one empty word
        word, owner = word.filter(real), owner.filter(real)
    return word, owner.to_numpy()
