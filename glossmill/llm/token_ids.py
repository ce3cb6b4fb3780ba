"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import numpy as np
import tiktoken

_loaded: dict[tuple[str, str], tiktoken.Encoding] = {}


def byte_bpe_50k() -> tuple[str, str]:
    """Place and pattern of the vocabulary of 50,257 ids, in its rank form: one vocabulary, one set of ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary, loaded once in each Python worker process. Special strings in a text are ordinary text."""
    if (path, pattern) not in _loaded:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def ids_of(text: str | None, path: str, pattern: str) -> np.ndarray:
    """Unsigned 32-bit ids; none for null and for an empty text."""
    return encoding(path, pattern).encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)
