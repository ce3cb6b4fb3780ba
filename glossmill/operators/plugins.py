"""The caller's models and tokenizers on the workers."""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Callable
from typing import Any

from pyspark import cloudpickle

Spans = list[list[tuple[int, int]]]
_loaded: OrderedDict[str, Any] = OrderedDict()
#: How many models and tokenizers a worker process keeps; the least recently used goes first.
MOST = 4


class Plugin:
    """What a caller's ``make`` returns, made once in each Python worker process, which Spark uses for many tasks.

    Two plug-ins of the same ``make`` are the same, so a second run on the same workers loads nothing.
    """

    def __init__(self, make: Callable[[], Any]):
        self.make = make
        self.key = hashlib.sha256(cloudpickle.dumps(make)).hexdigest()

    def get(self) -> Any:
        if self.key not in _loaded:
            while len(_loaded) >= MOST:
                _loaded.popitem(last=False)
            _loaded[self.key] = self.make()
        _loaded.move_to_end(self.key)
        return _loaded[self.key]


def spans_of(encoder: Any, texts: list[str]) -> Spans:
    """First and last character place of every token, from an encoder that can tell them."""
    if not hasattr(encoder, "spans"):
        raise TypeError("cutting texts needs an encoder with a method spans(texts): (start, end) of each token of each text")
    return encoder.spans(texts)


def clipped(encoder: Any, texts: list[str], most: int) -> list[str]:
    """The texts up to the end of their token number ``most``, as the encoder counts."""
    if most <= 0:
        return ["" for _ in texts]
    return [t if len(s) <= most else t[: s[most - 1][1]] for t, s in zip(texts, spans_of(encoder, texts))]


class FileEncoder:
    """A tokenizer of the ``tokenizers`` library from its JSON file: ids when called, and spans.

    ``special`` adds the file's special tokens to the ids, as a model trained with them expects; they have no place in
    the text and do not count when it is cut.
    """

    def __init__(self, path: str, special: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.special = Tokenizer.from_file(path), special

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=self.special)]

    def spans(self, texts: list[str]) -> Spans:
        return [e.offsets for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
