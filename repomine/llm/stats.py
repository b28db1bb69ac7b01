"""Statistics of a text: the inputs of the quality and toxicity models."""

from __future__ import annotations

import math

import numpy as np

from repomine.llm.text import split_words

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_spread", "letters", "upper", "digits", "marks", "symbols",
    "beyond_ascii", "different_words", "top_word", "repeated_next", "upper_words", "capital_words", "marked_words",
    "bare_marks", "long_words", "log_lines", "line_words", "different_lines", "ending_lines", "stops", "commas",
)

_MARKS = b".,;:!?'\"()-"


def _byte_class(chars: bytes) -> np.ndarray:
    flags = np.zeros(256, bool)
    flags[list(chars)] = True
    return flags


_UPPER = _byte_class(bytes(range(65, 91)))
_LETTER = _UPPER | _byte_class(bytes(range(97, 123)))
_DIGIT = _byte_class(b"0123456789")
_MARK = _byte_class(_MARKS)
_BLANK = _byte_class(b" \t\n\r\x0b\x0c")
_BEYOND = np.arange(256) >= 128
_LATER = (np.arange(256) >= 128) & (np.arange(256) < 192)  # later bytes of a character
_SYMBOL = ~(_LETTER | _DIGIT | _MARK | _BLANK | _BEYOND)


def text_statistics(text: bytes) -> list[float]:
    """The numbers named in ``NAMES``; all are zero for an empty text."""
    size = len(text)
    if not size:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = size - int(counts[_LATER].sum())
    words = split_words(text)
    n = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    different = list(tally.items())
    upper_words = sum(k for w, k in different if len(w) > 1 and w.isupper())
    capital_words = sum(k for w, k in different if w[:1].isupper())
    # A word that ends in two marks or symbols, or in one that no sentence ends with.
    marked = sum(k for w, k in different if not w[-1:].isalnum() and w[-1] < 128 and (w[-1] not in b".,;:!?)\"'" or len(w) > 1 and not w[-2:-1].isalnum() and w[-2] < 128))
    bare = sum(k for w, k in different if len(w) <= 2 and not w.isalnum() and max(w) < 128)
    lines = [x for x in text.split(b"\n") if x.strip()] or [b""]
    shares = [counts[c].sum() / size for c in (_LETTER, _UPPER, _DIGIT, _MARK, _SYMBOL, _BEYOND)]
    return [
        math.log1p(chars), math.log1p(len(words)), float(lengths.mean()), float(lengths.std()),
        *map(float, shares),
        len(different) / n, max(tally.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        upper_words / n, capital_words / n, marked / n, bare / n, float((lengths > 20).sum()) / n,
        math.log1p(len(lines)), math.log1p(len(words) / len(lines)), len(set(lines)) / len(lines),
        sum(x.rstrip()[-1:] in (b".", b"!", b"?") for x in lines) / len(lines),
        float(counts[ord(".")]) / n, float(counts[ord(",")]) / n,
    ]
