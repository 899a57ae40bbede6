"""Counts over one text, from its UTF-8 bytes; shared by the quality rules, the quality classifier and mixing."""

from __future__ import annotations

import numpy as np

#: ASCII white space; bytes.split() cuts at exactly these, so words are [^\x20\x09-\x0D]+.
SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = b"0123456789"
CONTINUATION = bytes(range(0x80, 0xC0))

NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_bangs", "n_stops", "n_commas", "longest_word", "n_doubled")


def repeated_words(ids: np.ndarray, distinct: int) -> int:
    """Words that lie in some 3-word window occurring twice or more."""
    if len(ids) < 4:
        return 0
    if distinct < 1 << 21:
        key = (ids[:-2] * distinct + ids[1:-1]) * distinct + ids[2:]
    else:
        pair = np.unique(ids[:-2] * distinct + ids[1:-1], return_inverse=True)[1]
        key = pair.astype(np.int64) * distinct + ids[2:]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def without(text: bytes, chars: bytes) -> int:
    """How many bytes of text are in chars."""
    return len(text) - len(text.translate(None, chars))


def counts(text: bytes | None) -> tuple[int, ...]:
    """The NAMES of a text; a null text counts as an empty one."""
    text = text or b""
    words = text.split()
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    lines = [x for x in text.split(b"\n") if x.strip()]
    n_chars = len(text) - without(text, CONTINUATION)
    return (
        len(words),
        n_chars - without(text, SPACE),
        without(text, SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(ids, len(seen)),
        n_chars,
        len(lines),
        len(seen),
        without(text, UPPER),
        without(text, LOWER),
        without(text, DIGITS),
        text.count(b"!"),
        text.count(b"."),
        text.count(b","),
        max(map(len, seen), default=0),
        int((ids[1:] == ids[:-1]).sum()),
    )


def ratios(columns) -> np.ndarray:
    """A row of features per text from columns of NAMES (in that order); all finite, for empty texts too."""
    c = dict(zip(NAMES, (np.asarray(x, np.float64) for x in columns)))
    words, chars, lines = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1), np.maximum(c["n_lines"], 1)
    return np.stack([
        np.log1p(c["n_words"]), c["word_chars"] / words, np.log1p(c["longest_word"]), c["n_distinct"] / words, np.log1p(c["n_chars"] / lines),
        c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_doubled"] / words, c["n_upper"] / chars,
        c["n_lower"] / chars, c["n_digits"] / chars, c["n_bangs"] / words, c["n_stops"] / words, c["n_commas"] / words,
    ], 1)
