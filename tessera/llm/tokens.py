"""Token ids of whole texts by the tokenizers library, with a bounded cache of the ids of chunks.

A text is cut where the vocabulary's own pre-tokenizer must cut, so the ids of the chunks, joined, are the
ids of the text: no merge crosses such a place, and nothing before or after it changes how a chunk is cut.
Words seen before come from the cache; the library works out the rest.
"""

from __future__ import annotations

import functools
import re
import string
import struct

#: For each kind of vocabulary: bytes that odd chunks, and bare words, may take in each of a cache's two halves; bytes of text that
#: are worked on together. Those of words are smaller, as packing follows other stages in the same workers.
WORD_ROOM, BYTE_ROOM = (8 << 20, 24 << 20, 4 << 20), (24 << 20, 80 << 20, 12 << 20)
#: Bytes that an entry of a cache takes besides those of its key and value.
ENTRY = 130
#: Letters of ASCII and of U+00C0 to U+00FF, then ASCII punctuation: such a chunk is one
#: match of letters and one of punctuation for either kind of vocabulary, and composed already.
PLAIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
LETTERS = r"\A[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+\z"
#: Byte-level vocabularies write a byte that is no printable Latin-1 character as the next one from U+0100 on.
PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
SPELLED = dict(zip((b for b in range(256) if b not in PRINTABLE), map(chr, range(0x100, 0x200))))


@functools.cache
def loaded(path: str):
    """The tokenizer of a file, once per process, in one thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Halves:
    """A dictionary of bytes bounded in bytes: when the new half is full it becomes the old one, and what is asked for again moves back. What would fill a sixteenth of a half is not kept."""

    def __init__(self, most: int):
        self.most, self.held, self.new, self.old = most, 0, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        size = len(key) + len(value) + ENTRY
        if size > self.most // 16:
            return
        if self.held + size > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        self.new[key] = value
        self.held += size


class Cached:
    """Ids of texts that are given as lists of chunks.

    A plain chunk is letters and then punctuation: one or two pre-tokens, for each of which the library's model
    is asked. Others go through the whole tokenizer. A batch of texts is worked on by its distinct chunks; what
    is done for each occurrence is one gather. lower: whether the tokenizer's normalizer puts letters in lower
    case. lead: what stands before every chunk but the first of a text, and is not part of it. chunks, cores:
    bytes of a half of either cache.
    """

    def __init__(self, path: str, lower: bool, lead: bytes, chunks: int, cores: int):
        self.tokenizer, self.lower, self.lead = loaded(path), lower, lead
        self.chunks, self.cores = Halves(chunks), Halves(cores)

    def core(self, word: bytes) -> bytes:
        """Ids of one pre-token."""
        ids = self.cores.get(word)
        if ids is None:
            bare = word.removeprefix(b" ")
            spelled = (SPELLED[32] if len(bare) < len(word) else "") + bare.decode() if bare.isalpha() else word.decode("latin-1").translate(SPELLED)
            ids = packed_ids([t.id for t in self.tokenizer.model.tokenize(spelled)])
            self.cores.put(word, ids)
        return ids

    def plain(self, m: re.Match, lead: bytes) -> bytes:
        word = m[1].decode().lower().encode() if self.lower else m[1]
        return self.core(lead + word) + (self.core(m[2]) if m[2] else b"")

    def others(self, chunks: list[bytes]) -> list[bytes]:
        """Ids of chunks that are not plain."""
        made, rest = [], []
        for chunk in chunks:
            ids = self.chunks.get(chunk)
            if ids is None and self.lead and b"\n" in chunk and all(lines := [PLAIN.fullmatch(x) for x in chunk.split(b"\n")]):
                # one line end between plain pieces is a pre-token of its own
                ids = self.core(b"\n").join(self.plain(x, b"" if k else self.lead) for k, x in enumerate(lines))
            if ids is None:
                rest.append(len(made))
            made.append(ids)
        for k, got in zip(rest, self.tokenizer.encode_batch_fast([(self.lead + chunks[k]).decode() for k in rest], add_special_tokens=False) if rest else ()):
            made[k] = packed_ids(got.ids)
            self.chunks.put(chunks[k], made[k])
        return made

    def first(self, chunk: bytes) -> bytes:
        """Ids of a chunk without what leads others."""
        if m := PLAIN.fullmatch(chunk):
            return self.plain(m, b"")
        return packed_ids(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids) if chunk else b""

    def distinct(self, words):
        """Ids of an Arrow array of distinct chunks, one after the other, and how many each has."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        bare = pc.ascii_rtrim(words, characters=string.punctuation)
        plain = pc.match_substring_regex(bare, LETTERS).to_numpy(zero_copy_only=False)
        tail = (pc.binary_length(words).to_numpy() - pc.binary_length(bare).to_numpy()) * plain
        bare = bare.filter(pa.array(plain))
        named = (pc.utf8_lower(bare) if self.lower else bare).dictionary_encode()
        cores = [self.lead + x for x in named.dictionary.cast(pa.large_binary()).to_pylist()]
        found = list(map(self.cores.new.get, cores))
        if None in found:
            found = [self.core(c) if ids is None else ids for c, ids in zip(cores, found)]
        ends: dict[bytes, int] = {b"": 0}
        texts = words.filter(pa.array(tail > 0)).cast(pa.large_binary()).to_pylist()
        marks = [ends.setdefault(x[-k:], len(ends)) for x, k in zip(texts, tail[tail > 0].tolist())]
        others = self.others(words.filter(pa.array(~plain)).cast(pa.large_binary()).to_pylist())
        pieces = [*(self.core(x) if x else b"" for x in ends), *found, *others]  # ends of words, cores, whole chunks
        picks = np.zeros((len(words), 2), np.int64)
        picks[plain, 0] = len(ends) + named.indices.to_numpy()
        picks[tail > 0, 1] = marks
        picks[~plain, 0] = len(ends) + len(found) + np.arange(len(others))
        flat, sizes = gathered(*table(pieces), picks.ravel())
        return flat, sizes.reshape(-1, 2).sum(1)

    def batch(self, lists) -> tuple:
        """Ids of all texts of an Arrow array of lists of chunks, and where each text's end."""
        import numpy as np
        import pyarrow as pa

        chunks, offsets = lists.flatten(), lists.offsets.to_numpy()
        offsets = offsets - offsets[0]
        coded = chunks.dictionary_encode()
        flat, sizes = self.distinct(coded.dictionary)
        picks = coded.indices.to_numpy().astype(np.int64)
        if self.lead:
            heads = offsets[:-1][offsets[1:] > offsets[:-1]]
            more, lengths = table(list(map(self.first, chunks.take(pa.array(heads)).cast(pa.large_binary()).to_pylist())))
            picks[heads] = len(sizes) + np.arange(len(heads))
            flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, lengths])
        flat, sizes = gathered(flat, sizes, picks)
        return flat, np.concatenate([[0], np.cumsum(sizes)])[offsets]


def table(pieces: list[bytes]) -> tuple:
    """Ids of all pieces, one after the other, and how many each has."""
    import numpy as np

    return np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4


def gathered(flat, sizes, picks) -> tuple:
    """The same for the picked pieces of a table."""
    import numpy as np

    n = sizes[picks]
    ends = np.cumsum(n)
    spot = np.repeat((np.cumsum(sizes) - sizes)[picks] - ends + n, n)
    spot += np.arange(len(spot))
    return flat[spot], n


def parts(rows, most: int):
    """Slices of an Arrow array (or of an iterable) of texts as large strings, null as empty, of about `most` bytes, or of one text that is longer."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    column = rows if isinstance(rows, pa.Array) else pa.array(list(rows), pa.large_binary())
    column = pc.fill_null(column.cast(pa.large_string()), "")
    turn = np.cumsum(pc.binary_length(column).to_numpy()) // most
    cuts = np.flatnonzero(np.diff(turn)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(column)]):
        if b > a:
            yield column.slice(a, b - a)


def packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@functools.cache
def word_encoder(path: str):
    """texts (Arrow array, or bytes or None each) -> ids of each as little-endian unsigned 32-bit bytes, for a vocabulary whose normalizer and pre-tokenizer drop white space.

    Chunks: what stands between ASCII white space.
    """
    *room, most = WORD_ROOM
    cache = Cached(path, True, b"", *room)

    def encode(rows):
        import pyarrow.compute as pc

        for texts in parts(rows, most):
            flat, ends = cache.batch(pc.ascii_split_whitespace(texts))
            yield from (flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:]))

    return encode


#: A space next to anything but a visible ASCII character or a letter from U+00C0 to U+00FF.
UNCLEAR = re.compile(rb" (?:(?![\x21-\x7e\xc3])|(?<![\x21-\x7e] )(?<!\xc3[\x80-\xbf] ))")


def byte_chunks(text: bytes) -> list[bytes]:
    """Chunks of a text for a byte-level pre-tokenizer that puts one space before a word; all but the first lack that space.

    A cut before a single space with no white space on either side is always a cut of the pre-tokenizer:
    its matches end there, and each match is found from where the last one ended. Where it is not clear that
    a neighbour is no white space, nothing is cut, so a chunk may be longer than need be but never cut wrongly.
    """
    unclear = {m.start() for m in UNCLEAR.finditer(text)}
    out, at = [], 0
    for m in re.finditer(rb" ", text):
        if m.start() not in unclear and m.start():
            out.append(text[at : m.start()])
            at = m.end()
    return [*out, text[at:]]


@functools.cache
def byte_encoder(path: str):
    """The same for a byte-level vocabulary without normalizer that cuts as byte_chunks says. Texts without unclear spaces are cut by Arrow at all of them."""
    *room, most = BYTE_ROOM
    cache = Cached(path, False, b" ", *room)

    def encode(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        for texts in parts(rows, most):
            whole = texts.cast(pa.large_binary()).to_pylist()
            hard = [k for k, text in enumerate(whole) if UNCLEAR.search(text)]
            mask = pa.array([True] * len(whole)) if not hard else pc.invert(pc.is_in(pa.array(range(len(whole))), pa.array(hard)))
            made = [(x[a:b] for x, ends in [cache.batch(lists)] for a, b in zip(ends[:-1], ends[1:])) for lists in (pc.split_pattern(texts.filter(mask), " "), pa.array([byte_chunks(whole[k]) for k in hard], pa.large_list(pa.large_binary())).cast(pa.large_list(pa.large_string())))]
            rest = set(hard)
            yield from (next(made[k in rest]).tobytes() for k in range(len(whole)))

    return encode
