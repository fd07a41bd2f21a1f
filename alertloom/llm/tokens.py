"""Token ids of whole texts through a public tokenizer file."""

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField

from alertloom.llm.rows import arrow_map, as_bytes, fields, sliced

WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 1
# The tokenizer file's own word pattern (fixed), for lower-case ASCII; other letters are checked when first met.
_PIECES = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z\x80-\xff]+|[0-9]+|[^\s0-9a-z\x80-\xff]+")
SPACE, LETTER, DIGIT, OTHER = range(4)
_CLASSES = np.full(256, OTHER, np.uint8)
_CLASSES[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASSES[[*range(97, 123), *range(128, 256)]] = LETTER
_CLASSES[48:58] = DIGIT
_ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def _is_word(piece: bytes) -> bool:
    """Letters alone, in lower case too: one word to the tokenizer."""
    return piece.isalpha() or not piece.isascii() and piece.decode("utf-8", "replace").lower().isalpha()


def pieces_of(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of a lower-cased line start and end: what the word pattern finds, by changes of byte classes."""
    data = np.frombuffer(line, np.uint8)
    kinds = _CLASSES[data]
    start = np.empty(len(data) + 1, bool)
    start[0], start[-1] = True, True
    np.not_equal(kinds[1:], kinds[:-1], out=start[1:-1])
    if 39 in line:  # an apostrophe that opens a run of signs, and the ending behind it, are one piece
        for at in np.flatnonzero((data == 39) & start[:-1]).tolist():
            for ending in _ENDINGS:
                if line.startswith(ending, at + 1):
                    start[at + 1] = False
                    start[at + 1 + len(ending)] = True
                    break
    at = np.flatnonzero(start)
    held = kinds[at[:-1]] != SPACE
    return at[:-1][held], at[1:][held]


class WordTokens:
    """Ids of texts for the word tokenizer (lower case, white space dropped), as little-endian unsigned integers.

    The tokenizer encodes a text word by word, so each distinct word of a group of texts is looked up once; pieces are
    found and ids put together in arrays.  Words are remembered by a 128-bit hash, at about 40 bytes each, and forgotten
    when ``most_words`` are held, which costs time and changes no id.  Texts with a special token's opening or non-ASCII
    marks are encoded by the tokenizer itself where they hold those, stretch by stretch between white space.
    """

    STRANGE = -1

    def __init__(self, path: str, most_words: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        size = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.ends_word = np.zeros(size, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most_words = most_words
        self.forget()

    def forget(self) -> None:
        """``known`` has a sorted first half of each word's hash, the other half, where its ids start, and how many."""
        self.known = (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32))
        self.ids = np.empty(0, self.dtype)

    def _encode(self, parts: list[bytes]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast([p.decode("utf-8", "replace") for p in parts], add_special_tokens=False)
        return [np.array(e.ids, self.dtype) for e in encoded]

    def _new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and per word where its own start and how many; :attr:`STRANGE` for what is no single word to the tokenizer.

        Words are encoded many in one call: each ends with its only end-of-word token.
        """
        starts, counts = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
        pool, size, plain, others = [np.empty(0, self.dtype)], 0, [], []
        for i, w in enumerate(words):
            if w.isascii():
                (plain if w.isalpha() else others).append(i)
            elif _is_word(w):
                plain.append(i)
            else:
                counts[i] = self.STRANGE
        for at in range(0, len(plain), 1024):
            some = plain[at:at + 1024]
            ids = self._encode([b" ".join([words[i] for i in some])])[0]
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some) and ends[-1] == len(ids):
                starts[some], counts[some] = size + np.concatenate([[0], ends[:-1]]), np.diff(ends, prepend=0)
                pool.append(ids)
                size += len(ids)
            else:
                others += some
        for at in range(0, len(others), 1024):
            some = others[at:at + 1024]
            found = self._encode([words[i] for i in some])
            counts[some] = [len(ids) for ids in found]
            starts[some] = size + np.cumsum(counts[some]) - counts[some]
            pool += found
            size += int(counts[some].sum())
        return np.concatenate(pool), starts, counts

    def lookup(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words start in :attr:`ids`, and how many they are."""
        if len(self.known[0]) > self.most_words:
            self.forget()
        marks = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), "<u8").reshape(-1, 2)
        at = np.searchsorted(self.known[0], marks[:, 0])
        near = np.minimum(at, len(self.known[0]) - 1)
        here = (self.known[0][near] == marks[:, 0]) & (self.known[1][near] == marks[:, 1]) if len(self.known[0]) else np.zeros(len(words), bool)
        if not here.all():
            new = np.flatnonzero(~here)
            new = new[np.argsort(marks[new, 0], kind="stable")]
            ids, starts, counts = self._new([words[i] for i in new])
            added = marks[new, 0], marks[new, 1], starts + np.int32(len(self.ids)), counts
            self.known = tuple(np.insert(old, at[new], more) for old, more in zip(self.known, added, strict=True))
            self.ids = np.concatenate([self.ids, ids])
            near = np.searchsorted(self.known[0], marks[:, 0])
        return self.known[2][near], self.known[3][near]

    def _by_stretch(self, text: bytes) -> bytes:
        """Texts that hold more than words: stretches of plain words from memory, others by the tokenizer."""
        chunks, out = text.split(), []
        pieces = [[] if b"<|" in c else _PIECES.findall(c.lower()) for c in chunks]
        distinct = list({p for some in pieces for p in some})
        at, counts = self.lookup(distinct) if distinct else ([], [])
        found = {w: None if n < 0 else self.ids[s:s + n].tobytes() for w, s, n in zip(distinct, at, counts)}
        whole: dict[bytes, bytes] = {}
        for c, some in zip(chunks, pieces):
            if not some or any(found[p] is None for p in some):
                if c not in whole:
                    whole[c] = self._encode([c])[0].tobytes()
                out.append(whole[c])
            else:
                out += [found[p] for p in some]
        return b"".join(out)

    def _group(self, texts: list[bytes]) -> list[bytes]:
        """Ids of texts none of which holds a special token's opening."""
        line = b" ".join(texts).lower()
        starts, ends = pieces_of(line)
        if not len(starts):
            return [b""] * len(texts)
        data = np.frombuffer(line, np.uint8)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [
            None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[_CLASSES[data] != SPACE])]).dictionary_encode()
        which = words.indices.to_numpy()
        first, lengths = self.lookup(words.dictionary.to_pylist())
        count = np.maximum(lengths, 0)[which]
        total = np.concatenate([[0], np.cumsum(count)])
        raw = self.ids[np.repeat(first[which] - total[:-1], count) + np.arange(total[-1])].tobytes()
        cuts = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]))
        at = (total[cuts] * self.dtype.itemsize).tolist()
        odd = np.concatenate([[0], np.cumsum((lengths < 0)[which])])[cuts]
        return [self._by_stretch(t) if odd[i + 1] > odd[i] else raw[at[i]:at[i + 1]] for i, t in enumerate(texts)]

    def encode(self, texts: list[bytes | None], end: int | None = END_ID, group_bytes: int = 2 << 20) -> list[bytes]:
        closing = b"" if end is None else np.array([end], self.dtype).tobytes()
        out, group, size = [], [], 0

        def flush():
            nonlocal group, size
            out.extend(ids + closing for ids in self._group(group))
            group, size = [], 0

        for text in texts:
            if text and b"<|" in text:
                flush()
                out.append(self._by_stretch(text) + closing)
                continue
            group.append(text or b"")
            size += len(group[-1])
            if size >= group_bytes:
                flush()
        flush()
        return out


@lru_cache(maxsize=1)
def word_tokens(path: str) -> WordTokens:
    """One per worker process, so that its tasks share the tokenizer and the words it remembers, 16 MB at most."""
    return WordTokens(path)


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    return public_tokenizers.path(name)


def token_table(df: DataFrame, keep: tuple[str, ...], text: str = "_text", tokenizer: str = WORD_TOKENIZER,
                end: int | None = END_ID) -> DataFrame:
    """The kept columns with ``ids`` (binary, unsigned 16-bit little-endian for vocabularies that fit) and ``n``.

    Null texts count as empty; with an end id every document has at least one id.
    """
    def run(batches):
        words = word_tokens(tokenizer_path(tokenizer))
        width = words.dtype.itemsize
        for batch in sliced(batches, 512):
            ids = words.encode(as_bytes(batch.column(batch.num_columns - 1)), end)
            yield *batch.columns[:-1], ids, [len(i) // width for i in ids]

    source = df.select(*keep, F.col(text))
    return arrow_map(source, run, fields(source, StructField("ids", BinaryType()), StructField("n", LongType()), keep=keep))
