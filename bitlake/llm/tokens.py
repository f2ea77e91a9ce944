"""Tokenisation by distinct chunks.

A text is cut where white space follows something else, and in a store also where a full stop or comma follows
an ASCII letter. The pre-tokenisers of the byte-level and the word BPE vocabularies never match across such a
place, and neither do their normalisers, so the ids of a text are those of its chunks, one after the other. The
library encodes the distinct chunks; a bounded store per worker keeps what it gave for those most used.
"""

from __future__ import annotations

import itertools
import os
import re

import numpy as np
import pyarrow as pa

#: The code points with the Unicode property White_Space, as ranges for a character class.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: A text without these has single spaces or single line ends between words only.
_ODD_ASCII = ("\t", "\x0b", "\x0c", "\r", "  ", "\n\n", " \n", "\n ")
_ODD_OTHER = tuple(c for c in map(chr, range(0x80, 0x3001)) if re.fullmatch(f"[{WHITE}]", c))


#: Chunks a store holds, in every worker.
LIMIT = 800_000
#: The first chunks of a store, which are frequent ones, are looked up without Python; chunks encoded as one text.
FIRST, JOINED = 1 << 16, 100
#: Chunks that stand behind one space. Of letters with at most one sign behind them: one word, or a word and a sign.
_WORD = re.compile(f" [^{WHITE}]+")
_LETTERS = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?")


def plain(text: str) -> bool:
    """Whether only single spaces and single line ends separate the words, with none at either end."""
    if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(x in text for x in _ODD_ASCII):
        return False
    return text.isascii() or not any(x in text for x in _ODD_OTHER)


def chunks(text: str) -> list[str]:
    """The chunks of text; joined they give text."""
    return _CHUNK.findall(text)


#: Kinds of bytes: ASCII white space, signs, ASCII letters, first bytes of further white space, others.
_WHITE, _SIGN, _LETTER, _LEAD = 1, 2, 3, 4
_KIND = bytes(_WHITE if i in b"\t\n\v\f\r " else _SIGN if i in b".," else _LETTER if chr(i).isascii() and chr(i).isalpha() else _LEAD if i in b"\xc2\xe1\xe2\xe3" else 0 for i in range(256))


def _offsets(texts: pa.Array) -> np.ndarray:
    """Where the texts begin in their buffer, and the end of the last."""
    if not len(texts):
        return np.zeros(1, np.int32)
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The chunks of all texts (strings, null as empty) as binaries in the texts' own buffer, and the number of chunks
    up to the end of each text."""
    if texts.null_count:
        texts = texts.fill_null("")
    n, offsets = len(texts), _offsets(texts)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return pa.array([], pa.binary()), np.zeros(n, np.int64)
    data = texts.buffers()[2].slice(first, last - first)
    raw, offsets = np.frombuffer(data, np.uint8), offsets.astype(np.int64) - first
    kind = np.frombuffer(data.to_pybytes().translate(_KIND), np.uint8)
    white = kind == _WHITE
    lead = np.flatnonzero(kind == _LEAD)
    if len(lead):
        a, b, c = raw[lead], raw[np.minimum(lead + 1, len(raw) - 1)], raw[np.minimum(lead + 2, len(raw) - 1)]
        two = lead[(a == 0xC2) & ((b == 0x85) | (b == 0xA0))]
        general = (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | (b == 0x81) & (c == 0x9F)
        three = lead[(a == 0xE1) & (b == 0x9A) & (c == 0x80) | (a == 0xE2) & general | (a == 0xE3) & (b == 0x80) & (c == 0x80)]
        for at, width in ((two, 2), (three, 3)):
            for i in range(width):
                white[at + i] = True  # no text ends within a character
    begins = white.copy()
    begins[1:] &= ~white[:-1]
    begins[1:] |= (kind[1:] == _SIGN) & (kind[:-1] == _LETTER)
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(begins)
    places = np.append(at, len(raw)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(places), data]), np.searchsorted(at, offsets[1:])


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    os.environ.setdefault("RAYON_NUM_THREADS", "1")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class ChunkStore:
    """Numbers distinct chunks and keeps their ids in flat arrays.

    Once it has more than ``limit`` chunks, those most used stay, half as many, with their uses halved. Chunks are kept
    as UTF-8, as they stand in texts.
    """

    def __init__(self, path: str, limit: int = LIMIT):
        self.tokenizer, self.limit = load(path), limit
        #: Whether a vocabulary drops white space, so that it does not matter which stands before a chunk.
        self.drops_white = self._same("a b") and self._same("a\nb")
        # Tokens by which the ids of joined chunks are told apart: where words end, or where a space begins one.
        vocabulary = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.mark[[i for t, i in vocabulary.items() if (t.endswith("</w>") if self.drops_white else t.startswith("\u0120"))]] = True
        self.number: dict[bytes, int] = {}
        self.first = pa.array([], pa.binary())
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length, self.uses = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def _same(self, text: str) -> bool:
        ids = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        return ids(text) == ids(text[0]) + ids(text[2:])

    def _halve(self) -> None:
        order = np.argsort(-self.uses, kind="stable")[: self.limit // 2]
        keys = list(self.number)
        self.number = {keys[j]: i for i, j in enumerate(order.tolist())}
        self.ids, self.length, self.uses = self.encode(order), self.length[order], self.uses[order] // 2
        self.used = len(self.ids)
        self.start = np.cumsum(self.length) - self.length
        self.first = pa.array(list(itertools.islice(self.number, FIRST)), pa.binary())

    def _joined(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, numbers of ids) of easy chunks encoded some hundreds at a time as one text; None if they cannot be told apart in it."""
        texts = ["".join(keys[i : i + JOINED]) for i in range(0, len(keys), JOINED)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
        if self.drops_white:
            words = np.fromiter((2 if k[-1] in ".," else 1 for k in keys), np.int64, len(keys))
            ends = np.flatnonzero(self.mark[ids]) + 1
            if len(ends) != words.sum() or (len(ids) and ends[-1] != len(ids)):
                return None
            return ids, np.diff(np.concatenate([[0], ends[np.cumsum(words) - 1]]))
        begin = np.flatnonzero(self.mark[ids])
        if len(begin) != len(keys) or begin[0] != 0:
            return None
        return ids, np.diff(np.append(begin, len(ids)))

    def _add(self, keys: list[str]) -> None:
        """Encodes keys, which have the next numbers in order."""
        easy = _LETTERS.fullmatch if self.drops_white else _WORD.fullmatch
        base, plain_ = len(self.length), np.fromiter((easy(k) is not None for k in keys), bool, len(keys))
        self.start, self.length, self.uses = (np.concatenate([x, np.zeros(len(keys), np.int64)]) for x in (self.start, self.length, self.uses))
        at = np.flatnonzero(plain_)
        found = self._joined([keys[i] for i in at]) if len(at) else None
        if found is None:
            at = at[:0]
        else:
            self._keep(base + at, *found)
        rest = np.setdiff1d(np.arange(len(keys)), at, assume_unique=True)
        if len(rest):
            got = [e.ids for e in self.tokenizer.encode_batch_fast([keys[i] for i in rest], add_special_tokens=False)]
            length = np.fromiter(map(len, got), np.int64, len(got))
            self._keep(base + rest, np.fromiter((i for x in got for i in x), np.uint32, int(length.sum())), length)

    def _keep(self, numbers: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(max(self.used, len(ids)), np.uint32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[numbers], self.start[numbers] = length, np.cumsum(length) - length + self.used
        self.used += len(ids)

    def _numbered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of each distinct chunk, which of them each chunk is, numbers of chunks up to the end of each text)."""
        if len(self.number) > self.limit:
            self._halve()
        parts, ends = cut(texts)
        if not len(self.first) and len(self.number) >= FIRST:
            self.first = pa.array(list(itertools.islice(self.number, FIRST)), pa.binary())
        known = len(self.first) if len(parts) else 0
        # One dictionary for both, which begins with the first ones.
        found = pa.chunked_array([self.first, parts]).dictionary_encode().chunk(1) if known else parts.dictionary_encode()
        distinct = found.dictionary.slice(known).to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.number.get, distinct, itertools.repeat(-1)), np.int64, len(distinct))
        missing, base = np.flatnonzero(numbers < 0), len(self.number)
        new = [distinct[i] for i in missing.tolist()]
        self.number.update(zip(new, range(base, base + len(new)), strict=True))
        numbers[missing] = np.arange(base, base + len(new))
        numbers = np.concatenate([np.arange(known), numbers])
        for i in range(0, len(new), 20_000):
            self._add([k.decode() for k in new[i : i + 20_000]])
        at = found.indices.to_numpy()
        self.uses[numbers] += np.bincount(at, minlength=len(numbers))
        return numbers, at, ends

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the numbers of its chunks; they hold until the next call."""
        numbers, at, ends = self._numbered(pa.array(texts, pa.string()))
        return np.split(numbers[at], ends[:-1]) if texts else []

    def encoded(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts (strings, null as empty) one after the other, each with the end id behind it, and where each ends."""
        numbers, at, ends = self._numbered(texts)
        # The end id is a further chunk, whose place is filled in afterwards.
        length, start = np.append(self.length[numbers], 1), np.append(self.start[numbers], 0)
        at = np.insert(at, ends, len(numbers))
        size = length[at]
        stops = np.cumsum(size)
        places = np.repeat(start[at] - (stops - size), size)
        places += np.arange(len(places))
        out = self.ids[places]
        stops = stops[ends + np.arange(len(ends))]
        out[stops - 1] = end
        return out, stops

    def encode(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of one text, from the numbers of its chunks."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.start[numbers] - (ends - length), length)
        return self.ids[at]


_STORES: dict[str, ChunkStore] = {}


def store(path: str, limit: int = LIMIT) -> ChunkStore:
    """The worker's store for a vocabulary file; it outlives tasks."""
    found = _STORES.get(path)
    if found is None:
        found = _STORES[path] = ChunkStore(path)
    found.limit = limit
    return found


def slices(batch: pa.RecordBatch, column: int, size: int = 4 << 20):
    """batch in runs of rows with about size bytes in a column of strings."""
    offsets, n, first = _offsets(batch.column(column)), batch.num_rows, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, int(offsets[first]) + size, side="right")) - 1)
        yield batch.slice(first, end - first)
        first = end


def text_batches(values: list, size: int = 4 << 20):
    """(first, texts) in runs of about size characters; null is the empty text."""
    first, held, texts = 0, 0, []
    for i, x in enumerate(values):
        texts.append(x or "")
        held += len(texts[-1])
        if held >= size:
            yield first, texts
            first, held, texts = i + 1, 0, []
    if texts:
        yield first, texts
