"""Token counts by prefix dynamic programming.

The last token of a byte pair encoding of a prefix is the one token ending there that may follow the
last token of the shorter prefix it leaves; its count is that prefix's count plus one. Stored for
every prefix of every distinct word, this answers how many tokens any prefix of a text has, and where
a token budget ends, without encoding anything again.

A token pair may stand side by side if no merge across its border would have come before the merges
that built the two: only the right edge of the first and the left edge of the second matter.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); strings of special tokens inside a
text count as the library counts them by default (one token); texts of any length, and single words
of any length, take time in proportion; repeated and null doc_ids are ordinary rows.
"""

from __future__ import annotations

import json
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from bitlake.llm.tokens import WHITE, chunks, plain, vocabulary_path

TOKEN_LIMIT = 1024
#: Fixed value: the public pattern by which byte-level BPE vocabularies cut text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SIMPLE = re.compile(r" ?[A-Za-z]+\Z")
_LEADING = re.compile(f"[{WHITE}]*")


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else 256 and on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PrefixCounter:
    """Token counts of every prefix of a text under a byte-level BPE file of the tokenizers library."""

    def __init__(self, path: str, limit: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or model.get("unk_token") or model.get("dropout"):
            raise ValueError("a byte-level BPE without normalizer is needed")
        self.split = regex.compile(PATTERN).findall
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.id: dict[str, int] = model["vocab"]
        self.letters = dict(enumerate(byte_letters()))
        self.longest = max(map(len, self.id))
        self.rank: dict[int, int] = {}
        part: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, ab = self.id[a], self.id[b], self.id[a + b]
            self.rank[a << 32 | b] = r
            part.setdefault(ab, (a, b, r))
        self.part, self.limit = part, limit
        self.edge: tuple[dict, dict] = ({}, {})
        self.fits: dict[int, bool] = {}
        self.known: dict[str, tuple[int, int]] = {}
        self.total: dict[str, int] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens along one edge (1: right, 0: left) of a token, each with the rank of the merge that takes it in."""
        if token not in self.edge[side]:
            out, t, until = [], token, float("inf")
            while True:
                out.append((t, until))
                if t not in self.part:
                    break
                until, t = self.part[t][2], self.part[t][side]
            self.edge[side][token] = out
        return self.edge[side][token]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether encoding the two tokens' joint bytes gives just them."""
        pair = first << 32 | second
        fits = self.fits.get(pair)
        if fits is None:
            if len(self.fits) > 2 * self.limit:
                self.fits.clear()
            fits, rank, left = True, self.rank.get, self._edge(second, 0)
            for x, a in self._edge(first, 1):
                for y, b in left:
                    r = rank(x << 32 | y)
                    # Of equal merges the leftmost comes first, so the first token's own beats one across the border.
                    if r is not None and r < a and r <= b:
                        fits = False
                        break
                if not fits:
                    break
            self.fits[pair] = fits
        return fits

    def _spell(self, word: str) -> str:
        """One letter per byte of the word's UTF-8 form."""
        return (word if word.isascii() else word.encode("utf-8", "surrogatepass").decode("latin-1")).translate(self.letters)

    def _last(self, s: str) -> tuple[int, int]:
        """(count, last token) of a spelled word; those of all its prefixes are kept."""
        known = self.known
        if s in known:
            return known[s]
        ids, j = self.id.get, len(s) - 1
        while j and s[:j] not in known:
            j -= 1
        for i in range(j + 1, len(s) + 1):
            for k in range(max(0, i - self.longest), i):
                t = ids(s[k:i])
                if t is None:
                    continue
                if not k:
                    known[s[:i]] = 1, t
                    break
                count, last = known[s[:k]]
                if self.may_follow(last, t):
                    known[s[:i]] = count + 1, t
                    break
        return known[s]

    def word(self, word: str) -> list[int]:
        """Counts of the prefixes of one pre-token, by characters."""
        s = self._spell(word)
        if len(s) > 64:
            counts = self._long(s)
        else:
            self._last(s)
            counts = [0, *(self.known[s[:i]][0] for i in range(1, len(s) + 1))]
        if len(s) == len(word):
            return counts[1:]
        return [counts[e] for e in accumulate(len(c.encode("utf-8", "surrogatepass")) for c in word)]

    def _long(self, s: str) -> list[int]:
        """As word(), with the states in lists: the prefixes of very long words are not worth keeping."""
        counts, last, ids = [0] * (len(s) + 1), [-1] * (len(s) + 1), self.id
        for i in range(1, len(s) + 1):
            for k in range(max(0, i - self.longest), i):
                t = ids.get(s[k:i])
                if t is not None and (k == 0 or self.may_follow(last[k], t)):
                    counts[i], last[i] = counts[k] + 1, t
                    break
        return counts

    def prefixes(self, chunk: str) -> list[int]:
        """Counts of the prefixes of a chunk (white space, then other characters), by characters."""
        if len(self.known) > self.limit:
            self.known.clear()
        if _SIMPLE.match(chunk):
            return self.word(chunk)
        if found := [(chunk.index(x), x) for x in self.special if x in chunk]:
            at, x = min(found, key=lambda f: (f[0], -len(f[1])))
            head, tail = chunk[:at], chunk[at + len(x) :]
            before = self.count(head) + 1
            return [*self.prefixes(chunk[: at + len(x) - 1]), before, *(before + c for c in (self.prefixes(tail) if tail else ()))]
        white = _LEADING.match(chunk).end()
        # White space at the end of a text is one word, however it is cut once something follows.
        out = self.word(chunk[:white]) if white else []
        base, at = 0, 0
        for w in self.split(chunk):
            if at + len(w) > white or white == len(chunk):
                counts = self.word(w)
                if w[0] == "'" and len(w) > 2 and w[1].isalpha():
                    # A contraction is a word as a whole only: before its last letter it is a quote and a letter.
                    counts = [counts[0], *(self.word("'")[-1] + c for c in self.word(w[1:-1])), counts[-1]]
                new = at + len(w) - max(at, white)
                if white < len(chunk) and new:
                    out += [base + c for c in counts[-new:]]
                base += counts[-1]
            else:
                base += self.word(w)[-1]
            at += len(w)
        return out

    def count(self, text: str) -> int:
        """Tokens of a whole text: the count stored at its last prefix."""
        total, get = 0, self.total.get
        for c in self._chunks(text):
            n = get(c)
            total += n if n is not None else self._total(c)
        return total

    @staticmethod
    def _chunks(text: str) -> list[str]:
        if not plain(text):
            return chunks(text)
        first, *rest = text.replace("\n", " \n").split(" ") if text else [""]
        return [first, *(x if x[0] == "\n" else " " + x for x in rest)] if text else []

    def _total(self, chunk: str) -> int:
        if len(self.total) > self.limit:
            self.total.clear()
        if len(self.known) > self.limit:
            self.known.clear()
        if any(x in chunk for x in self.special):
            return self.prefixes(chunk)[-1]
        n = 0
        for w in (chunk,) if _SIMPLE.match(chunk) else self.split(chunk):
            s = self._spell(w)
            n += self._last(s)[0] if len(s) <= 64 else self._long(s)[-1]
        if len(chunk) < 200:
            self.total[chunk] = n
        return n

    def table(self, text: str) -> list[int]:
        """Counts of all prefixes of text: entry i is for text[:i]."""
        out, base = [0], 0
        for c in chunks(text):
            out += [base + n for n in self.prefixes(c)]
            base = out[-1]
        return out

    def fitting(self, text: str, budget: int) -> int:
        """The length of the longest prefix with at most budget tokens such that no shorter prefix has more."""
        base, at = 0, 0
        for c in self._chunks(text):
            counts = self.prefixes(c)
            if base + max(counts) > budget:
                return at + next(i for i, n in enumerate(counts) if base + n > budget)
            base, at = base + counts[-1], at + len(c)
        return at


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = TOKEN_LIMIT, cut: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs (doc_id, text); cut adds fits, the characters that fit the limit."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    if cut:
        fields.append(T.StructField("fits", T.LongType()))

    def run(batches):
        counts = counter(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            n = [counts.count(x) for x in texts]
            columns = [batch.column(0), pa.array([len(x.encode("utf-8", "surrogatepass")) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())]
            if cut:
                columns.append(pa.array([counts.fitting(x, limit) for x in texts], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return docs.select("doc_id", "text").mapInArrow(run, T.StructType(fields))
