"""Byte-level BPE: words of a text are looked up, new words are encoded together in a trie.

A text is cut into words by the pattern of the vocabulary, here with array operations over code point classes.
Words a worker has not met are sorted, which is the depth-first order of their trie, and walked with a stack: for
every prefix the *last token* of its encoding is kept, so a prefix shared by many words is worked out once. The last
token of a prefix is the one suffix ``t`` that is a token, ends the prefix and may follow the last token of what is
before it. Whether ``t`` may follow ``s`` is asked of the merge order only (:meth:`Vocabulary.may_follow`). The full
encoding of a word is then read off backwards.

Defined results: a null or empty text has no tokens; strings of added tokens in a text become that token; a word of any
length costs time in proportion to it. Repeated rows give repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import free_name, tokenizer_path, with_text_result

NEVER = 1 << 60

# Fixed values of the pattern: White_Space code points, and letters after an apostrophe that end a word
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
SHORT_ENDS = ("s", "t", "m", "d", "re", "ve", "ll")

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Class of every code point."""
    table = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[list(WHITE_SPACE)] = SPACE
    return table


def word_starts(text: str) -> np.ndarray:
    """Where the words of the pattern begin, with the length of the text at the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    if not n:
        return np.zeros(1, np.int64)
    kind = _classes()[points]
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    space = kind == SPACE
    blank = points == 32
    # the last space of a run before a word: a blank joins the word, anything else stands alone
    last_space = space[:-1] & ~space[1:]
    joined = np.flatnonzero(last_space & blank[:-1]) + 1
    start[:-1] |= last_space
    start[joined] = False
    quotes = np.flatnonzero((points[:-1] == 39) & (kind[1:] == LETTER) & start[:-1])
    for i in quotes.tolist():
        for end in SHORT_ENDS:
            if text.startswith(end, i + 1):
                start[i + 1] = False
                after = i + 1 + len(end)
                if after < n and kind[after] == LETTER:
                    start[after] = True
                break
    return np.append(np.flatnonzero(start), n)


def _byte_letters() -> dict[str, int]:
    """The letter by which the file format writes each byte: itself if printable, else the next free one."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in plain):
        letters[chr(256 + i)] = b
    return letters


class Vocabulary:
    """Tokens and merges of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = _byte_letters()
        vocab = data["model"]["vocab"]
        added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.token_bytes = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        self.token_bytes.update({i: t.encode() for t, i in added.items()})
        self.added = added
        self.added_pattern = (
            re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        )
        self.base = {b: vocab[c] for c, b in letters.items() if c in vocab}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = vocab[left], vocab[right]
            self.rank[a, b] = rank
            self.parts.setdefault(vocab[left + right], (a, b, rank))
        self._ending: dict[bytes, int] = {}
        self._right: dict[int, list] = {}
        self._left: dict[int, list] = {}
        self._pairs: dict[int, bool] = {}

    @property
    def ending(self) -> dict[bytes, int]:
        """Suffixes of tokens: the token that is spelt so, or -1. Made when first asked for."""
        if not self._ending:
            for t in [*self.base.values(), *self.parts]:
                word = self.token_bytes[t]
                for i in range(1, len(word)):
                    self._ending.setdefault(word[i:], -1)
                self._ending[word] = t
        return self._ending

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """Tokens at one edge of ``token`` from its byte up, each with the rank of the merge that takes it up."""
        kept = self._right if side else self._left
        if token not in kept:
            out, until, t = [], NEVER, token
            while True:
                out.append((t, until))
                if t not in self.parts:
                    break
                until = self.parts[t][2]
                t = self.parts[t][side]
            kept[token] = out[::-1]
        return kept[token]

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the bytes of ``a`` and ``b`` gives just these two tokens.

        Two edge pieces that exist at the same time would be merged across the border if their merge comes before both are
        taken up by their own tokens; of equal merges the one further left comes first.
        """
        left, right = self._edge(a, 1), self._edge(b, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = left[i], right[j]
            rank = self.rank.get((x, y), NEVER)
            if rank < x_until and rank <= y_until and rank < NEVER:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; ``words`` sorted and distinct, so that neighbours share prefixes."""
        ending, pairs, spelt = self.ending.get, self._pairs, self.token_bytes
        if len(pairs) > 1_000_000:
            pairs.clear()
        pair = pairs.get
        last: list[int] = [-1]
        before, out = b"", []
        for word in words:
            n, shared = len(word), 0
            most = min(n, len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, n + 1):
                for start in range(end - 1, -1, -1):
                    t = ending(word[start:end])
                    if t is None:
                        raise ValueError("no token ends this prefix")
                    if t < 0:
                        continue
                    if start:
                        key = last[start] << 32 | t
                        follows = pair(key)
                        if follows is None:
                            follows = pairs[key] = self.may_follow(last[start], t)
                        if not follows:
                            continue
                    last.append(t)
                    break
                else:
                    raise ValueError("no token ends this prefix")
            ids, end = [], n
            while end:
                ids.append(last[end])
                end -= len(spelt[last[end]])
            out.append(ids[::-1])
            before = word
        return out


class Encoder:
    """Encodes texts with a bounded memory of words, kept by each worker between tasks."""

    def __init__(self, path: str, cache_words: int = 400_000, longest_cached: int = 64):
        self.vocabulary = Vocabulary(path)
        self.cache_words, self.longest = cache_words, longest_cached
        self.known: dict[str, bytes] = {}

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        by_bytes = {w.encode("utf-8", "surrogatepass"): w for w in new}
        order = sorted(by_bytes)
        return {by_bytes[b]: array("I", ids).tobytes() for b, ids in zip(order, self.vocabulary.encode_words(order))}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        pattern, known = self.vocabulary.added_pattern, self.known
        cut: list[list] = []
        for text in texts:
            pieces: list = []
            parts = pattern.split(text) if pattern is not None else [text]
            for k, part in enumerate(parts):
                if k % 2:
                    pieces.append(array("I", [self.vocabulary.added[part]]).tobytes())
                elif part:
                    at = word_starts(part).tolist()
                    pieces.append([part[a:b] for a, b in zip(at, at[1:])])
            cut.append(pieces)
        met = {w for pieces in cut for p in pieces if type(p) is list for w in p}
        found = self._learn({w for w in met if w not in known})
        if len(known) + len(found) > self.cache_words:
            # start anew with the words at hand
            found.update({w: known[w] for w in met if w in known})
            known.clear()
        if len(found) <= self.cache_words:
            known.update({w: ids for w, ids in found.items() if len(w) <= self.longest})
        if any(w not in known for w in found):
            get = {**{w: known[w] for w in met if w in known}, **found}.__getitem__
        else:
            get = known.__getitem__
        return [
            b"".join(p if type(p) is bytes else b"".join(map(get, p)) for p in pieces) for pieces in cut
        ]

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement characters."""
        spelt = self.vocabulary.token_bytes
        out = b"".join(map(spelt.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return out.decode("utf-8", "replace").encode("utf-8")


class LibraryEncoder(Encoder):
    """The same ids, with new words encoded by a tokenizer library instead of the trie."""

    def __init__(self, path: str, cache_words: int = 200_000, longest_cached: int = 64):
        import tiktoken

        super().__init__(path, cache_words, longest_cached)
        own = self.vocabulary
        ranks = {own.token_bytes[t]: t for t in [*own.base.values(), *own.parts]}
        self.library = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        encode = self.library.encode_ordinary
        return {w: array("I", encode(w)).tobytes() for w in new}


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def in_chunks(texts: list, size: int = 2_000_000):
    """Runs of ``texts`` of about ``size`` characters, so that a batch of long texts does not fill the memory."""
    run, held = [], 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= size:
            yield run
            run, held = [], 0
    if run:
        yield run


def digests(texts: list, path: str) -> list[tuple]:
    """(number of tokens, sha256 of ids, sha256 of the decoded text) of each text."""
    own, out = encoder(path), []
    for run in in_chunks([t or "" for t in texts]):
        for ids in own.encode(run):
            decoded = own.decode(ids)
            out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()))
    return out


def encode_column(df: DataFrame, text_col: str = "text", name: str = "ids", path: str | None = None) -> DataFrame:
    """``df`` with the token ids of ``text_col`` as an array column ``name``."""
    place = path or tokenizer_path()

    def ids(texts: list) -> list[tuple]:
        own = encoder(place)
        return [
            (np.frombuffer(b, "<u4").astype(np.int32).tolist(),)
            for run in in_chunks([t or "" for t in texts])
            for b in own.encode(run)
        ]

    held = free_name(df, "_encoded")
    out = with_text_result(df, text_col, ids, "ids array<int>", held)
    return out.withColumn(name, F.col(f"{held}.ids")).drop(held)


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Number of tokens and digests of ids and decoded text, one row per row of ``df``."""
    place = path or tokenizer_path()
    base = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = with_text_result(
        base, "text", lambda t: digests(t, place), "n_tokens bigint, ids_sha256 string, decoded_sha256 string", "r"
    )
    return out.select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
