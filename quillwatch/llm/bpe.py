"""BPE encoding and decoding with a public vocabulary file, by a prefix-sharing trie.

Text is normalised and cut into words as the vocabulary file asks (NFC, white space, lower case; contractions, letters, single numbers, other signs).
The distinct words of a batch of rows go into a trie whose edges are the symbols of the vocabulary; a word's last symbol carries the end mark. A depth-first walk
gives each node the last token of its prefix's encoding: the only token that ends there and that, merged next to the last token of the remaining prefix, stays
apart from it. So a prefix shared by many words is encoded once; a word's encoding is read off by stepping back over last tokens.

Each task works on its own rows and nothing is shuffled: joining words back to their places would move every word of the corpus. Encoded words
are kept between batches in a table that is emptied at `CACHE` words; a word seen again after that is simply encoded anew.

The vocabulary is read once by the driver and sent to the tasks (its size is that of the file, whatever the corpus is).

Defined cases: a null or empty text has no ids and decodes to an empty text; the strings of special tokens in a text are those tokens, as in the
tokenizers library by default; whole texts are encoded, whatever their length; rows are independent, so repeated rows give repeated results.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType

from quillwatch.llm.letters import cut, lower

CACHE = 500_000
#: Fixed value: the word pattern of the vocabulary file's pre-tokenizer.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: The same for lower-cased ASCII texts.
ASCII_WORDS = re.compile(r"[a-z]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\t-\r a-z0-9]+")


def byte_letters() -> list[str]:
    """The printable letter of every byte: itself where it is printable Latin-1, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Vocabulary:
    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for t, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = t
        self.ranks = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.letters = byte_letters()
        self.table = dict(enumerate(self.letters))
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.words = regex.compile(WORDS)
        # Tokens that their own symbols merge to; only these can come out of an encoding.
        self.inner: dict[str, int] = {}
        self.last: dict[str, int] = {}
        self.symbols: dict[int, tuple[str, ...]] = {}
        for t, i in self.ids.items():
            parts = self._symbols(t)
            if self.merge(list(parts)) == [t]:
                self.symbols[i] = parts
                if self.end and t.endswith(self.end) and len(t) > len(self.end):
                    self.last[t[:-len(self.end)]] = i
                else:
                    self.inner[t] = i
        self.longest = max(len(t) for t in [*self.inner, *self.last])
        self.inner_sizes, self.last_sizes = self._sizes(self.inner), self._sizes(self.last if self.end else self.inner)
        self.apart: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def _sizes(known: dict[str, int]) -> dict[str, list[int]]:
        """Lengths of the tokens that end in the same three letters (or are shorter), longest first."""
        sizes: dict[str, set[int]] = {}
        for t in known:
            sizes.setdefault(t[-3:], set()).add(len(t))
        return {k: sorted(v, reverse=True) for k, v in sizes.items()}

    def _symbols(self, token: str) -> tuple[str, ...]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[:-len(self.end)]
            return (*body[:-1], body[-1] + self.end)
        return tuple(token)

    def merge(self, parts: list[str]) -> list[str]:
        """Merges by rank, the leftmost of equals first; for short lists."""
        ranks = self.ranks
        while len(parts) > 1:
            best, at = min(((ranks.get(p, 1 << 60)), k) for k, p in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stay_apart(self, left: int, right: int) -> bool:
        key = (left, right)
        known = self.apart.get(key)
        if known is None:
            if len(self.apart) > 4 * CACHE:
                self.apart.clear()
            known = self.apart[key] = self.merge([*self.symbols[left], *self.symbols[right]]) == [self.tokens[left], self.tokens[right]]
        return known

    def last_token(self, tail: str, depth: int, path: list[int], known: dict[str, int], sizes: dict[str, list[int]]) -> int:
        """The last token of the prefix of length depth that ends in tail. path: last tokens of its shorter prefixes."""
        apart, stay_apart = self.apart, self.stay_apart
        for end in (tail[-3:], tail[-2:], tail[-1:]) if depth > 2 else (tail[-2:], tail[-1:]) if depth == 2 else (tail,):
            for size in sizes.get(end, ()):
                if size > depth:
                    continue
                token = known.get(tail[-size:])
                if token is None:
                    continue
                if size == depth:
                    return token
                left = path[depth - size]
                ok = apart.get((left, token))
                if ok or ok is None and stay_apart(left, token):
                    return token
        raise ValueError(f"no encoding of {tail!r}")

    def _read(self, depth: int, path: list[int], final: int) -> bytes:
        out = [final]
        depth -= len(self.symbols[final])
        while depth > 0:
            out.append(path[depth])
            depth -= len(self.symbols[out[-1]])
        return np.array(out[::-1], np.int32).tobytes()

    def encode_words(self, words: set[str]) -> dict[str, bytes]:
        """Encodings (int32 ids) of distinct words."""
        root: dict = {}
        for word in words:  # symbols lead down; the key "" of a node lists the words whose last symbol follows it
            letters = word if word.isascii() and word.isprintable() else word.encode("utf-8", "replace").decode("latin-1").translate(self.table)
            node = root
            for c in letters[:-1]:
                node = node.setdefault(c, {})
            node.setdefault("", []).append((letters[-1], word))
        done: dict[str, bytes] = {}
        path = [0]
        stack: list = [(root, "", 0)]
        longest, inner, sizes = self.longest, self.inner, self.inner_sizes
        marked, marked_sizes, find = self.last if self.end else inner, self.last_sizes, self.last_token
        while stack:
            node, tail, depth = stack.pop()
            if depth:
                del path[depth:]
                path.append(find(tail, depth, path, inner, sizes))
            for c, child in node.items():
                if c:
                    stack.append((child, (tail + c)[-longest:], depth + 1))
                else:
                    for letter, word in child:
                        done[word] = self._read(depth + 1, path, find((tail + letter)[-longest:], depth + 1, path, marked, marked_sizes))
        return done

    def pieces(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        return cut(self.words, lower(unicodedata.normalize("NFC", text)))

    def cut(self, text: str) -> list[str]:
        """Words and special tokens of a text, in order."""
        if self.special_pattern is None or "<" not in text or not self.special_pattern.search(text):
            return self.pieces(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*self.pieces(text[at:m.start()]), m[0]]
            at = m.end()
        return out + self.pieces(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        cache = self.cache
        new: set[str] = set()
        for words in cut:
            new.update(words)
        if len(cache) + len(new) > CACHE:
            keep = {w: cache[w] for w in new if w in cache}
            cache.clear()
            cache.update(keep)
        new.difference_update(cache)
        for t, i in self.special.items():
            if t in new:
                new.discard(t)
                cache[t] = np.array([i], np.int32).tobytes()
        cache.update(self.encode_words(new))
        return [b"".join(map(cache.__getitem__, words)) for words in cut]


_loaded: dict[str, Vocabulary] = {}


def loaded(text: str) -> Vocabulary:
    """One vocabulary per worker process."""
    if text not in _loaded:
        _loaded.clear()
        _loaded[text] = Vocabulary(text)
    return _loaded[text]


def read_vocabulary(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


#: Characters of text that are cut into words at once.
TOGETHER = 2_000_000


def groups(texts: list[str]) -> Iterator[list[str]]:
    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size > TOGETHER:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoder(vocabulary: str) -> Callable[[Column], Column]:
    """Column function: text to ids."""
    @arrow_udf(ArrayType(IntegerType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(vocabulary)
        for batch in batches:
            rows = [b for group in groups(batch.fill_null("").to_pylist()) for b in model.encode(group)]
            offsets = np.zeros(len(rows) + 1, np.int32)
            np.cumsum([len(b) // 4 for b in rows], out=offsets[1:])
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(rows), np.int32)))
    return encode


def decoder(vocabulary: str) -> Callable[[Column], Column]:
    """Column function: ids to text. The vocabulary file names no decoder, so tokens are joined by one space."""
    @arrow_udf(StringType())
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = pa.array(loaded(vocabulary).tokens)
        for batch in batches:
            ids = batch.fill_null([]) if batch.null_count else batch
            yield pc.binary_join(pa.ListArray.from_arrays(pc.cast(pa.array(np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))])), pa.int32()), tokens.take(ids.flatten())), " ")
    return decode
