"""BPE encoding and decoding: speculate and verify.

A word's tokens are proposed by greedy longest match. A proposal is the BPE encoding if and only if every token encodes
to itself and every adjacent pair encodes to itself, so one vectorised check tests all adjacent pairs of a batch of words
against a table of known pairs; only words with a failing pair undergo exact merging.

Null text counts as empty: no tokens, empty decoding. Repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

#: Distinct words kept encoded in a worker; beyond it the memory starts anew.
MEMORY_WORDS = 400_000
#: Characters of the texts handled at once; a longer single text makes a slice of its own.
SLICE_CHARS = 1 << 20
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class WordBpe:
    """A vocabulary file of kind BPE with word ends, lower case, white space dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(a, b): r for r, (a, b) in enumerate(pairs)}
        self.prefixes = {t[:k] for t in self.vocab for k in range(1, len(t) - len(self.end) * t.endswith(self.end))}
        self.letter = byte_letters()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.base = len(self.vocab) + 1  # second half of a pair code; the last value stands for "no right neighbour"
        self.known = np.zeros(0, np.int64)
        self.good = np.zeros(0, bool)
        self.memory: dict[str, tuple[str, str]] = {}

    def units(self, word: str) -> list[str]:
        found = [self.letter[b] for b in word.encode("utf-8")]
        found[-1] += self.end
        return found

    def merge(self, units: list[str]) -> list[str]:
        """Exact merging: the lowest rank first, leftmost among equals; a linked list and a heap, n log n."""
        import heapq

        n = len(units)
        if n < 2:
            return units
        at, left, right = list(units), list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, units[i], units[i + 1]) for i in range(n - 1) if (r := self.rank.get((units[i], units[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i]
            if at[i] != a or j < 0 or at[j] != b:
                continue
            at[i], at[j] = a + b, ""
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (r := self.rank.get((at[i], at[right[i]]))) is not None:
                    heapq.heappush(heap, (r, i, at[i], at[right[i]]))
            if left[i] >= 0 and (r := self.rank.get((at[left[i]], at[i]))) is not None:
                heapq.heappush(heap, (r, left[i], at[left[i]], at[i]))
        return [a for a in at if a]

    def propose(self, units: list[str]) -> list[int]:
        """Greedy longest match, walking only prefixes of tokens."""
        out, i, n = [], 0, len(units)
        while i < n:
            body, best, j, stop = "", -1, i, i
            while j < n:
                body += units[j]
                j += 1
                if (t := self.vocab.get(body)) is not None:
                    best, stop = t, j
                elif body not in self.prefixes:
                    break
            out.append(best)
            i = stop
        return out

    def pieces(self, token: str) -> list[str]:
        if token.endswith(self.end):
            found = list(token[: -len(self.end)])
            found[-1] += self.end
            return found
        return list(token)

    def pair_holds(self, code: int) -> bool:
        a, b = divmod(int(code), self.base)
        if b == self.base - 1:
            return self.merge(self.pieces(self.names[a])) == [self.names[a]]
        return self.merge(self.pieces(self.names[a]) + self.pieces(self.names[b])) == [self.names[a], self.names[b]]

    def holds(self, codes: np.ndarray) -> np.ndarray:
        """For each pair code whether the two tokens stay apart as they are; unknown pairs are merged once."""
        distinct, where = np.unique(codes, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        seen = at < len(self.known)
        seen[seen] = self.known[at[seen]] == distinct[seen]
        new = distinct[~seen]
        if len(new):
            if len(self.known) > 4 * MEMORY_WORDS:
                self.known, self.good, new = np.zeros(0, np.int64), np.zeros(0, bool), distinct
            known = np.concatenate([self.known, new])
            good = np.concatenate([self.good, np.fromiter(map(self.pair_holds, new), bool, len(new))])
            order = np.argsort(known)
            self.known, self.good = known[order], good[order]
        return self.good[np.searchsorted(self.known, distinct)][where]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        units = [self.units(w) for w in words]
        found = [self.propose(u) for u in units]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter((t for f in found for t in f), np.int64, int(sizes.sum()))
        nxt = np.append(flat[1:], 0)
        ends = np.cumsum(sizes) - 1
        nxt[ends] = self.base - 1
        codes = np.concatenate([flat * self.base + nxt, flat * self.base + self.base - 1])
        owner = np.repeat(np.arange(len(found)), sizes)
        failed = np.unique(np.concatenate([owner, owner])[~self.holds(codes)])
        for k in failed:
            found[k] = [self.vocab[t] for t in self.merge(units[k])]
        return found

    def words(self, text: str) -> list[str]:
        """The words of a text in order; a special string is a word of its own, marked by a leading blank."""
        parts = self.split.split(text) if self.split and "<|" in text else [text]
        out: list[str] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(" " + part)
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                part = part.lower() if "Σ" not in part else "".join(map(str.lower, part))
                out += _PIECES.findall(part)
        return out

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memory]
        if len(self.memory) + len(new) > MEMORY_WORDS:
            self.memory.clear()
            new = list(words)
        plain = [w for w in new if w[0] != " "]
        for w, ids in zip(plain, self.encode_words(plain) if plain else [], strict=True):
            self.memory[w] = (" ".join(map(str, ids)), " ".join(self.names[i] for i in ids))
        for w in new:
            if w[0] == " ":
                self.memory[w] = (str(self.special[w[1:]]), w[1:])

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Per text (decimal ids joined by a blank, decoded text); the file has no decoder, so tokens are joined by a blank."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
                size += len(texts[j])
                j += 1
            words = [self.words(t) for t in texts[i:j]]
            self.learn(set().union(*words))
            memory = self.memory
            for row in words:
                found = [memory[w] for w in row]
                yield " ".join([f[0] for f in found]), " ".join([f[1] for f in found])
            i = j

    def encode(self, text: str) -> tuple[str, str]:
        return next(self.encode_all([text]))


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, number of tokens, SHA-256 of the ids and of the decoded text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(path)
        for batch in batches:
            rows = []
            for ids, decoded in bpe.encode_all([t or "" for t in batch[text_col]]):
                rows.append((ids.count(" ") + 1 if ids else 0, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, id_col, batch[id_col].to_numpy())
            yield out

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
