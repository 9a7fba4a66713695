"""Token counts by finite-state transducers.

A lexical transducer over character classes marks where words start. The text is cut into chunks; each chunk's map from
entry state to exit state is found in lockstep, the maps compose through a parallel prefix scan, and the resulting entry
states replay every chunk at once. The in-word transducer's state is the hash of the word so far, and its final
transition emits the word's token count; final transitions are compiled when a word is first seen, by exact merging.

Null text counts as empty: 0 bytes, 0 tokens. Repeated rows repeat; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from helixframe.llm import bpe as bpe_mod
from helixframe.llm.textkernel import mix

#: Characters of a chunk, of the texts handled at once, and words whose final transitions a worker keeps.
CHUNK, SLICE_CHARS, MEMORY_WORDS = 64, 1 << 19, 1_000_000

# character classes: blank, letter, digit, other, apostrophe, and the letters of contractions
BLANK, LETTER, NUMBER, OTHER, QUOTE, ONE, R, V, L, E = range(10)
# states: after blank, in letters, after a digit, in others, after a quote that starts a run, after 'r 'v 'l, after a contraction
S0, SL, SN, SO, SQ, SR, SV, SLL, SC = range(9)


def lexical_table() -> np.ndarray:
    """next state [state, class]."""
    table = np.zeros((9, 10), np.uint8)
    for s in range(9):
        table[s, BLANK], table[s, NUMBER], table[s, OTHER] = S0, SN, SO
        table[s, [LETTER, ONE, R, V, L, E]] = SL
        table[s, QUOTE] = SO if s in (SO, SQ) else SQ
    table[SQ, ONE], table[SQ, R], table[SQ, V], table[SQ, L] = SC, SR, SV, SLL
    table[SR, E] = table[SV, E] = table[SLL, L] = SC
    return table


_NEXT = lexical_table()
_classes: list[np.ndarray] = []


def char_classes() -> np.ndarray:
    if not _classes:
        found = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for pattern, c in ((r"\s", BLANK), (r"\p{L}", LETTER), (r"\p{N}", NUMBER)):
            found[[ord(x) for x in regex.findall(pattern, every)]] = c
        for letters, c in (("'", QUOTE), ("stmd", ONE), ("r", R), ("v", V), ("l", L), ("e", E)):
            found[list(letters.encode())] = c
        _classes.append(found)
    return _classes[0]


def states(classes: np.ndarray) -> np.ndarray:
    """The lexical state after each character, from S0, by chunk maps and a prefix scan."""
    n = len(classes)
    m = -(-n // CHUNK)
    grid = np.zeros(m * CHUNK, np.uint8)
    grid[:n] = classes
    grid = grid.reshape(m, CHUNK)
    maps = np.tile(np.arange(9, dtype=np.uint8), (m, 1))
    for j in range(CHUNK):
        maps = _NEXT[maps, grid[:, j, None]]
    step = 1
    while step < m:  # inclusive scan: after it maps[i] is the composition of chunks 0..i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.int64), axis=1)
        step *= 2
    state = np.zeros(m, np.uint8)
    state[1:] = maps[:-1, S0]
    out = np.empty((m, CHUNK), np.uint8)
    for j in range(CHUNK):
        state = _NEXT[state, grid[:, j]]
        out[:, j] = state
    return out.reshape(-1)[:n]


def word_starts(after: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether a word starts at each character; what a contraction decides late is put right behind it."""
    before = np.concatenate([[S0], after[:-1]]).astype(np.uint8)
    letter = (classes == LETTER) | (classes >= ONE)
    start = letter & (before != SL) & ~((after == SC) | np.isin(after, [SR, SV, SLL]))
    start |= classes == NUMBER
    start |= ((classes == OTHER) | (classes == QUOTE)) & ~np.isin(before, [SO, SQ])
    # 'r 'v 'l that no contraction follows: the letter starts a word, and a letter after it continues that word
    pending = np.isin(after, [SR, SV, SLL])
    following = np.concatenate([after[1:], [S0]])
    start |= pending & (following != SC)
    start &= ~(letter & np.isin(before, [SR, SV, SLL]) & (after != SC))
    return start


class Counter:
    def __init__(self, path: str):
        self.bpe = bpe_mod.tokenizer(path)
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def finals(self, keys: np.ndarray, first: np.ndarray, ends: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Token counts of distinct words."""
        at = np.searchsorted(self.keys, keys)
        seen = at < len(self.keys)
        seen[seen] = self.keys[at[seen]] == keys[seen]
        if not seen.all():
            if len(self.keys) > MEMORY_WORDS:
                self.keys, self.counts, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(keys), bool)
            new = np.flatnonzero(~seen)
            words = [text[first[i] : ends[i]].tobytes().decode("utf-32-le") for i in new]
            counts = np.array([len(x) for x in self.bpe.encode_words(words)], np.int64)
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            self.keys, self.counts = all_keys[order], np.concatenate([self.counts, counts])[order]
        return self.counts[np.searchsorted(self.keys, keys)]

    def normal(self, text: str) -> tuple[str, int]:
        """(normalised text, number of special strings); each special string leaves a blank."""
        special = 0
        if self.bpe.split and "<|" in text:
            parts = self.bpe.split.split(text)
            special = len(parts) // 2
            parts = [unicodedata.normalize("NFC", p) for p in parts[::2]]
            text = " ".join(parts)
        elif not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return (text.lower() if "Σ" not in text else "".join(map(str.lower, text))), special

    def count(self, texts: list[str]) -> np.ndarray:
        found = [self.normal(t) for t in texts]
        ends_of = np.cumsum([len(t) + 1 for t, _ in found])
        code = np.frombuffer((" ".join(t for t, _ in found) + " ").encode("utf-32-le"), np.uint32)
        classes = char_classes()[code]
        start = word_starts(states(classes), classes)
        firsts = np.flatnonzero(start)
        special = np.array([s for _, s in found], np.int64)
        if not len(firsts):
            return special
        # a word ends where the next one starts or at the first blank before that
        blank = np.append(np.flatnonzero(classes == BLANK), len(code))
        ends = np.minimum(np.append(firsts[1:], len(code)), blank[np.searchsorted(blank, firsts)])
        # the in-word state: a rolling hash over code points
        base = np.uint64(0x9E3779B97F4A7C15)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.full(len(code), base, np.uint64)
        powers[0] = 1
        np.multiply.accumulate(powers, out=powers)
        back = np.full(len(code), inverse, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
        keys = mix((sums[ends] - sums[firsts]) * back[firsts] + (ends - firsts).astype(np.uint64))
        distinct, one, where = np.unique(keys, return_index=True, return_inverse=True)
        per_word = self.finals(distinct, firsts[one], ends[one], code)[where]
        sums = np.concatenate([[0], np.cumsum(per_word)])
        upto = sums[np.searchsorted(firsts, ends_of)]
        return np.diff(upto, prepend=0) + special


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, UTF-8 bytes, tokens, whether the tokens exceed limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = _counters.setdefault(path, Counter(path))
        for batch in batches:
            texts = [t or "" for t in batch[text_col]]
            counts, i = [], 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE_CHARS):
                    size += len(texts[j])
                    j += 1
                counts.append(counter.count(texts[i:j]))
                i = j
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pd.DataFrame({id_col: batch[id_col].to_numpy(), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n, "over_limit": n > limit})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
