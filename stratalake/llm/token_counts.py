"""Token counts of byte-level BPE tokenizers by rank-synchronous array merging.

Texts are cut at the added tokens, then into pre-tokens.  The pre-tokens of a slice that no earlier
slice had become one ragged numpy array of symbols.  In each round every sequence takes the pair of
its own lowest rank and merges all of that pair's places at once; sequences without a ranked pair
leave the array.  What is left of a sequence is its number of tokens.  Merging all places of a pair
at once equals merging one by one, as a pair that holds a merged symbol ranks after that symbol's
own merge; the loader refuses a vocabulary in which that does not hold.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are kept one for one, so
repeated rows and null ids stay; an empty table gives an empty result; of the input only the id and
text columns are read, so other columns can't clash.  Memory: the slice, a bounded cache of
pre-tokens for each Python worker, and the longest single pre-token; a text above a million
characters is cut into pre-tokens piece by piece.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import kernels
from .tables import mapped, pick

CACHED = 400_000
PIECE = 1_000_000
NO_RANK = np.int64(1) << 40
#: How byte-level tokenizers cut texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=1)
def _newer() -> dict[int, str]:
    """Letters and numbers that only the cutting library's newer Unicode tables know, to be cut as signs."""
    every = "".join(map(chr, chain(range(0x80, 0xD800), range(0xE000, 0x110000))))
    return {ord(c): "†" for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"}


class Tokenizer:
    """Merges, symbols and added tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        plain = [spec["normalizer"], spec["post_processor"], spec["truncation"], spec["padding"], model.get("dropout"), model.get("ignore_merges") or None, model.get("continuing_subword_prefix"), model.get("end_of_word_suffix")]
        if before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"] or any(x is not None for x in plain):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        added = spec["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path}: an added token takes its surroundings")
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        vocab = model["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
        self.symbol = np.array([vocab[shown[b]] for b in range(256)], np.int64)
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, made = (np.array([vocab[x] for x in xs], np.int64) for xs in (*zip(*merges, strict=True), ["".join(m) for m in merges]))
        born = dict(zip(made.tolist(), range(len(made)), strict=True))
        if any(born.get(a, -1) >= i or born.get(b, -1) >= i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True))):
            raise ValueError(f"{path}: a pair ranks before its own parts")
        order = np.argsort(keys := (left << 20) | right, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order, made[order]
        self.pattern, self.late = regex.compile(PATTERN), re.compile("[԰-\U0010ffff]").search
        self.cache: dict[str, int] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.ranks[at], NO_RANK), self.made[at]

    def merged(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols each byte string keeps."""
        out = np.array([len(t) for t in tokens], np.int64)
        live = np.flatnonzero(out > 1)
        symbols = self.symbol[np.frombuffer(b"".join(tokens[i] for i in live), np.uint8)]
        sizes = out[live]
        rank, made = np.full(len(symbols), NO_RANK), np.zeros(len(symbols), np.int64)
        stale = np.setdiff1d(np.arange(len(symbols)), np.cumsum(sizes) - 1, assume_unique=True)
        while live.size:
            # only pairs that the last round changed are looked up; the last symbol of each sequence has none
            rank[stale], made[stale] = self._rank(symbols[stale], symbols[stale + 1])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            owner = np.repeat(np.arange(len(live)), sizes)
            best = np.minimum.reduceat(rank, starts)
            # of overlapping places (a pair of equal symbols in a run) every second counts, from the left
            places = np.flatnonzero((rank == best[owner]) & (rank < NO_RANK))
            fresh = np.ones(len(places), bool)
            fresh[1:] = np.diff(places) > 1
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - head) % 2 == 0]
            symbols[places] = made[places]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            touched = np.zeros(len(symbols), bool)
            touched[places] = True
            touched[places[places > 0] - 1] = True  # a merged-away neighbour is dropped below
            back = places[places > 1] - 2
            touched[back] |= ~keep[back + 1]
            sizes = sizes - np.bincount(owner[places], minlength=len(live))
            done = (best == NO_RANK) | (sizes == 1)
            out[live] = sizes
            keep &= ~done[owner]
            symbols, rank, made, live, sizes = symbols[keep], rank[keep], made[keep], live[~done], sizes[~done]
            touched = touched[keep]
            touched[np.cumsum(sizes) - 1] = False
            rank[np.cumsum(sizes) - 1] = NO_RANK
            stale = np.flatnonzero(touched)
        return out

    def _learn(self, tokens: set[str]) -> None:
        new = [t for t in tokens if t not in self.cache]
        if len(self.cache) + len(new) > CACHED:
            self.cache.clear()
            new = list(tokens)
        self.cache.update(zip(new, self.merged([t.encode() for t in new]).tolist(), strict=True))

    def _pretokens(self, text: str):
        """Lists of pre-tokens of a piece without added tokens."""
        if self.late(text) and (cut := text.translate(_newer())) != text:
            found = (text[m.start() : m.end()] for m in self.pattern.finditer(cut))
        elif len(text) <= PIECE:
            yield self.pattern.findall(text)
            return
        else:
            found = (m.group() for m in self.pattern.finditer(text))
        while some := list(islice(found, PIECE // 8)):
            yield some

    def counts(self, texts: list[str]) -> list[int]:
        out, short, owner = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            pieces = [text]
            if self.added and self.added.search(text):
                pieces = self.added.split(text)
                out[i] = len(pieces) - 1
            for piece in pieces:
                for some in self._pretokens(piece):
                    if len(texts) > 1:
                        short.append(some)
                        owner.append(i)
                    else:
                        self._learn(set(some))
                        out[i] += sum(map(self.cache.__getitem__, some))
        self._learn(set().union(*short))
        for i, some in zip(owner, short, strict=True):
            out[i] += sum(map(self.cache.__getitem__, some))
        return out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def token_counts(df: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row; `path` is the tokenizer's file on every executor."""

    def run(batches):
        own = tokenizer(path)
        for batch in batches:
            offsets, _ = kernels.buffers(batch.column(1))
            tokens = [n for _, texts in kernels.text_lists(batch.column(1)) for n in own.counts(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(pick(df, **{id_col: "long", text_col: "string"}), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
