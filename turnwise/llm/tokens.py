"""Token ids of every text by a public byte-level BPE vocabulary.

Method: pair occurrence index. The distinct pieces of a partition are laid out as one sequence of byte symbols; every
pair that has a rank is mapped to all its positions; active ranks are taken in ascending order, each merged at all its
positions from left to right, and the lists of the pairs to the left and right of a merge are updated. Merging piece by
piece would give the same ids: pieces never share a pair.

A text is cut at single blanks into chunks whose pieces do not depend on their neighbours; texts where blanks meet other
white space are cut by the vocabulary's pattern as a whole. Ids of chunks seen before are looked up.

Null and empty texts have an empty list of ids, so every document keeps its row.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwise.session import map_batches

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# fixed value: the vocabulary's own cut of a text into pieces
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE_CHUNKS = 500_000
CACHE_CHARS = 8_000_000
MAX_VOCABULARY = 50_000_000
_UNEVEN = re.compile(r" \s| $")


def load_ranks(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


class PairIndex:
    """Encodes pieces by an index from pairs to their positions."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.text = {rank: token for token, rank in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """The id of the token the pair merges to, which is also its rank; -1 if there is none."""
        r = self.pairs.get((a, b))
        if r is None:
            r = self.pairs[a, b] = self.ranks.get(self.text[a] + self.text[b], -1)
        return r

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        symbols: list[int] = []
        starts, right, left = [], [], []
        for p in pieces:
            at, n = len(symbols), len(p)
            starts.append(at)
            symbols += [self.single[b] for b in p]
            right += [*range(at + 1, at + n), -1] if n else []
            left += [-1, *range(at, at + n - 1)] if n else []
        places: dict[int, list[int]] = defaultdict(list)
        for i, j in enumerate(right):
            if j >= 0 and (r := self.rank(symbols[i], symbols[j])) >= 0:
                places[r].append(i)
        active = list(places)
        heapq.heapify(active)
        rank = self.rank
        while active:
            r = heapq.heappop(active)
            for i in sorted(places.pop(r, ())):
                j = right[i]
                if symbols[i] < 0 or j < 0 or rank(symbols[i], symbols[j]) != r:
                    continue  # a symbol of the pair has been merged since
                symbols[i], symbols[j] = r, -1
                right[i] = k = right[j]
                if k >= 0:
                    left[k] = i
                    if (q := rank(r, symbols[k])) >= 0:
                        if q not in places:
                            heapq.heappush(active, q)
                        places[q].append(i)
                if (h := left[i]) >= 0 and (q := rank(symbols[h], r)) >= 0:
                    if q not in places:
                        heapq.heappush(active, q)
                    places[q].append(h)
        ends = [*starts[1:], len(symbols)]
        return [[s for s in symbols[a:b] if s >= 0] for a, b in zip(starts, ends)]


class Encoder:
    """Ids of texts; keeps the ids of chunks it has met as one flat array."""

    def __init__(self, vocabulary: bytes) -> None:
        self.index = PairIndex(load_ranks(vocabulary))
        self.pattern = regex.compile(PATTERN)
        self.reset()

    def reset(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat = np.zeros(0, dtype=np.int32)
        self.start = np.zeros(1, dtype=np.int64)

    def learn(self, chunks: Iterable[str]) -> None:
        new = sorted(chunks)
        cut = [self.pattern.findall(c) for c in new]
        pieces = sorted(set().union(*map(set, cut))) if cut else []
        ids = dict(zip(pieces, self.index.encode([p.encode("utf-8", "surrogatepass") for p in pieces])))
        known: list[int] = []
        ends: list[int] = []
        for parts in cut:
            for p in parts:
                known += ids[p]
            ends.append(len(known))
        self.codes.update((c, len(self.start) - 1 + i) for i, c in enumerate(new))
        self.start = np.concatenate((self.start, np.array(ends, dtype=np.int64) + self.start[-1]))
        self.flat = np.concatenate((self.flat, np.array(known, dtype=np.int32)))

    def chunks(self, text: str) -> list[str]:
        if _UNEVEN.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + c for c in rest]] if first else [" " + c for c in rest]

    def encode(self, texts: list[str | None], ids: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text and, unless only counts are asked for, all ids one after the other.

        Texts are taken ``CACHE_CHARS`` characters (or one text) at a time, so what is kept does not grow with the batch.
        """
        parts, at, held = [], 0, 0
        for i, t in enumerate(texts):
            size = len(t) if t else 0
            if held and held + size > CACHE_CHARS:
                parts.append(self._encode(texts[at:i], ids))
                at, held = i, 0
            held += size
        parts.append(self._encode(texts[at:], ids))
        return tuple(np.concatenate(x) for x in zip(*parts)) if len(parts) > 1 else parts[0]

    def _encode(self, texts: list[str | None], ids: bool) -> tuple[np.ndarray, np.ndarray]:
        if len(self.codes) > CACHE_CHUNKS:
            self.reset()
        every: list[str] = []
        n = np.zeros(len(texts) + 1, dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                own = self.chunks(t)
                every += own
                n[i + 1] = len(own)
        new = set(every) - self.codes.keys()
        if new:
            self.learn(new)
        code = np.fromiter(map(self.codes.__getitem__, every), dtype=np.int64, count=len(every))
        begin, size = self.start[code], self.start[code + 1] - self.start[code]
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = ends[np.cumsum(n)]
        if not ids:
            return np.diff(bounds), np.zeros(0, dtype=np.int32)
        take = np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])
        return np.diff(bounds), self.flat[take]


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str, vocabulary: bytes) -> Encoder:
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(vocabulary)
    return _ENCODERS[name]


def shipped(df: DataFrame, tokenizer: str):
    """Name and content of the vocabulary file, which only the driver has to hold; the workers get it by broadcast (about 1 MB)."""
    content = Path(tokenizer).read_bytes()
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"vocabulary over {MAX_VOCABULARY} bytes")
    return hashlib.blake2b(content, digest_size=16).hexdigest(), df.sparkSession.sparkContext.broadcast(content)


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(``key``, ``ids``): the token ids of each text, without special tokens; an empty list for null and empty texts.

    Strings of special tokens inside a text are ordinary text. Repeated rows keep their rows; extra columns are ignored.
    """

    name, vocabulary = shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, vocabulary.value)
        for b in batches:
            n, flat = e.encode(b.column(1).to_pylist())
            offsets = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return map_batches(df.select(key, F.col(text)), run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, keep: list[str], text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of each text (0 for null and empty texts)."""

    name, vocabulary = shipped(df, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(name, vocabulary.value)
        for b in batches:
            n, _ = e.encode(b.column(len(keep)).to_pylist(), ids=False)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(n)], names=[*keep, "n_tokens"])

    kinds = dict(df.dtypes)
    return map_batches(df.select(*keep, F.col(text)), run, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", n_tokens bigint")
