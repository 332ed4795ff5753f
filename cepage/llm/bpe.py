"""Byte-level BPE encoding of a corpus with a public rank file.

A text is cut into pre-tokens; the ids of a pre-token are kept in a bounded cache of the task, since few pre-tokens
make up most of a corpus. A pre-token that is not there is merged with a rank queue: a bucket for each merge rank
holds the positions (of a linked list of parts) whose pair has that rank, a three-level bitmap tells which buckets
hold anything, and find-first-set gives the next rank. Entries whose pair has changed meanwhile are stale and
skipped. Each byte enters a bucket a bounded number of times, so a pre-token of a million bytes takes about a
million steps, where repeated scans for the best pair would take a million times as many.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cepage.functions.frames import require_columns
from cepage.session import spread

# Fixed value: the pattern that cuts texts into pre-tokens for this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"


class RankQueue:
    """Positions in buckets by rank, with a bitmap of three levels over the ranks below 2**18."""

    def __init__(self) -> None:
        self.top = 0
        self.middle = [0] * 64
        self.leaf: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(position)
            return
        self.buckets[rank] = [position]
        word = rank >> 6
        self.leaf[word] = self.leaf.get(word, 0) | 1 << (rank & 63)
        self.middle[word >> 6] |= 1 << (word & 63)
        self.top |= 1 << (word >> 6)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its positions from left to right; None when all buckets are empty."""
        if not self.top:
            return None
        high = (self.top & -self.top).bit_length() - 1
        m = self.middle[high]
        word = high << 6 | (m & -m).bit_length() - 1
        bits = self.leaf[word]
        rank = word << 6 | (bits & -bits).bit_length() - 1
        self.leaf[word] = bits & (bits - 1)
        if not self.leaf[word]:
            self.middle[high] = m & (m - 1)
            if not self.middle[high]:
                self.top &= self.top - 1
        return rank, sorted(self.buckets.pop(rank))


class Encoder:
    """Encoder for a file of lines "base64 token, rank"; ranks are ids."""

    def __init__(self, rank_file: bytes, cache: int = 500_000) -> None:
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        if max(self.ranks.values()) >= 1 << 18:
            raise ValueError("ranks must be below 2**18")
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.byte_id = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(PATTERN).findall
        self.pairs: dict[tuple[int, int], int] = {}
        self.cache: dict[str, array] = {}
        self.most = cache

    def pair_rank(self, left: int, right: int) -> int:
        """Rank of the merge of two ids, or -1."""
        key = (left, right)
        rank = self.pairs.get(key)
        if rank is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            rank = self.pairs[key] = self.ranks.get(self.token[left] + self.token[right], -1)
        return rank

    def merge(self, data: bytes) -> array:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return array("i", [whole])
        n = len(data)
        ids = [self.byte_id[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\x01") * n
        queue, pair_rank = RankQueue(), self.pair_rank
        for k in range(n - 1):
            if (rank := pair_rank(ids[k], ids[k + 1])) >= 0:
                queue.push(rank, k)
        while (item := queue.pop()) is not None:
            rank, positions = item
            for k in positions:
                j = after[k]
                if not alive[k] or j >= n or pair_rank(ids[k], ids[j]) != rank:
                    continue
                ids[k], alive[j] = rank, 0
                after[k] = j = after[j]
                if j < n:
                    before[j] = k
                    if (r := pair_rank(rank, ids[j])) >= 0:
                        queue.push(r, k)
                if (i := before[k]) >= 0 and (r := pair_rank(ids[i], rank)) >= 0:
                    queue.push(r, i)
        return array("i", (ids[k] for k in range(n) if alive[k]))

    def extend(self, out: array, text: str) -> None:
        """Append the ids of ``text`` to ``out``."""
        cache = self.cache
        for piece in self.split(text):
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 256:
                    if len(cache) >= self.most:
                        cache.clear()
                    cache[piece] = ids
            out.extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out = array("i")
        if text:
            self.extend(out, text)
        return list(out)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", rank_path: str = DEFAULT_RANKS) -> DataFrame:
    """(key, ids) of every document, special tokens' strings being ordinary text.

    Null and empty texts have the empty list of ids; blank texts have the ids of their blanks. Null and repeated
    keys are kept row by row, other columns are ignored, and an empty table gives no rows. The rank file is read
    by the driver and sent to the tasks once (its size is that of the vocabulary).
    """
    require_columns(documents, (key, text))
    with open(rank_path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value)
        for batch in batches:
            keys, texts = batch.columns
            for at in range(0, batch.num_rows, 1000):
                flat, ends = array("i"), [0]
                for t in texts.slice(at, 1000).to_pylist():
                    if t:
                        encoder.extend(flat, t)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1000), ids], [key, "ids"])

    rows = spread(documents.select(f"`{key}`", F.col(f"`{text}`").cast("string")))
    return rows.mapInArrow(run, f"`{key}` {dict(documents.dtypes)[key]}, ids array<int>")
