"""Encoding with a public byte-level BPE vocabulary, written out: ranks in a priority queue over a linked symbol list.

A text is cut into words by the vocabulary's pattern; each word's bytes become a doubly linked list of symbols. The
queue holds ``(rank, position)`` of every neighbouring pair that the vocabulary merges. The lowest rank is taken, the
right symbol is unlinked, and the two new pairs are queued; entries whose symbols have changed since are stale and are
skipped. A word of n bytes costs n log n, so an unbroken run of a million characters is no problem. Decoding joins the
vocabulary's byte strings.

The vocabulary is a parameter (a path). The driver reads it and broadcasts it: its size is that of the vocabulary
(about 1 MB for 50,000 entries) and is checked against ``MAX_VOCABULARY_BYTES``; it does not grow with the data.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: the published splitting pattern of the byte-level vocabularies (fixed value)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_VOCABULARY_BYTES = 16 << 20
CACHE_WORDS = 200_000
CACHED_WORD_CHARS = 64


class Vocabulary:
    """Ranks of byte strings; the rank is the id."""

    def __init__(self, data: bytes, pattern: str = PATTERN) -> None:
        pairs = (line.split() for line in data.splitlines() if line.strip())
        self.ranks: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in pairs}
        self.strings = {rank: piece for piece, rank in self.ranks.items()}
        self.words = regex.compile(pattern).findall
        self.cache: dict[str, tuple[int, ...]] = {}

    @classmethod
    def read(cls, path: str) -> tuple[bytes, Vocabulary]:
        with open(path, "rb") as file:
            data = file.read()
        if len(data) > MAX_VOCABULARY_BYTES:
            raise ValueError(f"{path} holds {len(data)} bytes, more than is broadcast")
        return data, cls(data)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        ranks = self.ranks
        if word in ranks:
            return [ranks[word]]
        n = len(word)
        symbols: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            rank = ranks.get(word[i : i + 2])
            if rank is not None:
                queue.append((rank, i, word[i : i + 2]))
        heapq.heapify(queue)
        while queue:
            rank, i, pair = heapq.heappop(queue)
            a = symbols[i]
            j = right[i]
            if a is None or j >= n or a + symbols[j] != pair:
                continue  # stale: one of the two was merged meanwhile
            symbols[i], symbols[j] = pair, None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if (r := ranks.get(pair + symbols[k])) is not None:
                    heapq.heappush(queue, (r, i, pair + symbols[k]))
            h = left[i]
            if h >= 0 and (r := ranks.get(symbols[h] + pair)) is not None:
                heapq.heappush(queue, (r, h, symbols[h] + pair))
        return [ranks[s] for s in symbols if s is not None]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text without special tokens; none for null and empty texts.

        Lone surrogates, which are no Unicode text, are encoded as U+FFFD, as the public libraries do.
        """
        if not text:
            return []
        out: list[int] = []
        cache = self.cache
        for word in self.words(text):
            ids = cache.get(word)
            if ids is None:
                ids = self.merge(word.encode("utf-8", "replace"))
                if len(word) <= CACHED_WORD_CHARS:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    cache[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_LOADED: dict[int, Vocabulary] = {}


def _vocabulary(shared) -> Vocabulary:
    """The worker's vocabulary, built once per broadcast."""
    data = shared.value
    key = hash(data)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(data)
    return _LOADED[key]


def encode_table(
    texts: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = (), with_ids: bool = True, out: str = "ids"
) -> DataFrame:
    """``key``, the columns of ``keep``, ``out`` (list of ids) and ``n_tokens`` of every row, whole texts, row by row.

    Null and empty texts give an empty list and 0. Repeated rows stay. No shuffle: rows stay where the scan has them.
    """
    spark = texts.sparkSession
    data, _ = Vocabulary.read(vocabulary)
    shared = spark.sparkContext.broadcast(data)
    columns = [key, *keep]
    rows = texts.select(*(F.col(f"`{c}`") for c in columns), F.col(f"`{text}`").alias("_text"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*columns).schema.fields]
    if with_ids:
        kinds.append(f"`{out}` array<int>")
    schema = ", ".join([*kinds, "n_tokens int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            step = 2000
            for at in range(0, batch.num_rows, step):
                ids = [vocab.encode(t) for t in texts.slice(at, step).to_pylist()]
                arrays = [c.slice(at, step) for c in batch.columns[:-1]]
                names = list(columns)
                if with_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append(out)
                arrays.append(pa.array([len(x) for x in ids], pa.int32()))
                yield pa.RecordBatch.from_arrays(arrays, [*names, "n_tokens"])

    return rows.mapInArrow(run, schema)


def decode_table(encoded: DataFrame, ids: str = "ids", vocabulary: str = DEFAULT_VOCABULARY, keep: tuple[str, ...] = (), out: str = "text") -> DataFrame:
    """The columns of ``keep`` and the text of each list of ids: the vocabulary's strings laid end to end."""
    data, _ = Vocabulary.read(vocabulary)
    shared = encoded.sparkSession.sparkContext.broadcast(data)
    rows = encoded.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{ids}`").alias("_ids"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = _vocabulary(shared)
        for batch in batches:
            texts = [vocab.decode(x.as_py() or []) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, out])

    return rows.mapInArrow(run, schema)
