"""Token counts by heap-and-linked-list byte-pair merging.

The symbols of a pre-token form a linked list and its mergeable pairs a heap by
(rank, place). The lowest pair is popped and merged again and again; pairs whose
symbols have changed since are skipped. The count is the initial symbols minus the
merges: no identifiers come out.

Defined results: a null or empty text has no bytes and no tokens; special strings
in a text count as the one token that the library makes of them; rows that repeat
are counted each; a very long text is counted chunk by chunk; other columns play no
part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spectrail.llm import common, wordbpe

LIMIT = 2048
TOKENIZER = "word_bpe_49k.json"


def count_merges(symbols: list[int], merges: dict[tuple[int, int], tuple[int, int]]) -> int:
    """How many merges BPE makes in one pre-token."""
    n = len(symbols)
    if n < 2:
        return 0
    if n == 2:
        return int((symbols[0], symbols[1]) in merges)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = merges.get((symbols[i], symbols[i + 1]))
        if found:
            heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
    heapq.heapify(heap)
    merged = 0
    while heap:
        _, i, a, b, new = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        merged += 1
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = merges.get((new, symbols[k]))
            if found:
                heapq.heappush(heap, (found[0], i, new, symbols[k], found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get((symbols[h], new))
            if found:
                heapq.heappush(heap, (found[0], h, symbols[h], new, found[1]))
    return merged


def count_word(bpe: wordbpe.WordBPE, word: str) -> int:
    raw = word.encode("utf-8")
    symbols = [bpe.inside_list[b] for b in raw]
    symbols[-1] = bpe.last_list[raw[-1]]
    return len(raw) - count_merges(symbols, bpe.merges)


@functools.cache
def chunk_counts(path: str) -> wordbpe.ChunkCache:
    bpe = wordbpe.load(path)
    return wordbpe.ChunkCache(bpe, lambda words: [count_word(bpe, w) for w in words], lambda _: 1, sum)


def count_tokens(docs: DataFrame, key: str, text: str, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """Each row's key, n_bytes, n_tokens and over_limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = chunk_counts(tokenizer_path)
        for batch in batches:
            size, count = cache.counts(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size), pa.array(count), pa.array(count > limit)],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(common.lean(run), f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path(TOKENIZER))
