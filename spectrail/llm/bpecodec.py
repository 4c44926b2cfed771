"""BPE encoding and decoding by batched merge rounds.

The symbols of many pre-tokens lie in one flat array, each with its word's number.
A round looks every adjacent pair up among the sorted pair keys by binary search,
takes each word's lowest rank and merges that pair wherever it stands in the word,
from the left. Words without a pair left are put aside; the rest go on.

Merging all places of the lowest pair at once equals merging them one by one, as a
pair made by a merge ranks after it: its symbol is that merge's own. A file for
which that doesn't hold is refused.

Defined results: a null or empty text has no ids and decodes to nothing; special
strings in a text become the ids that the library gives them; a very long text is
cut into chunks like any other, and only its ids and their decoding are held whole;
rows that repeat are encoded each; other columns play no part; an empty table gives
an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spectrail.llm import common, wordbpe

TOKENIZER = "word_bpe_49k.json"
#: Symbols of one flat array at most, but for a single longer word.
FLAT_SYMBOLS = 1 << 18


class MergeTable:
    """Pair keys in order, with their ranks and the symbols that they make."""

    def __init__(self, bpe: wordbpe.WordBPE):
        self.bpe = bpe
        self.base = max(bpe.tokens) + 1
        pairs = np.array([a * self.base + b for a, b in bpe.merges], dtype=np.int64)
        ranks = np.array([r for r, _ in bpe.merges.values()], dtype=np.int64)
        made = np.array([m for _, m in bpe.merges.values()], dtype=np.int64)
        birth = np.full(self.base, -1, dtype=np.int64)
        np.maximum.at(birth, made, ranks)
        if np.any(np.maximum(birth[pairs // self.base], birth[pairs % self.base]) >= ranks):
            raise ValueError("a pair ranks before the merge that makes its symbol")
        order = np.argsort(pairs)
        self.keys, self.ranks, self.made = pairs[order], ranks[order], made[order]
        self.none = len(ranks)

    def look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (one past the last for pairs that don't merge) and places in the table."""
        place = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
        return np.where(self.keys[place] == pairs, self.ranks[place], self.none), place

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        symbols = self.bpe.inside[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.bpe.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        # Every round looks up all pairs of the words that are still open.
        while len(symbols):
            within = word[:-1] == word[1:]
            rank = np.full(len(symbols), self.none, dtype=np.int64)
            rank[:-1][within], place = self.look_up(symbols[:-1][within] * self.base + symbols[1:][within])
            at = np.zeros(len(symbols), dtype=np.int64)
            at[:-1][within] = place
            starts = np.flatnonzero(np.r_[True, ~within])
            lowest = np.minimum.reduceat(rank, starts)
            own = np.repeat(lowest, np.diff(np.r_[starts, len(symbols)]))
            over = own == self.none
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                live = ~over
                symbols, word, rank, at, own = symbols[live], word[live], rank[live], at[live], own[live]
                if not len(symbols):
                    break
            hit = rank == own
            # In a run of overlapping hits (the pair of one symbol with itself) every second one counts.
            follows = np.zeros(len(hit), dtype=bool)
            follows[1:] = hit[1:] & hit[:-1]
            if follows.any():
                index = np.arange(len(hit))
                run_start = np.maximum.accumulate(np.where(hit & ~follows, index, 0))
                hit &= (index - run_start) % 2 == 0
            symbols[hit] = self.made[at[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[np.flatnonzero(hit) + 1] = False
            symbols, word = symbols[keep], word[keep]
        flat, owner = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(owner, kind="stable")
        flat, owner = flat[order], owner[order]
        return np.split(flat, np.searchsorted(owner, np.arange(1, len(words))))

    def encode_words(self, words: list[str]) -> Iterator[np.ndarray]:
        """The ids of each word, merged a bounded number of symbols at a time."""
        raw = [w.encode("utf-8") for w in words]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= FLAT_SYMBOLS):
                size += len(raw[to])
                to += 1
            yield from self.merge(raw[at:to])
            at = to


@functools.cache
def merge_table(path: str) -> MergeTable:
    return MergeTable(wordbpe.load(path))


def encode(text: str | None, path: str) -> list[int]:
    """The ids of one text."""
    return next(iter(_id_cache(path).joined_ids(pa.array([text], pa.string())))).tolist()


def decode(ids: Iterable[int], path: str) -> str:
    """Token strings with a blank between; this tokenizer has no decoder that would join them further."""
    return _decode_bytes(ids, path).decode("utf-8")


def _decode_bytes(ids: Iterable[int], path: str) -> bytes:
    return b" ".join(map(_token_bytes(path).__getitem__, ids))


@functools.cache
def _token_bytes(path: str) -> list[bytes]:
    tokens = wordbpe.load(path).tokens
    return [tokens.get(i, "").encode("utf-8") for i in range(max(tokens) + 1)]


@functools.cache
def _id_cache(path: str) -> wordbpe.ChunkCache:
    """Each chunk's packed ids."""
    table = merge_table(path)

    def values(words: list[str]) -> Iterator[bytes]:
        return (ids.astype("<u4").tobytes() for ids in table.encode_words(words))

    return wordbpe.ChunkCache(table.bpe, values, lambda i: np.array([i], dtype="<u4").tobytes(), b"".join)


def encode_decode(docs: DataFrame, key: str, text: str, tokenizer_path: str, with_output: bool = True) -> DataFrame:
    """Each row's key, n_tokens and digests of its ids and of what they decode to; with_output adds both themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _id_cache(tokenizer_path)
        for batch in batches:
            counts, packed_sha, text_sha, packed, texts = [], [], [], [], []
            for ids in cache.joined_ids(batch.column(1)):
                decoded = _decode_bytes(ids.tolist(), tokenizer_path)
                counts.append(len(ids))
                packed_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if with_output:
                    packed.append(ids.astype(np.int64))
                    texts.append(decoded.decode("utf-8"))
            arrays = [batch.column(0), pa.array(counts, pa.int64()), pa.array(packed_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [key, "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_output:
                arrays += [pa.array(packed, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    kind = docs.schema[key].dataType.simpleString()
    more = ", ids array<long>, decoded string" if with_output else ""
    return docs.select(key, text).mapInArrow(common.lean(run), f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path(TOKENIZER), with_output=False)
