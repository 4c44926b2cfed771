"""The word-level BPE of a tokenizers .json file, without the library: chunks, pre-tokens and tables.

A text is cut at ASCII white space into chunks. Every step of the tokenizer works
inside a chunk, as no pattern of it spans white space, so that a text's tokens are
its chunks' tokens in order. Each distinct chunk of some megabytes of texts is taken
apart once: most are Latin letters with at most one mark behind them, which Arrow's
functions tell by the batch; the others go one by one through `WordBPE.parts`.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from collections import ChainMap
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from spectrail.llm import common

#: Pre-tokens kept per Python worker, twice: when as many are new, those not seen since the last time are forgotten.
#: Longer ones are encoded each time.
CACHE_WORDS = 130_000
CACHE_WORD_BYTES = 96
CHUNKS_AT_ONCE = 1 << 18
#: Texts taken apart together.
SLICE_BYTES = 8 << 20

#: Letters that are composed and have one lower-case form, and what may stand behind them: a pre-token of its own.
MARKS = ".,;:!?"
PLAIN = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+[{MARKS}]?$"


@functools.cache
def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


def _read(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


class WordBPE:
    """Vocabulary and merges of one file. Fails on a file whose steps differ from those built here."""

    def __init__(self, path: str):
        self.path = path
        #: Code points met so far that Python's table has.
        self.assigned: set[str] = set()
        spec = _read(path)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if steps != ["NFC", "Replace", "Lowercase"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"] or spec["post_processor"] or spec["decoder"] or model["unk_token"] or model["ignore_merges"]:
            raise ValueError(f"{path}: not a word-level byte BPE as built here")
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        self.special: dict[str, int] = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens: dict[int, str] = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pattern = split["pattern"]["Regex"]
        self.words = regex.compile(pattern)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        symbols = byte_symbols()
        inside = [self.vocab[s] for s in symbols]
        last = [self.vocab[s + self.suffix] for s in symbols]
        self.inside, self.last = np.array(inside, dtype=np.int64), np.array(last, dtype=np.int64)
        self.inside_list, self.last_list = inside, last

    @functools.cached_property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        """(left id, right id) -> (rank, merged id)"""
        out: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(_read(self.path)["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            out.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        return out

    def pretokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk without special tokens."""
        if chunk.isascii():
            return self.words.findall(chunk.lower())
        self.assigned.update(c for c in set(chunk).difference(self.assigned) if unicodedata.category(c) != "Cn")
        if not self.assigned.issuperset(chunk):
            return self._newer_pretokens(chunk)
        return self.words.findall("".join(map(str.lower, unicodedata.normalize("NFC", chunk))))

    def _newer_pretokens(self, chunk: str) -> list[str]:
        """The pre-tokens of a chunk with code points that Python's table lacks.

        Tables of other versions may hold them as letters: only the library knows what it lower-cases and where it splits.
        """
        library = _library(self.path)
        split = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))
        return [bytes(map(_byte_of().__getitem__, word)).decode("utf-8") for word, _ in split]

    def parts(self, text: str) -> list[str | int]:
        """A chunk's pre-tokens, and the ids of special tokens between them."""
        if "<|" not in text:
            return self.pretokens(text)
        out: list[str | int] = []
        for k, piece in enumerate(self.specials.split(text)):
            out += [self.special[piece]] if k % 2 else self.pretokens(piece)
        return out


@functools.cache
def _byte_of() -> dict[str, int]:
    return {symbol: byte for byte, symbol in enumerate(byte_symbols())}


@functools.cache
def _library(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


@functools.cache
def load(path: str) -> WordBPE:
    return WordBPE(path)


@dataclass(frozen=True)
class Chunks:
    """Some texts taken apart: the values of pre-tokens and odd chunks, and how chunks and texts are made of them."""

    #: Each text's UTF-8 length, and the number of its last chunk, plus one.
    sizes: np.ndarray
    ends: np.ndarray
    #: The distinct chunk that each chunk is.
    numbers: np.ndarray
    #: Places of a distinct chunk's parts among the values; -1 for no second part.
    first: np.ndarray
    second: np.ndarray
    values: list


def gather(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The runs of `flat` that start at `starts`, end to end."""
    till = np.cumsum(counts, dtype=np.int64)
    source = np.repeat((starts - (till - counts)).astype(np.int32), counts)
    source += np.arange(len(source), dtype=np.int32)
    return flat[source]


class ChunkCache:
    """The values of texts' chunks, made from the values of their pre-tokens, which are kept while they fit.

    `encode` gives the values of new pre-tokens, `special` that of a special token's id, `combine` that of a chunk
    from its parts'.
    """

    def __init__(self, bpe: WordBPE, encode: Callable[[list[str]], Iterable], special: Callable[[int], object], combine: Callable[[Sequence], object], keep: bool = True):
        self.bpe, self.encode, self.special, self.combine = bpe, encode, special, combine
        #: Where memory is short nothing is kept from slice to slice: kept words lie between freed ones and hold their pages.
        self.keep = keep
        self.words: dict[str, object] = {}
        self.old_words: dict[str, object] = {}

    def look_up(self, texts: pa.Array, slice_bytes: int | None = None) -> Iterator[Chunks]:
        """The texts' chunks, some texts at a time."""
        texts = pc.fill_null(texts, "")
        wanted = slice_bytes or (SLICE_BYTES if self.keep else SLICE_BYTES // 4)
        till = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(till, (till[at - 1] if at else 0) + wanted, side="right")))
            yield self._take_apart(texts.slice(at, to - at), np.diff(till[at:to], prepend=till[at - 1] if at else 0))
            common.give_back()
            at = to

    def _take_apart(self, texts: pa.Array, sizes: np.ndarray) -> Chunks:
        split = pc.ascii_split_whitespace(texts)
        offsets = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        del split
        distinct, numbers = coded.dictionary, coded.indices.to_numpy()
        # Empty chunks stand at the ends of texts with white space there; they have no pre-tokens.
        plain = pc.match_substring_regex(distinct, PLAIN)
        lower = pc.utf8_lower(distinct.filter(plain))
        stems = pc.utf8_rtrim(lower, MARKS)
        marked = pc.binary_length(stems).to_numpy() < pc.binary_length(lower).to_numpy()
        marks = np.array([MARKS.index(x[-1]) for x in lower.filter(pa.array(marked)).to_pylist()], dtype=np.int32)
        coded = stems.dictionary_encode()
        words, stem = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        del lower, stems, coded
        is_plain = plain.to_numpy(zero_copy_only=False)
        odd = [self.bpe.parts(c) for c in distinct.filter(pc.invert(plain)).to_pylist()]
        found = self._values(words, odd)

        value = found.__getitem__
        values = [*map(value, words), *map(value, MARKS), *(self.combine([value(x) if x.__class__ is str else self.special(x) for x in parts]) for parts in odd)]
        first = np.empty(len(distinct), dtype=np.int32)
        second = np.full(len(distinct), -1, dtype=np.int32)
        first[is_plain] = stem
        first[~is_plain] = np.arange(len(odd), dtype=np.int32) + len(words) + len(MARKS)
        second[np.flatnonzero(is_plain)[marked]] = marks + len(words)
        return Chunks(sizes, offsets[1:] - offsets[0], numbers, first, second, values)

    def joined_ids(self, texts: pa.Array, slice_bytes: int | None = None) -> Iterator[np.ndarray]:
        """Each text's ids where values are packed ids."""
        for c in self.look_up(texts, slice_bytes):
            flat = np.frombuffer(b"".join(c.values), dtype="<u4")
            counts = np.fromiter(map(len, c.values), dtype=np.int64, count=len(c.values)) // 4
            starts = np.cumsum(counts) - counts
            parts = np.column_stack([c.first, c.second]).ravel()
            parts = parts[parts >= 0]
            table = gather(flat, starts[parts], counts[parts])
            counts = counts[c.first] + np.where(c.second >= 0, counts[c.second], 0)
            starts = np.cumsum(counts) - counts
            bounds = np.r_[0, np.cumsum(counts[c.numbers])][np.r_[0, c.ends]]
            # A very long text alone goes some chunks at a time.
            step = max(1, len(c.numbers) if len(c.ends) > 1 else CHUNKS_AT_ONCE)
            pieces = [gather(table, starts[c.numbers[k : k + step]], counts[c.numbers[k : k + step]]) for k in range(0, len(c.numbers), step)]
            ids = pieces[0] if len(pieces) == 1 else np.concatenate([np.zeros(0, dtype="<u4"), *pieces])
            yield from (ids[a:b] for a, b in itertools.pairwise(bounds.tolist()))

    def counts(self, texts: pa.Array, slice_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Each text's UTF-8 length and number of tokens where values are counts."""
        sizes, totals = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for c in self.look_up(texts, slice_bytes):
            each = np.array(c.values, dtype=np.int64)
            each = each[c.first] + np.where(c.second >= 0, each[c.second], 0)
            sizes.append(c.sizes)
            totals.append(np.diff(np.r_[0, np.cumsum(each[c.numbers])][np.r_[0, c.ends]]))
        return np.concatenate(sizes), np.concatenate(totals)

    def _values(self, words: list[str], odd: list[list[str | int]]) -> Mapping[str, object]:
        """A mapping that holds the values of the words, of the marks and of the words in odd chunks."""
        if not self.keep:
            self.words = {}
        elif len(self.words) > CACHE_WORDS:
            self.old_words, self.words = self.words, {}
        values, old = self.words, self.old_words
        fresh = {x for parts in odd for x in parts if x.__class__ is str}.union(words, MARKS).difference(values)
        back = fresh.intersection(old)
        values.update(zip(back, map(old.__getitem__, back), strict=True))
        fresh = list(fresh.difference(back))
        long: dict[str, object] = {}
        for word, value in zip(fresh, self.encode(fresh) if fresh else (), strict=True):
            (values if len(word) <= CACHE_WORD_BYTES else long)[word] = value
        return ChainMap(long, values) if long else values
