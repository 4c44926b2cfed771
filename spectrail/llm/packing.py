"""Packing documents into as few sequences as possible: a configuration linear program, rounded.

A configuration is a multiset of piece lengths that fits one sequence. The linear
program (how often to use each configuration, so that every length is covered) is
solved over the length histogram by multiplicative weights: a length's weight falls
as configurations cover it, and pricing, the most valuable configuration under the
weights, is a knapsack dynamic program over some of the open lengths, each in its
turn. Rounds go on until every length is covered. The solution is rounded down, room
in its configurations is used up by longer pieces of the remainder, a few sequences
are given up again, and the remainder is filled one configuration at a time, longest
piece first, the last by a subset-sum program. If longest-first alone needs fewer
sequences, its plan is taken; `solve_with_report` says what came from the program,
and the lower bound: the program's dual at prices in proportion to length.

Only the histogram, at most `capacity` numbers, reaches the driver. Pieces get their
places by their rank among those of their length: a configuration used m times is
m sequences, so that rank alone gives sequence and offset.

Defined results: a null or empty text is one document of the closing id only; only
documents longer than a sequence are cut; rows that repeat are packed each; other
columns play no part; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrail.llm import common, wordbpe

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Rounds of multiplicative weights, and how sharply weights fall.
ROUNDS = 120
STEP = 0.5
#: The part of a price that falls.
FALLING = 0.1
#: Ways to round, until one meets the bound: whether only full sequences stay (1), and the part of those that is given up for
#: the remainder, those with the shortest pieces first.
ROUNDINGS = ((1, 0.02), (1, 0.05), (1, 0.0), (0, 0.0))
WORDS_AT_ONCE = 2000
#: Lengths that a pricing round looks at, of all that are open.
POOL = 48
#: Lengths that the fill's subset-sum program looks at.
PRICED = 96
SEED = 4_229


def _chunk_ids(path: str, keep: bool = True) -> wordbpe.ChunkCache:
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()

    bpe = wordbpe.WordBPE(path)
    ends = np.array([bpe.tokens.get(i, "").endswith(bpe.suffix) for i in range(max(bpe.tokens) + 1)])

    def encode(words: list[str]) -> Iterator[bytes]:
        """Words go to the library many in one text; each ends with the one token that has the end-of-word suffix."""
        for at in range(0, len(words), WORDS_AT_ONCE):
            part = words[at : at + WORDS_AT_ONCE]
            ids = np.array(library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
            if len(cuts) == len(part):
                raw = ids.tobytes()
                yield from map(raw.__getitem__, map(slice, [0, *cuts[:-1]], cuts))
            else:  # the library cuts one of them further
                yield from (np.array(e.ids, dtype="<u4").tobytes() for e in library.encode_batch_fast(part, add_special_tokens=False))

    return wordbpe.ChunkCache(bpe, encode, lambda i: np.array([i], dtype="<u4").tobytes(), b"".join, keep)


@functools.cache
def _kept_chunk_ids(path: str) -> wordbpe.ChunkCache:
    """What a worker keeps from task to task."""
    return _chunk_ids(path)


def cut_pieces(docs: DataFrame, key: str, text: str, tokenizer_path: str, capacity: int = CAPACITY, keep_words: bool = True) -> DataFrame:
    """Each document's pieces and their ids (packed, little-endian unsigned 32 bits), with their task's number and their rank in the task among pieces of their length.

    Task and rank are fixed once the table is written; `place_pieces` needs it settled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _kept_chunk_ids(tokenizer_path) if keep_words else _chunk_ids(tokenizer_path, False)
        task = TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            owner, piece, start, length, rank, packed = [], [], [], [], [], []
            for row, ids in enumerate(cache.joined_ids(batch.column(1))):
                total = len(ids) + 1
                for k, at in enumerate(range(0, total, capacity)):
                    part = ids[at : at + capacity].tobytes()
                    n = min(capacity, total - at)
                    owner.append(row)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    rank.append(seen[n])
                    seen[n] += 1
                    packed.append(part if len(part) == 4 * n else part + end)
            arrays = [batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length)), pa.array([task] * len(owner), pa.int32()), pa.array(rank, pa.int64()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=[key, "piece", "start", "length", "task", "task_rank", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(common.lean(run), f"`{key}` {kind}, piece int, start long, length long, task int, task_rank long, ids binary")


def _best_configuration(lengths: np.ndarray, values: np.ndarray, limits: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of greatest value that fits: a bounded knapsack by dynamic programming over the capacity."""
    sizes, gains, item, count = [], [], [], []
    for i, (length, limit) in enumerate(zip(lengths.tolist(), limits.tolist(), strict=True)):
        left, k = min(limit, capacity // length), 1
        while left > 0:  # binary parts of the limit
            k = min(k, left)
            sizes.append(length * k)
            gains.append(values[i] * k)
            item.append(i)
            count.append(k)
            left -= k
            k *= 2
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), dtype=bool)
    buffer = np.empty(capacity + 1)
    for j, (size, gain) in enumerate(zip(sizes, gains, strict=True)):
        if size > capacity:
            continue
        offer = np.add(best[: capacity + 1 - size], gain, out=buffer[: capacity + 1 - size])
        np.greater(offer, best[size:], out=took[j, size:])
        np.maximum(offer, best[size:], out=best[size:])
    chosen = np.zeros(len(lengths), dtype=np.int64)
    room = int(np.argmax(best))
    for j in range(len(sizes) - 1, -1, -1):
        if took[j, room]:
            chosen[item[j]] += count[j]
            room -= sizes[j]
    return chosen


def _fill(lengths: np.ndarray, left: np.ndarray, capacity: int, exact: bool) -> np.ndarray:
    """One configuration of what is left, from long to short; `exact` looks for a full filling in place of its shortest piece."""
    chosen = np.zeros(len(lengths), dtype=np.int64)
    room = capacity
    live = np.flatnonzero(left)[::-1]
    shortest = int(lengths[live[-1]])
    at = 0
    while room >= shortest and at < len(live):
        # The next length that fits; lengths ascend, so that it is found by bisection.
        at = max(at, len(live) - int(np.searchsorted(lengths[live[::-1]], room, side="right")))
        if at == len(live):
            break
        i = live[at]
        chosen[i] = min(int(left[i]), room // int(lengths[i]))
        room -= int(chosen[i] * lengths[i])
        at += 1
    if room and exact and chosen.sum() > 1:
        small = int(np.flatnonzero(chosen)[0])
        chosen[small] -= 1
        room += int(lengths[small])
        rest = left - chosen
        within = np.flatnonzero((rest > 0) & (lengths <= room))
        if len(within) > PRICED:  # the longest, and others all the way down
            within = np.unique(np.r_[within[-PRICED // 2 :], within[np.linspace(0, len(within) - 1, PRICED // 2).astype(np.int64)]])
        within = within[::-1]
        chosen[within] += _best_configuration(lengths[within], lengths[within].astype(float), rest[within], room)
    return chosen


def _as_dict(lengths: np.ndarray, chosen: np.ndarray) -> dict[int, int]:
    """A configuration without its zeros: thousands of them are held at once."""
    at = np.flatnonzero(chosen)
    return dict(zip(lengths[at].tolist(), chosen[at].tolist(), strict=True))


def _fill_all(lengths: np.ndarray, left: np.ndarray, capacity: int, exact: bool) -> list[tuple[dict[int, int], int]]:
    plan = []
    while left.any():
        chosen = _fill(lengths, left, capacity, exact)
        inside = chosen > 0
        times = int(np.min(left[inside] // chosen[inside]))
        plan.append((_as_dict(lengths, chosen), times))
        left = left - times * chosen
    return plan


def cover(lengths: np.ndarray, demand: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], float]]:
    """A fractional solution by multiplicative weights: configurations with their use, which cover each length's demand exactly.

    A round uses one configuration for up to `step` of the demand of its scarcest length, at least once where that much
    is open. Rounds go on until nothing is open, however many lengths there are. Pricing looks at `POOL` lengths at a time,
    and each has its turn: the least covered come first, in seeded order among equals.
    """
    rng = np.random.default_rng(SEED)
    step = min(0.5, 4 / rounds * max(1.0, len(lengths) / POOL))
    open_ = demand.astype(float)
    use: dict[tuple[tuple[int, int], ...], float] = {}
    while True:
        live = np.flatnonzero(open_ > 1e-9)
        if not len(live):
            break
        # The least covered lengths, and as many of the others: alone, lengths of high demand would use each other up.
        order = live[np.lexsort((rng.random(len(live)), 1 - open_[live] / demand[live]))]
        pool = np.r_[order[: POOL // 2], rng.permutation(order[POOL // 2 :])[: POOL // 2]]
        # A length weighs more the less of its demand is covered, and in proportion to its length at first. Only a part
        # of its price falls: prices in proportion to length are the dual of the volume bound, that make full ones best.
        weight = lengths[pool] * (1 - FALLING + FALLING * np.exp(-STEP / step * (1 - open_[pool] / demand[pool])))
        chosen = _best_configuration(lengths[pool], weight, np.ceil(open_[pool] - 1e-9).astype(np.int64), capacity)
        at, count = pool[chosen > 0], chosen[chosen > 0]
        share = min(float(np.min(open_[at] / count)), max(1.0, step * float(np.min(demand[at] / count))))
        open_[at] -= share * count
        key = tuple(sorted(zip(lengths[at].tolist(), count.tolist(), strict=True)))
        use[key] = use.get(key, 0.0) + share
    return [(dict(k), u) for k, u in use.items()]


@dataclass(frozen=True)
class Report:
    """How a plan came about: its sequences, those among them from the rounded program, the program's value and the lower bound."""

    sequences: int
    from_program: int
    value: float
    bound: int


def _round_down(solution: list[tuple[dict[int, int], float]], lengths: np.ndarray, left: np.ndarray, capacity: int, least: int, spare: float = 0.0) -> tuple[list[tuple[dict[int, int], int]], np.ndarray]:
    """Whole multiples of the configurations, with room in them used up by longer pieces of the remainder; and what they leave.

    Those that then hold less than `least` go back to the remainder, and `spare` of the others, those with the shortest
    pieces first: they let the fill end in full sequences.
    """
    rest = dict(zip(lengths.tolist(), left.tolist(), strict=True))
    todo = []
    for chosen, u in solution:
        times = min(int(u + 1e-6), *(rest[k] // n for k, n in chosen.items()))
        if times > 0:
            todo.append((chosen, times))
            for k, n in chosen.items():
                rest[k] -= times * n
    plan = []
    while todo:
        chosen, times = todo.pop()
        room = capacity - sum(k * n for k, n in chosen.items())
        # The longest step up that some piece can take; what the remainder has too few of leaves the others as they are.
        step, k = next(((d, k) for d in range(room, 0, -1) for k in chosen if rest.get(k + d)), (0, 0))
        if not step:
            if capacity - room >= least:
                plan.append((chosen, times))
            else:
                for i, n in chosen.items():
                    rest[i] += times * n
            continue
        some = min(times, rest[k + step])
        rest[k + step] -= some
        rest[k] += some
        longer = dict(chosen)
        longer[k + step] = longer.get(k + step, 0) + 1
        longer[k] -= 1
        todo.append(({i: n for i, n in longer.items() if n}, some))
        if times > some:
            todo.append((chosen, times - some))
    plan.sort(key=lambda x: -min(x[0]))
    given_up, most = 0, spare * sum(m for _, m in plan)
    while plan and given_up + plan[-1][1] <= most:
        chosen, times = plan.pop()
        given_up += times
        for i, n in chosen.items():
            rest[i] += times * n
    return plan, np.array([rest[k] for k in lengths.tolist()], dtype=np.int64)


def solve_with_report(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], int]], Report]:
    """The plan of `solve`, and how it came about. Sequences that one piece fills are counted as the program's."""
    lengths = np.array(sorted(histogram), dtype=np.int64)
    left = np.array([histogram[i] for i in lengths.tolist()], dtype=np.int64)
    bound = -(-int(lengths @ left) // capacity)
    count = lambda plan: sum(m for _, m in plan)
    whole: list[tuple[dict[int, int], int]] = []
    full = lengths == capacity
    if full.any():
        whole.append(({capacity: 1}, int(left[full][0])))
    lengths, left = lengths[~full & (left > 0)], left[~full & (left > 0)]
    if not len(lengths):
        return whole, Report(count(whole), count(whole), float(count(whole)), bound)
    solution = cover(lengths, left, capacity, rounds)
    value = sum(u for _, u in solution)
    tries = []
    for least, spare in ROUNDINGS:
        rounded, rest = _round_down(solution, lengths, left, capacity, least * capacity, spare)
        tries.append((whole + rounded + _fill_all(lengths, rest, capacity, True), count(whole + rounded)))
        if count(tries[-1][0]) == bound:
            break
    else:  # Without the program's help, longest first: in small or odd histograms that can need fewer.
        tries.append((whole + _fill_all(lengths, left, capacity, False), count(whole)))
    plan, from_program = min(tries, key=lambda x: count(x[0]))
    return plan, Report(count(plan), from_program, count(whole) + value, bound)


def solve(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[dict[int, int], int]]:
    """Configurations with how many sequences use each; together they hold every piece exactly once."""
    return solve_with_report(histogram, capacity, rounds)[0]


@dataclass(frozen=True)
class Places:
    """Where ranks of each length go. Its rows are no more than configurations times lengths in one, whatever the input."""

    key: np.ndarray  # length * 2**44 + first rank
    first_sequence: np.ndarray
    each: np.ndarray  # pieces of the length in one sequence
    offset: np.ndarray


def lay_out(plan: list[tuple[dict[int, int], int]]) -> Places:
    ranks: dict[int, int] = {}
    rows = []
    sequence = 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rows.append(((length << 44) + ranks.get(length, 0), sequence, chosen[length], offset))
            ranks[length] = ranks.get(length, 0) + chosen[length] * times
            offset += length * chosen[length]
        sequence += times
    rows.sort()
    return Places(*(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True))) if rows else Places(*[np.zeros(0, dtype=np.int64)] * 4)


def place_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of a settled table of pieces with `sequence_id` and `offset`."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = common.settle(counts, "pack-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = lay_out(solve(histogram, capacity))
    common.give_back()
    # A task has a row for each length that it holds, so that the windows see far fewer rows than there are pieces.
    before = counts.select("task", "length", (F.sum("n").over(W.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    ranked = pieces.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("task_rank")).drop("before", "task_rank", "task")
    shared = pieces.sparkSession.sparkContext.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = shared.value
        for batch in batches:
            length = batch.column(batch.schema.get_field_index("length")).to_numpy()
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy()
            row = np.searchsorted(at.key, (length << 44) + rank, side="right") - 1
            past = (length << 44) + rank - at.key[row]
            sequence = at.first_sequence[row] + past // at.each[row]
            offset = at.offset[row] + past % at.each[row] * length
            keep = [i for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], names=[*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(common.lean(run), f"{schema}, sequence_id long, offset long")


def pack(docs: DataFrame, key: str, text: str, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """Each piece with its sequence and offset and the CRC of its ids, taken from the ids as they were written; with_ids gives these too.

    Without keep_words Python workers take more CPU time and less memory: they keep nothing from slice to slice, nor from task to task.
    """
    common.bound_batches(docs.sparkSession)
    pieces = common.settle(cut_pieces(docs, key, text, tokenizer_path, capacity, keep_words), "pack-pieces")
    rows = pieces.select(key, "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "task_rank", *(["ids"] if with_ids else []))
    return place_pieces(rows, capacity).select(key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else []))


def write_sequences(packed: DataFrame, path: str) -> DataFrame:
    """Write what `pack` with ids gives as whole sequences, in order within files that hold ranges of them, and read it back."""
    packed.repartitionByRange("sequence_id").sortWithinPartitions("sequence_id", "offset").write.parquet(path)
    return packed.sparkSession.read.schema(packed.schema).parquet(path)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir), "doc_id", "text", public_tokenizers.path(TOKENIZER))
