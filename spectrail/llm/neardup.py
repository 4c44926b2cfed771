"""Near-duplicate documents by MinHash bands and sequential Bayesian verification.

Documents with equal shingle sets form a class, which one document stands for. The
classes' signatures are cut into bands; classes that agree in a band meet in a
bucket. Candidates are compared a batch of signature rows at a time: after each
batch a pair is pruned if, under a uniform prior, the posterior probability that
its similarity reaches the threshold is below `MISS`. Survivors are confirmed on
their full sets.

A bucket of near copies isn't expanded into pairs. In each of `STAR_ROUNDS` rounds
every bucket has one leader per band, drawn by a seeded hash; a class meets the
leaders of its buckets, and of those that survive the one that looks most similar
is confirmed. After these rounds most of a bucket is one component. What is left,
pairs in different components where not both are in the bucket's largest, is
compared in full, cell by cell of two bounded blocks, so that no pair that shares a
bucket goes unseen. A cell gives out the links that join its components, not pairs.

Bands are as wide as lets a pair at the threshold share none with a probability of
at most `UNSEEN`: 24 bands of 5 rows at 0.85 (8e-7), 30 of 4 at 0.80 (2e-7).

Shingles are compared by 64-bit hashes. Two documents of n and m shingles take one
for another with a probability of n * m / 2**64: 5e-12 for ten thousand shingles each.

Defined results: a document without words (null, empty or white space) has an empty
set and is linked with nothing, whatever other rows share its id; one with fewer
words than a shingle has its whole sequence as one shingle; rows that share an id
count as one document, linked with all that any of its texts is linked with; a row
without an id has no component and is kept; of a very long text the set is held
whole, its signature is made from some shingles at a time; columns other than key
and text play no part, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spectrail.llm import common

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
HASHES = 120
UNSEEN = 1e-6
BATCH = 20
MISS = 1e-7
STAR_ROUNDS = 2
BLOCK = 256
SEED = 1_871
#: Shingles hashed at a time, so that a long text needs no more memory than a short one.
SHINGLES_AT_ONCE = 4096


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; empty without words."""
    parts = text.encode("utf-8").lower().split() if text else []  # bytes.lower() changes A-Z only
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    if len(parts) < words:
        return np.array([xxhash.xxh64_intdigest(b"\n".join(parts), seed=1)], dtype=np.uint64)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    n = len(parts) - words + 1
    mixed = np.zeros(n, dtype=np.uint64)
    for k in range(words):
        mixed = (mixed ^ hashed[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, HASHES, dtype=np.uint64)


def signature(shingles: np.ndarray, multipliers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    a, b = multipliers
    least = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(shingles), SHINGLES_AT_ONCE):
        least = np.minimum(least, (shingles[at : at + SHINGLES_AT_ONCE, None] * a + b).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def banding(percent: int, unseen: float = UNSEEN) -> tuple[int, int]:
    """Bands, and rows in each: as wide as may be if a pair at the threshold is to share a band but for a chance of `unseen`."""
    fits = [r for r in range(1, HASHES + 1) if HASHES % r == 0 and (1 - (percent / 100) ** r) ** (HASHES // r) <= unseen]
    rows = max(fits, default=1)
    return HASHES // rows, rows


def fewest_matches(percent: int, miss: float = MISS) -> list[int]:
    """For 0, BATCH, 2*BATCH, ... rows compared: the fewest matches with which a pair stays a candidate.

    With m of n rows equal and a uniform prior the similarity is Beta(m+1, n-m+1), whose
    tail above t is the chance of at most m successes in n+1 trials of probability t.
    """
    t = percent / 100
    table = [0]
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        table.append(m)
    return table


def survives(left: np.ndarray, right: np.ndarray, table: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of signature rows that no batch prunes, and their matches in all rows."""
    at = np.arange(len(left))
    matches = np.zeros(len(left), dtype=np.int64)
    for k in range(1, len(table)):
        rows = slice((k - 1) * BATCH, k * BATCH)
        matches = matches + (left[at, rows] == right[at, rows]).sum(axis=1)
        stay = matches >= table[k]
        at, matches = at[stay], matches[stay]
    return at, matches


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u4").reshape(-1, HASHES)


def profile(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Each row's id, set size, 128-bit digest of the set in two halves, and signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        multipliers = _multipliers()
        for batch in batches:
            sizes, high, low, rows = [], [], [], []
            for x in batch.column(1):
                shingles = shingle_set(x.as_py(), words)
                digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), dtype="<i8")
                sizes.append(len(shingles))
                high.append(int(digest[0]))
                low.append(int(digest[1]))
                rows.append(signature(shingles, multipliers).tobytes() if len(shingles) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(rows, pa.binary())], names=["id", "n", "d1", "d2", "sig"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(common.lean(run), "id long, n long, d1 long, d2 long, sig binary")


def components(edges: DataFrame) -> DataFrame:
    """Each node of the edges (a, b) with the smallest node reachable, as (node, component).

    Labels fall to the least among neighbours, then to their label's label, until their sum stays.
    """
    both = common.settle(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "cc-edges")
    labels = common.settle(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "cc-labels")
    total = lambda x: x.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
    last = total(labels)
    while last is not None:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = common.settle(labels.join(near, "node").select("node", F.least("component", "near").alias("component")), "cc-lower")
        jumped = common.settle(lower.join(lower.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", F.col("next").alias("component")), "cc-labels")
        common.release(lower, labels)
        labels = jumped
        now = total(labels)
        if now == last:
            break
        last = now
    common.release(both)
    return labels


def _merge_components(component: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components of earlier rounds, joined further by new links between nodes."""
    if component is None:
        return components(links)
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a != b")
    further = components(between)
    moved = component.join(further.select(F.col("node").alias("component"), F.col("component").alias("next")), "component", "left").select("node", F.coalesce("next", "component").alias("component"))
    merged = common.settle(moved.union(further.join(component, "node", "left_anti")), "components")
    common.release(component, further)
    return merged


def _length_fits(percent: int):
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _compare(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the sequential test keeps, with their matching rows."""
    of = lambda side: sketches.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sig").alias(f"s{side}"))
    table = fewest_matches(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, matches = survives(_signatures(batch.column(2)), _signatures(batch.column(3)), table)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(matches)], names=["a", "b", "matches"])

    return pairs.join(of("a"), "a").join(of("b"), "b").where(_length_fits(percent)).select("a", "b", "sa", "sb").mapInArrow(common.lean(run), "a long, b long, matches long")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    of = lambda side: sets.select(F.col("id").alias(side), F.col("shingles").alias(f"x{side}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), dtype=np.uint64), np.frombuffer(y.as_py(), dtype=np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                place = np.minimum(np.searchsorted(large, small), len(large) - 1)
                common_size = int((large[place] == small).sum())
                good.append(100 * common_size >= percent * (len(x) + len(y) - common_size))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "xa", "xb").mapInArrow(common.lean(run), "a long, b long")


def _sets(docs: DataFrame, key: str, text: str, ids: DataFrame, words: int) -> DataFrame:
    """The full sets of the documents named in `ids`, one for each id and set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [shingle_set(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["id", "n", "shingles"])

    wanted = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(ids, "id", "left_semi")
    return wanted.mapInArrow(common.lean(run), "id long, n long, shingles binary").where("n > 0").dropDuplicates()


def _same_ids(named: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Components of the classes that share an id; None if each id has one text."""
    digest = F.struct("d1", "d2")
    many = common.settle(named.groupBy("id").agg((F.min(digest) != F.max(digest)).alias("many")).where("many").select("id"), "dup-same-ids")
    if many.isEmpty():
        common.release(many)
        return None
    kin = named.join(many, "id", "left_semi").select(F.col("id").alias("b"), "d1", "d2").join(classes.withColumnRenamed("id", "a"), ["d1", "d2"])
    found = components(kin.select("a", "b").distinct())
    common.release(many)
    return found


def _leaders(members: DataFrame, round_: int) -> DataFrame:
    order = F.xxhash64(F.lit(SEED + round_), F.col("bucket"), F.col("id"))
    return common.settle(members.groupBy("bucket").agg(F.min_by("id", order).alias("a")), "dup-leaders")


def _star_pairs(members: DataFrame, leaders: DataFrame, component: DataFrame | None) -> DataFrame:
    """Each class with the leaders of its buckets, where they are in different components."""
    pairs = members.join(leaders, "bucket").select("a", F.col("id").alias("b")).where("a != b").distinct()
    if component is None:
        return pairs
    of = lambda side: component.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    apart = F.coalesce("ca", "a") != F.coalesce("cb", "b")
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").where(apart).select("a", "b")


def _rest_cells(members: DataFrame, component: DataFrame, sketches: DataFrame, percent: int, band_rows: int) -> DataFrame:
    """What is left to confirm, by cells: a block of a bucket's probes against a block of its classes.

    In each bucket the classes outside its largest component are probes; they meet all its classes in other
    components. A pair is looked at in the first band that it shares only. Of each cell come a row for each probe
    that the sequential test leaves candidates, with these in an array, and a row for each class named.
    """
    tagged = members.join(component.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = tagged.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("parts"))
    split = split.where("parts > 1").select("bucket", F.col("top.component").alias("largest"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("probe_blocks"), F.ceil(F.col("all") / BLOCK).cast("int").alias("target_blocks"))
    rows = tagged.join(common.settle(split, "dup-split"), "bucket").withColumn("probe", F.col("component") != F.col("largest"))
    rows = rows.join(sketches.select("id", "n", "sig"), "id")
    block = lambda n: F.pmod(F.xxhash64(F.lit(SEED), "id"), n).cast("int")
    one = F.lit(0)
    target = F.transform(F.sequence(one, F.col("probe_blocks") - 1), lambda i: F.struct(i.alias("p"), block(F.col("target_blocks")).alias("t"), F.lit(False).alias("asks")))
    asked = F.transform(F.sequence(one, F.col("target_blocks") - 1), lambda i: F.struct(block(F.col("probe_blocks")).alias("p"), i.alias("t"), F.lit(True).alias("asks")))
    cells = rows.select("bucket", "band", "id", "component", "probe", "n", "sig", F.explode(F.when(F.col("probe"), F.concat(target, asked)).otherwise(target)).alias("c"))
    table = fewest_matches(percent)
    names = ["bucket", "p", "t", "id", "component", "candidates"]

    def flush(key: tuple, group: list[dict]) -> Iterator[pa.RecordBatch]:
        probes, targets = [g for g in group if g["asks"]], [g for g in group if not g["asks"]]
        if not probes or not targets:
            return
        take = lambda rows, name: np.array([r[name] for r in rows], dtype=np.int64)
        left = np.frombuffer(b"".join(r["sig"] for r in probes), dtype="<u4").reshape(-1, HASHES)
        right = np.frombuffer(b"".join(r["sig"] for r in targets), dtype="<u4").reshape(-1, HASHES)
        ids, sizes, parts, probe = (take(targets, c) for c in ("id", "n", "component", "probe"))
        earlier = band_rows * group[0]["band"]
        named: dict[int, int] = {}
        out = []
        for i, p in enumerate(probes):
            fits = (parts != p["component"]) & (100 * np.minimum(sizes, p["n"]) >= percent * np.maximum(sizes, p["n"])) & ((probe == 0) | (ids > p["id"]))
            at = np.flatnonzero(fits)
            if earlier and len(at):
                same = (right[at, :earlier] == left[i, :earlier]).reshape(len(at), -1, band_rows).all(axis=2).any(axis=1)
                at = at[~same]
            if len(at):
                stay, _ = survives(np.broadcast_to(left[i], (len(at), HASHES)), right[at], table)
                at = at[stay]
            if len(at):
                named[p["id"]] = p["component"]
                named.update(zip(ids[at].tolist(), parts[at].tolist(), strict=True))
                out.append((p["id"], p["component"], ids[at].tolist()))
        rows = [(*key, i, c, None) for i, c in named.items()] + [(*key, *o) for o in out]
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, group in _by_cell(batches):
            yield from flush(key, group)

    return (
        cells.select("bucket", "band", F.col("c.p").alias("p"), F.col("c.t").alias("t"), F.col("c.asks").alias("asks"), "id", "component", "probe", "n", "sig")
        .repartition("bucket", "p", "t")
        .sortWithinPartitions("bucket", "p", "t")
        .mapInArrow(common.lean(run), "bucket long, p int, t int, id long, component long, candidates array<long>")
    )


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of sorted batches by cell; a cell has two blocks at most."""
    now, group = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            for row in batch.slice(at, BLOCK).to_pylist():
                key = (row["bucket"], row["p"], row["t"])
                if key != now:
                    if group:
                        yield now, group
                    now, group = key, []
                group.append(row)
    if group:
        yield now, group


def _confirm_cells(cells: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of settled cells, confirmed on full sets; no more than join the cell's components are looked for."""

    def links(group: list[dict]) -> Iterator[tuple[int, int]]:
        full: dict[int, list[np.ndarray]] = {}  # of an id with several texts all sets
        root: dict[int, int] = {}
        for r in group:
            if r["candidates"] is None:
                full.setdefault(r["id"], []).append(np.frombuffer(r["shingles"], dtype=np.uint64))
                root[r["id"]] = r["component"]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while x in above:
                x = above[x]
            return x

        for r in group:
            for own in full[r["id"]] if r["candidates"] is not None else ():
                left = r["candidates"]
                while left:
                    now, left = left[:32], left[32:]
                    pairs = [(t, x) for t in now if top(root[t]) != top(root[r["id"]]) for x in full[t]]
                    if not pairs:
                        continue
                    sizes = np.array([len(x) for _, x in pairs])
                    flat = np.concatenate([x for _, x in pairs])
                    hits = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
                    both = np.add.reduceat(hits.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
                    for k in np.flatnonzero(100 * both >= percent * (sizes + len(own) - both)):
                        a, b = top(root[pairs[k][0]]), top(root[r["id"]])
                        if a != b:
                            above[max(a, b)] = min(a, b)
                            yield r["id"], pairs[k][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in _by_cell(batches):
            found = list(links(group))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    named = cells.where("candidates IS NULL").join(sets, "id").select("bucket", "p", "t", "id", "component", "shingles", "candidates")
    asking = cells.where("candidates IS NOT NULL").select("bucket", "p", "t", "id", "component", F.lit(None).cast("binary").alias("shingles"), "candidates")
    return named.unionAll(asking).repartition("bucket", "p", "t").sortWithinPartitions("bucket", "p", "t").mapInArrow(common.lean(run), "a long, b long")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Each row's id, set size, component and whether it is the document that its component keeps."""
    many_bands, band_rows = banding(percent)
    profiles = common.settle(profile(docs, key, text, words), "dup-profiles")
    named = profiles.where("n > 0 AND id IS NOT NULL")
    classes = common.settle(named.groupBy("d1", "d2").agg(F.min("id").alias("id")), "dup-classes")
    sketches = common.settle(profiles.where("n > 0").join(classes, ["id", "d1", "d2"], "left_semi").select("id", "n", "sig").dropDuplicates(), "dup-sketches")
    bands = F.array(*[F.struct(F.lit(z).alias("band"), F.xxhash64(F.lit(z), F.substring("sig", 1 + 4 * band_rows * z, 4 * band_rows)).alias("bucket")) for z in range(many_bands)])
    banded = sketches.select("id", F.explode(bands).alias("x")).select("id", "x.band", "x.bucket")
    shared = common.settle(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket"), "dup-buckets")
    members = common.settle(banded.join(shared, "bucket", "left_semi"), "dup-members")
    met = common.settle(members.select("id").distinct(), "dup-met")
    sets = common.settle(_sets(docs, key, text, met, words).select("id", "shingles"), "dup-sets")
    near = common.settle(sketches.join(met, "id", "left_semi"), "dup-near")

    component = _same_ids(named, classes)
    for round_ in range(STAR_ROUNDS):
        leaders = _leaders(members, round_)
        likely = _compare(_star_pairs(members, leaders, component), near, percent)
        best = common.settle(likely.groupBy("b").agg(F.max(F.struct("matches", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"), "dup-star")
        component = _merge_components(component, _confirm(best, sets, percent))
        common.release(leaders, best)
    rest = common.settle(_rest_cells(members, component, near, percent, band_rows), "dup-rest")
    component = _merge_components(component, _confirm_cells(rest, sets, percent))

    known = common.settle(
        classes.join(component.withColumnRenamed("node", "id"), "id", "left").select("d1", "d2", F.coalesce("component", "id").alias("component_id")),
        "dup-known",
    )
    common.release(classes, sketches, shared, members, met, sets, near, rest, component)
    placed = profiles.select("id", "n", "d1", "d2").join(known, ["d1", "d2"], "left")
    component_id = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component_id = F.when(F.col("id").isNotNull(), component_id)
    return placed.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component_id.alias("component_id"), F.coalesce(F.col("id") == component_id, F.lit(True)).alias("kept"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(common.documents(spark, sf_dir), words=3, percent=85)


#: All pairs with a shingle in common, exactly, then reachability.
OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS shingle FROM w)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
), e AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = d.doc_id
"""
