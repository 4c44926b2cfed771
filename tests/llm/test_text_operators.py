"""Quality, near-duplicates, tokens, packing and codec against brute force on hard cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spectrail.llm import bpecodec, neardup, packing, quality, tokencount, wordbpe
from tests.llm.helpers import DOC_SCHEMA, hard_documents, words, write_tables

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("hard"), labels=[(i, int(i % 5 > 0), 0) for i in range(60)])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write_tables(spark, tmp_path_factory.mktemp("empty"), documents=[])


# quality


def slow_counts(text):
    parts = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if w]
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if any(c not in " \t\n\v\f\r" for c in line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(parts[i : i + 8]) for i in range(len(parts) - 7))
    covered = {j for i in range(len(parts) - 7) if grams[tuple(parts[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(parts), sum(map(len, parts)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_quality_counts(spark, hard):
    rows = {r["doc_id"]: r for r in quality.op1_quality(spark, hard).collect()}
    assert len(rows) == len(hard_documents())
    for i, text, *_ in hard_documents():
        n, chars, symbols, dup, repeat = slow_counts(text)
        r = rows[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60))
def test_repeated_words(parts):
    assert quality.repeated_words(parts) == slow_counts(b" ".join(parts).decode())[4]


def test_quality_empty_and_unlabelled(spark, empty, tmp_path):
    assert quality.op1_quality(spark, empty).count() == 0
    clean = write_tables(spark, tmp_path, documents=[(i, words(random.Random(i), 50), "en", "s", 1) for i in range(5)])
    assert all(r["kept"] for r in quality.op1_quality(spark, clean).collect())


def test_quality_finds_junk(spark, tmp_path):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(600):
        text = words(rng, rng.randint(30, 200))
        bad = i % 8 == 0
        if bad:
            text = " ".join(w + "***" for w in text.split()) if i % 16 else text.upper().replace(" ", "!! ")
        docs.append((i, text, "en", "s", len(text)))
        if i % 2 == 0:
            labels.append((i, int(not bad), 0))
    path = write_tables(spark, tmp_path, docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in quality.op1_quality(spark, path).collect()}
    # Rows without labels are held out.
    assert all(kept[i] for i in range(600) if i % 8)
    assert not any(kept[i] for i in range(0, 600, 8))


STRANGE = {
    "symbols": lambda t: t.replace(" ", " ## ", 12),
    "exclamations": lambda t: t.replace(" ", "!! ", 20),
    "capitals": lambda t: " ".join(w.upper() if i % 3 else w for i, w in enumerate(t.split())),
    "accented capitals": lambda t: " ".join("ÉÀ" if i % 3 else w for i, w in enumerate(t.split())),
    "stutters": lambda t: " ".join(f"{w} {w}" if i % 3 == 0 else w for i, w in enumerate(t.split())),
    "repeats": lambda t: " ".join([*t.split(), *t.split()[: len(t.split()) // 8]]),
    "lines": lambda t: "\n".join([*(f"{w} {i}" for i, w in enumerate(t.split())), *["same"] * (len(t.split()) // 4)]),
}


def test_quality_finds_what_no_row_of_the_fit_has(spark, tmp_path):
    """Each measure's anomaly, where the labelled rows know of one kind of junk only."""
    rng = random.Random(18)
    docs, labels = [], []
    for i in range(800):
        text = words(rng, rng.randint(60, 200))
        bad = i % 10 == 0
        docs.append((i, text.replace(" ", " %% ") if bad else text, "en", "s", None))
        labels.append((i, int(not bad), 0))
    clean = [(1000 + i, words(rng, rng.randint(60, 200)), "en", "s", None) for i in range(100)]
    strange = [(2000 + i, f(words(rng, 150)), "en", "s", None) for i, f in enumerate(STRANGE.values())]
    path = write_tables(spark, tmp_path, docs + clean + strange, labels)
    rows = {r["doc_id"]: r for r in quality.op1_quality(spark, path).collect()}
    assert not any(r["base_failed"] for r in rows.values())
    assert all(rows[i]["kept"] for i in rows if 1000 <= i < 2000) and all(rows[i]["kept"] for i in range(800) if i % 10)
    assert [name for i, name in enumerate(STRANGE) if rows[2000 + i]["kept"]] == []
    # The more of it, the more anomalous.
    few, many = ("a b c d e f g h i j " * 1 + words(random.Random(1), 200) for _ in range(2))
    forest = quality.fit(quality.rule_counts(spark.read.parquet(f"{path}/documents.parquet"), "doc_id", "text"), spark.read.parquet(f"{path}/labels.parquet"), "doc_id")
    none, few, many = (np.array([quality.count_text(t)]) for t in (few, few.replace(" ", "! ", 1), many.replace(" ", "! ")))
    assert forest.score(none)[0] <= forest.score(few)[0] < forest.threshold <= forest.score(many)[0]


def slow_score(forest, counts):
    """Path by path, for one document."""
    shares = [min(1.0, counts[t] / max(counts[b], 1)) for t, b in zip(quality._TOPS, quality._BASES, strict=True)]
    x = [0.005 * (min(v, t) / t if t else 0.0) + 0.995 * (max(v - t, 0.0) / max(1 - t, 1e-9)) ** 0.25 for v, t in zip(shares, forest.tolerance, strict=True)]
    depths = []
    for node in forest.roots:
        while forest.left[node] != node:
            node = forest.left[node] if x[forest.feature[node]] < forest.split[node] else forest.right[node]
        depths.append(forest.depth[node])
    return 2 ** (-sum(depths) / len(depths) / forest.usual)


def test_quality_verdicts_by_brute_force(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    counts = quality.rule_counts(docs, "doc_id", "text")
    forest = quality.fit(counts, spark.read.parquet(f"{hard}/labels.parquet"), "doc_id")
    got = {r["doc_id"]: r for r in quality.judge(counts, forest, "doc_id").collect()}
    for i, text, *_ in hard_documents():
        c = quality.count_text(text)
        failed = c[0] < 20 or 100 * c[4] > 30 * c[0]
        assert got[i]["anomaly_score"] == pytest.approx(slow_score(forest, c), rel=1e-9)
        assert got[i]["kept"] == (not failed and got[i]["anomaly_score"] < forest.threshold)


def test_quality_keeps_other_columns(spark):
    forest = quality.grow(np.zeros((1, len(quality.COUNTS)), dtype=np.int64), np.zeros(len(quality.MEASURES)))
    df = spark.createDataFrame([(1, words(random.Random(1), 40), 5), (2, None, 6)], "doc_id long, text string, n_words int")
    out = quality.keep_rows(df, forest)
    assert out.schema == df.schema and [r["doc_id"] for r in out.collect()] == [1]


# near-duplicates


def slow_components(rows, size, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_components(spark, size, percent):
    rows = hard_documents()
    got = neardup.link(spark.createDataFrame(rows, DOC_SCHEMA).repartition(5), words=size, percent=percent).collect()
    want = slow_components(rows, size, percent)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_a_crowd_of_near_copies_that_are_no_duplicates(spark):
    """Copies with random edits: some pairs link, others share buckets only, and all cells are needed."""
    rng = random.Random(3)
    base = words(rng, 90).split()
    rows = [(i, " ".join(w if rng.random() > 0.03 else words(rng, 1) for w in base), None, None, None) for i in range(400)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.link(spark.createDataFrame(rows, DOC_SCHEMA), words=3, percent=85).collect()}
    assert got == slow_components(rows, 3, 85)


def test_components_of_odd_tables(spark, empty):
    assert neardup.op2_minhash(spark, empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f g", 1), (3, "a b c d e f g", 2), (3, "a b c d e f g", 2), (4, None, 3)], "doc_id long, text string, component_id int")
    rows = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.link(df).collect()), key=str)
    assert rows == sorted([(None, None, True), (3, 3, True), (3, 3, True), (4, 4, True)], key=str)


def test_texts_that_share_an_id(spark):
    """All that any text of an id is linked with is one component, also where several classes have the same least id."""
    rng = random.Random(9)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    near = " ".join(["changed", *c.split()[1:]])
    rows = [(3, a), (5, a), (5, b), (9, b), (20, c), (20, d), (21, near), (22, d), (23, " ".join([*d.split(), "more"])), (30, words(rng, 60)), (5, ""), (30, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for percent in (80, 85):
        got = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in neardup.link(df, words=3, percent=percent).collect()}
        want = {3: 3, 5: 3, 9: 3, 20: 20, 21: 20, 22: 20, 23: 20, 30: 30}
        assert got == {**{(i, True): (c, i == c) for i, c in want.items()}, (5, False): (5, True), (30, False): (30, True)}


def test_bands_follow_the_threshold():
    assert neardup.banding(85) == (24, 5) and neardup.banding(80) == (30, 4)
    for percent in range(50, 100, 5):
        bands, rows = neardup.banding(percent)
        assert bands * rows == neardup.HASHES and (1 - (percent / 100) ** rows) ** bands <= neardup.UNSEEN


def test_pruning_table_keeps_true_pairs():
    """At the threshold itself the chance to be pruned stays near the chosen one for each batch."""
    import math

    table = neardup.fewest_matches(85)
    assert len(table) == neardup.HASHES // neardup.BATCH + 1
    for k in range(1, len(table)):
        n = k * neardup.BATCH
        lost = sum(math.comb(n, m) * 0.85**m * 0.15 ** (n - m) for m in range(table[k]))
        assert lost < 1e-5


def test_connected_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert neardup.components(edges.where("a < 0")).count() == 0


# tokens


ODD = ["", "  ", None, "<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "it's they'll I'M ''s", "\x00\x1c\x1d a\x1cb", "é ́x ΑΣ ΑΣ. İI İ. Straße ªº ǅ", "a b ​", "'s. 's' ll.", "\t\n\v\f\r x\x85y", " lead", "trail ", "aaaa" * 800, "ꟋꟜ", chr(0x32808) + "x"]


@pytest.fixture(scope="module")
def token_rows(spark, hard):
    rows = hard_documents() + [(1000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    return rows, spark.createDataFrame(rows, DOC_SCHEMA).repartition(3)


def test_token_counts(spark, token_rows, library):
    rows, df = token_rows
    got = {r["doc_id"]: r for r in tokencount.count_tokens(df, "doc_id", "text", PATH).collect()}
    for i, t, *_ in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 2048), (i, t)


def test_codec(spark, token_rows, library):
    rows, df = token_rows
    got = {r["doc_id"]: r for r in bpecodec.encode_decode(df, "doc_id", "text", PATH).collect()}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        r = got[i]
        assert r["ids"] == ids and r["decoded"] == decoded == bpecodec.decode(ids, PATH), (i, t)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest() and r["n_tokens"] == len(ids)


def counted(cache, texts, slice_bytes=None):
    return cache.counts(pa.array(texts, pa.string()), slice_bytes)[1].tolist()


def test_every_code_point_alone_and_inside_words(library):
    for at in range(0, 0x110000, 1 << 14):
        points = [chr(c) for c in range(at, at + (1 << 14)) if not 0xD800 <= c < 0xE000]
        text = "".join(f"a{c}b {c} " if at < 0x40000 else f"a{c}b " for c in points)
        want = library.encode(text, add_special_tokens=False).ids
        assert bpecodec.encode(text, PATH) == want, hex(at)
        assert counted(tokencount.chunk_counts(PATH), [text]) == [len(want)], hex(at)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abcxyz'.,é你 1", max_size=30), max_size=5))
def test_merge_rounds_and_heap_agree_with_the_library(texts):
    library = Tokenizer.from_file(PATH)
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert bpecodec.encode(t, PATH) == ids
        assert counted(tokencount.chunk_counts(PATH), [t]) == [len(ids)]


def test_plain_letters_are_lowered_alike():
    letters = [chr(c) for c in range(0x180) if __import__("re").match(wordbpe.PLAIN, chr(c))]
    assert len(letters) > 150 and pc.utf8_lower(pa.array(letters)).to_pylist() == [c.lower() for c in letters]
    assert all(__import__("unicodedata").normalize("NFC", c.lower()) == c.lower() for c in letters)


def test_caches_that_overflow(monkeypatch, library):
    monkeypatch.setattr(wordbpe, "CACHE_WORDS", 3)
    bpe = wordbpe.load(PATH)
    cache = wordbpe.ChunkCache(bpe, lambda ws: [tokencount.count_word(bpe, w) for w in ws], lambda _: 1, sum)
    rng = random.Random(1)
    texts = [words(rng, 30) for _ in range(40)]
    assert counted(cache, texts, 200) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_queries_on_empty_tables(spark, empty):
    assert tokencount.op3_token_count(spark, empty).count() == bpecodec.op10_bpe_codec(spark, empty).count() == packing.op5_packing(spark, empty).count() == 0


# packing


def check_packing(rows, pieces, library, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    total = 0
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]
        total += len(ids)
        own = sorted(by_doc[i], key=lambda p: p["piece"])
        assert [p["start"] for p in own] == list(range(0, len(ids), capacity)) and [p["piece"] for p in own] == list(range(len(own)))
        for p in own:
            part = ids[p["start"] : p["start"] + capacity]
            assert p["length"] == len(part) and p["ids_crc32"] == zlib.crc32(np.array(part, dtype="<u4").tobytes())
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= capacity
    return len(by_sequence), -(-total // capacity)


@pytest.mark.parametrize("capacity", [packing.CAPACITY, 256])
def test_packing(spark, token_rows, library, capacity, tmp_path):
    rows, df = token_rows
    packed = packing.pack(df, "doc_id", "text", PATH, capacity, with_ids=True)
    written = packing.write_sequences(packed, str(tmp_path / "sequences"))
    placed = written.collect()
    used, least = check_packing(rows, placed, library, capacity)
    assert used <= least + max(1, least // 50)
    texts = {i: t for i, t, *_ in rows}
    for p in placed:
        ids = [*library.encode(texts[p["doc_id"]] or "", add_special_tokens=False).ids, packing.END_ID]
        assert np.frombuffer(p["ids"], dtype="<u4").tolist() == ids[p["start"] : p["start"] + p["length"]]
    # A sequence is in one file, in order.
    order = written.select("sequence_id", "offset", F.col("_metadata.file_path").alias("file")).collect()
    for file in {r["file"] for r in order}:
        mine = [(r["sequence_id"], r["offset"]) for r in order if r["file"] == file]
        assert mine == sorted(mine) and not {s for s, _ in mine} & {r["sequence_id"] for r in order if r["file"] != file}
    plain = packing.pack(df, "doc_id", "text", PATH, capacity, keep_words=False).collect()
    assert check_packing(rows, plain, library, capacity)[0] == used and "ids" not in plain[0].asDict()


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_solution_holds_every_piece_once(histogram):
    plan = packing.solve(histogram, 64, 30)
    used = Counter()
    for chosen, times in plan:
        assert times > 0 and sum(k * v for k, v in chosen.items()) <= 64
        for k, v in chosen.items():
            used[k] += v * times
    assert used == Counter(histogram)
    # No worse than first-fit decreasing.
    bins = []
    for k in sorted(histogram, reverse=True):
        for _ in range(histogram[k]):
            for b in range(len(bins)):
                if bins[b] >= k:
                    bins[b] -= k
                    break
            else:
                bins.append(64 - k)
    assert sum(times for _, times in plan) <= len(bins)


def test_program_covers_many_lengths_and_packs_most_of_them():
    rng = random.Random(3)
    histogram = Counter(min(1023, 1 + int(rng.expovariate(1 / 200))) for _ in range(8000))
    lengths = np.array(sorted(histogram))
    demand = np.array([histogram[k] for k in lengths.tolist()])
    solution = packing.cover(lengths, demand, 1024)
    covered = Counter()
    for chosen, use in solution:
        assert use > 0 and sum(k * n for k, n in chosen.items()) <= 1024
        for k, n in chosen.items():
            covered[k] += use * n
    assert [covered[k] for k in lengths.tolist()] == pytest.approx(demand.tolist(), abs=1e-4)
    plan, report = packing.solve_with_report(histogram, 1024)
    assert report.sequences == sum(times for _, times in plan) <= report.bound + 1
    assert report.bound <= report.value + 1 and report.value <= 1.01 * report.bound
    assert report.from_program > report.sequences / 2


def test_knapsack_against_brute_force():
    import itertools

    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths, values, limits = np.array([3, 5, 7]), rng.random(3), rng.integers(0, 4, 3)
        best = max(sum(v * c for v, c in zip(values, cs, strict=True)) for cs in itertools.product(*[range(n + 1) for n in limits]) if np.dot(lengths, cs) <= 20)
        chosen = packing._best_configuration(lengths, values, limits, 20)
        assert (chosen <= limits).all() and lengths @ chosen <= 20 and values @ chosen == pytest.approx(best)
