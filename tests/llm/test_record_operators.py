"""Sharding, archive, neighbours, toxicity, chat and the pipeline on hard cases."""

import base64
import hashlib
import random
import re
import uuid
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from spectrail.llm import ann, chat, common, neardup, packing, quality, sharding, toxicity, warc
from tests.llm.helpers import DOC_SCHEMA, hard_documents, words, write_tables

# sharding


def check_shards(rows, out, shards):
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert 0 <= r["shard"] < shards and r["grown_shard"] in (r["shard"], shards) and r["law"] == "key"
    for slots in by.values():
        assert sorted(slots) == list(range(len(slots)))


def test_sharding(spark, tmp_path):
    rows = hard_documents() + [(7, "twice", None, None, None)] * 50 + [(None, "no id", None, None, None)]
    path = write_tables(spark, tmp_path, rows)
    out = sharding.op6_sharding(spark, path).collect()
    check_shards(rows, out, sharding.SHARDS)
    texts = {i: t for i, t, *_ in hard_documents()}
    for r in out:
        if r["doc_id"] is not None and r["doc_id"] != 7:
            raw = (texts[r["doc_id"]] or "").encode()
            assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
    # One more shard takes rows only into itself.
    grown = {r["record"]["doc_id"]: r["shard"] for r in sharding.scatter(spark.read.parquet(f"{path}/documents.parquet"), "doc_id", "text", sharding.SHARDS + 1).collect()}
    assert all(grown[r["doc_id"]] == r["grown_shard"] for r in out)
    again = {(r["doc_id"], r["slot"], r["shard"]) for r in sharding.op6_sharding(spark, path).collect()}
    assert again == {(r["doc_id"], r["slot"], r["shard"]) for r in out}


def test_sharding_with_many_buckets(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 50).alias("text"))
    scattered = common.settle(sharding.scatter(df, "doc_id", "text", 3), "t")
    out = sharding.shuffle_buckets(scattered, 3, bucket_bytes=2000).collect()
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append((r["slot"], r["record"]["doc_id"]))
    assert sum(map(len, by.values())) == 5000
    for rows in by.values():
        assert [s for s, _ in sorted(rows)] == list(range(len(rows)))
        order = [d for _, d in sorted(rows)]
        assert order != sorted(order)


def test_a_hot_key_is_spread_over_buckets(spark, tmp_path):
    """Repeated rows of one key fill many buckets of their shard, in tasks of their own."""
    df = spark.range(4000).select(F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.repeat(F.lit("x"), 84).alias("text")).repartition(3)
    scattered = common.settle(sharding.scatter(df, "doc_id", "text", 4), "t")
    hot = scattered.where("record.doc_id = 7").select("shard").distinct().collect()
    assert len(hot) == 1
    in_hot = scattered.where(F.col("shard") == hot[0]["shard"])
    buckets = -(-100 * in_hot.count() // 10_000)
    sizes = [r["count"] for r in in_hot.groupBy(F.pmod("scatter", F.lit(buckets))).count().collect()]
    assert buckets > 20 and len(sizes) == buckets and max(sizes) < 200
    out = sharding.shuffle_buckets(scattered, 4, bucket_bytes=10_000).select("shard", "slot", "record.doc_id", F.spark_partition_id().alias("task")).collect()
    slots = sorted(r["slot"] for r in out if r["shard"] == hot[0]["shard"])
    assert slots == list(range(len(slots))) and sum(r["doc_id"] == 7 for r in out) == 2001
    assert len({r["task"] for r in out if r["doc_id"] == 7}) > 10


def test_written_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}", "clash") for i in range(200)], "doc_id long, text string, shard string")
    back = sharding.write_shards(df, str(tmp_path / "out"), "doc_id", "text", 4)
    rows = back.select(F.col("record.text").alias("text"), F.col("record.shard").alias("clash")).collect()
    assert {r["text"] for r in rows} == {f"text {i}" for i in range(200)} and {r["clash"] for r in rows} == {"clash"}


def test_sharding_describes_the_written_records(spark, tmp_path, monkeypatch):
    written = []
    write = sharding.write_shards
    monkeypatch.setattr(sharding, "write_shards", lambda df, path, *a: written.append(path) or write(df, path, *a))
    out = sharding.op6_sharding(spark, write_tables(spark, tmp_path)).collect()
    back = {r["record"]["doc_id"]: r for r in spark.read.parquet(written[0]).collect()}
    want = {i: (i, t, lang, source, n) for i, t, lang, source, n in hard_documents()}
    assert {i: tuple(r["record"]) for i, r in back.items()} == want
    for r in out:
        stored = back[r["doc_id"]]
        raw = (stored["record"]["text"] or "").encode()
        assert (r["shard"], r["slot"], r["size"], r["text_crc32"]) == (stored["shard"], stored["slot"], len(raw) + 16, zlib.crc32(raw))


def test_sharding_of_nothing(spark, tmp_path):
    assert sharding.op6_sharding(spark, write_tables(spark, tmp_path, [])).count() == 0


# archive


PAGES = "page_id long, url string, html string, extra int"


def test_archive_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>", 1), (2, None, "<p>x</p>", 2), (3, "http://b/\r\nX-Page-ID: 9", None, 3), (4, "http://c/", "", 4), (5, "http://d/", "ü" * 30_000, 5), (5, "http://d/", "ü" * 30_000, 5), (None, "http://e/", "only", 6)]
    path = write_tables(spark, tmp_path, [], pages=(rows, PAGES))
    out = warc.op7_warc(spark, path).collect()
    assert len(out) == len(rows)
    want = {}
    for page_id, _, html, _ in rows:
        raw = (html or "").encode()
        want.setdefault(page_id, (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode()))
    for r in out:
        assert (r["payload_bytes"], r["payload_digest"]) == want[r["page_id"]]
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in out)
    assert kinds == sorted([("1", "revisit", 2), ("2", "response", None), ("3", "revisit", 4), ("4", "response", None), ("5", "response", None), ("5", "revisit", 5), ("None", "response", None)], key=lambda k: (k[0], k[1]))
    archive = warc.write_archive(spark.read.parquet(f"{path}/pages.parquet"))
    assert spark.read.parquet(archive.payloads).count() == 4
    records = warc.record_bytes(warc.read_archive(spark, archive)).where("page_id = 4").first()
    assert bytes(records["bytes"]).startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and bytes(records["bytes"]).endswith(b"\r\n\r\n\r\n\r\n")
    urls = {r["page_id"]: r["url"] for r in warc.read_archive(spark, archive).select("page_id", "url").collect()}
    assert urls[3] == "http://b/%0D%0AX-Page-ID: 9" and urls[2] is None
    headers = [dict(line.split(": ", 1) for line in r["header"].split("\r\n")[1:-1]) for r in warc.read_archive(spark, archive).select("header").collect()]
    ids = {h["WARC-Record-ID"]: h for h in headers}
    assert len(ids) == len(rows) and all(uuid.UUID(i[len("<urn:uuid:") : -1]).version == 5 for i in ids)
    assert all(re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", h["WARC-Date"]) for h in headers)
    for h in headers:
        assert ("WARC-Profile" in h) == ("WARC-Refers-To" in h) == (h["WARC-Type"] == "revisit")
        if h["WARC-Type"] == "revisit":
            assert ids[h["WARC-Refers-To"]]["WARC-Type"] == "response" and ids[h["WARC-Refers-To"]]["X-Page-ID"] == h["X-Refers-To-Page"]


def test_archive_with_a_least_size(spark):
    rows = [(1, "u", "same", 0), (2, "u", "same", 0), (3, "u", "longer text", 0), (4, "u", "longer text", 0)]
    found = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, PAGES), min_bytes=8))
    assert {r["page_id"]: r["record_type"] for r in found.collect()} == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_archive(spark, tmp_path):
    assert warc.op7_warc(spark, write_tables(spark, tmp_path, [], pages=([], PAGES))).count() == 0


# neighbours


def vectors(n=700, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, 24))
    rows = [(i, (centres[i % 8] + 0.6 * rng.normal(size=24)).tolist(), i % 8) for i in range(n)]
    rows += [(n + i, rows[50][1], 0) for i in range(40)]
    rows += [(5000, None, 0), (5050, [0.0] * 24, 0), (5100, [1.0, None] + [0.5] * 22, 0), (5150, [float("nan")] * 24, 0), (5200, [float("inf")] * 24, 0), (5250, [], 0), (5300, [1.0, 2.0], 0), (5350, [2.0, 1.0], 0), (None, [1.0] * 24, 0), (50, rows[50][1], 0)]
    return rows


def test_neighbours(spark, tmp_path):
    rows = vectors()
    path = write_tables(spark, tmp_path, [], embeddings=(rows, "vec_id long, embedding array<float>, label int"))
    out = ann.op4_ann(spark, path).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    assert set(by) == {i for i in good if i % 50 == 0}
    hits = total = 0
    for q, found in by.items():
        same = {i: v for i, v in good.items() if len(v) == len(good[q]) and i != q}
        cos = {i: float(v @ good[q] / np.sqrt(v @ v) / np.sqrt(good[q] @ good[q])) for i, v in same.items()}
        want = sorted(cos, key=lambda i: (-round(cos[i], 12), i))[:5]
        assert [r for r, _, _ in found] == list(range(1, len(want) + 1))
        assert all(abs(cos[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(want))
        total += len(want)
    assert hits / total >= 0.95
    # All copies of one vector: ties go to the smaller ids.
    assert [i for _, i, _ in by[50]] == [700, 701, 702, 703, 704]


def test_neighbours_of_many_shards(spark):
    rng = np.random.default_rng(9)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(900)]
    df = ann._valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    graphs = common.settle(ann.index(common.settle(ann.classes(df, 3), "t"), shard_nodes=200), "t")
    assert graphs.count() == 5
    out = ann.search(graphs, df.where("id < 30"), 3).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, ann.search(graphs, df.where("id < 30"), 3, task_queries=7).collect()))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(30):
        s = x @ x[q]
        s[q] = -9
        hits += len(set(np.argsort(-s)[:3]) & {r["vec_id"] for r in out if r["query_id"] == q})
    assert hits >= 85


def test_an_id_with_several_vectors(spark):
    """It is as near as the nearest of them, as a query and as a candidate."""
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [3.0, 1.0]), (3, [1.0, 4.0]), (4, [-1.0, -2.0])]
    df = ann._valid(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    graphs = common.settle(ann.index(common.settle(ann.classes(df, 5), "t")), "t")
    out = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(graphs, df, 5).collect()}
    unit = {i: [np.array(v) / np.linalg.norm(v) for k, v in rows if k == i] for i, _ in rows}
    for q in unit:
        want = sorted((-max(float(a @ b) for a in unit[q] for b in unit[c]), c) for c in unit if c != q)
        assert [out[q, k + 1][0] for k in range(3)] == [c for _, c in want]
        assert [out[q, k + 1][1] for k in range(3)] == pytest.approx([-x for x, _ in want])


def test_shards_grow_slowly():
    assert [ann.shards_of(n, 512) for n in (0, 1, 3_000, 10_000, 50_000, 1_000_000)] == [1, 1, 1, 2, 4, 18]
    assert ann.shards_of(10**9, 512) > 5_000 and ann.shards_of(900, 128, 200) == 5


def test_neighbours_of_nothing(spark, tmp_path):
    path = write_tables(spark, tmp_path, [], embeddings=([], "vec_id long, embedding array<float>, label int"))
    assert ann.op4_ann(spark, path).count() == 0


def test_pruning_keeps_diverse_edges():
    x = ann.unit(np.array([[1.0, 0.0], [0.99, 0.1], [0.98, 0.12], [0.0, 1.0]]))
    kept = ann.robust_prune(x, np.array([0]), np.array([[1, 2, 3, -1, 1]]), 3, 1.2)[0].tolist()
    assert kept[0] == 1 and 2 not in kept and 3 in kept


# toxicity


def toxic_corpus(n=900):
    rng = random.Random(4)
    bad = ["grumble", "snarl", "hissing", "vile", "rotten", "wretch"]
    docs, labels = [], []
    for i in range(n):
        parts = words(rng, rng.randint(10, 150)).split()
        toxic = i % 9 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                parts[rng.randrange(len(parts))] = rng.choice(bad) + rng.choice(["", "", "ing", "er"])
        docs.append((i, " ".join(parts), "en", "s", None))
        if i % 3 != 1:
            labels.append((i, 1, int(toxic)))
    return docs, labels


def test_toxicity_held_out(spark, tmp_path):
    docs, labels = toxic_corpus()
    path = write_tables(spark, tmp_path, docs + [(2000, None, None, None, None), (2001, "", None, None, None)], labels)
    rows = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, path).collect()}
    assert len(rows) == len(docs) + 2 and not rows[2000]["toxic"] and not rows[2001]["toxic"]
    assert not any(rows[i]["toxic"] for i in range(900) if i % 9)
    assert sum(rows[i]["toxic"] for i in range(0, 900, 9)) >= 97
    assert all(0 <= rows[i][c] <= 1 for i in rows for c in ("p_category_1", "p_category_2", "p_category_3", "p_toxic"))


def test_toxicity_with_more_labels_than_are_fitted(spark, tmp_path):
    docs, labels = toxic_corpus()
    path = write_tables(spark, tmp_path, docs, labels)
    frame, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fitted = toxicity.fit(frame, known, "doc_id", "text", fit_rows=300)
    assert fitted.bins.sum() == 300
    scored = toxicity.score(frame, fitted.chain, "doc_id", "text")
    chain = toxicity.calibrate(fitted, scored, known, "doc_id")
    kept = {r["doc_id"] for r in toxicity.keep_rows(frame, chain).collect()}
    assert sum(i in kept for i in range(900) if i % 9) >= 795 and sum(i in kept for i in range(0, 900, 9)) <= 8


def test_toxicity_without_labels(spark, tmp_path):
    path = write_tables(spark, tmp_path, hard_documents(), [])
    assert not any(r["toxic"] for r in toxicity.op8_toxicity(spark, path).collect())
    assert toxicity.op8_toxicity(spark, write_tables(spark, tmp_path / "none", [], [])).count() == 0


def test_chain_by_brute_force(spark, tmp_path):
    """Verdicts from words, weights and thresholds, document by document."""
    docs, labels = toxic_corpus()
    path = write_tables(spark, tmp_path, docs + [(2000, None, None, None, None)], labels)
    frame, known = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    fitted = toxicity.fit(frame, known, "doc_id", "text")
    scored = toxicity.score(frame, fitted.chain, "doc_id", "text")
    chain = toxicity.calibrate(fitted, scored, known, "doc_id")
    rows = {r["doc_id"]: r for r in toxicity.op8_toxicity(spark, path).collect()}
    for i, text, *_ in [*docs, (2000, None)]:
        found = {w.lower() for w in "".join(c if c.isalpha() else " " for c in text or "").split()}
        names = {f"={w}" for w in found} | {f"{w[:n]}*" for w in found for n in (4, 5, 6) if len(w) > n}
        p = []
        for link in range(4):
            z = chain.intercepts[link] + sum(chain.weights[link][chain.vocabulary[f]] for f in names & chain.vocabulary.keys()) + sum(b * q for b, q in zip(chain.past[link], p, strict=True))
            p.append(1 / (1 + np.exp(-z)))
        assert [rows[i][c] for c in ("p_category_1", "p_category_2", "p_category_3", "p_toxic")] == pytest.approx(p, abs=1e-9)
        assert rows[i]["toxic"] == (rows[i]["p_toxic"] > chain.threshold) == (not rows[i]["kept"])


def test_a_fold_gives_its_chain_nothing():
    """What only a held-out fold holds has no weight in the chain that judges it."""
    rng = np.random.default_rng(6)
    n = 300
    fold = np.arange(n) % toxicity.FOLDS
    y = (np.arange(n) % 6 == 0).astype(float)
    dense = rng.random((n, 8)) < 0.2
    dense[:, 0] = y > 0
    dense[:, 7] = (y > 0) & (fold == 2)
    rows, columns = np.nonzero(dense)
    x = toxicity.Sparse(columns, rows, dense.shape)
    chosen = tuple(np.array([c for c in range(8) if c != 7 or k != 2]) for k in range(toxicity.FOLDS + 1))
    data = toxicity.Labelled(x, y, fold, chosen)
    weights, past, intercepts, held = toxicity.fit_without(data, 2, 2)
    assert not weights[:, 7].any() and len(held) == (fold == 2).sum()
    assert (held[y[fold == 2] > 0] > 0.5).all() and (held[y[fold == 2] == 0] < 0.5).all()
    assert [len(b) for b in past] == [0, 1, 2]


def test_threshold_lies_in_the_first_stretch(spark):
    chain = toxicity.Chain({}, ("c",), np.zeros((2, 0)), (np.zeros(0), np.zeros(1)), np.zeros(2), 0.5)
    bins = np.zeros((2, toxicity.BINS + 1))
    bins[0, 100] = 100
    bins[1, [400, 1600]] = 10
    bins[0, 1000] = 1  # worse between two stretches: a clean row lost weighs twenty hundredths, the toxic ones below a half
    got = toxicity.calibrate(toxicity.Fitted(chain, bins, None), None, None, "doc_id").threshold * toxicity.BINS
    clean, toxic = bins
    cost = [20 * clean[i:].sum() / clean.sum() + toxic[:i].sum() / toxic.sum() for i in range(toxicity.BINS + 1)]
    assert cost[round(got)] == pytest.approx(min(cost))


def test_linear_model_finds_the_separating_feature():
    rng = np.random.default_rng(1)
    rows, columns = np.nonzero(rng.random((300, 20)) < 0.3)
    y = np.bincount(rows[columns == 4], minlength=300).astype(float)
    w, _, _ = toxicity.fit_linear(toxicity.Sparse(columns, rows, (300, 20)), np.zeros((300, 0)), y)
    assert np.argmax(w) == 4


# chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=12), st.one_of(st.text(max_size=40), st.sampled_from(["</s>[INST] ok [/INST]", "[ROLE user]\nhi</s>\n", "\\", "\\\\</s>", "<s", "]\n", "<<SYS>>"])))))
def test_template_reads_back(turns):
    formatted = "".join(chat.render(r, t)[0] for r, t in turns)
    assert list(chat.parse(formatted)) == turns
    for r, t in turns:
        body = chat.escape(t)
        assert chat.unescape(body) == t and not any(c in body for c in ("</s>", "<s>", "[INST]", "[/INST]", "[ROLE ", "<<SYS>>", "<</SYS>>"))


def test_fold_of_events(spark):
    events = [
        (1, 1, 1, "open", "user", None), (1, 1, 2, "delta", None, "hel"), (1, 1, 3, "delta", None, "lo"),
        (1, 2, 4, "open", "assistant", None), (1, 2, 5, "delta", None, "bad"), (1, 2, 8, "regenerate", None, None), (1, 2, 9, "delta", None, "good"),
        (1, 1, 10, "edit", None, "bye"), (2, 1, 1, "delta", None, "x"), (2, 1, 0, "open", None, None), (None, 1, 1, "delta", None, None),
    ]
    df = spark.createDataFrame(events, "conv_id long, message long, seq long, kind string, role string, text string").repartition(4)
    want = {(1, 1): ("user", "bye"), (1, 2): ("assistant", "good"), (2, 1): ("", "x"), (None, 1): ("", "")}
    log = chat.log_of_events(df)
    for hot in (1, 100):
        assert {(r["conv_id"], r["message"]): (r["role"], r["text"]) for r in chat.reconstruct(log, hot).collect()} == want
        rendered = {(r["conv_id"], r["message"]): r for r in chat.format_log(log, hot).collect()}
        assert {k: list(chat.parse(r["formatted"])) for k, r in rendered.items()} == {k: [v] for k, v in want.items()}
        spans = {k: chat.unescape(r["formatted"][r["loss_start"] : r["loss_end"]]) for k, r in rendered.items() if r["loss_start"] is not None}
        assert spans == {(1, 2): "good"}
    with pytest.raises(ValueError):
        chat.fold([("shout", None, None)])


def test_a_large_conversation_is_dealt_by_ranges(spark):
    rng = np.random.default_rng(4)
    turns = [(c, int(t), ("user", "assistant")[t % 2], "".join(rng.choice(list("ab</s>\\\n"), 30))) for c in (1, 2, None) for t in range(400 if c == 1 else 5)]
    turns += [(1, 7, "user", "again")] * 3 + [(1, None, None, None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(7)
    cold = sorted(map(tuple, chat.format_and_read_back(chat.log_of_turns(df)).collect()), key=str)
    hot = sorted(map(tuple, chat.format_and_read_back(chat.log_of_turns(df), hot_rows=3).collect()), key=str)
    long = sorted(map(tuple, chat.format_and_read_back(chat.log_of_turns(df), hot_chars=1000).collect()), key=str)
    assert cold == hot == long and [r[1] for r in cold] == [404, 5, 5]
    one = [t for t in turns if t[0] == 1]
    one.sort(key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
    assert cold[0][2] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in one).encode()).hexdigest()


def test_chat_query(spark, tmp_path):
    rows = [(1, 1, "assistant", "b" * 9000, 0), (1, 0, "user", "</s>a\\", 0), (2, 0, None, None, 0), (2, 0, None, None, 0), (3, None, "assistant", "late", 0), (3, 0, "assistant", "é", 0)]
    path = write_tables(spark, tmp_path, [], conversations=(rows, "conv_id long, turn long, role string, text string, n_turns int"))
    out = {r["conv_id"]: r for r in chat.op9_chat_format(spark, path).collect()}
    want = {1: [("user", "</s>a\\"), ("assistant", "b" * 9000)], 2: [("", ""), ("", "")], 3: [("assistant", "late"), ("assistant", "é")], -7: [("user", chat.PLANTED_TEXT), ("assistant", chat.PLANTED_TEXT)]}
    assert out.keys() == want.keys()
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c]["n_turns"] == len(turns) and out[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[c]["loss_chars"] == len(loss) and out[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert out[c]["formatted_chars"] == sum(len(chat.render(r, t)[0]) for r, t in turns)
    nothing = write_tables(spark, tmp_path / "none", [], conversations=([], "conv_id long, turn long, role string, text string"))
    assert [r["conv_id"] for r in chat.op9_chat_format(spark, nothing).collect()] == [-7]


# pipeline


def test_pipeline_stages(spark, tmp_path):
    docs, labels = toxic_corpus(450)
    rng = random.Random(6)
    copy = docs[1][1].split()
    docs += [docs[4], docs[4], (3000, docs[2][1], "en", "s", None), (3001, " ".join([*copy, "extra"]), "en", "s", None), (3002, "", None, None, None), (3003, None, None, None, None), (3004, " ".join(["again"] * 60), "en", "s", None)]
    docs += [(3100 + i, " ".join(w + "%%%" for w in words(rng, 60).split()), "en", "s", None) for i in range(20)]
    labels += [(3100 + i, 0, 0) for i in range(10)]
    path = write_tables(spark, tmp_path, docs, labels)
    frame = spark.read.parquet(f"{path}/documents.parquet")
    first = common.settle(corpus_pipeline.keep_quality(spark, frame, path), "t")
    kept = {r["doc_id"] for r in first.collect()}
    assert first.columns == frame.columns and not kept & {3002, 3003, 3004, *range(3100, 3120)}
    assert {i for i, t, *_ in docs if i < 3000 and len(t.split()) >= 20} <= kept
    second = common.settle(corpus_pipeline.keep_clean(spark, first, path), "t")
    clean = {r["doc_id"] for r in second.collect()}
    assert {i for i in kept if i >= 3000 or i % 9} == {i for i in clean if i >= 3000 or i % 9} and sum(i % 9 == 0 for i in clean if i < 3000) <= 2
    third = common.settle(corpus_pipeline.keep_one_of_each(spark, second, path), "t")
    single = {r["doc_id"] for r in third.collect()}
    assert third.columns == frame.columns
    rows = [tuple(r) for r in second.collect()]
    from tests.llm.test_text_operators import slow_components

    assert third.count() == len(single)
    assert single == {c for _, c in slow_components(rows, neardup.SHINGLE_WORDS, neardup.SIMILARITY_PERCENT).values()}
    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p["doc_id"] for p in pieces} == single
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "toxicity", "near-duplicates", "best-fit packing"]
    assert packing.CAPACITY >= max(p["length"] for p in pieces) and quality.MIN_WORDS == 20


def test_pipeline_keeps_one_row_of_each_document(spark, tmp_path):
    """Ids on several texts, repeated rows, rows without an id, and columns that share names with what the stages make."""
    rng = random.Random(12)
    a, b, c, d = (words(rng, 80) for _ in range(4))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (9, b, 4), (20, max(c, d), 5), (20, min(c, d), 6), (20, max(c, d), 5), (None, a, 7), (30, None, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").withColumns({n: F.lit(1) for n in ("component_id", "count", "row", "id", "n", "toxic", "label")})
    out = corpus_pipeline.keep_one_of_each(spark, df.repartition(3), str(tmp_path))
    assert out.columns == df.columns
    assert sorted((str(r["doc_id"]), r["kept"]) for r in out.collect()) == [("20", 6), ("3", 1), ("30", 8), ("None", 7)]
    path = write_tables(spark, tmp_path, [], [(i, 1, 0) for i in (3, 5)])
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.keep_clean):
        assert stage(spark, df, path).schema == df.schema
    assert corpus_pipeline.pack_pieces(spark, df, path).count() == len(rows)


def test_pipeline_on_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, write_tables(spark, tmp_path, [], [])).count() == 0


def test_failed_queries_leave_no_tables(spark, tmp_path, monkeypatch):
    from spectrail.llm import registry

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    path = write_tables(spark, tmp_path, [(i, f"text {i}", None, None, None) for i in range(9)], [(1, 1, 0)])
    monkeypatch.setattr(quality, "judge", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        registry.tidied(quality.op1_quality)(spark, path)
    assert not list((tmp_path / "shared").iterdir())
    registry.tidied(packing.op5_packing)(spark, path).collect()
    assert list((tmp_path / "shared").iterdir())


def test_registry_matches_contract(spark, sf_dir):
    import __spark_entry__

    names = {n.split("_")[0] for n in __spark_entry__.queries() if n[:2] == "op" and n[2:3].isdigit()}
    assert names == {f"op{i}" for i in range(1, 11)} and "pipeline" in __spark_entry__.queries()
    assert DOC_SCHEMA.startswith("doc_id")
