"""The pipeline against its stages applied by hand."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pourstat.llm import jaccard, pieces, quality, secrets, simhash
from pourstat.llm.catalog import PIECE_MODEL

SF = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r.doc_id for r in quality.quality(frame).filter("kept").collect()}
    words = {i: re.findall(rb"[^\x20\x09-\x0D]+", (docs[i].text or "").encode().lower()) for i in good}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items()}
    parent = {i: i for i in good}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in good:
        for b in good:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    left = {i for i in good if root(i) == i}
    plain = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    grams = {tuple(w[i : i + 13]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [plain(r.text)] for i in range(len(w) - 12)}
    clean = {i for i in left if not any(tuple(w[k : k + 13]) in grams for w in [plain(docs[i].text)] for k in range(len(w) - 12))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    # Items under thirteen words may take out a few more.
    assert set(got) <= clean and len(clean - set(got)) <= 2
    codec = pieces.Codec(pieces.load(PIECE_MODEL))
    for i, r in got.items():
        text = codec.decode(*codec.encode([docs[i].text]))[0]
        assert text == docs[i].text
        if not secrets.known_spans(text):
            assert r.pieces == codec.encode([text])[0].tolist() and r.round_trip


def test_stages_keep_columns_and_survive_odd_rows(spark):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (None, "a b", None, None, None, None), (1, "a " * 200, "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, kept string")
    for source in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, source, SF).columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, source, SF).count() == source.count()


def test_near_duplicates_reach_the_threshold(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(30):
        words = rng.choice(5000, 150).astype(str)
        rows.append(" ".join(words))
        for changes in rng.integers(1, 7, 3):
            near = words.copy()
            near[rng.choice(150, changes, replace=False)] = "changed"
            rows.append(" ".join(near))
    rows += ["few words", "Few  words", "other words", "", None, rows[0].upper()]
    ids = [100 + k // 2 if k > 120 else k for k in range(len(rows))]  # a few ids repeat
    sets = []
    for t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    parent = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = (parent[k] for k in (a, b))
                parent = [y if p == x else p for p in parent]
    docs = spark.createDataFrame(list(zip(ids, rows)), "doc_id bigint, text string")
    for bucket in (8, 1024):
        monkeypatch.setattr(jaccard, "BUCKET", bucket)
        got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
        groups = [parent[rows.index(r.text)] for r in got]
        assert sorted(groups) == sorted(set(parent))
        assert all(r.doc_id == min(ids[k] for k, p in enumerate(parent) if p == parent[rows.index(r.text)]) for r in got)


def test_texts_are_told_apart_by_their_whole_digest(spark):
    texts = ["a b", "", None, "A b", "äß"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", simhash.text_hash().alias("th")).collect()
    assert {r.text: bytes(r.th) for r in rows} == {t: hashlib.sha256((t or "").encode()).digest() for t in texts}


def test_a_place_shared_by_other_content_brings_no_set():
    here, other = "one two three four five six", "seven eight nine ten eleven twelve"
    number = jaccard.set_number(jaccard.shingle_set(here, {}))
    batch = pa.RecordBatch.from_arrays([pa.array([number, number]), pa.array([other, here])], names=["e", "text"])
    (out,) = jaccard._set_rows(iter([batch]))
    assert out.column(0).to_pylist() == [number]
    assert out.column(1)[0].as_py() == jaccard.shingle_set(here, {}).view(np.int64).tolist()


def test_set_links():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, 40)) for _ in range(40)] + [np.arange(k, k + 50) for k in (0, 2, 4, 200)]
    reach = lambda n, pairs: {frozenset(c) for c in _groups(n, pairs)}
    pairs = [(a, b) for a in range(44) for b in range(a) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))]
    assert reach(44, jaccard.set_links(sets)) == reach(44, pairs)


def _groups(n, pairs):
    label = list(range(n))
    for a, b in pairs:
        x, y = label[a], label[b]
        label = [y if p == x else p for p in label]
    return [[k for k in range(n) if label[k] == p] for p in set(label)]


CLASHING = ("_h", "_r", "_id", "_th", "_leak", "_key", "_spans", "_row", "_text", "_w", "id", "th", "r", "whole", "spans", "first_id", "body", "ident", "key")


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES[:-1])
def test_stages_leave_columns_of_any_name_alone(spark, name, stage):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wide = docs
    for k, c in enumerate(CLASHING):
        wide = wide.withColumn(c, F.concat(F.lit(f"{k}-"), F.col("doc_id").cast("string")))
    plain = {(r.doc_id, r.text) for r in stage(spark, docs, SF).collect()}
    out = stage(spark, wide, SF)
    assert out.columns == wide.columns
    rows = out.collect()
    assert {(r.doc_id, r.text) for r in rows} == plain and len(rows) == len(plain)
    assert all(r[c] == f"{k}-{r.doc_id}" for r in rows for k, c in enumerate(CLASHING))
