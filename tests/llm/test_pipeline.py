"""The pipeline's stages on their own inputs, against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import sentencepiece

import corpus_pipeline
from quernstone.llm import registry
from quernstone.llm.mixing import mix_sources
from quernstone.llm.near_duplicates import shingles
from quernstone.plans import shared_table
from tests.llm.test_operators import SCHEMA, WORD, brute_targets, odd_rows


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    kept = {}
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs.collect()
        docs = shared_table(stage(spark, docs, sf_dir), f"test-{name}")
        kept[name] = docs.collect()
        if name != "piece_codec":
            assert docs.columns == names
    one = registry.QUERIES["op1_kneser_ney_quality"](spark, sf_dir).where("kept").select("doc_id").collect()
    assert sorted(r.doc_id for r in kept["quality_classifier"]) == sorted(r.doc_id for r in one)
    # exact: one row of each text without white space
    norm = lambda r: re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
    want = {}
    for r in sorted(inputs["exact_dedup"], key=lambda r: (-len(r.text or ""), r.doc_id)):
        want.setdefault(norm(r), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(want.values())
    # near: of the classes that five-word Jaccards of 0.8 connect, the smallest id
    src = sorted(inputs["simhash_near_dedup"], key=lambda r: r.doc_id)
    root = list(range(len(src)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    sets = [set(shingles(r.text).tolist()) for r in src]
    places = defaultdict(list)
    for k, one in enumerate(sets):
        for h in one:
            places[h].append(k)
    for a, b in {(a, b) for ks in places.values() for a in ks for b in ks if a < b}:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and top(a) != top(b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    assert sorted(r.doc_id for r in kept["simhash_near_dedup"]) == [r.doc_id for k, r in enumerate(src) if top(k) == k]
    # mix: taken words come near the targets
    size, taken = defaultdict(int), defaultdict(int)
    for r in inputs["source_mix"]:
        size[r.source] += len(WORD.findall(r.text))
    for r in kept["source_mix"]:
        taken[r.source] += len(WORD.findall(r.text))
    longest = max(len(WORD.findall(r.text)) for r in inputs["source_mix"])
    for s, t in brute_targets(dict(size)).items():
        assert abs(taken[s] - t) <= longest
    assert max(Counter(r.doc_id for r in kept["source_mix"]).values()) <= 2
    plain = sentencepiece.SentencePieceProcessor(model_file=registry.default_model())
    got = Counter((r.doc_id, r.ids_sha256) for r in kept["piece_codec"])
    assert got == Counter((r.doc_id, hashlib.sha256(",".join(map(str, plain.encode(r.text))).encode()).hexdigest()) for r in inputs["piece_codec"])


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0


def test_other_cut(spark, tmp_path, monkeypatch):
    """Verdicts meet their rows although the files are cut otherwise in the next scan."""
    texts = [f"text {k % 40} of forty" for k in range(120)]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(12, "doc_id").write.parquet(str(tmp_path / "documents"))
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)

    def cut_after(name):
        first = getattr(corpus_pipeline, name)

        def run(*args, **more):
            out = shared_table(first(*args, **more), "test-verdicts")
            spark.conf.set(key, "1")
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            return out

        monkeypatch.setattr(corpus_pipeline, name, run)

    try:
        cut_after("exact_dedup")
        cut_after("mix_sources")
        for stage in (corpus_pipeline.exact_stage, corpus_pipeline.mix_stage):
            spark.conf.set(key, str(1 << 27))
            spark.conf.set("spark.sql.files.minPartitionNum", "12")
            docs = spark.read.parquet(str(tmp_path / "documents"))
            got = sorted(r.doc_id for r in stage(spark, docs, "").collect())
            if stage is corpus_pipeline.exact_stage:
                assert got == list(range(40))
            else:
                copies = {r.row_uid: round(r.taken / r.size) for r in mix_sources(docs).collect()}
                assert len(got) == sum(copies.values())
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_near_stage(spark, tmp_path):
    """Pairs with a five-word Jaccard of 0.8 lose one document at any SimHash distance; those below keep both."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    shingle = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    docs, want = [], set()
    for k in range(120):
        a = [word() for _ in range(100)]
        b = list(a)
        for _ in range(rng.choice([1, 2, 3])):
            b[rng.randrange(100)] = word()
        x, y = shingle(a), shingle(b)
        docs += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k} if len(x & y) / len(x | y) >= 0.8 else {2 * k, 2 * k + 1}
    docs += [(900, "one two"), (901, "ONE two"), (902, ""), (903, None)]
    spark.createDataFrame([(i, t, "en", "s", 1) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents"))
    got = {r.doc_id for r in corpus_pipeline.near_stage(spark, spark.read.parquet(str(tmp_path / "documents")), "").collect()}
    assert got == want | {900, 902, 903}


def test_near_large_bands(spark, tmp_path):
    """Variants near their base but not each other, in bands of many rows: classes as of all pairs, in any order of the files."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    texts = []
    for with_base, many in ((True, 90), (False, 24), (True, 12)):
        base = [word() for _ in range(100)]
        texts += [" ".join(base)] * with_base
        for _ in range(many):
            at, ws = rng.randrange(98), list(base)
            ws[at : at + 3] = [word() for _ in range(3)]
            texts.append(" ".join(ws))
    sets = [set(shingles(t).tolist()) for t in texts]
    root = list(range(len(texts)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    want = [k for k in range(len(root)) if top(k) == k]
    assert 3 < len(want) < 27
    for seed in (1, 2):
        rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
        random.Random(seed).shuffle(rows)
        path = str(tmp_path / f"documents{seed}")
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(path)
        assert sorted(r.doc_id for r in corpus_pipeline.near_stage(spark, spark.read.parquet(path), "").collect()) == want


def test_stages_odd(spark, tmp_path):
    """Nulls, blanks, repeated rows, ties and clashing names pass all stages, and so do empty tables."""
    spark.createDataFrame([(3, 1, 0), (4, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = shared_table(stage(spark, docs, str(tmp_path)), "test-odd")
            ids = {r.doc_id for r in docs.collect()}
            assert {r.doc_id for r in out.collect()} <= ids
            if name != "piece_codec":
                assert out.columns == docs.columns
                docs = out
            if name == "exact_dedup" and rows:
                texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
                assert len(texts) == len(set(texts))
