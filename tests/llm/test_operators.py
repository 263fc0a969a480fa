"""Operators of the training-data pipeline against plain brute-force versions and odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quernstone.llm import html_text as H
from quernstone.llm import kneser_ney as K
from quernstone.llm import langid as L
from quernstone.llm import packed as P
from quernstone.llm import registry
from quernstone.llm import word_ngrams as W
from quernstone.llm.automaton import compile_rules, longest_from
from quernstone.llm.exact_dedup import exact_dedup
from quernstone.llm.host_rules import quality_rules
from quernstone.llm.licences import Recogniser, scan_licences
from quernstone.llm.mixing import mix_sources, schedule, source_targets
from quernstone.llm.pieces import Pieces, piece_digests, piece_ids, read_model
from quernstone.llm.rows import number_rows
from quernstone.llm.secrets import RULES, Rule, Scanner, scan_secrets, secret_report
from quernstone.llm.simhash import fingerprint, member_links, simhash_classes
from tests.compare import rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, id string, rank int"


def words_of(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "éa", "ou"]) for _ in range(n))


def odd_rows():
    """Nulls everywhere, empty and blank texts, ties, repeated rows, a very long text, clashing names."""
    rng = random.Random(1)
    out = [(k, words_of(rng, 30 + k), "en" if k % 3 else "fr", f"s{k % 4}", 1, "x", "y", 3) for k in range(24)]
    out += [(100, None, None, None, None, None, None, None), (101, "", "en", "s1", 0, None, "", 1), (102, " \t\n\x0b", "en", "s1", 4, None, "", 1), (None, "null id here", None, "s0", 1, None, None, None), (None, None, "en", None, 1, None, None, None)]
    out += [out[3], out[3], (103, out[3][1] + "  ", "en", "s9", 1, "", "", 0), (104, out[3][1].replace(" ", "\n"), "en", "s9", 1, "", "", 0)]
    out += [(105, " ".join(words_of(rng, 9) for _ in range(3000)), "en", "s0", 1, "", "", 0), (106, "Ünïcödé ☃ 🙂 日本語 " * 5, None, "s2", 1, "", "", 0)]
    return out


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_oracles(spark, sf_dir, duck):
    for name, sql in registry.ORACLES.items():
        got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns), name
        assert rows(got) == rows(want), name


# --- exact dedup ---

def test_exact_dedup(odd, none):
    got = exact_dedup(odd).collect()
    src = odd_rows()
    assert len(got) == len(src)
    groups = defaultdict(list)
    for r in src:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    want = Counter()
    for norm, members in groups.items():
        best = min(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        for r in members:
            want[r[0], best[0], len(members), hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup(none).count() == 0


# --- host rules ---

def brute_rules(text):
    text = text or ""
    ws = WORD.findall(text)
    seen = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {i + k for i in range(len(ws) - 7) if seen[tuple(ws[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd, none):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(odd).collect())
    assert got == Counter((r[0], *brute_rules(r[1])) for r in odd_rows())
    assert quality_rules(none).count() == 0
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) + rng.choice(["", "\n# x\n# x\n\n\n", "|<>|"]) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("source", F.lit("one"))
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules(df).collect()} == {i: brute_rules(t) for i, t in enumerate(texts)}


def test_bad_hosts(spark):
    good, bad = "word " * 3 + " ".join(map(str, range(30))), "short text"
    df = spark.createDataFrame([(k, good if k % 50 else bad, f"ok{k % 5}") for k in range(400)] + [(1000 + k, bad if k % 20 else good, "spam") for k in range(200)], "doc_id long, text string, source string")
    got = quality_rules(df).collect()
    assert {r.kept for r in got if r.doc_id >= 1000} == {False}
    assert all(r.kept == (not r.base_failed) for r in got if r.doc_id < 1000)


# --- mixing ---

def brute_targets(sizes, ratio=1.5):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, cap, target = ratio * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()}, {}
    open_, left = set(order), total
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] >= cap[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: cap[s] for s in full}
        left -= sum(cap[s] for s in full)
        open_ -= full
    return target


def test_mix(spark, odd, none):
    got = mix_sources(odd).collect()
    src = odd_rows()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((r[0], len(WORD.findall(r[1] or ""))) for r in src)
    size = Counter()
    for r in src:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    want = brute_targets(size)
    assert sorted({round(r.target, 6) for r in got}) == sorted({round(x, 6) for x in want.values()})
    assert sum(r.taken for r in got) == sum(math.floor(x) for x in want.values())
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert Counter((r.doc_id, r.taken) for r in mix_sources(odd).collect()) == Counter((r.doc_id, r.taken) for r in got)
    assert mix_sources(none).count() == 0


def test_targets_and_schedule(spark):
    rng = random.Random(8)
    for n in (1, 2, 7, 40):
        sizes = {(None if k == 3 else f"s{k:02d}"): rng.choice([0, 3, 50, 1000, 40000]) for k in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))
    df = spark.createDataFrame([("a", 60000), ("b", 60000), ("c", 60000)], "source string, source_size long")
    slots = schedule(source_targets(df), 64).orderBy("slot").collect()
    per = defaultdict(list)
    for r in slots:
        per[r.source].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    share = {r.source: r.target for r in source_targets(df).collect()}
    # any stretch of the schedule is close to the targets
    for k in range(200, 4000, 400):
        part = Counter(r.source for r in slots[3 : 3 + k])
        assert all(abs(part[s] - k * share[s] / sum(share.values())) < 8 for s in share)


# --- language ---

def test_language(spark, sf_dir, odd, none):
    got = registry.QUERIES["op3_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.93
    said = L.identify_language(odd, odd).collect()
    assert len(said) == len(odd_rows()) and all(0 <= r.score <= 1 for r in said)
    assert {r.lang_pred for r in said if r.doc_id in (100, 101, 102)} == {"und"}
    assert {r.lang_pred for r in L.identify_language(odd, none).collect()} == {"und"}
    assert L.identify_language(none, odd).count() == 0


def test_language_samples(spark, odd):
    """Whole texts, each once however often it occurs, bounded in number; dictionaries hold whole words up to their size."""
    rows = [(f"text number {k} " + "x" * 5000, "en") for k in range(300)] + [("the same copy", "en")] * 500 + [("un texte", "fr"), (None, "fr"), ("no language", None)]
    found = L.language_samples(spark.createDataFrame(rows, "text string, lang string"), "lang", "text", 40)
    assert set(found) == {"en", "fr"} and found["fr"] == ["un texte"]
    assert 15 <= len(found["en"]) <= 80 and len(set(found["en"])) == len(found["en"])
    assert all(len(t) > 5000 or t == "the same copy" for t in found["en"])
    cut = L.dictionaries({"en": ["zeta alpha beta gamma alpha"]}, 12)["en"]
    assert cut == b"zeta alpha"


def test_language_choice():
    """The choice is the smallest coding by dictionaries, coded here one by one."""
    import zstandard

    rng = random.Random(9)
    words = {lang: ["".join(rng.choice(a) for _ in range(5)) for _ in range(200)] for lang, a in (("p", "abcdefg"), ("q", "hijklmn"), ("r", "opqrstu"))}
    dicts = L.dictionaries({k: [" ".join(v)] for k, v in words.items()}, 65536)
    coders, order = L.Coders(dicts), {"p": 0, "q": 1, "r": 2}
    for _ in range(60):
        text = " ".join(rng.choice(words[rng.choice("pqr")]) for _ in range(rng.randrange(1, 30)))
        data = L.normal_words(text)
        size = {}
        for k, d in dicts.items():
            coder = zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=18, hash_log=17, chain_log=17, search_log=3, min_match=3, target_length=0, strategy=zstandard.STRATEGY_BTOPT, write_content_size=False, write_checksum=False, write_dict_id=False), dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            size[k] = sum(len(coder.compress(bytes(64) + data[i : i + 2048])) for i in range(0, len(data), 2048))
        lang, score, _ = coders.classify(text, order)
        assert lang == min(size, key=lambda k: (size[k], order[k])) and 0 <= score <= 1


# --- secrets ---

def brute_secrets(text):
    out = []
    text = text or ""
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if m[0].isascii() and len(m[2]) >= 12:
            out.append((m.start(), m.end(), 0))
    out += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_secrets(spark, sf_dir, odd, none):
    scanner = Scanner()
    rng = random.Random(3)
    parts = ["token", "Secret", "=", ":", " ", "'", '"', "abc", "AKIA", "0f9a", "Z9", "é", "api", "_", "KEY", "passwd", "a" * 7, "\n", "==", "-"]
    texts = ["".join(rng.choice(parts) for _ in range(40)) for _ in range(3000)] + ["token=secret: abcdefghijklmnop", "", "AKIA" * 9, "ghp_" + "a1" * 18, "-----BEGIN RSA PRIVATE KEY-----"]
    for t in texts:
        assert [x for x in scanner.spans(t) if x[2] < 3] == brute_secrets(t), t
    assert [RULES[x[2]].kind for x in scanner.spans(texts[-2])][:1] == ["github"] and [RULES[x[2]].kind for x in scanner.spans(texts[-1])] == ["pem"]
    got = registry.QUERIES["op4_secret_scan"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in got:
        want = brute_secrets(texts[r.doc_id])
        kinds = Counter(x[2] for x in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (kinds[0], kinds[1], kinds[2])
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert secret_report(scan_secrets(odd)).count() == len(odd_rows()) and scan_secrets(none).count() == 0


def test_automaton():
    rng = random.Random(6)
    for pattern in (r"(ab|a)*c?d", r"[a-c]{2,3}x+", r"a(b|cd)?[^a]", r"\x61\d+|b{2,}"):
        dfa = compile_rules([(pattern, False)], starts=False)
        back = compile_rules([(pattern, False), ("zz", False)], starts=True)
        for _ in range(400):
            data = "".join(rng.choice("abcdx1") for _ in range(rng.randrange(12))).encode()
            ends = [e for e in range(len(data) + 1) if re.fullmatch(pattern.encode(), data[:e])]
            assert longest_from(dfa, data, 0) == max([e for e in ends if e], default=-1)
            state, at = back.start, []
            for i in reversed(range(len(data))):
                state = back.step[state + data[i]]
                if 0 in back.accepting.get(state, ()):
                    at.append(i)
            assert at[::-1] == [i for i in range(len(data)) if any(re.fullmatch(pattern.encode(), data[i:e]) for e in range(i + 1, len(data) + 1))]


def test_secrets_linear():
    """No text makes the scan go over its bytes again and again; a rule that would is refused."""
    scanner = Scanner()
    for part in ("eyJ", "eyJa.eyJ", "token=", "postgres://a:", "mysql://x:y", "0f", "AKIA", "sk_live_"):
        text = part * (300_000 // len(part))
        began = time.perf_counter()
        scanner.spans(text)
        assert time.perf_counter() - began < 3
    jwt = "eyJ" * 5000 + ".eyJab.cd" + " " * 9
    assert [(s, e, RULES[r].kind) for s, e, r in scanner.spans(jwt) if RULES[r].kind == "jwt"] == [(0, len(jwt) - 9, "jwt")]
    with pytest.raises(ValueError):
        Scanner((Rule("late", "a(b*c)?"),))


# --- licences ---

def test_licences(spark, odd, none):
    r = Recogniser()
    find = lambda t: [x[0] for x in r.licences(r.sentences(t))]
    assert find("Some words. Released under the MIT License.\nMore.") == ["MIT"]
    assert find("Licensed under the Apache\nLicense, Version 2.0.") == ["Apache-2.0"]
    assert find("// Licensed under the Apache License, Version 2.0 (the \"License\");\n// you may not use this file except in compliance with the License.") == ["Apache-2.0"]
    assert find("it was not released under the MIT License today") == []
    assert find("This work is licensed under the GNU General Public License, version 3. Licensed under CC BY-NC 4.0.") == ["GPL-3.0", "CC-BY-NC-4.0"]
    assert find("Released under the" + " " * 3000 + "MIT License.") == ["MIT"]
    text = "é. Released under the MIT License."
    assert r.licences(r.sentences(text)) == [("MIT", 3, len(text))]
    assert len(find("Released under the MIT License.\n" * 3000)) == 3000
    assert scan_licences(odd).count() == len(odd_rows()) and scan_licences(none).count() == 0


# --- simhash ---

def brute_fingerprint(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[i : i + 4]) for i in range(max(1, len(ws) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(fps):
    top = list(range(len(fps)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_simhash(spark, odd, none):
    rng = random.Random(11)
    base = [words_of(rng, 60).split() for _ in range(12)]
    texts = []
    for k in range(150):
        ws = list(rng.choice(base))
        for _ in range(rng.randrange(3)):
            ws[rng.randrange(len(ws))] = rng.choice(["Alpha", "zeta", "Beta"])
        texts.append(" ".join(ws))
    texts += [None, "", " \n", "one", "one two", "ONE two", texts[0], texts[0]]
    df = spark.createDataFrame([(1000 - k, t, 5) for k, t in enumerate(texts)], "doc_id long, text string, fp int")
    got = {r.doc_id: r for r in simhash_classes(df).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [fingerprint(t) for t in texts] == fps
    cls = brute_classes(fps)
    low = defaultdict(lambda: 10**9)
    for k, c in enumerate(cls):
        low[c] = min(low[c], 1000 - k)
    for k in range(len(texts)):
        assert got[1000 - k].fingerprint == format(fps[k], "016x")
        assert got[1000 - k].component_id == low[cls[k]]
    assert sum(r.kept for r in got.values()) == len(set(cls))
    assert simhash_classes(none).count() == 0
    many = simhash_classes(odd).collect()
    assert len(many) == len(odd_rows()) and all(r.component_id is not None for r in many if r.doc_id is not None)


def test_anchors_cover(spark):
    """Random points with neighbours at every distance up to six: links up to four, and only those, connect."""
    rng = random.Random(12)
    fps = set()
    for _ in range(250):
        x = rng.getrandbits(64)
        fps.add(x)
        for d in range(1, 7):
            y = x
            for b in rng.sample(range(64), d):
                y ^= 1 << b
            fps.add(y)
    fps = sorted(fps)
    from quernstone.llm.simhash import anchor_links
    from quernstone.operators.components import connected_components

    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = anchor_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    comp = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
    cls = brute_classes(fps)
    got = defaultdict(set)
    for i, x in enumerate(signed):
        got[comp.get(x, ("own", x))].add(i)
    want = defaultdict(set)
    for i, c in enumerate(cls):
        want[c].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_large_anchor():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**33, 6000, dtype=np.uint64) << np.uint64(31)
    near = base[:500] ^ np.uint64(1 << 40) ^ np.uint64(1 << 62)
    fps = np.unique(np.concatenate((base, near))).view(np.int64)
    links = member_links(fps, 0)
    assert all((int(a) ^ int(b)) & (2**64 - 1) and ((int(a) ^ int(b)) & (2**64 - 1)).bit_count() <= 4 for a, b in links)
    tied = {x for pair in links for x in pair}
    assert all(int(x) in tied for x in near.view(np.int64))


# --- perplexity ---

def test_quality_classifier(spark, sf_dir, odd, none):
    got = {r.doc_id: r.kept for r in registry.QUERIES["op1_kneser_ney_quality"](spark, sf_dir).collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good, low = [got[i] for i, (q, t) in labels.items() if q == 1 and not t], [got[i] for i, (q, _) in labels.items() if q == 0]
    assert sum(good) / len(good) >= 0.97 and (not low or sum(low) / len(low) <= 0.4)
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    said = K.classify_quality(odd, no_labels).collect()
    assert len(said) == len(odd_rows())
    assert all(r.kept == (r.neg_log_prob is not None) for r in said)
    assert K.classify_quality(none, no_labels).count() == 0
    assert K.keep_quality(odd, no_labels).columns == odd.columns
    assert K.keep_quality(odd, no_labels).count() == sum(r.kept for r in said)
    some = spark.createDataFrame([(3, 1, 0), (None, 1, 0), (4, 0, 0), (5, 1, None)], "doc_id long, quality int, toxic int")
    classifier, scores = K.fit_and_score(number_rows(odd), some)
    assert classifier.limits[None] < float("inf")
    assert Counter(r.id for r in scores.collect()) == Counter(r[0] for r in odd_rows())
    assert sum(r.trusted for r in scores.collect()) == sum(r[0] in (3, 5) for r in odd_rows())


def brute_word_model(texts):
    """p(k, words): probability of the last of up to k words by the recursive formula."""
    t3 = Counter(x for t in texts for w in [plain_words(t)] if len(w) > 3 for x in zip(w, w[1:], w[2:]))
    t2 = Counter(x[1:] for x in t3)
    tables = [Counter(x[1:] for x in t2), t2, t3]

    def discounts(t):
        n = [0, *[sum(v == k for v in t.values()) for k in (1, 2, 3, 4)]]
        if not n[1] or not n[2]:
            return 0.5, 0.75, 0.9
        y = n[1] / (n[1] + 2 * n[2])
        return [min(max(k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.9 * k, 0.05), k - 0.05) for k in (1, 2, 3)]

    cuts = [discounts(t) for t in tables]

    def p(k, g):
        if not k:
            return 1 / (len(tables[0]) + 1)
        t, d, low = tables[k - 1], cuts[k - 1], p(k - 1, g[1:])
        row = [v for x, v in t.items() if x[:-1] == g[:-1]]
        if not row:
            return low
        cut = lambda v: d[min(v, 3) - 1]
        own = max(t[g] - cut(t[g]), 0) if t[g] else 0
        return own / sum(row) + sum(map(cut, row)) / sum(row) * low

    return p, tables


def plain_words(text):
    trim = lambda w: w[:-1] if len(w) > 1 and w[-1] in ".,;:?!" else w
    return ["<", "<", *map(trim, (text or "").lower().split()), ">"]


@pytest.mark.parametrize("rounds", [1, 3])
def test_word_trigrams(spark, rounds):
    """Scores against the recursive formula, in any number of rounds; every trigram is in the model."""
    rng = random.Random(6)
    made = [" ".join(rng.choice(["ka", "li", "mo", "nu", "pe", "ri"]) for _ in range(rng.randrange(1, 30))) + "." for _ in range(60)]
    texts = ["the cat sat on the mat.", "a hat for the cat.", "the cat sat on a hat", "", " \n", None, "the cat sat.", *made]
    model = W.train_words(spark.createDataFrame([(t,) for t in texts], "text string"), rounds=rounds, shard_words=16)
    p, tables = brute_word_model(texts)
    asked = ["the cat", "zebra! the the the", "a cat sat on the mat", "Mat 77", None, " ", made[0], "ka li mo nu pe ri ri ri ka li", "the cat"]
    rows = spark.createDataFrame([(k - 3, k, None, k == 6, t) for k, t in enumerate(asked)], "uid long, id long, lang string, trusted boolean, text string")
    got = {r.id: r for r in W.word_scores(rows, model).collect()}
    for k, t in enumerate(asked):
        w = plain_words(t)
        if len(w) == 3:
            assert got[k].mean is None
            continue
        want = -np.mean([math.log(p(3, g)) for g in zip(w, w[1:], w[2:])])
        assert got[k].mean == pytest.approx(want, abs=4e-3) and got[k].words == len(w) - 2
        assert got[k].novel == len(set(zip(w, w[1:], w[2:])))
        assert (got[k].mean_elsewhere > got[k].mean + 0.01) == (k == 6)
    held = [W.unpack(r.data, np.float16, np.uint32) for t in model.shards for r in t.collect() if r.kind == 1]
    assert Counter(np.concatenate([x[2] for x in held]).tolist()) == Counter(tables[2].values())
    model.drop()


def test_sums_in_parts(spark):
    """A task that sends its sums on early, time and again, gives the same sums; ids are those of each portion."""
    rng = random.Random(8)
    made = [" ".join(rng.choice(["ka", "li", "mo", "nu", "pe"]) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    model = W.train_words(spark.createDataFrame([(t,) for t in made], "text string"), rounds=1, shard_words=16)
    rows = spark.createDataFrame([(k - 7, k % 3 == 0, t) for k, t in enumerate(made)], "uid long, trusted boolean, text string").repartition(5)
    met = W.exchange(model.shards[0].union(W._document_rows(rows, model.shard_bits, 0, 1)), 2).toArrow().to_batches()
    sums, parts = {}, {}
    for most in (1, 15, W._HELD):
        out = [r for batch in W._look_up(iter(met), most) for r in batch.to_pylist()]
        sums[most], parts[most] = Counter(), len(out)
        for r in out:
            uid, *values = W.unpack(r["data"], np.float32, np.float32)
            for k, v in enumerate(values):
                for u, x in zip(uid.astype(np.uint64).view(np.int64).tolist(), v.tolist(), strict=True):
                    sums[most][u, k] += x
    assert parts[1] >= parts[15] > parts[W._HELD] >= 5
    assert {u for u, _ in sums[1]} == set(range(-7, 33))
    assert sums[1] == pytest.approx(sums[W._HELD], abs=1e-3) and sums[15] == pytest.approx(sums[W._HELD], abs=1e-3)
    model.drop()


def test_packed():
    rng = np.random.default_rng(1)
    keys = np.sort(rng.integers(0, 1 << 63, 1000))
    few = rng.random(1000).astype(np.float16)
    for n in (0, 1, 1000):
        a, b = P.unpack(P.pack(keys[:n], few[:n]), np.float16)
        assert (a == keys[:n]).all() and (b == few[:n]).all()
    shard = P.shard_of(keys, 5)
    dealt = P.deal(7, shard, keys, few)
    assert [s for s, _, _ in dealt] == sorted(set(shard.tolist())) and P.deal(0, shard[:0], keys[:0]) == []
    back = P.merged([P.unpack(d, np.float16) for _, _, d in dealt])
    assert (back[0] == keys).all() and (back[1] == few).all()


def test_quality_by_words(spark):
    """Known letters in unknown words are rejected; a character model of these lets them pass."""
    rng = random.Random(4)
    known = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(300)]
    other = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(30000)]
    other = [w for w in other if w not in known]
    prose = lambda ws: " ".join(rng.choice(ws) for _ in range(400))
    docs = spark.createDataFrame([(k, prose(known), "en") for k in range(40)] + [(100 + k, prose(other), "en") for k in range(10)] + [(200 + k, prose(known), "en") for k in range(10)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in K.classify_quality(docs, labels).collect()}
    assert all(got[k] == (not 100 <= k < 200) for k in got)


def test_quality_repeats(spark):
    """Texts of middling perplexity that repeat themselves are rejected, copies of trusted texts aren't."""
    rng = random.Random(5)
    known = ["".join(rng.choice("aeiou") + rng.choice("lmnrst") for _ in range(3)) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(known) for _ in range(n))
    good = [prose(200) for _ in range(40)]
    junk = [" ".join([w] * 300) for w in known[:8]] + [" ".join(["xyzzy", known[k]] * 200) for k in range(4)] + [(prose(6) + " ") * 60 for _ in range(4)]
    docs = [(k, t) for k, t in enumerate(good)] + [(100 + k, t) for k, t in enumerate(junk)] + [(200 + k, t) for k, t in enumerate(good[:5])] + [(300 + k, prose(200)) for k in range(10)] + [(400, known[0] + " " + known[0])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    classifier, scores = K.fit_and_score(number_rows(docs), labels)
    got = classifier.judge(scores).collect()
    assert all(r.kept == (not 100 <= r.id < 200) for r in got)
    # the mean alone doesn't show them
    repeats, classifier.repeats = classifier.repeats, dict.fromkeys(classifier.repeats, math.inf)
    assert any(r.kept for r in classifier.judge(scores).collect() if 100 <= r.id < 200)
    classifier.repeats = repeats
    # the lower side of the mean
    classifier.floors = dict.fromkeys(classifier.floors, -99.0)
    assert not any(r.kept for r in classifier.judge(scores).collect() if r.id < 400)


# --- main text ---

def test_main_text(spark, sf_dir, none):
    w = H.learn_weights({})
    page = """<html><body class="has-sidebar"><header><h1>Site</h1></header><nav><a>Home</a></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Title &amp; more</h1><p>First  para <b>bold</b>text<br>line</p><aside>Related words here</aside><p>Second&nbsp;one<ul><li>item 1<li>item 2</ul>
    <form>Mail <input></form><div class="comments"><p>nice nice nice</p></div></article><section id="comments"><p>I liked it a lot, really a lot more than others did</p></section><footer>(c)</footer><script>var a = "<p>no</p>";</script></body></html>"""
    assert H.main_text(page, w) == "Title & more\n\nFirst para boldtext line\n\nSecond one\n\nitem 1\n\nitem 2"
    assert H.main_text(None, w) == H.main_text("", w) == H.main_text("<nav>Only a menu</nav>", w) == ""
    assert H.main_text("plain text &lt;b&gt;", w) == "plain text <b>"
    assert H.main_text("<div><p>" + "word " * 40 + "</p></div><div><a>x</a> <a>y</a></div>", w) == " ".join(["word"] * 40)
    for broken in ("<p", "<a href='x", "a < b > c", "</p></div>", "<!-- open", "<article><p>kept", "<script>never closed"):
        H.main_text(broken, w)
    assert H.main_text("<article><p>kept", w) == "kept"
    got = registry.QUERIES["op8_html_main_text"](spark, sf_dir).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    import html

    for r in got:
        h = pages[r.page_id]
        inner = re.sub(r"</?b>", "", h[h.index("<article>") + 9 : h.index("</article>")])
        blocks = [" ".join(html.unescape(x).split()) for x in re.split("<[^>]*>", inner)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    learnt = H.train_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    for r in got:
        # with the labels hidden, the scan finds the same text
        assert H.main_text(re.sub("(</?)article>", r"\1div>", pages[r.page_id]), learnt) == r.text
    odd_pages = spark.createDataFrame([(1, None, None), (None, "u", "<p>x y</p>"), (1, None, None)], "page_id long, url string, html string")
    assert sorted(r.text for r in H.extract_text(odd_pages, H.train_weights(odd_pages)).collect()) == ["", "", "x y"]
    assert H.extract_text(odd_pages.limit(0), w).count() == 0


def test_main_text_by_weights(spark, sf_dir):
    """Links and a copyright line beside the text stay out by the learnt weights alone, in any depth."""
    w = H.train_weights(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    text = [" ".join(f"word{k}{i}" for i in range(50)) for k in range(3)]
    links = "".join(f"<li><a href='/{k}'>link {k}</a></li>" for k in range(10))
    page = f"<html><body><div class='x'><div class='left'><ul>{links}</ul></div><div class='mid'>" + "".join(f"<p>{t}</p>" for t in text) + "</div><div>Copyright 2024 Some Company</div></div></body></html>"
    assert H.main_text(page, w) == "\n\n".join(text)
    assert "link 3" in H.main_text(page, dict.fromkeys([*w, "div", "ul", "li", "a", "p"], 0.0) | {H.LINK_WORD: 1.0})
    deep = "<div>" * 600 + "<nav>Menu of a deep page</nav><p>" + text[0] + "</p>" + "</div>" * 600
    assert H.main_text(deep, w) == text[0]
    began = time.perf_counter()
    many = H.main_text("<div><p>" * 20000 + "<i>" * 20000 + text[1] + "</b></u>" * 20000, w)
    assert text[1] in many and time.perf_counter() - began < 5


def test_main_text_odd_pages(spark):
    w = H.learn_weights({})
    long = "<article>" + "".join(f"<p>paragraph number {k} of a very long page</p>" for k in range(20000)) + "</article>"
    rows = [(1, "u", long, "t", 7, "n"), (2, "u", "<p>one two</p><hr><p>one two</p>", None, None, None), (2, "u", "<p>one two</p><hr><p>one two</p>", None, None, None), (3, None, " ", "x", 1, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, id string")
    got = H.extract_text(pages, w)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted(got.collect(), key=lambda r: (r.page_id, r.n_chars))
    assert [r.page_id for r in got] == [1, 2, 2, 3] and got[0].text.count("\n\n") == 19999 and got[1].text == got[2].text and got[3].text == ""


# --- pieces ---

def test_pieces(spark, sf_dir, odd, none):
    import sentencepiece

    model = read_model(registry.default_model())
    pieces, plain = Pieces(model), sentencepiece.SentencePieceProcessor(model_file=registry.default_model())
    rng = random.Random(21)
    parts = [" ", "  ", "   ", "▁", "▁▁", " " * 17, "a", "Ḁ", "é", "日本", "🙂", "\n", "\t", "<s>", "<0x0A>", "token", "ing", "he", "ll", "\x00", "1", "23", "ß", "the ", " of", "﻿"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    texts += [" " * k + "x" * (k % 3) for k in range(70)] + ["x" * 3000, "🙂" * 2000, "ab" * 5000 + " c"]
    for t in texts:
        n, said, back = pieces.encoded(t)
        ids = plain.encode(t)
        assert said == ",".join(map(str, ids)) and n == len(ids) and back == plain.decode(ids), t
    for a in rng.sample(sorted(pieces.ids), 60):
        for b in rng.sample(sorted(pieces.ids), 60):
            if not (a.strip("▁") and b.strip("▁")) or len(pieces.merge(a)) > 1 or len(pieces.merge(b)) > 1:
                continue
            assert pieces.compatible(a, b) == (pieces.merge(a + b) == [a, b]), (a, b)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in registry.QUERIES["op10_piece_codec"](spark, sf_dir).collect():
        ids = plain.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(plain.decode(ids).encode()).hexdigest()
    got = {r.doc_id: r.ids for r in piece_ids(odd, model).collect()}
    assert got[100] == [] and got[106] == plain.encode(odd_rows()[-1][1])
    assert piece_digests(odd, model).count() == len(odd_rows()) and piece_digests(none, model).count() == 0
