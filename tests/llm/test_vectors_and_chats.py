"""Whitening, chat formatting and the prefix trie against plain versions and odd inputs."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernstone.llm import chat as C
from quernstone.llm import prefix_trie as T
from quernstone.llm import registry
from quernstone.llm import whitening as W

VECTORS = "vec_id long, embedding array<float>, label int, v string, n int"
CHATS = "conv_id long, turn long, role string, text string, segment string, part int"


# --- whitening ---

def plain_whitening(rows, k=8):
    kept = [(i, v) for i, v, *_ in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for _, v in kept], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [int(d) for d in ((n * x - s) ** 2).sum(axis=1)]
    y = (x - s / n).astype(float)
    e, u = np.linalg.eigh(y.T @ y / n)
    return [i for i, _ in kept], n, deviation, y, e[::-1][:k], u.T[::-1][:k], e.sum()


def check_whitening(rows, got, k):
    ids, n, deviation, y, e, u, trace = plain_whitening(rows, k)
    assert len(got) == len(ids) * k
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, k + 1))
    assert sorted((str(r.vec_id), r.deviation) for r in got if r.component == 1) == sorted((str(i), d) for i, d in zip(ids, deviation, strict=True))
    for c in range(k):
        mine = sorted((str(r.vec_id), r.whitened) for r in got if r.component == c + 1)
        want = sorted(zip(map(str, ids), y @ u[c] / np.sqrt(e[c]), strict=True))
        sign = np.sign(sum(a * b for (_, a), (_, b) in zip(mine, want, strict=True))) or 1
        assert np.allclose([v for _, v in mine], [sign * v for _, v in want], atol=1e-9)
        assert {round(r.explained / (e[c] / trace), 9) for r in got if r.component == c + 1} == {1.0}
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_whitening(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(400, 12)) * np.linspace(1, 3, 12) + 5
    rows = [(k, [float(np.float32(c)) for c in v], None, None, 1) for k, v in enumerate(base)]
    rows += [(None, rows[0][1], 1, "x", None), rows[5], rows[5]]  # a null id and repeated rows stay
    left_out = [(1000, None, None, None, None), (1001, rows[1][1][:-1] + [None], 0, "", 1), (1002, [float("nan")] * 12, 0, "", 1), (1003, [float("-inf")] + rows[1][1][1:], 0, "", 1)]
    df = spark.createDataFrame(rows + left_out, VECTORS).repartition(5)
    got = W.whitened_rows(df, W.fit_whitening(df)).collect()
    check_whitening(rows, got, 8)
    assert W.fit_whitening(df).sums == W.fit_whitening(df.repartition(2)).sums


def test_whitening_small_tables(spark):
    """Fewer dimensions than components, one vector, none, equal ones, other lengths, entries beyond any integer."""
    rows = [(k, [float(k % 7), float(k % 3)], None, None, None) for k in range(50)]
    df = spark.createDataFrame(rows, VECTORS)
    check_whitening(rows, W.whitened_rows(df, W.fit_whitening(df)).collect(), 2)
    odd = spark.createDataFrame([*rows, (90, [], 1, "", 1), (91, [1.0], 1, "", 1), (92, [1.0, 2.0, 3.0], 1, "", 1)], VECTORS)
    check_whitening(rows, W.whitened_rows(odd, W.fit_whitening(odd)).collect(), 2)
    for same in (rows[:1], [rows[4]] * 3):
        flat = spark.createDataFrame(same, VECTORS)
        got = W.whitened_rows(flat, W.fit_whitening(flat)).collect()
        assert len(got) == 2 * len(same) and {(r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(0, 0.0, 0.0, 1.0)}
    none = df.limit(0)
    assert W.whitened_rows(none, W.fit_whitening(none)).collect() == []
    empty = spark.createDataFrame([(1, [], 1, "", 1)], VECTORS)
    assert W.whitened_rows(empty, W.fit_whitening(empty)).collect() == []
    huge = spark.createDataFrame([(k, [3e38 * (-1) ** k, float(k)], None, None, None) for k in range(9)], VECTORS)
    assert {r.deviation for r in W.whitened_rows(huge, W.fit_whitening(huge)).collect()} == {None}
    wide = spark.createDataFrame([(k, [1e9 * (-1) ** k, 0.0]) for k in range(4)], "vec_id long, embedding array<double>")
    assert {int(r.deviation) for r in W.whiten(wide, W.fit_whitening(wide)).collect()} == {(4 * 1024 * 10**9) ** 2}


def test_whitening_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(W, "_BLOCK", 24)
    rows = [(k, [float((k * p) % 11) for p in (1, 2, 3, 5)], None, None, None) for k in range(60)]
    df = spark.createDataFrame(rows, VECTORS)
    column = df.toArrow().column("embedding").combine_chunks()
    assert [len(x) for _, x in W._blocks(column, 1024.0, 100_000)] == [6] * 10


# --- chat ---

def odd_chats():
    rng = random.Random(4)
    out = []
    for c in range(40):
        for t in range(rng.randint(1, 9)):
            out.append((c, t, rng.choice(["system", "user", "assistant", "assistant", "tool"]), rng.choice(["", "hello", "a <|im_end|> b", "<\\|", "<", "<<\\\\|x", "|>", "\\", "é🙂\n\n", "<|im_start|>assistant\n"]), "s", 1))
    out += [(50, None, "user", "first by null", None, None), (50, 0, None, None, None, None), (50, -3, "user\n<|im_start|>", "\\n", None, None), (51, 0, "user", "q", "", 0), (51, 0, "user", "q", "", 0), (51, 0, "assistant", "same turn", "", 0)]
    out += [(None, 0, "user", "no id", None, 1), (None, 1, "assistant", "x" * 300_000 + "<|", None, 1), (60, 0, "assistant\\n", "a role of its own", None, 2)]
    return out


def in_order(rows):
    by = defaultdict(list)
    for c, t, role, text, *_ in rows:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_chats(spark):
    df = spark.createDataFrame(odd_chats(), CHATS).repartition(3)
    segments = C.format_chats(df)
    whole, flags = defaultdict(str), defaultdict(list)
    for r in sorted(segments.collect(), key=lambda r: (str(r.conv_id), r.segment)):
        whole[r.conv_id] += r.text
        flags[r.conv_id].append((r.text, r.loss))
    digests = {r.conv_id: r for r in C.chat_digests(segments).collect()}
    read = defaultdict(list)
    for r in C.read_chats(segments).collect():
        read[r.conv_id].append((r.turn, r.role, r.text, r.learnt))
    want = in_order(odd_chats())
    assert set(want) == set(digests) == set(whole)
    for c, turns in want.items():
        d = digests[c]
        learnt = "".join(x for r, x in turns if r == "assistant")
        assert whole[c].count("<|") == 2 * len(turns)  # no text holds a mark
        assert d.n_turns == len(turns) and d.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert d.loss_chars == len(learnt) and d.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
        assert d.formatted_chars == len(whole[c])
        assert [(r, x) for _, r, x, _ in sorted(read[c])] == turns
        assert "".join(x for *_, x in sorted(read[c])) == learnt
        # found by the marks, wherever the text is cut
        again = list(C.Template.of(C.CHATML).read((ch, False) for ch in whole[c])) if len(whole[c]) < 2000 else []
        assert not again or [t[:2] for t in again] == turns
    assert C.chat_digests(C.format_chats(df.limit(0))).collect() == []


@pytest.mark.parametrize("roles,valid,states", [
    ("user assistant", True, "asked answered"), ("system user assistant user assistant", True, "primed asked answered asked answered"), ("user", False, "asked"), ("assistant user", False, "refused refused"),
    ("user system assistant", False, "asked refused refused"), ("system system", False, "primed refused"), ("user user", False, "asked refused"), ("user tool", False, "asked refused"),
])
def test_chat_machine(spark, roles, valid, states):
    df = spark.createDataFrame([(1, k, r, "x") for k, r in enumerate(roles.split())], "conv_id long, turn long, role string, text string")
    segments = C.format_chats(df)
    assert [r.state for r in segments.where("segment % 3 = 0").orderBy("segment").collect()] == states.split()
    assert C.chat_digests(segments).collect()[0].valid is valid


def test_chat_template():
    t = C.Template.of(C.CHATML)
    for text in ["<|", "<\\|", "<\\\\|", "<<|", "<|<|", "a<", "|", "<\\", "\\<|\\", "<\\<|"]:
        assert t.unescape(t.escape(text)) == text and "<|" not in t.escape(text)
        assert t.unescape_role(t.escape_role(text + "\n" + text)) == text + "\n" + text and "\n" not in t.escape_role("\n" + text)
    for bad in ({"opener": "<"}, {"opener": "<<"}, {"before": "<|x|>"}, {"before": "x{role}\n"}, {"after": "end"}, {"after": "<|im_start|>"}, {"before": "<|a<|{role}\n"}, {"accept": ["nowhere"]}, {"start": "refused"}):
        with pytest.raises(ValueError):
            C.Template.of(C.CHATML | bad)
    with pytest.raises(ValueError):
        list(t.read([("<|im_start|>user\nno end", False)]))
    with pytest.raises(ValueError):
        list(t.read([("stray<|im_end|>\n", False)]))
    # another template
    plain = C.Template.of(C.CHATML | {"opener": "[/", "before": "[/ {role}\n", "after": "[/]\n", "loss": ["user", "assistant"]})
    pieces = [p for role, text in [("user", "[/]\n"), ("assistant", "[\\/")] for p in plain.segments(role, text)]
    assert [(r, x, y) for r, x, y, _ in plain.read(iter(pieces))] == [("user", "[/]\n", "[/]\n"), ("assistant", "[\\/", "[\\/")]


# --- trie ---

def plain_trie(convs):
    """Nodes of {conv_id: turns}, each from the definition."""
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in nodes:
        if k:
            children[k[:-1]].append(k)

    def below(k):
        todo = [k]
        while todo:
            x = todo.pop()
            yield x
            todo += children[x]

    size = lambda k: len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = sorted(c for c in members if len(convs[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else None, len(members), len(children[k]), sum(not children[x] for x in below(k)), sum((len(nodes[x]) - 1) * size(x) for x in below(k)), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    return out


def trie_rows(df):
    return sorted([(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()], key=str)


def few_turns(seed, n=120, longest=9):
    """Conversations that share many beginnings, some of them whole."""
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", ""]), "s", 1) for c in rng.sample(range(400), n) for t in range(rng.randint(1, longest))]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie(spark, seed):
    rows = few_turns(seed)
    convs = in_order(rows)
    keys = T.turn_keys(spark.createDataFrame(rows, CHATS).repartition(3))
    assert trie_rows(T.prefix_trie(keys)) == plain_trie(convs)
    assert trie_rows(T.prefix_trie(T.share_prefixes(keys))) == plain_trie(rebuilt(convs))


def test_trie_merges(spark):
    """Many small partial tries, merged in pairs, with lists in pieces of two ids; a long conversation; turnless ones."""
    rows = few_turns(3, 150, 4) + [(1000, t, "user", str(t), "", 1) for t in range(700)] + [(1001, t, "user", str(t), "", 1) for t in range(650)] + [(2000 + c, 0, "user", "hot", "", 1) for c in range(200)]
    convs = rebuilt(in_order(rows))
    assert any(not t for t in convs.values())  # their base is absent and they have few turns
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        paths = T.prefix_paths(T.share_prefixes(T.turn_keys(spark.createDataFrame(rows, CHATS))))
        assert paths.agg(F.max("part")).collect()[0][0] >= 8
        partial = T.partial_tries(paths, max_nodes=7)
        assert partial.count() > partial.select("node", "part").distinct().count()  # several tables of a range
        merged = T.merge_tries(partial, 1, 2)
        assert merged.agg(F.sum("n")).collect() == partial.agg(F.sum("n")).collect()
        assert merged.agg(F.max(F.length("ids"))).collect()[0][0] <= 8 * 7
        nodes = T.merged_nodes(paths, bits=1, max_nodes=7, piece=2)
        assert trie_rows(T.roll_up(nodes, paths)) == plain_trie(convs)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_trie_odd(spark):
    """Null ids are left out; null turns come first; null roles and texts are empty; repeated turns count."""
    rows = [(5, None, None, None, None, None), (5, 1, "user", "x", "", 1), (6, 0, "", "", "", 1), (6, 1, "user", "x", "", 1), (7, 0, "us", "erx", "", 1), (8, 0, "user", "x", "", 1), (8, 0, "user", "x", "", 1), (None, 0, "user", "x", "", 1), (-3, 0, "user", "y" * 100_000, "", 1)]
    convs = in_order(rows)
    convs.pop(None)
    keys = T.turn_keys(spark.createDataFrame(rows, CHATS))
    assert trie_rows(T.prefix_trie(keys)) == plain_trie(convs)
    assert T.prefix_trie(T.share_prefixes(T.turn_keys(spark.createDataFrame([], CHATS)))).collect() == []


def test_queries(spark, sf_dir):
    added = registry.op12_chat_format(spark, sf_dir).where("conv_id = -1").collect()
    text = registry.MARKED
    assert [(r.n_turns, r.loss_chars, r.loss_sha256, r.valid) for r in added] == [(2, len(text), hashlib.sha256(text.encode()).hexdigest(), True)]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_whitening([tuple(r) for r in vectors], registry.op11_embedding_whitening(spark, sf_dir).collect(), 8)
