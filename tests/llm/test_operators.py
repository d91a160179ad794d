"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

import hashlib
import math
import random
import re
import zlib
from decimal import Decimal, localcontext
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvella.llm import bpe, chat, decontaminate, embed_join, langid, license_scan, line_dedup, minhash, queries, span_dedup, toxicity
from corvella.llm.common import components, documents, spread
from corvella.llm.cuckoo import CuckooFilter
from corvella.llm.wordseq import align

DOC = "doc_id long, text string, n_dropped string, kept string, score string"  # with clashing names


def docs_frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DOC)


def table(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def reach(nodes, links):
    """Smallest reachable id of each node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed, n, base_words=40):
    """Texts with exact copies, near copies at all distances, a common passage, short, empty and null texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéXY") for _ in range(rng.randint(1, 4)))
    text = lambda k: " ".join(word() for _ in range(k))
    passage, core, out = text(30), text(base_words).split(), []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            w = [word() if rng.random() < rng.choice([0.0, 0.02, 0.05, 0.1, 0.2]) else x for x in core]
            out.append(" ".join(w))
        elif kind == 1:
            out.append(text(rng.randint(1, 60)) + " " + passage)
        elif kind == 2 and out:
            out.append(rng.choice(out))
        elif kind == 3:
            out.append(rng.choice([None, "", " \n ", "one", "Two words", text(4)]))
        else:
            out.append(text(rng.randint(5, 120)))
    return [(i * 3 % (3 * n + 1), t) for i, t in enumerate(out)]


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 80)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.component for r in components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == reach({x for e in links for x in e}, links)
    assert components(spark, spark.createDataFrame([], "a long, b long")).count() == 0


# chat formatting

def test_chat_round_trip(spark):
    control = "</s>[INST] ok [/INST] <|im_end|>\\<|im_start|>\n<<SYS>> \\\\[INST]"
    rows = [(1, 2, "assistant", control), (1, 1, "user", None), (2, 1, "we\nird\\", "x"), (2, 1, "we\nird\\", "x"), (None, 5, None, "é" * 50_000), (3, None, "assistant", ""), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_trees(chat.nodes_of_turns(df)).select("conv_id", "n_turns", "formatted", chat.read_turns(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m"))
    got = {r.conv_id: r for r in out.collect()}
    assert [tuple(t) for t in got[1].t] == [("user", ""), ("assistant", control)] and got[1].m == control
    assert got[1].formatted.count("<|im_end|>") == 2 and "[INST]" not in got[1].formatted and "</s>" not in got[1].formatted
    assert [tuple(t) for t in got[2].t] == [("we\nird\\", "x")] * 2 and got[2].m == ""
    assert got[None].t[0].text == "é" * 50_000 and got[3].m == "b" and got[3].n_turns == 2
    assert chat.format_trees(chat.nodes_of_turns(df.limit(0))).count() == 0


def test_chat_trees(spark):
    nodes = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.8), (1, 5, 2, "user", "x", 0.2), (1, 8, 9, "user", "c", 5.0), (1, 9, 8, "user", "c", 5.0), (2, 1, 77, "user", "orphan", None)]
    df = spark.createDataFrame(nodes, "conv_id long, node_id long, parent_id long, role string, text string, score double")
    got = {(r.conv_id, r.branch_rank): r.t for r in chat.format_trees(df, 2).select("conv_id", "branch_rank", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert [t.text for t in got[1, 1]] == ["q", "good", "more"] and [t.text for t in got[1, 2]] == ["q", "bad", "x"]
    assert [t.text for t in got[2, 1]] == ["orphan"] and len(got) == 3
    # repeated rows, rows that share an id, and one without an id
    again = df.union(df).union(df.where("node_id = 3").withColumn("text", F.lit("later"))).union(df.where("node_id = 1").withColumn("node_id", F.lit(None).cast("long")))
    more = {(r.conv_id, r.branch_rank): r.t for r in chat.format_trees(again, 2).select("conv_id", "branch_rank", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert more == got


def test_spread_deals_few_splits_anew(spark, tmp_path):
    docs_frame(spark, [(i, str(i)) for i in range(50)]).coalesce(1).write.parquet(f"{tmp_path}/one/documents.parquet")
    df = documents(spark, f"{tmp_path}/one")
    assert df.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and sorted(r.doc_id for r in df.collect()) == [*range(50)]
    enough = spark.range(100, numPartitions=spark.sparkContext.defaultParallelism)
    assert spread(enough) is enough


# embeddings

def test_ego_join_brute(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12))
    for i in range(60):
        x[100 + i] = x[i % 20] + rng.normal(size=12) * rng.choice([0.05, 0.2, 0.35])
    x[200:230] = x[0]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] * 12), (904, [None] + [1.0] * 11), (905, [float("inf")] + [0.0] * 11), (906, [1.0, 0.0]), (907, [2.0, 0.0]), (7, x[7].astype(np.float32).tolist()), (None, [1.0] * 12)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n_links int")
    got = table(embed_join.ego_join(df, 0.9, chunk=12 * 25), "vec_id")
    v = {i: np.array(e, float) for i, e in rows if i is not None and e and None not in e and np.isfinite(np.array(e, float)).all() and any(e)}
    links = [(a, b) for a, b in combinations(v, 2) if len(v[a]) == len(v[b]) and v[a] @ v[b] / np.sqrt(v[a] @ v[a] * (v[b] @ v[b])) >= 0.9]
    ids = {i for i, _ in rows if i is not None}
    root = reach(ids, links)
    assert got == {i: {"vec_id": i, "n_links": sum(i in e for e in links), "component_id": root[i], "kept": root[i] == i} for i in ids}
    assert len(links) > 400 and embed_join.ego_join(df.limit(0)).count() == 0


def test_ego_join_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    base = [3.0, 4.0, 0.0, 12.0]  # length 13
    near = [[9.0, 0.0, 0.0, math.sqrt(19.0)], [9.0, math.sqrt(19.0), 0.0, 0.0], [0.9, 0.0, 0.0, math.sqrt(0.19)], [math.nextafter(0.9, 0), 0.0, 0.0, math.sqrt(0.19)]]
    x = [[1.0, 0.0, 0.0, 0.0], base, *near, *(rng.normal(size=(40, 4)) * 1e-3 + [1, 0, 0.4843, 0]).tolist()]
    got = table(embed_join.ego_join(spark.createDataFrame([(i, v) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), 0.9, chunk=40), "vec_id")

    def cosine(a, b):  # to 60 digits, then rounded once
        with localcontext(prec=60):
            a, b = [Decimal(v) for v in a], [Decimal(v) for v in b]
            dot = lambda p, q: sum(s * t for s, t in zip(p, q))
            return float(dot(a, b) / (dot(a, a) * dot(b, b)).sqrt())

    links = [(a, b) for a, b in combinations(range(len(x)), 2) if cosine(x[a], x[b]) >= 0.9]
    assert {i: r["n_links"] for i, r in got.items()} == {i: sum(i in e for e in links) for i in range(len(x))}
    assert embed_join._reaches(np.array(x[0]), np.array(x[2]), 0.9) == (cosine(x[0], x[2]) >= 0.9)


# lines

def brute_lines(rows, least=10):
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for k in {key(s) for s in (t or "").split("\n")}:
            if i is not None and len(k) >= least:
                held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if i is None or len(held.get(key(s), ())) < 2 or min(held[key(s)]) == i]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


LINES = [(5, "A common header LINE\nown text of five\n\n"), (2, " a common header line\t\nshort\nshort"), (9, "short\nÉcole est là ici\nÉcole est là ici"), (8, "école est là ici\nA common header line"), (3, None), (4, ""), (None, "A common header line"), (11, "\n".join(["A common header line"] * 2000 + ["x" * 90_000]))]


def test_lines(spark):
    out = line_dedup.dedupe_lines(docs_frame(spark, LINES))
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()} == brute_lines(LINES)
    assert line_dedup.dedupe_lines(docs_frame(spark, [])).count() == 0
    twice = docs_frame(spark, LINES[:1] * 2)
    assert [r.n_dropped for r in line_dedup.dedupe_lines(twice).collect()] == [0, 0]


def test_lines_are_reversible(spark):
    first, more = docs_frame(spark, LINES[1:6]), docs_frame(spark, LINES[:1] + LINES[7:])
    index = line_dedup.LineIndex.build(first).insert(more)
    rows = [x for x in LINES if x[0] is not None]
    texts = lambda i, r: {x.doc_id: x.text for x in i.apply(docs_frame(spark, r)).collect()}
    assert texts(index, rows) == {k: v[0] for k, v in brute_lines(rows).items()}
    left = [x for x in rows if x[0] != 2]
    assert texts(index.delete(spark.createDataFrame([(2,)], "doc_id long")), left) == {k: v[0] for k, v in brute_lines(left).items()}


def test_line_filters_change_with_their_keys(spark):
    line = lambda k: f"a line that says {k}"
    rows = [(i, "\n".join(line(k) for k in range(i, i + 30))) for i in range(60)]
    blobs = lambda x: {r.shard: bytes(r.blob) for r in x.filters.collect()}
    index = line_dedup.LineIndex.build(docs_frame(spark, rows))
    before = blobs(index)
    more = index.insert(docs_frame(spark, [(500, line("new")), (501, line("new"))]))
    after = blobs(more)
    assert more.shards == index.shards and sum(before.get(k) != v for k, v in after.items()) == 1
    less = more.delete(spark.createDataFrame([(501,)], "doc_id long"))
    assert {k: v for k, v in blobs(less).items() if any(v)} == before
    # so many keys that filters are too full, then all gone again
    grown = less.insert(docs_frame(spark, [(i, "\n".join(line(f"more {k}") for k in range(3000))) for i in (600, 601)]))
    both = rows + [(500, line("new"))] + [(i, "\n".join(line(f"more {k}") for k in range(3000))) for i in (600, 601)]
    assert {r.doc_id: r.text for r in grown.apply(docs_frame(spark, both)).collect()} == {k: v[0] for k, v in brute_lines(both).items()}
    back = grown.delete(spark.createDataFrame([(i,) for i in (500, 600, 601)], "doc_id long"))
    assert {r.doc_id: r.text for r in back.apply(docs_frame(spark, rows)).collect()} == {k: v[0] for k, v in brute_lines(rows).items()}
    assert sorted(back.refs.collect()) == sorted(index.refs.collect())


def test_cuckoo():
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, size=(50_000, 2))
    f = CuckooFilter.build(h[:20_000, 0], h[:20_000, 1])
    f = CuckooFilter.from_bytes(f.to_bytes())
    assert f.contains(h[:20_000, 0], h[:20_000, 1]).all() and f.contains(h[20_000:, 0], h[20_000:, 1]).mean() < 0.002
    assert f.delete(h[:500, 0], h[:500, 1]) == 500 and f.contains(h[500:20_000, 0], h[500:20_000, 1]).all()
    assert f.contains(h[:500, 0], h[:500, 1]).mean() < 0.05 and CuckooFilter.build(h[:0, 0], h[:0, 1]).contains(h[:3, 0], h[:3, 1]).sum() == 0


# near duplicates

def brute_near(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = reach(sets, links)
    return {i: {"doc_id": i, "n_shingles": len(s), "component_id": root[i], "kept": root[i] == i} for i, s in sets.items()}, links


@pytest.mark.parametrize("seed,words", [(1, 40), (2, 400)])
def test_near_duplicates_brute(spark, seed, words, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", 16)  # hot lists in blocks
    rows = corpus(seed, 260, words)
    expected, links = brute_near(rows)
    assert table(minhash.near_duplicates(docs_frame(spark, rows))) == expected and len(links) > 100


def test_near_duplicates_edges(spark):
    assert minhash.near_duplicates(docs_frame(spark, [])).count() == 0
    got = table(minhash.near_duplicates(docs_frame(spark, [(7, "a b"), (7, "a b"), (3, "A  B"), (None, "a b"), (9, None)])))
    assert {k: v["component_id"] for k, v in got.items()} == {7: 3, 3: 3, 9: 9} and not got[7]["kept"]


def test_cell_links_brute():
    rng = np.random.default_rng(12)
    for crossed in (False, True):
        sets, pool = [], [rng.integers(0, 1 << 62, n) for n in (40, 500, 1500, 5000)]
        for k in range(120):  # copies of four sizes at similarities around the limit, and strangers
            own = rng.choice(pool[k % 4], int(len(pool[k % 4]) * rng.uniform(0.8, 1)), replace=False)
            sets.append(np.unique(np.r_[own, rng.integers(0, 1 << 62, int(len(own) * rng.uniform(0, 0.08)))]))
        label, side = rng.integers(0, 100, 120), rng.integers(0, 2, 120) if crossed else np.zeros(120, int)
        got = minhash.cell_links(label, side, sets, 75)
        jaccard = lambda a, b: len(np.intersect1d(a, b)) * 100 >= 75 * len(np.union1d(a, b))
        assert all(jaccard(sets[a], sets[b]) for a, b in got) and len(got) > 20
        same = [(1000 + int(label[k]), k) for k in range(120)]  # rows of a label are linked already
        wanted = [(a, b) for a, b in combinations(range(120), 2) if (not crossed or side[a] != side[b]) and jaccard(sets[a], sets[b])]
        nodes = [*range(120), *{a for a, _ in same}]
        assert reach(nodes, same + got) == reach(nodes, same + wanted) and len(got) < 120


# spans

def test_spans(spark):
    rng = random.Random(2)
    sentence = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(12)).capitalize() + "."
    shared = " ".join(sentence() for _ in range(4))
    rows = [(4, f"Own start of four. {shared} Own end of four."), (2, f"Own start of two. {shared}\nOwn end of two."), (6, shared.upper()), (1, None), (3, ""), (5, "Short. Very. So."), (8, "Short. Very. So."), (None, shared)]
    rows += [(9, " ".join(["word"] * 60) + "."), (10, "x. " + " ".join(["word"] * 60) + "."), (11, " \n\t "), (12, f"  before the passage {shared} behind it")]
    got = {r.doc_id: r for r in span_dedup.dedupe_spans(docs_frame(spark, rows)).collect()}
    assert got[2].text == rows[1][1] and got[4].text == "Own start of four. Own end of four." and got[6].text == ""
    assert (got[4].n_sentences, got[4].n_dropped, got[2].n_dropped) == (6, 4, 0)
    assert got[1].text == "" and got[1].n_sentences == 0 and got[11].text == " \n\t "
    assert got[5].text == got[8].text == "Short. Very. So." and got[None].text == shared
    assert got[9].n_dropped == 0 and got[10].text == "x. "
    # in the midst of another sentence: the host's own words may only lose their neighbours in the piece
    assert got[12].text.startswith("  before") and len(got[12].text.split()) < 20
    assert span_dedup.dedupe_spans(docs_frame(spark, [])).count() == 0


def brute_spans(rows, least=30, reach=4):
    digest = lambda w: hashlib.md5(w.encode()).hexdigest()[:15]
    every, cut = [], {}
    for i, t in rows:
        raw = [m.group() for m in re.finditer(r"[^ \t-\r]+[ \t-\r]*", t)]
        words = [w.split()[0].lower() for w in raw]
        ends = [k + 1 for k, w in enumerate(words) if w[-1] in ".!?" or "\n" in raw[k] or k + 1 == len(words)]
        pieces = []
        for a, b in zip([0, *ends], ends):
            d = [digest(w) for w in words[a:b]]
            pieces += [a] + [a + k for k in range(reach, b - a - reach) if d[k] < min(d[k - reach : k]) and d[k] <= min(d[k + 1 : k + 1 + reach])]
        closes = [*pieces[1:], len(words)] if pieces else []
        own = {(s, e) for s in pieces for e in [min((e for e in closes if e >= s + least), default=None)] if e}
        own |= {(max(s for s in pieces if s + least <= e), e) for e in ends if e >= least and e not in {z for _, z in own}}
        every += [(tuple(words[s:e]), i, s, e) for s, e in own]
        cut[i] = (t, raw, set())
    first = {}
    for key, i, s, _ in sorted(every, key=lambda x: x[1:3]):
        first.setdefault(key, (i, s))
    for key, i, s, e in every:
        if first[key] != (i, s):
            cut[i][2].update(range(s, e))
    return {i: t[: len(t) - len("".join(raw))] + "".join(w for k, w in enumerate(raw) if k not in gone) for i, (t, raw, gone) in cut.items()}


def test_spans_brute(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice(["", "", ",", "x"])
    pool = [" ".join(word() for _ in range(rng.choice([1, 3, 8, 15, 40]))) + rng.choice([". ", ".\n", "! ", "\n\n", " "]) for _ in range(30)]
    rows = [(i, rng.choice(["", " "]) + "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))) for i in range(80)]
    expected = brute_spans(rows)
    assert {r.doc_id: r.text for r in span_dedup.dedupe_spans(docs_frame(spark, rows)).collect()} == expected
    assert sum(expected[i] != t for i, t in rows) > 20


def test_spans_find_passages_wherever_they_begin(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    prose = lambda n: "".join(word() + rng.choice([" "] * 11 + [", ", ". "]) for _ in range(n)).strip()
    rows = []
    for k in range(200):
        passage = prose(rng.randint(51, 70))
        rows += [(2 * k, f"{prose(rng.randint(0, 40))} {passage} {prose(40)}"), (2 * k + 1, f"{prose(rng.randint(0, 40))} {passage} {prose(40)}")]
    rows += [(1000 + k, prose(rng.randint(1, 300))) for k in range(100)]
    got = {r.doc_id: r.n_dropped for r in span_dedup.dedupe_spans(docs_frame(spark, rows)).collect()}
    assert sum(got[2 * k + 1] > 0 for k in range(200)) >= 195 and not any(got[2 * k] for k in range(200)) and not any(got[1000 + k] for k in range(100))


def test_spans_of_short_lines_and_of_text_without_spaces(spark):
    menu = [f"item{i}" if i % 2 else f"item {i}" for i in range(60)]
    rng = random.Random(15)
    glyphs = lambda n: "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(n))
    lines, line = [glyphs(150) for _ in range(4)], glyphs(900)
    rows = [(i, "\n".join([f"own start {i}", *common, f"own end {i}"])) for i, common in enumerate([menu, menu, lines, lines, [line], [line]])]
    rows += [(6, "。".join(glyphs(20) for _ in range(9)) + line + glyphs(200)), (8, " \n" * 50_000), (9, "a\nb\nc"), (10, "a\nb\nc"), (11, "x" * 100_000)]
    got = {r.doc_id: r.text for r in span_dedup.dedupe_spans(docs_frame(spark, rows)).collect()}
    assert all(got[i] == dict(rows)[i] for i in (0, 2, 4, 8, 9, 10, 11))
    assert all(got[i] == f"own start {i}\nown end {i}" for i in (1, 3, 5)) and len(got[6]) < len(rows[6][1]) - 600  # less its first and last piece


# language

@pytest.mark.parametrize("k", [3, 30])
def test_marginals_are_exact(k):
    rng = np.random.default_rng(0)
    sizes = np.array([0, 1, 31, 32, 33, 100, 0])
    e, t, at = rng.random((sizes.sum(), k)) + 0.01, rng.random((k, k)) + 0.1, 0
    got = langid.marginals(e, sizes, t)
    for n in sizes:
        own = e[at : at + n]
        a, b = np.full(k, 1 / k), [np.ones(k)]
        for j in range(n - 1, 0, -1):
            b.insert(0, t @ (own[j] * b[0]))
        for j in range(n):
            a = (a @ t) * own[j]
            assert np.allclose(a * b[j] / (a * b[j]).sum(), got[at + j])
        at += n


def test_language_held_out(spark):
    """The query's accuracy on held-out documents, and its rows against predictions of one text at a time."""
    rng = random.Random(41)
    syllables = {f"l{k}": ["".join(rng.choice("abcdefghijklmno") for _ in range(2)) for _ in range(25)] for k in range(30)}
    word = lambda k: "".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3)))
    rows = [(i, " ".join(word(f"l{i % 30}") for _ in range(rng.randint(10, 60))), f"l{i % 30}") for i in range(1500)] + [(None, "null id", "l0")] * 400
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(df)
    got = table(langid.predict(df, model))
    held = [i for i, _, _ in rows if i is not None and got[i]["held_out"]]
    assert len(model.languages) == 30 and sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held) > 300
    one = model.predictor()
    for i in range(0, 1500, 100):
        lang, score = one([rows[i][1]])[0]
        assert lang == got[i]["lang_pred"] and abs(score - got[i]["score"]) < 1e-9


def test_language(spark):
    rng = random.Random(2)
    kinds = {"xx": ["the", "thing", "ther", "and"], "yy": ["une", "été", "deux", "eau"]}
    rows = [(i, " ".join(rng.choice(kinds[k]) + rng.choice(["", "s", ","]) for _ in range(30)), k) for i, k in enumerate(["xx", "yy"] * 60)]
    df = spark.createDataFrame([(*r, "s") for r in [*rows, (500, None, "xx"), (501, "12 !!", "yy"), (502, "", None)]], "doc_id long, text string, lang string, score string")
    model = langid.train(df)
    got = table(langid.predict(df, model))
    assert all(got[i]["lang_pred"] == k for i, _, k in rows) and all(0 <= r["score"] <= 1 for r in got.values())
    assert {got[i]["lang_pred"] for i in (500, 501, 502)} == {"und"} and all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    mixed = model.predictor()(["the thing and ther the and thing " * 3 + "une été deux eau " * 2, "été"])
    assert mixed[0][0] == "xx" and mixed[1][0] == "yy"
    assert langid.predict(df.limit(0), None).count() == 0 and {r.lang_pred for r in langid.predict(df, langid.train(df.limit(0))).collect()} == {"und"}


def test_language_of_text_without_spaces(spark):
    rng = random.Random(11)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    kinds = {"xx": "abcdefgh", "yy": "стуфхцчш"}
    df = spark.createDataFrame([(i, word(kinds[k], 120), k) for i, k in enumerate(["xx", "yy"] * 60)], "doc_id long, text string, lang string")
    predict = langid.train(df).predictor()
    # the first 40 and the last letters are of the other language
    assert [x for x, _ in predict([word(kinds["xx"], 40) + word(kinds["yy"], 400) + word(kinds["xx"], 4), word(kinds["yy"], 40) + word(kinds["xx"], 400) + word(kinds["yy"], 4)])] == ["yy", "xx"]
    assert {langid.features_of("a" * 60 + "bcd", {}).count(x) for x in ("abc", "bcd")} == {1}


# toxicity

def test_toxicity(spark):
    rng = random.Random(3)
    plain = lambda: [rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(40)]
    rows, labels = [], []
    for i in range(240):
        bad = i % 3 == 0
        rows.append((i, " ".join(plain() + (["vile", "nasty", "vile"][: rng.randint(1, 3)] if bad else []))))
        labels.append((i, int(bad)))
    df, lab = docs_frame(spark, [*rows, (900, None), (901, "")]), spark.createDataFrame([*labels, (None, 1), (5, None), (7777, 1)], "doc_id long, toxic int")
    model = toxicity.train(df, lab)
    got = table(toxicity.score(df, model))
    assert all(got[i]["rejected"] == bool(t) for i, t in labels) and model.thresholds[0] < model.thresholds[1] and (model.weights >= 0).all()
    assert not got[900]["rejected"] and not got[901]["rejected"]
    none = toxicity.score(df, toxicity.train(df, lab.limit(0)))
    assert none.where("rejected").count() == 0 and toxicity.score(df.limit(0), model).count() == 0


def toxic_corpus(rng, n, grades):
    plain = lambda: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 90))]
    bad = ["vile", "nasty", "foul", "rotten", "wicked", "cursed", "dreadful", "hateful"]
    rows = []
    for i in range(n):
        grade, words = rng.choice([0, 0, *range(1, grades + 1)]), plain()
        for _ in range(0 if not grade else 2 if grades == 1 else 2 * grade):
            words.insert(rng.randrange(len(words)), rng.choice(bad) + rng.choice(["", "ly", ","]))
        rows.append((i, " ".join(words), grade))
    return rows


@pytest.mark.parametrize("grades", [1, 3])
def test_toxicity_held_out(spark, grades):
    """Held-out recall and false alarms, severity by grade, and the query's numbers against the model's formula."""
    rows = toxic_corpus(random.Random(40), 1500, grades)
    df = spark.createDataFrame(rows, "doc_id long, text string, grade int")
    labels = spark.createDataFrame([(i, g) for i, _, g in rows if i < 900], "doc_id long, toxic int")
    model = toxicity.train(df, labels)
    got = table(toxicity.score(df, model))
    bad, clean = ([got[i] for i, _, g in rows if i >= 900 and (g > 0) == t] for t in (True, False))
    assert sum(r["rejected"] for r in bad) >= 0.9 * len(bad) and sum(r["rejected"] for r in clean) <= 0.02 * len(clean)
    if grades > 1:
        mean = [np.mean([got[i]["severity"] for i, _, x in rows if i >= 900 and x == g]) for g in range(grades + 1)]
        assert len(model.thresholds) == grades and all(b > a + 0.3 for a, b in zip(mean, mean[1:]))
    for i, t, _ in rows[::50]:
        s = 0.0
        for f, k in model.index.items():
            count = sum(f in toxicity.features_of("".join(c for c in w if c.isalnum())) for w in t.lower().split())
            s += model.weights[k] * math.log(1 + count)
        p = [1 / (1 + math.exp(c - s)) for c in model.thresholds]
        steps = [1, *p, 0]
        assert abs(sum(p) - got[i]["severity"]) < 1e-9 and got[i]["grade"] == int(np.argmax([a - b for a, b in zip(steps, steps[1:])])) and got[i]["rejected"] == (sum(p) >= toxicity.REJECT)


# decontamination

def test_alignment_brute():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(1, 5, rng.integers(1, 9)), rng.integers(0, 5, rng.integers(1, 12))
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert align(a, b)[0] == h.max()
        # within a band: cells outside it stay empty
        low, high = sorted(rng.integers(-6, 7, 2).tolist())
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                if low <= j - i <= high:
                    h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        score, hits, i, i_end, j, j_end = align(a, b, (low, high))
        assert score == h.max() and 2 * hits >= score and i_end - i >= hits <= j_end - j


def test_decontamination(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = [text(30) for _ in range(6)] + [["only", "two"]]
    edited = [w if k % 7 else "changed" for k, w in enumerate(items[1])]
    rows = [(1, text(50) + items[0] + text(50)), (2, text(20) + edited), (3, text(400)), (4, items[2][:8]), (5, text(9) + ["Only,", "TWO!"]), (6, items[0] * 40)]
    df = docs_frame(spark, [*[(i, " ".join(w)) for i, w in rows], (7, None), (8, "")])
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(50, None)], "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 80):
        got = sorted((r.doc_id, r.item_id) for r in decontaminate.matches(df, bench, block_words=block).collect())
        assert got == [(1, 0), (2, 1), (5, 6), (6, 0)]
    r = decontaminate.matches(df, bench).where("doc_id = 1").first()
    assert (r.score, r.start_word, r.end_word) == (1.0, 50, 80)
    assert decontaminate.matches(df, bench.limit(0)).count() == 0 and decontaminate.matches(df.limit(0), bench).count() == 0


def test_decontamination_finds_evenly_edited_copies(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(400)]
    item = [rng.choice(words) for _ in range(40)]
    filler = lambda: [rng.choice(words) for _ in range(30)]
    edited = {step: [f"new{k}" if k % step == step - 1 else w for k, w in enumerate(item)] for step in (4, 5, 6)}
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    for exact in (0, 3):
        rows = [(step, filler() + w + filler()) for step, w in edited.items()] + [(100 + i, filler() + item) for i in range(exact)] + [(200, filler())]
        got = {r.doc_id for r in decontaminate.matches(docs_frame(spark, [(i, " ".join(w)) for i, w in rows]), bench).collect()}
        assert got == {i for i, _ in rows} - {200}


def test_decontamination_brute(spark):
    """The query against whole alignments of every document with every item, edited copies in all degrees."""
    rng = random.Random(31)
    words = [f"w{i}" for i in range(900)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    items = {i: text(rng.choice([5, 9, 20, 40, 70])) for i in range(14)}
    rows = {}
    for i in range(150):
        rate, item = rng.choice([0, 0.05, 0.1, 0.15, 0.2, 0.25]), items[i % 14]
        copy = []
        for w in item:
            kind = rng.random()
            copy += [w] if kind >= rate else rng.choice([[], [rng.choice(words)], [w, rng.choice(words)]])
        rows[i] = text(rng.randint(0, 60)) + (copy if i < 120 else []) + text(rng.randint(0, 60))
    number = {w: k + 1 for k, w in enumerate(words)}
    ids = lambda ws: np.array([number[w] for w in ws], np.int64)
    expected = {(d, i) for d, t in rows.items() for i, it in items.items() if len(t) and align(ids(it), ids(t))[0] >= len(it)}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs_frame(spark, [(i, " ".join(w)) for i, w in rows.items()]), bench).collect()}
    planted = {(d, d % 14) for d in range(120)} & expected
    assert got <= expected and len(got & planted) >= 0.97 * len(planted) > 100


def test_decontamination_of_long_items(spark):
    rng = random.Random(32)
    words = [f"w{i}" for i in range(3000)]
    item = [rng.choice(words) for _ in range(20_000)]
    edited = [w for k, w in enumerate(item) if k % 9]
    df = docs_frame(spark, [(1, " ".join(item[:100] + edited)), (2, " ".join(rng.choice(words) for _ in range(30_000)))])
    got = decontaminate.matches(df, spark.createDataFrame([(5, " ".join(item)), (None, "x"), (6, None)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and got[0].score > 0.8


# tokens

def test_bpe_matches_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    lib.no_padding()
    lib.no_truncation()
    rng = random.Random(6)
    alphabet = "aàéÉΣσıİẞßﬁ \n\t'’sStT.!?1½٣中́🙂🏽" + "abcdefgh" * 3
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(400)]
    texts += [None, "", "<|endoftext|>", "a<|startoftext|>B", "x" * 3000, "\x1c a\x1db", "ab" * 9000 + "!" * 500, "don't we'LL ΟΔΟΣ"]
    df = docs_frame(spark, [*enumerate(texts)])
    for i, r in table(bpe.encode_decode(df, path)).items():
        ids = lib.encode(texts[i] or "", add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), texts[i]
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encode_decode(df.limit(0), path).count() == 0


def test_bpe_matches_library_on_every_code_point():
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), bpe.WordBpe(path)
    lib.no_padding()
    lib.no_truncation()
    # planes 0 and 1, all blocks that Unicode versions of late have filled, and the edges of the others
    points = [c for c in [*range(0x20000), *range(0x2A6D0, 0x2A710), *range(0x2B730, 0x2B830), *range(0x2CEA0, 0x2CEB8), *range(0x2EBE0, 0x2EE70), *range(0x30000, 0x33500, 7), *range(0x33400, 0x33500), *range(0xE0000, 0xE01F0)] if not 0xD800 <= c <= 0xDFFF]
    for s in range(0, len(points), 4000):
        texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}É" for c in points[s : s + 4000]]
        wrong = [hex(c) for c, t, e in zip(points[s : s + 4000], texts, lib.encode_batch(texts, add_special_tokens=False)) if own.encode(t) != e.ids]
        assert not wrong


def test_merges_agree():
    rng = random.Random(7)
    rank = {}
    for k, (a, b) in enumerate([(a, b) for a in range(6) for b in range(6) if (a * b) % 4 != 3]):
        rank[a, b] = (rng.randrange(1000) * 100 + k, (a + 2 * b) % 6)
    for _ in range(300):
        parts = [rng.randrange(6) for _ in range(rng.randint(1, 40))]
        assert bpe.merge_scan([*parts], rank) == bpe.merge_heap([*parts], rank)


# licences

def test_licenses(spark):
    mit = license_scan.TEMPLATES["MIT-grant"]
    texts = [(1, "Some text. Released under the MIT License. More text"), (2, "x " * 500 + mit.replace("free of charge,", "for free,").replace("copies of", "copy of") + " y"), (3, "the MIT wind"), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0. then Licensed under CC BY-NC 4.0."), (7, "Licensed under the Apache License, Version 2.0.")]
    got = [(r.doc_id, r.license, r.start_word, r.end_word) for r in license_scan.scan(docs_frame(spark, texts)).orderBy("doc_id", "start_word").collect()]
    assert [g[:2] for g in got] == [(1, "MIT-notice"), (2, "MIT-grant"), (6, "CC-BY-NC-4.0-notice"), (6, "CC-BY-NC-4.0-notice"), (7, "Apache-2.0-notice")]
    assert got[0][2:] == (2, 7) and got[1][2] == 500
    assert license_scan.scan(docs_frame(spark, [])).count() == 0 and license_scan.scan(docs_frame(spark, texts), {"none": ""}).count() == 0


def test_every_template_is_found_as_itself(spark):
    texts = [f"before it {t} behind it" for t in license_scan.TEMPLATES.values()]
    got = {}
    for r in license_scan.scan(docs_frame(spark, [*enumerate(texts)])).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.coverage))
    assert {i: x for i, x in got.items()} == {i: [(name, 1.0)] for i, name in enumerate(license_scan.TEMPLATES)}


def test_licenses_brute(spark):
    """Edited copies against alignments of whole texts without index or band."""
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    templates = {f"t{k}": [rng.choice(words) for _ in range(n)] for k, n in enumerate((5, 12, 40, 90, 200, 200))}
    rows = {}
    for i in range(160):
        t, rate, copy = templates[f"t{i % 6}"], rng.choice([0, 0.03, 0.06, 0.1]), []
        for w in t:
            copy += [w] if rng.random() >= rate else rng.choice([[], ["other"], [w, "other"]])
        if i % 5 == 0:  # a page header or a long name within
            at = rng.randrange(len(copy) + 1)
            copy[at:at] = ["holder"] * rng.randint(0, min(30, len(t) // 3))
        rows[i] = [rng.choice(words) for _ in range(rng.randint(0, 80))] + (copy if i < 120 else copy[: len(copy) // 2]) + [rng.choice(words) for _ in range(rng.randint(0, 80))]
    known = {w: k + 1 for k, w in enumerate(words)}
    expected = {}
    for i, text in rows.items():
        for name, t in templates.items():
            _, n, *_ = align(np.array([known[w] for w in t]), np.array([known.get(w, 0) for w in text]))
            if n >= license_scan.COVERAGE * len(t):
                expected[i, name] = n
    got = {(r.doc_id, r.license): r.matched for r in license_scan.scan(docs_frame(spark, [(i, " ".join(t)) for i, t in rows.items()]), {k: " ".join(t) for k, t in templates.items()}).collect()}
    assert {*got} <= {*expected} and len(got) >= 0.97 * len(expected) > 80 and all(abs(n - expected[k]) <= 2 for k, n in got.items())


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == [*range(1, 11)] and set(queries.ORACLES) <= set(queries.QUERIES)
