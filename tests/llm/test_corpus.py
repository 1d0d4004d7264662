"""Near duplicates, fingerprints, decontamination, WARC audit, preference format, and the pipeline."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import defaultdict
from types import SimpleNamespace

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, imatch, neardup, pieces, preference, queries, shared, toxicity, warc

SF = "/root/testdata/sf0.001"


def documents(spark, rows):  # noqa: ANN001, ANN201
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("clash")).withColumn("key", F.lit(0))


def word(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghij") for _ in range(5))


def brute_links(texts: dict[int, str]) -> tuple[dict[int, int], dict[int, int]]:
    """Links by document and lowest member of its group, by all pairs."""
    sets = {i: set(neardup.shingles(t).tolist()) for i, t in texts.items()}
    links, root = defaultdict(int), {i: i for i in texts}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b and (texts[a] == texts[b] or sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])):
                links[a] += 1
                links[b] += 1
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return links, {i: top(i) for i in ids}


def corpus(seed: int, groups: int = 12) -> dict[int, str]:
    rng, out = random.Random(seed), {}
    for _ in range(groups):
        base = [word(rng) for _ in range(rng.randint(20, 90))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = word(rng)
            out[len(out)] = " ".join(copy)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_links_and_groups_by_brute_force(spark, seed):  # noqa: ANN001
    texts = corpus(seed)
    links, roots = brute_links(texts)
    got = {r.doc_id: r for r in neardup.groups(documents(spark, list(texts.items()))).collect()}
    assert {i: got[i].n_links for i in texts} == {i: links[i] for i in texts}
    assert {i: got[i].group_id for i in texts} == roots


def test_small_blocks_lose_no_link(spark, monkeypatch):  # noqa: ANN001
    rng = random.Random(5)
    base = [word(rng) for _ in range(80)]
    texts = {i: " ".join(base[: 40 + i % 3] + [word(rng)] + base[42 + i % 3 :]) for i in range(60)}
    links, roots = brute_links(texts)
    texts |= {100 + i: " ".join(base[:20] + [word(rng) for _ in range(20)]) for i in range(20)}
    links, roots = brute_links(texts)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", 7)
    got = {r.doc_id: r for r in neardup.groups(documents(spark, list(texts.items()))).collect()}
    assert {i: got[i].n_links for i in texts} == {i: links[i] for i in texts} and sum(links.values()) > 1000
    assert {i: got[i].group_id for i in texts} == roots


def test_near_duplicates_odd_rows(spark):  # noqa: ANN001
    rows = [(1, None), (2, ""), (3, "one two"), (4, "one two"), (5, "ONE  two!"), (6, "x " * 30_000), (7, "x " * 29_999), (7, "x " * 29_999), (None, "one two"), (8, "!!!"), (9, "!!!")]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in neardup.groups(docs).collect()}
    assert got[1].group_id == got[2].group_id == 1
    assert got[3].group_id == got[4].group_id == got[5].group_id == 3 and got[3].n_links == 2
    assert got[6].group_id == got[7].group_id == 6 and got[9].group_id == 8 and got[7].copies == 3
    kept = neardup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 3, 6, 8, None], key=str)
    assert neardup.stage(spark, docs.limit(0), "").count() == 0


def test_prefix_depth_reaches_the_recall():
    d = neardup.prefix_depth()
    assert 1 - (1 - 0.8**d) ** neardup.TREES >= neardup.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** neardup.TREES


def prefix_sharers(rows: list[tuple[int, list[int]]], depth: int) -> set[tuple[int, int]]:
    """Pairs that share the first `depth` 16-bit values of some tree, by all pairs."""
    values = {i: np.array(label, dtype=">i8").view(">u2").reshape(neardup.TREES, neardup.LABEL) for i, label in rows}
    return {(a, b) for a in values for b in values if a < b and (values[a][:, :depth] == values[b][:, :depth]).all(axis=1).any()}


def test_tries_by_brute_force(spark):  # noqa: ANN001
    texts = corpus(8, groups=25)
    rows = [(i, neardup.labels(neardup.shingles(t)).tolist()) for i, t in texts.items() if t]
    classes = spark.createDataFrame(rows, "doc_id long, label array<long>")
    found = neardup.branches(classes)
    for depth in range(neardup.SHORTEST, neardup.LABEL + 1):
        held = defaultdict(set)
        for r in neardup.at_depth(found, depth).collect():
            held[r.node].add(r.doc_id)
        assert {(a, b) for x in held.values() for a in x for b in x if a < b} == prefix_sharers(rows, depth)
    want = prefix_sharers(rows, neardup.START)
    short = {r.doc_id: r.depth for r in neardup.depths(classes, spark.createDataFrame([(b, a) for a, b in want], "a long, b long")).collect()}
    for i in texts:  # by definition: neighbours' estimated similarities give the recall at each depth
        values = {k: np.array(label).view(np.uint16) for k, label in rows}
        s = np.array([(values[a] == values[b]).mean() for a, b in want if i in (a, b)])
        s = s[s >= neardup.EVIDENCE]
        good = [d for d in range(neardup.START, neardup.SHORTEST, -1) if not len(s) or len(s) / (1 / (1 - (1 - s**d) ** neardup.TREES)).sum() >= neardup.TARGET]
        assert short.get(i, neardup.START) == (max(good) if good else neardup.SHORTEST)
    assert short
    wide = defaultdict(set)
    for r in neardup.nodes(classes).collect():
        wide[r.node].add(r.doc_id)
    pairs = {(a, b) for x in wide.values() for a in x for b in x if a < b}
    depth_of = lambda i: short.get(i, neardup.START)
    reach = {d: prefix_sharers(rows, d) for d in range(neardup.SHORTEST, neardup.START + 1)}
    assert pairs >= {(a, b) for a in texts for b in texts if a < b and (a, b) in reach[min(depth_of(a), depth_of(b))]}


def test_recall_by_brute_force(spark):  # noqa: ANN001
    rng, texts = random.Random(11), {}
    for _ in range(150):
        base = [word(rng) for _ in range(rng.randint(60, 120))]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = word(rng)
            texts[len(texts)] = " ".join(copy)
    links, _ = brute_links(texts)
    got = {r.doc_id: r.n_links for r in neardup.groups(documents(spark, list(texts.items()))).collect()}
    assert all(got[i] <= links[i] for i in texts) and sum(got.values()) >= 0.999 * sum(links.values()) > 500


def test_components_of_a_long_chain(spark):  # noqa: ANN001
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.root for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == got[100] == 100
    assert neardup.components(edges.limit(0)).count() == 0


def brute_edited(rows: list[tuple]) -> dict[int, str]:
    ordered = sorted(rows, key=lambda r: -r[0])
    out = {}
    for k, (i, t) in enumerate(ordered):
        t, n = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        out[i] = t[: len(t) - cut] + n[:cut]
    return out


@pytest.mark.parametrize("ids", ["dense", "sparse"])
def test_edited_texts_and_fingerprints(spark, ids):  # noqa: ANN001
    rng = random.Random(3)
    vocab = [word(rng) for _ in range(2000)]
    rows = [(k if ids == "dense" else rng.getrandbits(62), " ".join(rng.choices(vocab, k=rng.randint(0, 60)))) for k in range(300)]
    rows[5], rows[6] = (rows[5][0], rows[7][1]), (rows[6][0], None)
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, rows).select("doc_id", "text")).collect()}
    edited = brute_edited(rows)
    for i, t in rows:
        assert got[i].edited_sha256 == hashlib.sha256(edited[i].encode()).hexdigest()
        assert got[i].n_chars == len(t or "") and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[rows[5][0]].fingerprint == got[rows[7][0]].fingerprint
    assert np.mean([r.near_edited for r in got.values()]) > 3 * np.mean([r.near_next for r in got.values()])


def test_fingerprints_by_definition(spark):  # noqa: ANN001
    rows = [(k, " ".join(f"w{j}" for j in range(k % 7, 60, 1 + k % 5))) for k in range(120)]
    docs = documents(spark, rows).select("doc_id", "text")
    inside = {r.term for r in imatch.lexicon(docs).collect()}
    df = defaultdict(int)
    for _, t in rows:
        for w in set(t.split()):
            df[w] += 1
    hashes = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in df}
    assert inside == {hashes[w] for w, n in df.items() if max(2, 0.0005 * 120) <= n <= max(2, 0.1 * 120)}
    kept = docs.select("doc_id", imatch.band_terms(F.col("text"), imatch.term_table(imatch.lexicon(docs))).alias("t")).collect()
    for r in kept:
        assert list(r.t) == sorted(hashes[w] for w in set(dict(rows)[r.doc_id].split()) if hashes[w] in inside)


def test_fingerprints_and_likenesses_by_brute_force(spark, monkeypatch):  # noqa: ANN001
    monkeypatch.setattr(imatch, "PART_ROWS", 10)
    rng = random.Random(9)
    vocab = [word(rng) for _ in range(400)]
    rows = [(3 * k, " ".join(rng.choices(vocab, k=rng.randint(0, 50)))) for k in range(150)] + [(450, None)]
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, rows).select("doc_id", "text")).collect()}
    edited = brute_edited(rows)
    df = defaultdict(int)
    for t in {t or "" for _, t in rows}:
        for w in set(t.split()):
            df[w] += 1
    n = len({t or "" for _, t in rows})
    words = sorted({w for t in [*(t or "" for _, t in rows), *edited.values()] for w in t.split()})
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    inside = {w for w, k in df.items() if max(2, imatch.MIN_SHARE * n) <= k <= max(2, imatch.MAX_SHARE * n)}
    subsets = {}

    def of(text: str) -> list[tuple]:
        terms = sorted(hashes[w] for w in set(text.split()) if w in inside)
        out = [tuple(terms)]
        for r in range(imatch.REPLICAS):
            part = [t for t in terms if not t >> (imatch.LEVELS * r) & 1]
            for level in range(imatch.LEVELS):
                out.append(tuple(part))
                part = [t for t in part if not t >> (imatch.LEVELS * r + level + 1) & 1]
        for p in out:
            subsets.setdefault(p, None)
        return out

    ordered = sorted(rows, key=lambda r: -r[0])
    prints = {i: (of(t or ""), of(edited[i])) for i, t in rows}
    for k, p in enumerate(list(subsets)):
        subsets[p] = p
    spelled = {r.k: r.h for r in spark.createDataFrame([(k, list(p)) for k, p in enumerate(subsets)], "k int, t array<long>").select("k", F.when(F.size("t") > 0, F.hash("t")).otherwise(0).alias("h")).collect()}
    number = {p: spelled[k] for k, p in enumerate(subsets)}

    def alike(a: list[tuple], b: list[tuple]) -> float:
        held = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in held) / len(held) if held else 1.0

    for k, (i, _) in enumerate(ordered):
        own, new = prints[i]
        assert got[i].fingerprint == "".join(f"{number[p] & 0xFFFFFFFF:08x}" for p in own)
        assert got[i].edited_fingerprint == "".join(f"{number[p] & 0xFFFFFFFF:08x}" for p in new)
        assert abs(got[i].near_edited - alike(own, new)) < 1e-12
        assert abs(got[i].near_next - alike(own, prints[ordered[(k + 1) % len(ordered)][0]][0])) < 1e-12


def test_fingerprints_odd_rows(spark):  # noqa: ANN001
    one = imatch.fingerprints(documents(spark, [(9, "only text here")]).select("doc_id", "text")).first()
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"only text only").hexdigest()
    assert imatch.fingerprints(documents(spark, []).select("doc_id", "text")).count() == 0
    rows = [(None, "no id"), (1, None), (2, ""), (2, ""), (3, "a" * 100_000)]
    assert imatch.fingerprints(documents(spark, rows).select("doc_id", "text")).count() == 5


def test_lexicon_by_either_join(spark, monkeypatch):  # noqa: ANN001
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = sorted(r.term for r in imatch.lexicon(docs).collect())
    monkeypatch.setattr(imatch, "BROADCAST_ROWS", -1)
    assert sorted(r.term for r in imatch.lexicon(docs).collect()) == got
    n = docs.select("text").distinct().count()
    terms = docs.select("text").distinct().select(F.explode(imatch.words(F.col("text"))).alias("term")).groupBy("term").count()
    assert got == sorted(r.term for r in terms.collect() if max(2, 0.0005 * n) <= r["count"] <= max(2, 0.1 * n))


def test_copies_keep_their_terms(spark):  # noqa: ANN001
    hot = ["amber basil cedar dune", "elm fern grove heath"]
    rows = [(k, hot[k % 2] if k < 80 else f"word{k} {hot[k % 2].split()[k % 4] if k < 88 else ''} other{k // 2}") for k in range(120)]
    got = {r.doc_id: r for r in imatch.fingerprints(documents(spark, rows).select("doc_id", "text")).collect()}
    empty = "0" * len(got[0].fingerprint)
    assert got[0].fingerprint == got[2].fingerprint != empty and got[1].fingerprint not in (empty, got[0].fingerprint)
    assert got[2].near_next < 1.0


ITEM = "A train leaves Boston at 40 km per hour and then meets Alice after 3 hours while 40 km remain to Paris for all passengers."


def test_reparameterised_items(spark):  # noqa: ANN001
    bench = spark.createDataFrame([(1, ITEM), (2, "too short"), (3, None), (None, ITEM)], "item_id long, text string")
    same = ITEM.replace("40", "55").replace("Boston", "Denver").replace("Alice", "Robert").replace(" 3 ", " 7 ").replace("Paris", "Rome")
    rows = [(1, "Some words before. " + same + " And after"), (2, same[::-1].replace("55", "56") + same.replace("while 55", "while 56")), (3, "nothing to see here at all, really nothing"), (4, None), (5, ""), (6, "word " * 20_000), (None, ITEM), (7, "Intro.\n" + ITEM), (7, "Intro.\n" + ITEM)]
    docs = documents(spark, rows)
    got = {r.doc_id: r for r in decontaminate.leaks(docs, bench).collect()}
    assert set(got) == {1, 7} and got[1].changed and not got[7].changed and got[1].covered == 1.0
    kept = decontaminate.stage
    assert sorted((r.doc_id for r in docs.join(decontaminate.leaks(docs, bench).select("doc_id"), "doc_id", "left_anti").collect()), key=str) == sorted([2, 3, 4, 5, 6, None], key=str)
    assert kept(spark, docs, SF).columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 and decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_short_items_inside_long_documents(spark):  # noqa: ANN001
    texts = {5: "green apples grow near rivers", 6: "seven tired sailors sang very loudly", 7: "old clocks never tick inside silent halls"}
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    around = "before this there are many other words, {} and then some more of them follow here"
    rows = [(k, around.format(t)) for k, t in texts.items()] + [(10, texts[6]), (11, around.format("green apples grow near lakes"))]
    got = decontaminate.leaks(documents(spark, rows), bench).collect()
    assert {(r.doc_id, r.item_id, r.covered, r.changed) for r in got} == {(5, 5, 1.0, False), (6, 6, 1.0, False), (7, 7, 1.0, False), (10, 6, 1.0, False)}


def test_items_of_few_literal_words(spark):  # noqa: ANN001
    texts = {1: "What Is The Capital City Of The United Kingdom Today", 2: "WHO WROTE THE NOVEL WAR AND PEACE IN RUSSIA", 3: "1 4 9 16 25 36 49 64 81 100 121", 4: "Who Painted The Mona Lisa", 5: "Which Large River Runs Through Old Vienna Town"}
    bench = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    rows = [(k, f"People often ask: {t}, and then more words follow here.") for k, t in texts.items()]
    rows += [(10, texts[1].replace(" The ", "\nThe ").replace("City Of", "City\nOf")), (11, "2 5 9 17 26 36 50 64 82 100 122"), (12, "We saw What Was The Second City In The Southern Province Today")]
    got = {(r.doc_id, r.item_id, r.covered, r.changed) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert got == {(k, k, 1.0, False) for k in texts} | {(10, 1, 1.0, False)}


def test_clashing_slots_leave_out_only_their_windows(spark):  # noqa: ANN001
    middle = "walk along quiet green rivers under tall old trees where small brown birds sing loudly every single morning before breakfast"
    item = f"there were 40 people who {middle} and then 12 of them met 15 others near the gate until 40 came back"
    named = "now Tom sees red paint and Tom buys blue paint and Tom mixes both colours while Tom sings one song then Tom rests and Tom sleeps until Tom wakes and Tom leaves the old house"
    bench = spark.createDataFrame([(1, item), (2, named), (3, "here 12 dogs chase 15 cats around town")], "item_id long, text string")
    rows = [(1, item.replace("until 40", "until 41")), (2, item.replace("12", "20").replace("15", "20")), (3, named.replace("Tom", "Sam").replace("Sam leaves", "Tim leaves")), (4, "here 20 dogs chase 20 cats around town")]
    got = {(r.doc_id, r.item_id, r.changed) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    assert {(d, i) for d, i, _ in got} == {(1, 1), (2, 1), (3, 2)} and (3, 2, True) in got


def test_planted_passages_by_brute_force(spark):  # noqa: ANN001
    plain = lambda t: " " + " ".join(re.findall(r"\w+", t.lower())) + " "
    items = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = decontaminate.op9_benchmark_decontamination(spark, SF).collect()
    assert len(rows) == len(docs) and all(r.leaked == bool(r.item_ids) == (r.covered > 0) for r in rows)
    got = {(r.doc_id, i) for r in rows for i in r.item_ids}
    assert got == {(d.doc_id, i) for d in docs for i, t in items.items() if t in plain(d.text)} and got


def test_shuffled_join_finds_the_same(spark, monkeypatch):  # noqa: ANN001
    before = decontaminate.op9_benchmark_decontamination(spark, SF).orderBy("doc_id").collect()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert decontaminate.op9_benchmark_decontamination(spark, SF).orderBy("doc_id").collect() == before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def redressed(words: list[str], rng: random.Random) -> str:
    """Words with anything that separates words between them."""
    return "".join(w + rng.choice([" ", "\n", "\t", "  ", "\u0001", " (", ") ", ' "', '", ', " [", "; ", ", ", "\r\n", " \u201c", "\u00a0"]) for w in words)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_by_brute_force(spark, seed):  # noqa: ANN001
    rng = random.Random(seed)
    cities = ["Boston", "Denver", "Rome", "Oslo", "Lima", "Cairo", "Quito", "Delhi"]
    items, rows, expected = [], [], set()
    for i in range(8):
        words = [word(rng) for _ in range(30)]
        slots = sorted(rng.sample(range(0, 30, 4), 5))
        values = {k: (rng.choice(cities) if k % 8 else str(rng.randint(2, 900))) for k in slots}
        items.append((i, " ".join(values.get(k, w) for k, w in enumerate(words))))
        new = dict(zip(cities, rng.sample(["Paris", "Kyoto", "Sofia", "Minsk", "New York", "Accra", "Dakar", "Tunis"], 8)))
        change = lambda v: new[v] if v in new else str(int(v) + 1000)  # noqa: B023, E731
        around = lambda: [word(rng) for _ in range(rng.randint(0, 30))]
        moved = [change(values[k]) if k in values else w for k, w in enumerate(words)]
        verbatim = [values.get(k, w) for k, w in enumerate(words)]
        broken = [word(rng) if k % 6 == 3 else w for k, w in enumerate(moved)]
        for kind, body in enumerate((moved, verbatim, broken)):
            rows.append((10 * i + kind, redressed([*around(), *body, *around()], rng)))
            if kind < 2:
                expected.add((10 * i + kind, i))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()}
    # by definition: an alignment of equal literal words, slots changing one to one, in half of the windows of 8
    token = re.compile(r"[0-9]+|[A-Z][a-z]*(?:[\s\x01'-]+[A-Z][a-z]*)*|[a-z]+")
    typed = lambda t: [(("0" if w[0].isdigit() else "N" if w[0].isupper() else w), " ".join(re.split(r"[\s\x01'-]+", w)).lower()) for w in token.findall(t)]
    brute = set()
    for d, text in rows:
        a = typed(text)
        for i, item in items:
            b = typed(item)
            for shift in range(-len(b), len(a)):
                ok = [k for k in range(len(b) - 7) if 0 <= k + shift and k + shift + 8 <= len(a) and all(a[k + shift + j][0] == b[k + j][0] for j in range(8))]
                pairs = {(b[k + j], a[k + shift + j]) for k in ok for j in range(8)}
                if 2 * len(ok) >= len(b) - 7 and len({x for x, _ in pairs}) == len(pairs) == len({y for _, y in pairs}):
                    brute.add((d, i))
    assert got == brute == expected


def test_separators_hide_nothing(spark):  # noqa: ANN001
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    same = ITEM.replace("40", "55").replace("Boston", "Denver").replace("Alice", "Robert").replace(" 3 ", " 7 ").replace("Paris", "Rome")
    named = lambda t, how: re.sub(r" (Denver|Robert|Rome|Boston|Alice|Paris)", how, t)
    texts = ["\u0001" + ITEM, named(ITEM, r"\n\1"), "He said " + ITEM.lower(), ITEM.upper()]
    texts += ["\u0001" + same, named(same, r"\t\1"), named(same, r' ("\1")'), named(same, r"\t[\1]"), same.replace("Robert", "(Robert)"), same.replace("Denver", "New York"), named(same, r"\n\1"), named(same, r"-\1"), "A " * 50_000 + same, "1.1" * 50_000 + " " + same]
    got = {r.doc_id: r.changed for r in decontaminate.leaks(documents(spark, list(enumerate(texts))), bench).collect()}
    assert got == {k: k >= 4 for k in range(len(texts))}


def test_items_of_under_five_words(spark):  # noqa: ANN001
    bench = spark.createDataFrame([(1, "Too Short"), (2, "one 2 three"), (3, "!?")], "item_id long, text string")
    rows = [(1, "too, short!"), (2, "this is too short"), (3, "one 2 three"), (4, "one 3 three"), (5, "?!"), (6, "")]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(documents(spark, rows), bench).collect()} == {(1, 1), (3, 2)}


def archive(spark, pages, path, known=None):  # noqa: ANN001, ANN201
    warc.write_warc(warc.records(pages), str(path))
    return warc.replica(spark, str(path), warc.catalogue(pages if known is None else known))


def found_by(frame):  # noqa: ANN001, ANN201
    return sorted((r.page_id, r.status, r.copies) for r in frame.collect())


def test_audit_finds_what_differs(spark, tmp_path):  # noqa: ANN001
    schema = "page_id long, url string, html string, file_no long"
    rows = [(i, f"http://a/{i}", "<p>" + "x" * (i % 50), 0) for i in range(3000)] + [(None, "u", "h", 0), (-5, None, None, 0), (9000, "long", "y" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, schema)
    ours = warc.manifest(warc.records(pages))
    assert ours.count() == 3002
    assert warc.audit(ours, archive(spark, pages, tmp_path / "same")).count() == 0
    other = spark.createDataFrame([(i, u, "z" + (h or "")[1:] if i in (5, 1500, 9000) else h, 0) for i, u, h, _ in rows if i != 77], schema)
    theirs = archive(spark, other, tmp_path / "other")
    assert found_by(warc.audit(ours, theirs).where("status <> 'extra'")) == [(5, "changed", 1), (77, "missing", 1), (1500, "changed", 1), (9000, "changed", 1)]
    assert found_by(warc.audit(theirs, ours)) == [(5, "changed", 1), (77, "extra", 1), (1500, "changed", 1), (9000, "changed", 1)]
    assert warc.audit(ours.limit(0), ours.limit(0)).count() == 0
    assert found_by(warc.audit(ours.limit(0), ours.where("page_id < 3"))) == [(-5, "extra", 1), (0, "extra", 1), (1, "extra", 1), (2, "extra", 1)]
    spans = [warc.extent(warc.leaves(x)) for x in (ours, ours)]
    assert len({tuple(warc.tree(warc.leaves(ours), *s).levels[-1].first()) for s in spans}) == 1


def test_a_lost_record_is_one_missing_record(spark, tmp_path):  # noqa: ANN001
    pages = spark.createDataFrame([(i, f"u{i}", "<p>" * (1 + i % 9)) for i in range(100)], "page_id long, url string, html string")
    less = archive(spark, pages.where("page_id <> 11"), tmp_path / "less")
    assert found_by(warc.audit(warc.manifest(warc.records(pages)), less)) == [(11, "missing", 1)]


def test_audit_of_repeated_pages(spark, tmp_path):  # noqa: ANN001
    schema = "page_id long, url string, html string"
    rows = [(1, "u", f"version {k}") for k in range(400)] + [(1, "u", "again")] * 5 + [(2, "u", "one")]
    pages = spark.createDataFrame(rows, schema)
    ours = warc.manifest(warc.records(pages))
    assert sorted(r.place for r in ours.collect()) == list(range(406))
    less = [r for r in rows if r[2] not in ("version 7", "version 8")]
    less.remove((1, "u", "again"))
    theirs = archive(spark, spark.createDataFrame([*less, (1, "u", "new"), (3, "v", "unknown")], schema), tmp_path / "a", pages)
    digest = {r.digest for r in ours.where("copy = 5").collect()}
    got = warc.audit(ours, theirs).collect()
    assert sum(r.copies for r in got if r.status == "changed") == 1 and sum(r.copies for r in got if r.status == "missing") == 2
    assert [(r.page_id, r.copies) for r in got if r.status == "extra"] == [(None, 1)]
    assert {r.digest for r in got if r.status != "extra"} >= digest


def test_warc_files_round_trip(spark, tmp_path):  # noqa: ANN001
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    made = warc.records(pages)
    warc.write_warc(made, str(tmp_path / "w"))
    back = {r.url: r for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    index = {r.page_id: r for r in warc.manifest(made).collect()}
    rows = pages.collect()
    assert len(back) == len({p.url for p in rows})
    for p in rows:
        if sum(q.url == p.url for q in rows) == 1:
            assert bytes(back[p.url].block).decode() == warc.BLOCK + p.html
            assert (back[p.url].length, back[p.url].digest) == (index[p.page_id].length, index[p.page_id].digest)


def test_preferences(spark):  # noqa: ANN001
    turns = "pair_id long, turn long, role string, text string"
    chosen = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "a"), (3, 0, None, None), (None, 0, "user", "x"), (4, 0, "user", "<|end|>")], turns)
    rejected = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "?"), (2, 0, "user", "a"), (3, 0, "user", ""), (4, 0, "user", "<|end|>")], turns)
    got = {r.pair_id: r for r in preference.format_preferences(chosen, rejected).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert got[1].n_prefix == 1 and got[1].prompt == "<|user|>\nhi<|end|>\n"
    assert got[1].chosen == "<|assistant|>\nyes<|end|>\n" and got[1].rejected == "<|assistant|>\nno<|end|>\n<|user|>\n?<|end|>\n"
    trained = "".join(c for c, m in zip(got[1].rejected, got[1].rejected_mask) if m == "1")
    assert trained == "no<|end|>\n" and len(got[1].rejected) == len(got[1].rejected_mask)
    assert got[2].n_prefix == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].n_prefix == 0 and got[3].chosen == "<|unknown|>\n<|end|>\n"
    assert got[4].prompt == "<|user|>\n< |end|><|end|>\n"
    assert preference.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0
    assert preference.format_preferences(chosen, rejected.limit(0)).where("pair_id = 1").first().rejected == ""


def test_preferences_odd_rows(spark):  # noqa: ANN001
    turns, long = "pair_id long, turn long, role string, text string, c string, r string, n_prefix string", "word " * 200_000
    rows = [(1, 0, "user", long, "x", "x", "x"), (1, 0, "user", long, "x", "x", "x"), (1, 1, "assistant", "same turn", "x", "x", "x"), (1, 1, "assistant", "equal place", "x", "x", "x")]
    chosen = spark.createDataFrame(rows, turns)
    rejected = spark.createDataFrame([*rows[:3], (1, 1, "assistant", long, "x", "x", "x")], turns)
    (got,) = preference.format_preferences(chosen, rejected).collect()
    assert got.n_prefix == 2 and got.prompt == f"<|user|>\n{long}<|end|>\n" * 2
    assert got.chosen == "<|assistant|>\nequal place<|end|>\n<|assistant|>\nsame turn<|end|>\n"
    assert got.rejected == f"<|assistant|>\nsame turn<|end|>\n<|assistant|>\n{long}<|end|>\n" and len(got.rejected_mask) == len(got.rejected)
    assert preference.format_preferences(chosen.limit(0), rejected.limit(0)).count() == 0


def plain_value(v: object) -> str:
    return "none" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):  # noqa: ANN001
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    cursor = con.execute(queries.ORACLES[name])
    places = [[d[0] for d in cursor.description].index(c) for c in columns]
    assert sorted(tuple(plain_value(r[i]) for i in places) for r in cursor.fetchall()) == sorted(tuple(plain_value(r[c]) for c in columns) for r in got.collect())


def test_pipeline_keeps_clean_documents(spark):  # noqa: ANN001
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(docs.columns) < set(out.columns) and [n for n, _ in corpus_pipeline.STAGES][-1] == "sentencepiece"
    left = {r.doc_id for r in out.collect()}
    assert 0.3 * docs.count() < len(left) < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_on(docs, labels)
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("score >= 0.5").collect()}
    leaked = {r.doc_id for r in decontaminate.op9_benchmark_decontamination(spark, SF).where("leaked").collect()}
    assert not left & toxic and not left & leaked
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len({texts[i] for i in left}) == len(left)


def test_clashing_column_names(spark):  # noqa: ANN001
    names = ["_toxic", "_quality", "n_tokens", "ids", "_p", "leaked_id", "of_text", "block", "copies", "share"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40).select("*", *(F.lit("mine").alias(n) for n in names))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[: len(docs.columns)] == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == "mine" for r in rows for n in names), name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.columns[len(docs.columns) :] == ["n_tokens_", "ids_sha256", "decoded_sha256"]
    coded = pieces.decode(pieces.encode(docs, pieces.default_model()), pieces.default_model(), ids="ids_", out="ids")
    assert coded.columns == [*docs.columns, "ids_", "begins", "ends", "ids__"]
    first = coded.first()
    assert first["ids__"] == first.text and first.ids == "mine"


def test_no_shared_folder_on_a_cluster():
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, other: other), sparkContext=SimpleNamespace(master="spark://somewhere"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(unset)


def test_pipeline_of_nothing(spark, tmp_path):  # noqa: ANN001
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
