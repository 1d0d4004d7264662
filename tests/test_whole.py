"""Queries over whole tables and vectors, against brute force on small fixtures."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from tessera.operators import models
from tessera.plans import catalog, registry

catalog.load()
DOCS = [(k, f"red blue red w{k}") for k in (0, 19, 20, 60, 250, 999)]
VECTORS = [(i, [1.0, 2.0] + [float((i * (j + 3)) % 17) for j in range(62)], i % 4) for i in range(45)]
VECTORS += [(100 + i, [1.0, 2.0] + [30.0 * (i // 5)] * 62, 3) for i in range(10)]
EVENTS = [(i, i % 3, "ab"[i % 2], float((i * 37) % 101)) for i in range(700)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):  # noqa: ANN001, ANN201
    d = str(tmp_path_factory.mktemp("whole"))
    for name, rows, schema in (("documents", DOCS, "doc_id long, text string"), ("embeddings", VECTORS, "vec_id long, embedding array<float>, label int"), ("events", EVENTS, "event_id long, user_id long, event_type string, value double")):
        spark.createDataFrame(rows, schema).selectExpr("*", *(["timestamp_seconds(event_id) AS ts"] if name == "events" else [])).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return d


def test_documents(spark, folder):  # noqa: ANN001
    run = lambda name: registry.QUERIES[name](spark, folder).collect()
    assert {(r.doc_id, r.token): r.n for r in run("bag_of_words")} == {(k, w): n for k, t in DOCS for w, n in Counter(t.split()).items()}
    held = {i: v for i, v, _ in VECTORS}
    want = {(k, j): held[(k * 7 + j) % 110] for k, _ in DOCS for j in range(5) if (k * 7 + j) % 110 in held}
    assert {(r.doc_id, r.at): list(r.vector) for r in run("embedding_lookup") if r.vector is not None} == want
    assert {r.doc_id for r in run("decoder_generate")} == {k for k, _ in DOCS}


def test_neighbours(spark, folder):  # noqa: ANN001
    want, labels = {}, {i: c for i, _, c in VECTORS}
    for i, v, _ in VECTORS:
        if i % 20 == 0:
            want[i] = sorted((float(np.linalg.norm(np.subtract(v, w))), j) for j, w, _ in VECTORS)[:5]
    got = registry.QUERIES["nearest"](spark, folder).collect()
    assert {(r.vec_id, r.near_id) for r in got} == {(i, j) for i, near in want.items() for _, j in near}
    found = {r.vec_id: r.predicted for r in registry.QUERIES["knn_regress"](spark, folder).collect()}
    assert found == pytest.approx({i: np.mean([labels[j] for _, j in near]) for i, near in want.items()}, abs=1e-6)
    votes = {i: Counter(labels[j] for _, j in near) for i, near in want.items()}
    assert {r.vec_id: r.predicted for r in registry.QUERIES["knn_class"](spark, folder).collect()} == {i: min(c, key=lambda x: (-c[x], x)) for i, c in votes.items()}


def test_tables_and_vectors(spark, folder):  # noqa: ANN001
    run = lambda name: registry.QUERIES[name](spark, folder).collect()
    x = np.array([e[3] for e in EVENTS])
    t = run("t_test_one_sample")[0]
    assert t.df == len(x) - 1 and t.statistic == pytest.approx((x.mean() - 50) / (x.std(ddof=1) / len(x) ** 0.5), abs=1e-5)
    order = sorted(EVENTS, key=lambda e: (e[0] % 7 == 0, 0 if e[0] % 7 == 0 else -e[3], e[2], e[0]))
    assert {r.event_id: r.place for r in run("sort_multi")} == {e[0]: k + 1 for k, e in enumerate(order)}
    counts = Counter(r.label for r in run("smote"))
    assert counts == {0: 12, 1: 21, 2: 11, 3: 21}
    clusters = {r.vec_id: r.cluster for r in run("dbscan")}
    assert clusters == {i: 0 if i in (0, 17, 34) else -1 if i < 100 else (i - 100) // 5 for i, _, _ in VECTORS}  # those three equal the first five copies


def test_blocks_of_neighbours(spark):  # noqa: ANN001
    rng = np.random.default_rng(8)
    rows = [(i, np.round(rng.normal(size=3), 1).tolist()) for i in range(90)] + [(100 + i, [0.5, 0.5, 0.5]) for i in range(30)]
    rows += [(200, None), (201, [1.0, None, 2.0]), (202, [1.0, float("nan"), 0.0]), (203, [1.0]), (204, [1e200, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "b int, features array<double>")

    def apart(v, w):  # noqa: ANN001, ANN202
        if v is None or w is None or len(v) != len(w) or None in v or None in w:
            return None
        d = 0.0
        for x, y in zip(v, w):
            d += (x - y) * (x - y)
        return math.sqrt(d)

    last = lambda d: (d is None, d != d, d if d is not None and d == d else 0.0)
    for most, k in ((204, 4), (205, 4), (205, 124)):
        few = df.where(df["b"] < most)
        held = [r for r in rows if r[0] < most]
        got = models.nearest(few.where("b % 3 = 0").withColumnRenamed("b", "q"), few, "q", "b", k, blocks=3).collect()
        want = {(i, j) for i, v in held if i % 3 == 0 for _, j in sorted((last(apart(v, w)), j) for j, w in held)[:k]}
        assert {(r.q, r.b) for r in got} == want
        named = dict(rows)
        assert all(str(r.distance) == str(apart(named[r.q], named[r.b])) for r in got)
    for blocks in (3, 20):  # of which some have no rows
        got = models.pairwise(df.where("b % 7 < 1"), "b", blocks=blocks).collect()
        n = sum(i % 7 < 1 for i, _ in rows)
        assert len(got) == len({(r.a, r.b) for r in got}) == n * (n - 1) // 2 and all(r.a < r.b and str(r.distance) == str(apart(named[r.a], named[r.b])) for r in got)


def test_plans_of_pairs_move_blocks(spark, folder):  # noqa: ANN001
    """Pairs of rows never pass an exchange: none stands above the exploded blocks but that by task."""
    for name in ("nearest", "pairwise"):
        plan = registry.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "MapInArrow" in plan


def test_silhouette_of_repeated_keys(spark):  # noqa: ANN001
    rows = [(1, 0, [0.0, 0.0]), (1, 0, [0.0, 3.0]), (2, 0, [0.0, 4.0]), (3, 1, [9.0, 0.0]), (4, 1, [9.0, 1.0])]
    out = []
    for key in (1, 2, 3, 4):
        apart = {c: [math.dist(v, w) for i, _, v in rows if i == key for j, k, w in rows if j != key and k == c] for c in (0, 1)}
        near, far = (np.mean(apart[c]) for c in ((0, 1) if key < 3 else (1, 0)))
        out.append((far - near) / max(near, far))
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    assert models.silhouette(df, "id", "label").first()[0] == pytest.approx(np.mean(out))


def test_smote_cuts_by_position(spark, folder):  # noqa: ANN001
    assert "Limit" not in registry.QUERIES["smote"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()


def test_streamed_rows_stay_with_executors(spark, folder):  # noqa: ANN001
    got = registry.QUERIES["streamed_running"](spark, folder)
    assert all(f.startswith(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) for f in (p.removeprefix("file://") for p in got.inputFiles())) and got.inputFiles()
    sums: dict = {}
    want = {}
    for i, user, _, value in EVENTS:
        want[i] = sums[user] = sums.get(user, 0.0) + value
    assert {r.event_id: r.total for r in got.collect()} == want


def test_words_are_counted_in_their_rows(spark, monkeypatch):  # noqa: ANN001
    from tessera.operators import text

    monkeypatch.setattr(text, "SLICE", 40)
    rows = [(i, f"Red, blue\t RED w{i % 4} " * (i % 5)) for i in range(30)] + [(40, None), (41, " \n"), (42, "...")]
    want = {(i, w): n for i, t in rows if t for w, n in Counter(t.lower().replace(",", "").replace(".", "").split()).items()}
    df = spark.createDataFrame(rows, "id long, text string")
    bag = text.bag_of_words(df, "id", "text")
    assert "Aggregate" not in bag._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.id, r.token): r.n for r in bag.collect()} == want and bag.count() == len(want)
    holders = Counter(w for _, w in want)
    size = {i: sum(n for (j, _), n in want.items() if j == i) for i, _ in rows}
    got = {(r.id, r.token): r.weight for r in text.tfidf(df, "id", "text").collect()}
    assert got == pytest.approx({(i, w): n / size[i] * math.log(33 / holders[w]) for (i, w), n in want.items()})
    twice = df.unionAll(df.where("id % 3 = 0").selectExpr("id", "concat(text, ' more') AS text"))  # rows that share a key
    both = Counter()
    for i, t in [*rows, *((i, f"{t} more") for i, t in rows if i % 3 == 0 and t is not None)]:
        both.update({(i, w): n for w, n in Counter((t or "").lower().replace(",", "").replace(".", "").split()).items()})
    assert {(r.id, r.token): r.n for r in text.bag_of_words(twice, "id", "text").collect()} == dict(both)
    assert abs(sum(r.n / r.size for r in text.counted(twice, "id", "text").collect()) - len({i for i, _ in both})) < 1e-9
