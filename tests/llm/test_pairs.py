import itertools
import os
import random

import numpy as np
import pytest

from vexel.llm import embedding_dedup as ed
from vexel.llm import graph
from vexel.llm import jaccard_join as jj
from vexel.llm.common import word_list

DOCS = "doc_id long, text string, kept string, class_id int, node string"


def docs(spark, rows):
    """Rows (doc_id, text) with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, "x", 7, None) for i, t in rows], DOCS)


def sets(text):
    w = word_list(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """id -> (class, links, kept) by comparing all pairs of rows."""
    s = [sets(t) for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        return i if up[i] == i else root(up[i])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if s[i] and s[j] and len(s[i] & s[j]) / len(s[i] | s[j]) >= 0.8:
            links[i] += 1
            links[j] += 1
            up[root(j)] = root(i)
    return sorted((i, min(rows[j][0] for j in range(len(rows)) if root(j) == root(k)), links[k]) for k, (i, _) in enumerate(rows))


def made(seed, groups=12, most=14):
    r = random.Random(seed)
    rows, vocabulary = [], [f"w{i}é" for i in range(900)]
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.choice([3, 30, 80, 200]))]
        for _ in range(r.randint(1, most)):
            text = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                text[r.randrange(len(text))] = r.choice(vocabulary)
            rows.append(" ".join(text).upper() if r.random() < 0.2 else "\n".join(text))
    r.shuffle(rows)
    return list(enumerate(rows))


def test_bands_miss_few_pairs_at_the_threshold():
    rows, bands = jj.bands_for()
    assert (1 - 0.8**rows) ** bands <= jj.MISS < (1 - 0.8**rows) ** (bands - 1)


@pytest.mark.parametrize("seed, block", [(1, 128), (2, 3), (3, 1)])
def test_links_and_classes_equal_brute_force(spark, seed, block):
    rows = made(seed)
    out = jj.near_duplicates(docs(spark, rows), block=block).collect()
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in out)
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.class_id) for r in out)


def pages_on_a_template(n, seed=3):
    """Texts whose sets are half shared: Jaccard 0.5."""
    r = random.Random(seed)
    template = [f"t{i}" for i in range(84)]
    return [(i, " ".join(template + [f"x{r.randrange(10**9)}" for _ in range(40)])) for i in range(n)]


def test_a_template_costs_no_quadratic_work(spark):
    rows = pages_on_a_template(4000)
    near = rows[7][1].rsplit(" ", 3)[0]
    rows += [(4000, near + " y y y"), (4001, near + " z")]
    pairs = {jj.bands_for(): None}
    k, bands = next(iter(pairs))
    signed = jj.signatures(docs(spark, rows), "doc_id", 5, k, bands).cache()
    links = jj.candidate_links(signed, jj.least_agreeing(k * bands, 0.8, jj.MISS), bucket=64, refined=64).cache()
    assert links.agg({"compared": "sum"}).first()[0] < 4000**2 / 2 / 10
    node = {r.id: bytes(r.node) for r in signed.select("id", "node").collect()}
    groups = {bytes(r.node): bytes(r.component) for r in graph.connected_components(links.where("u is not null").select("u", "v")).collect()}
    assert len({groups[node[i]] for i in (7, 4000, 4001)}) == 1 and len(groups) < 40
    got = {r.doc_id: (r.class_id, r.n_links) for r in jj.near_duplicates(docs(spark, rows)).collect() if r.n_links}
    assert got == {7: (7, 2), 4000: (7, 2), 4001: (7, 2)}


def test_refined_buckets_lose_no_links(spark, monkeypatch):
    for bucket, depth in ((2, 2), (3, 4)):
        monkeypatch.setattr(jj.candidate_links, "__defaults__", (bucket, bucket, depth))
        rows = made(4, groups=5, most=20)
        assert sorted((r.doc_id, r.class_id, r.n_links) for r in jj.near_duplicates(docs(spark, rows)).collect()) == brute(rows)


def test_edge_rows(spark):
    long = " ".join(f"word{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "!!! ..."), (4, "one two"), (5, "ONE, two"), (6, "one two three"), (7, long), (8, long + " more"), (9, "a b c d e f"), (9, "a b c d e f"), (None, "one two"), (None, None)]
    got = {}
    for r in jj.near_duplicates(docs(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.class_id, r.n_links))
    assert got[1] == [(1, 0)] and got[2] == [(2, 0)] and got[3] == [(3, 0)]
    assert got[4] == [(4, 2)] and got[5] == [(4, 2)] and got[6] == [(6, 0)]
    assert got[7] == [(7, 1)] and got[8] == [(7, 1)]
    assert got[9] == [(9, 1), (9, 1)] and sorted(got[None], key=str) == [(4, 2), (None, 0)]
    kept = jj.keep_one(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "class_id", "node"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 6, 7, 9, None, None]))


def test_texts_that_share_an_id(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (5, a + " z"), (6, b + " z"), (1, a + " y"), (1, b + " y"), (1, c + " y"), (1, c + " y")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.class_id, r.n_links) for r in jj.near_duplicates(docs(spark, rows)).collect()))
    assert got == [(False, 1, 1, 2), (False, 1, 1, 2), (False, 1, 1, 2), (False, 1, 1, 2), (False, 5, 1, 2), (False, 6, 1, 2), (True, 0, 1, 2), (True, 0, 1, 2), (True, 0, 1, 2)]
    only = sorted((r.n_links, str(r.class_id)) for r in jj.near_duplicates(docs(spark, [(None, a), (None, b), (None, a + " z"), (None, c)])).collect())
    assert only == [(0, "None"), (0, "None"), (1, "None"), (1, "None")]
    kept = sorted(r.text for r in jj.keep_one(docs(spark, rows)).collect() if r.doc_id is not None)
    assert kept == [a + " y", b + " y", c + " y"]


def test_no_rows(spark):
    assert jj.near_duplicates(docs(spark, [])).collect() == []
    assert jj.keep_one(docs(spark, [])).collect() == []


def test_connected_components(spark):
    r = random.Random(4)
    chain = [(f"{i:03}", f"{i + 1:03}") for i in range(60)]
    star = [("hub", f"leaf{i}") for i in range(50)]
    pairs = chain + star + [("a", "a"), ("x", "y"), ("y", "x")]
    r.shuffle(pairs)
    digest = lambda s: __import__("hashlib").md5(s.encode()).digest()
    df = spark.createDataFrame([(bytearray(digest(a)), bytearray(digest(b))) for a, b in pairs], "u binary, v binary")
    out = {bytes(x.node): bytes(x.component) for x in graph.connected_components(df).collect()}
    groups = [{digest(s) for p in g for s in p} for g in (chain, star, [("x", "y")])]
    assert len(out) == sum(map(len, groups))
    for g in groups:
        assert {out[n] for n in g} == {min(g)}
    assert graph.connected_components(df.limit(0)).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, node int, vector string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], k, 1, "z") for i, v, k in rows], VECTORS)


def near(x, y):
    a, b = np.float32(x).astype(float), np.float32(y).astype(float)
    return a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(5)
    rows = []
    for g in range(15):
        centre = r.standard_normal(16)
        for _ in range(int(r.integers(1, 40))):
            rows.append((len(rows), centre + r.standard_normal(16) * r.choice([0, 0.02, 0.1]), int(g % 3)))
    rows += [(len(rows) + i, rows[0][1], 0) for i in range(30)]
    links, up = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for (i, x, a), (j, y, b) in itertools.combinations(rows, 2):
        if a == b and near(x, y):
            links[i] += 1
            links[j] += 1
            up[max(root(i), root(j))] = min(root(i), root(j))
    for block in (128, 4):
        got = {x.vec_id: x for x in ed.near_vectors(vectors(spark, rows), block=block).collect()}
        assert {i: x.n_links for i, x in got.items()} == links
        assert {i: x.component_id for i, x in got.items()} == {i: root(i) for i in up}
        assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1, 0], 1), (2, [1, 0], 2), (3, [1, 0], None), (4, None, 1), (5, [0, 0], 1), (6, [nan, 1], 1), (7, [None, 1], 1), (8, [inf, 1], 1), (9, [], 1), (10, [2, 0], 1), (11, [1, 0, 0], 1), (10, [2, 0], 1), (12, [-0.0, 1], 2), (13, [0.0, 1], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in ed.near_vectors(vectors(spark, rows)).collect())
    assert got == [(1, 2, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (10, 2, 1), (10, 2, 1), (11, 0, 11), (12, 1, 12), (13, 1, 12)]
    assert ed.near_vectors(vectors(spark, [])).collect() == []


def test_more_vectors_need_more_passes():
    assert ed.passes_for(10) == 4 <= ed.passes_for(10**4) < ed.passes_for(10**9)


def test_links_of_labels_that_share_a_direction(spark):
    r = np.random.default_rng(11)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    base = unit(np.sqrt(0.9) * np.eye(64)[0] + np.sqrt(0.1) * unit(r.standard_normal((6000, 64))))
    near_by = unit(base[:1000] + 0.185 * unit(r.standard_normal((1000, 64))))
    x = np.concatenate([base, near_by]).astype(np.float32).astype(float)
    want = (unit(x) @ unit(x).T >= 0.98).sum(axis=1) - 1
    got = {v.vec_id: v.n_links for v in ed.near_vectors(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()}
    assert want.sum() > 1900 and [got[i] for i in range(len(x))] == want.tolist()


def test_a_crowded_label_is_not_sent_a_pass_more_for_each_bit(spark):
    r = np.random.default_rng(12)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    crowd = unit(unit(r.standard_normal((1, 64))) + 0.145 * unit(r.standard_normal((600, 64))))
    x = np.concatenate([unit(r.standard_normal((6000, 64))), crowd]).astype(np.float32).astype(float)
    want = (unit(x) @ unit(x).T >= 0.98).sum(axis=1) - 1
    df = vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)]).select("vec_id", "label", "embedding").cache()
    df.count()
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = size()
    got = {v.vec_id: v.n_links for v in ed.near_vectors(df).collect()}
    assert want[6000:].sum() > 10_000 and [got[i] for i in range(len(x))] == want.tolist()
    assert size() - before < 16 * x.size * 4


def test_crowds_by_blocks_and_by_passes(spark, monkeypatch):
    r = np.random.default_rng(13)
    unit = lambda z: z / np.linalg.norm(z, axis=1, keepdims=True)
    x = unit(np.eye(32)[0] + 0.16 * unit(r.standard_normal((900, 32)))).astype(np.float32).astype(float)
    want = (unit(x) @ unit(x).T >= 0.98).sum(axis=1) - 1
    for rows in (100, 1):
        monkeypatch.setattr(ed, "CROWD", rows)
        got = {v.vec_id: v.n_links for v in ed.near_vectors(vectors(spark, [(i, v.tolist(), 1) for i, v in enumerate(x)])).collect()}
        assert [got[i] for i in range(len(x))] == want.tolist()
