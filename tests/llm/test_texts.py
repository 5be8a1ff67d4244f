import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vexel.llm import decontaminate as dc
from vexel.llm import language_id as li
from vexel.llm import licenses, toxicity
from vexel.llm import lm_score as lm
from vexel.llm import mixing as mx
from vexel.llm.common import word_list

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, words int, size string, held_out int"


def docs(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names clash with those of the operators."""
    return spark.createDataFrame([(i, t, k, s, None, "x", 1, "y", 2) for i, t, k, s in rows], DOCS)


ODD = [None, "", " \t\n", "!!! 123", "é", "\U0001f600 ok", "one two three " * 40_000]


def held(i, folds):
    return zlib.crc32(str(i).encode()) % folds


# --- language ID ---

SYLLABLES = {"xx": "ka ro mi tu ne", "yy": "sch ein ung ver lich", "zz": "ção eux ñe ó ille"}


def spoken(n=240, seed=1):
    r, out = random.Random(seed), []
    for i in range(n):
        k = r.choice(list(SYLLABLES))
        out.append((i, " ".join("".join(r.choices(SYLLABLES[k].split(), k=r.randint(1, 4))) for _ in range(r.randint(3, 60))).title(), k, "s"))
    return out


def test_languages_of_held_out_texts(spark):
    rows = spoken()
    got = {r.doc_id: r for r in li.identify(docs(spark, rows)).collect()}
    assert all(got[i].held_out == (held(i, 3) == 1) for i, *_ in rows)
    assert np.mean([got[i].lang_pred == k for i, _, k, _ in rows if held(i, 3) == 1]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())


def test_languages_dont_depend_on_lang_of_held_out_rows(spark):
    rows = spoken()
    other = [(i, t, k if held(i, 3) != 1 else "??", s) for i, t, k, s in rows]
    a, b = (sorted((r.doc_id, r.lang_pred, r.score) for r in li.identify(docs(spark, x)).collect()) for x in (rows, other))
    assert a == b


def test_outputs_equal_kernel_ridge_regression_on_sets():
    rows = spoken(90)
    labels, sets = [k for _, _, k, _ in rows], [set(li.ngrams(t).tolist()) for _, t, _, _ in rows]
    k = lambda a, b: len(a & b) / math.sqrt(len(a) * len(b))
    marks, seen = [], Counter()
    for s, y in zip(sets, labels):
        seen[y] += 1
        if seen[y] <= 5:
            marks.append(s)
    inner = np.array([[k(a, b) for b in marks] for a in marks])
    cross = np.array([[k(a, b) for b in marks] for a in sets])
    # regression on coefficients of the landmarks' kernel functions, with their norm in that space as the penalty
    share = np.array([1 / labels.count(y) / 3 for y in labels])
    a = np.hstack([cross, np.ones((len(sets), 1))])
    penalty = np.zeros((16, 16))
    penalty[:15, :15] = inner * li.RIDGE / 3
    goal = np.array([[1.0 if y == z else -1.0 for z in sorted(set(labels))] for y in labels])
    solved = np.linalg.solve(a.T @ (a * share[:, None]) + penalty, a.T @ (goal * share[:, None]))
    model = li.fit([np.array(sorted(s)) for s in sets], labels, landmarks=5)
    for _, text, _, _ in spoken(20, 9):
        g = set(li.ngrams(text).tolist())
        assert model.outputs([text])[0][0] == pytest.approx(np.array([k(g, m) for m in marks] + [1.0]) @ solved, abs=1e-3)


def test_ngrams_are_those_of_the_whole_text(monkeypatch):
    text = "  Ab--cd \u00c9 " + "xyz  q" * 50
    whole = li.ngrams(text).tolist()
    raw = (" " + " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split()) + " ").encode()
    assert [x for x in whole if x < li.SPACE[0]] == sorted({raw[i] << 8 | raw[i + 1] for i in range(len(raw) - 1)})
    monkeypatch.setattr(li, "PIECE", 5)
    assert li.ngrams(text).tolist() == whole


def test_many_languages_share_the_bound(monkeypatch):
    monkeypatch.setattr(li, "MOST_LANDMARKS", 7)
    rows = spoken(90)
    assert len(li.fit([li.ngrams(t) for _, t, _, _ in rows], [k for _, _, k, _ in rows]).languages) == 3


def test_texts_that_no_language_fits_go(spark):
    rows = spoken(120) + [(1000, "\u4eca\u65e5\u306f\u3044\u3044\u5929\u6c17", None, None), (1001, "karo mitu nemi roka tune karo", None, None)]
    kept = {r.doc_id for r in li.keep_known(docs(spark, rows)).collect()}
    assert 1000 not in kept and 1001 in kept and len(kept) >= 119
    bare = [(i, t, None, s) for i, t, _, s in rows] + [(2000, "...", None, None)]
    assert {r.doc_id for r in li.keep_known(docs(spark, bare)).collect()} == {i for i, *_ in rows}


def test_odd_texts_have_no_language(spark):
    rows = spoken(90) + [(1000 + i, t, "xx", None) for i, t in enumerate(ODD)] + [(None, "karo mitu", None, None)]
    got = {r.doc_id: r.lang_pred for r in li.identify(docs(spark, rows)).collect()}
    assert [got[1000 + i] == "und" for i in range(len(ODD))] == [True, True, True, True, False, False, False]
    known = li.keep_known(docs(spark, rows))
    assert known.columns == docs(spark, []).columns and known.count() == len(rows) - 5  # a lone é has n-grams that no landmark holds
    assert li.identify(docs(spark, [])).count() == 0
    assert {r.lang_pred for r in li.identify(docs(spark, [(1, "abc", None, None)])).collect()} == {"und"}


# --- decontamination ---


def brute_hits(text, items, n=10):
    w = word_list(text)
    hit, found = set(), set()
    for k, t in items:
        x = word_list(t)
        size = min(n, len(x))
        for i in range(len(x) - size + 1 if size else 0):
            for j in range(len(w) - size + 1):
                if w[j : j + size] == x[i : i + size]:
                    hit.update(range(j, j + size))
                    found.add(str(k))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


def leaky():
    r = random.Random(3)
    v = [f"w{i}" for i in range(40)] + ["É", "ß2"]
    items = [(i, " ".join(r.choices(v, k=r.choice([1, 4, 9, 10, 11, 25])))) for i in range(12)] + [(50, None), (51, ""), (52, "..."), (3, "w1 w2 w3 w4 w5")]
    rows = []
    for i in range(60):
        w = r.choices(v, k=r.randint(0, 60))
        if r.random() < 0.5:
            x = r.choice(items[:12])[1].upper().replace(" ", ", ")
            w[len(w) // 2 : len(w) // 2] = x.split(" ")
        rows.append((i, " ".join(w), "en", "s"))
    return rows + [(100 + i, t, None, None) for i, t in enumerate(ODD)], items


@pytest.mark.parametrize("shard", [dc.SHARD_WINDOWS, 7])
def test_hits_equal_brute_force(spark, shard):
    rows, items = leaky()
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in dc.find_hits(docs(spark, rows), bench, shard_windows=shard).collect()}
    long = max(i for i, *_ in rows)
    assert {i: x for i, x in got.items() if i != long} == {i: brute_hits(t, items) for i, t, *_ in rows if i != long}
    assert got[long][0] == 120_000


def test_many_benchmarks_in_one_session(spark):
    r = random.Random(12)
    texts = [" ".join(r.choices("abcdefgh", k=12)) for _ in range(20)]
    df = docs(spark, [(i, f"x {t} y", "en", "s") for i, t in enumerate(texts)]).repartition(2).cache()
    for i, t in enumerate(texts):
        bench = spark.createDataFrame([(i, t)], "item_id long, text string")
        got = {x.doc_id: tuple(x)[1:] for x in dc.find_hits(df, bench).collect()}
        assert got == {k: brute_hits(f"x {u} y", [(i, t)]) for k, u in enumerate(texts)}


def test_pieces_of_long_items_hold_every_window(spark, monkeypatch):
    rows, items = leaky()
    want = {i: brute_hits(t, items) for i, t, *_ in rows if i < 100}
    monkeypatch.setattr(dc, "PIECE", 7)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {x.doc_id: tuple(x)[1:] for x in dc.find_hits(docs(spark, rows), bench, shard_windows=20).collect() if x.doc_id < 100} == want
    for unit in ("documents", "spans"):
        one, many = (sorted((x.doc_id, x.text) for x in dc.remove_hits(docs(spark, rows), bench, unit, shard_windows=k).collect() if x.text is None or len(x.text) < 9999) for k in (10**6, 20))
        assert one == many


def test_contaminated_rows_and_spans_go(spark):
    rows = [(1, "before A b, c d e f g h i j after", "en", "s"), (2, "clean text", "en", "s"), (3, None, None, None)]
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.remove_hits(docs(spark, rows), bench).collect()) == [2, 3]
    assert {r.doc_id: r.text for r in dc.remove_hits(docs(spark, rows), bench, "spans").collect()} == {1: "before  after", 2: "clean text", 3: None}
    assert dc.remove_hits(docs(spark, rows), bench.limit(0)).count() == 3
    assert dc.find_hits(docs(spark, []), bench).count() == 0
    named = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (None, "x y"), (8, None)], "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in dc.find_hits(docs(spark, [(1, "a b c d", "en", "s"), (2, "x y", "en", "s")]), named).collect()}
    assert got == {1: (4, 3, 2, hashlib.sha256(b"7").hexdigest(), True), 2: (2, 2, 1, hashlib.sha256(b"").hexdigest(), True)}


# --- LM scoring ---


def brute_ppm(training, text):
    """Prediction by partial matching with dicts: the same contexts, escapes and exclusions."""
    counts = defaultdict(Counter)
    for t in training:
        b = bytes([lm.END]) * lm.ORDER + lm.coded(lm.tokens_of(t))
        for i in range(lm.ORDER, len(b)):
            for k in range(lm.ORDER + 1):
                counts[b[i - k : i]][b[i]] += 1

    def p(context, s):
        if context is None:
            return 1 / lm.SYMBOLS
        shorter = context[1:] if context else None
        if context not in counts:
            return p(shorter, s)
        c = counts[context]
        n, d = sum(c.values()), len(c)
        left = 1 - sum(p(shorter, x) for x in c)
        if left <= 1e-9:
            return c[s] / n
        return (c[s] - 0.5) / n if s in c else 0.5 * d / n * p(shorter, s) / left

    seen, out = defaultdict(Counter), 0.0
    b = bytes([lm.END]) * lm.ORDER + lm.coded(lm.tokens_of(text))
    for i in range(lm.ORDER, len(b)):
        low = p(b[i - lm.ORDER : i], b[i])
        if i >= lm.ORDER + lm.ADAPTIVE:
            c = seen[b[i - lm.ADAPTIVE : i]]
            n = sum(c.values())
            if n:
                left = 1 - sum(p(b[i - lm.ORDER : i], x) for x in c)
                low = (c[b[i]] - 0.5) / n if b[i] in c else 0.5 * len(c) / n * low / max(left, 1e-9)
            c[b[i]] += 1
        out += math.log10(low)
    return out


def told(n=40):
    r = random.Random(8)
    v = ["the", "of", "ein", "und", "schön", "reading", "Übung", "x"]
    return [(i, " ".join(r.choices(v, k=r.randint(1, 12))) * r.choice([1, 1, 3]), "en", "s") for i in range(n)]


def test_scores_equal_brute_force(spark):
    rows = told()
    got = {r.doc_id: r for r in lm.score_texts(docs(spark, rows), frequent=3).collect()}
    training = [t for i, t, *_ in rows if held(i, 10)]
    c = Counter(w for t in training for w in [*lm.tokens_of(t), b""])
    n, v = sum(c.values()), len(c)
    for i, t, *_ in rows:
        r, w = got[i], [*lm.tokens_of(t), b""]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 10) == 0, len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    for i, t, *_ in rows[:12]:
        assert got[i].score == pytest.approx(brute_ppm(training, t), abs=2e-3, rel=1e-4)


def test_distributions_sum_to_one():
    raw = [lm.coded(lm.tokens_of(t)) for _, t, *_ in told()]
    g, n = lm.windows(raw, [True] * len(raw))
    levels = []
    for o in range(lm.ORDER + 1):
        levels.append(lm.level(levels, g.view(np.uint64) & np.uint64((1 << (8 * (o + 1))) - 1), n))
    r = random.Random(2)
    for context in [*r.sample(sorted(g >> 8), 40), 0x4141414141]:
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert lm.probability(levels, every).sum() + 1 / 257 * 0 == pytest.approx(1, abs=0.02)


def test_every_context_of_the_corpus_counts(spark):
    r = random.Random(3)
    v = ["".join(r.choices("abcdefghij", k=r.randint(4, 11))) for _ in range(900)] + ["nul\0nul", "Übungen"]
    rows = [(i, " ".join(r.choices(v, k=9)), "en", "s") for i in range(400)]
    rows += [(400 + i, f"{t} {t} {t[:-3]}zq {t}", "en", "s") for i, (_, t, *_) in enumerate(rows[:40])]  # contexts that repeat and go on another way
    whole = {x.doc_id: x.score for x in lm.score_texts(docs(spark, rows)).collect()}
    joined = {x.doc_id: x.score for x in lm.score_texts(docs(spark, rows), sent_windows=50, frequent=7).collect()}
    assert joined == pytest.approx(whole, rel=1e-6)
    training = [t for i, t, *_ in rows if held(i, 10)]
    for i, t, *_ in [x for x in rows if not held(x[0], 10)][:3] + rows[:3] + rows[400:404]:
        assert whole[i] == pytest.approx(brute_ppm(training, t), abs=2e-3, rel=1e-4)


def test_far_repeats_in_a_long_text_count(monkeypatch):
    raw = [lm.coded(lm.tokens_of(t)) for _, t, *_ in told()]
    known = lm.Known(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32))
    keys = np.sort(lm.windows(raw, [True] * len(raw))[0].view(np.uint64))
    more = (keys, np.full(len(keys), -1.0))
    one = lm.whole_scores(raw, known, more)[0]
    monkeypatch.setattr(lm, "PIECE", 40)
    assert lm.whole_scores(raw, known, more)[0] == pytest.approx(one)


def test_odd_texts_are_scored(spark):
    rows = told(12) + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(3, "again", None, None), (None, "no id", None, None)]
    got = lm.score_texts(docs(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.score < 0 and r.base_score < 0 for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (1000, 1001, 1002)} == {1}
    assert lm.score_texts(docs(spark, [])).count() == 0
    alone = lm.score_texts(docs(spark, [(i, "ab", None, None) for i in range(200) if held(i, 10) == 0][:2])).collect()
    assert all(r.train_tokens == 0 and r.score == pytest.approx(-3 * math.log10(257), rel=1e-4) for r in alone)


# --- toxicity ---


def rude(n=600):
    r = random.Random(2)
    calm = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("ra", "so", "tin", "vel", "wo", "xu", "zan")]
    bad = ["grunk", "snarfel", "vexoid", "vexing", "vexor"]
    out, labels = [], []
    for i in range(n):
        w, toxic = r.choices(calm, k=r.randint(5, 80)), r.random() < 0.2
        for _ in range(r.randint(2, 4) if toxic else 0):
            w.insert(r.randrange(len(w)), r.choice(bad))
        out.append((i, " ".join(w).capitalize(), "en", "s"))
        if r.random() < 0.7:
            labels.append((i, int(toxic), None))
    return out, labels, {i for i, t, *_ in out if any(b in t.lower().split() for b in bad)}


LABELS = "doc_id long, toxic int, quality int"


def test_toxic_texts_are_found_in_held_out_rows(spark):
    rows, labels, toxic = rude()
    got = {r.doc_id: r for r in toxicity.judge(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    out = [i for i, *_ in rows if held(i, 3) == 1]
    assert all(got[i].held_out for i in out)
    assert np.mean([got[i].predicted == (i in toxic) for i in out]) > 0.98
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept = {r.doc_id for r in toxicity.keep_clean(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    assert kept == {i for i, r in got.items() if r.score < 0.7}


def test_labels_of_held_out_rows_arent_learnt(spark):
    rows, labels, _ = rude(300)
    other = [(i, y if held(i, 3) != 1 else 1 - y, q) for i, y, q in labels]
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.judge(docs(spark, rows), spark.createDataFrame(x, LABELS)).collect()) for x in (labels, other))
    assert a == b


def test_odd_texts_and_labels(spark):
    rows, labels, _ = rude(200)
    rows = rows + [(1000 + i, t, None, None) for i, t in enumerate(ODD)] + [(0, "again grunk", None, None), (None, "grunk", None, None)]
    labels = labels + [(0, None, None), (None, 1, None), (1000, 1, 1), (5, 7, 1), (1, 0, 0), (1, 0, 0)]
    got = toxicity.judge(docs(spark, rows), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    none = toxicity.judge(docs(spark, rows), spark.createDataFrame([], LABELS)).collect()
    assert {(r.score, r.predicted) for r in none} == {(0.0, 0)}
    assert toxicity.judge(docs(spark, []), spark.createDataFrame(labels, LABELS)).count() == 0


def test_label_model_follows_accurate_voters():
    r = np.random.default_rng(1)
    truth = r.random(2000) < 0.3
    votes = np.stack([truth & (r.random(2000) < 0.7) for _ in range(6)] + [r.random(2000) < 0.02], axis=1).astype(float)
    post = toxicity.label_model(votes, np.where(r.random(2000) < 0.1, ~truth, truth) * 0.9 + 0.02, stray=0.05)
    assert ((post > 0.5) == truth).mean() > 0.97


def test_copies_of_a_voter_count_once():
    r = np.random.default_rng(3)
    truth = r.random(4000) < 0.3
    good = [np.where(truth, r.random(4000) < 0.6, r.random(4000) < 0.05) for _ in range(6)]
    noisy = np.where(r.random(4000) < 0.2, ~truth, truth) * 0.9 + 0.02
    once, often = (toxicity.label_model(np.stack([*good, *[good[0]] * k], axis=1).astype(float), noisy, stray=0.1, beside=1.0) for k in (0, 3))
    only = good[0] & ~np.any(good[1:], axis=0)
    assert only.sum() > 50 and abs(once[only].mean() - often[only].mean()) < 0.2
    assert ((once > 0.5) == truth).mean() > 0.95 and ((often > 0.5) == truth).mean() > 0.95


def test_label_model_equals_brute_force():
    """One round, by going through rows and voters one by one."""
    r = np.random.default_rng(7)
    truth = r.random(300) < 0.4
    votes = np.stack([np.where(r.random(300) < 0.8, truth, r.random(300) < 0.1) for _ in range(4)], axis=1).astype(float)
    start = np.where(r.random(300) < 0.2, ~truth, truth) * 0.8 + 0.1
    rows = [(v, {1: p, 0: 1 - p}) for v, p in zip(votes, start)]

    def count(y, test):
        return sum(w[y] for v, w in rows if test(v))

    def information(i, j):
        out = 0.0
        for y in (0, 1):
            n = count(y, lambda v: True)
            for a in (0, 1):
                for b in (0, 1):
                    c = count(y, lambda v: v[i] == a and v[j] == b)
                    out += c * math.log(c * n / (count(y, lambda v: v[i] == a) * count(y, lambda v: v[j] == b)))
        return out

    tree, inside = {0: None}, [0]
    while len(inside) < 4:
        i, j = max(((i, j) for i in inside for j in range(4) if j not in inside), key=lambda p: information(*p))
        tree[j] = i
        inside.append(j)
    prior = sum(start) / 300
    want = []
    for v, _ in rows:
        logit = math.log(prior / (1 - prior))
        for j, up in tree.items():
            for y in (1, 0):
                n = count(y, lambda u: True)
                p = (count(y, lambda u: u[j]) + 0.5) / (n + 1)
                if up is not None:
                    same = count(y, lambda u: u[up] == v[up])
                    p = (count(y, lambda u: u[j] and u[up] == v[up]) + toxicity.SHRINK * p) / (same + toxicity.SHRINK)
                    p = min(p, 0.5) if not y and v[up] else p
                logit += (1 if y else -1) * math.log(p if v[j] else 1 - p)
        want.append(1 / (1 + math.exp(-logit)))
    assert toxicity.label_model(votes, start, rounds=1, stray=1.0, beside=0.5) == pytest.approx(want, abs=1e-9)


# --- mixing ---


def mixed_rows():
    r = random.Random(6)
    rows = []
    for s, n in (("a", 40), ("b", 3), ("c", 90), ("É", 5), (None, 6)):
        rows += [(len(rows) + i, " ".join(["w"] * r.randint(1, 30)), "en", s) for i in range(n)]
    return rows + [(1, "again", "en", "a"), (None, "x y", None, "c"), (900, None, None, "c"), (901, "", None, None)]


def fair_targets(sizes):
    """Water filling, one round after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, total = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in order if s not in capped]
        level = (total - sum(capped.values())) / max(1e-9, sum(weight[s] for s in open_))
        over = [s for s in open_ if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {s: capped.get(s, level * weight[s]) for s in order}
        capped |= {s: 3.0 * sizes[s] for s in over}


def fair_queue(rows, want, sizes):
    """Words taken of each document, sending one packet after another by virtual finish time."""
    packets, budget, out = [], sum(sizes.values()), Counter()
    for s in want:
        mine = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, len((t or "").split())) for i, t, _, x in rows if x == s)
        sent = 0
        for _ in range(3):
            for _, i, n in mine:
                out[(None if i < 0 else i), n] += 0
                for at in range(0, n, mx.QUANTUM):
                    words = min(mx.QUANTUM, n - at)
                    if sent < want[s]:
                        packets.append(((sent + words) / want[s], s is None, s or "", sent, words, (None if i < 0 else i, n)))
                    sent += words
    for *_, words, key in sorted(packets):
        out[key] += min(words, max(0, budget))
        budget -= words
    return {k: v for k, v in out.items() if k[0] != 1}


@pytest.mark.parametrize("quantum", [mx.QUANTUM, 7])
def test_targets_and_words_taken(spark, monkeypatch, quantum):
    monkeypatch.setattr(mx, "QUANTUM", quantum)
    monkeypatch.setattr(mx.packets, "__defaults__", (quantum,))
    monkeypatch.setattr(mx.served, "__defaults__", (quantum, 1.0))
    rows = mixed_rows()
    df = docs(spark, rows)
    source = {i: s for i, _, _, s in rows}
    got = [(r, source[r.doc_id]) for r in mx.mix(df).collect()]
    sizes, taken = Counter(), Counter()
    for r, s in got:
        sizes[s] += r.size
        taken[s] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = fair_targets(sizes)
    assert min(want.values()) > 0 and sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r, s in got:
        assert r.target == pytest.approx(want[s]) and r.source_size == sizes[s]
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)  # a packet, here a document
    assert sum(taken.values()) == sum(sizes.values())
    assert {(r.doc_id, r.size): r.taken for r, _ in got if r.doc_id != 1} == fair_queue(rows, want, sizes)
    again = sorted(map(str, mx.mix(df.repartition(7)).collect()))
    assert again == sorted(map(str, mx.mix(df).collect()))


def test_emitted_copies(spark):
    df = docs(spark, mixed_rows())
    copies = mx.emit(df).collect()
    assert all(len(r.text.split()) == r.words for r in copies)
    assert sum(r.words for r in copies) == sum(r.taken for r in mx.mix(df).collect())
    assert [r.virtual_finish for r in copies] == sorted(r.virtual_finish for r in copies) and max(Counter(r.epoch for r in copies)) <= 2
    assert mx.mix(docs(spark, [])).count() == 0 and mx.emit(docs(spark, [])).count() == 0
    assert [r.taken for r in mx.mix(docs(spark, [(1, None, None, None)])).collect()] == [0]


# --- licences ---


def test_licences(spark):
    mit = "Copyright (c) 2020 Jane Doe\n" + licenses.TEXTS["MIT"].replace("sublicense", "sub-license").upper().replace("\n", "\r\n")
    rows = [(1, mit, None, None), (2, "Some text.\nRELEASED under the MIT Licence\nmore", None, None), (3, "Licensed under the Apache License, Version 2.0", None, None), (4, licenses.TEXTS["MIT"] + "\nand more", None, None)]
    rows += [(100 + i, t, None, None) for i, t in enumerate(ODD)] + [(2, "x", None, None), (None, None, None, None)]
    got = defaultdict(list)
    for r in licenses.scan(docs(spark, rows)).collect():
        got[r.doc_id].append((r.license, r.notices))
    assert got[1] == [("MIT", "")] and ("Apache-2.0", "Apache-2.0") in got[3] and got[4] == [(None, "")]
    assert sorted(got[2], key=str) == [(None, ""), (None, "MIT")]
    assert all(got[100 + i] == [(None, "")] for i in range(len(ODD)))
    assert licenses.scan(docs(spark, [])).count() == 0


def test_entire_texts_of_every_known_licence(spark, tmp_path):
    rows = []
    for k, t in licenses.TEXTS.items():
        for x in licenses.variants(k, t):
            body = x.replace("license", "licence").replace(", ", ",  ").upper()
            rows.append((len(rows), f"Copyright (c) 2019-2021, Some Body <some@body>\nAll rights reserved.\n\n{body}\n", k, None))
            words = x.split(" ")  # lines broken elsewhere, so that some begin with "copyright holders"
            rows.append((len(rows), "\n".join(w.replace("\n", " ") for w in " ".join(words).replace("COPYRIGHT", "\nCOPYRIGHT").split("\n")), k, None))
    (tmp_path / "Long-1.0.txt").write_text("The Long Licence\n\n" + " ".join(f"clause{i}" for i in range(3000)) + ".")
    rows += [(len(rows), (tmp_path / "Long-1.0.txt").read_text(), "Long-1.0", None), (len(rows) + 1, "\n".join(f"Clause{i}" for i in range(3000)), "Long-1.0", None)]
    got = {r.doc_id: r.license for r in licenses.scan(docs(spark, rows), licenses.read_texts(spark, str(tmp_path))).collect()}
    assert {i: got[i] for i, *_ in rows} == {i: k for i, _, k, _ in rows}
