"""N-gram join, spelling variants and hard negatives beside brute force, and on odd rows."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import hard_negatives, ngram_join, shingles, spelling
from tests.llm.test_edges import LONG, ROWS


# N-gram join

def grouped(docs, words=5, percent=80):
    """Components over all pairs, row by row."""
    sets = [(k, set(shingles.shingle_set((t or "").encode(), words).tolist())) for k, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and None not in (sets[i][0], sets[j][0]) and 100 * len(a & b) >= percent * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (k, s) in enumerate(sets):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return Counter((k, len(s), least.get(root(i)) if k is not None else None) for i, (k, s) in enumerate(sets))


def found(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in df.collect())


def mutated(rng, base, words, most):
    copy = list(base)
    for _ in range(rng.randint(0, most)):
        at = rng.randrange(len(copy))
        rng.choice([lambda: copy.insert(at, rng.choice(words)), lambda: copy.__setitem__(at, rng.choice(words)),
                    lambda: len(copy) > 5 and copy.pop(at)])()
    return copy


@pytest.mark.parametrize("words, percent", [(5, 80), (2, 80), (1, 60)])
def test_ngram_join_equals_all_pairs(spark, make, words, percent):
    rng = random.Random(words)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([3, 6, 20, 60, 160]))]
        for _ in range(14):
            text = " ".join(mutated(rng, base, vocabulary, 6))
            docs.append((len(docs), text + (" the common line of all of them" if family % 2 else "")))
    docs += [(500, ""), (501, "W1 w2"), (502, "w1\tW2"), (503, "w1"), (504, None), (None, docs[3][1]), (7, docs[40][1]), (7, docs[40][1])]
    assert found(ngram_join.similar_groups(make(docs), words=words, percent=percent)) == grouped(docs, words, percent)


def test_sets_of_a_template_that_are_not_similar_never_meet(spark, make):
    rng = random.Random(5)
    template = [f"t{i}" for i in range(38)]
    # 34 of 40 shingles are the template's: 74 % similar.
    docs = [(i, " ".join([*template[:9], f"own{i}a", *template[9:19], f"own{i}b", *template[19:30], f"own{i}c", *template[30:]]))
            for i in range(400)]
    rng.shuffle(docs)
    sets = spark.createDataFrame(
        [(k, shingles.shingle_set(t.encode(), 2).view(np.int64).tolist()) for k, t in docs], "id long, codes array<long>")
    filters = ngram_join.prefixes(sets, 80)
    none = spark.createDataFrame([], "id long, component long")
    assert filters.count() == 400 and ngram_join.across(filters, none, 80).count() == 0
    assert found(ngram_join.similar_groups(make(docs), words=2)) == Counter((k, 40, k) for k, _ in docs)


def test_prefixes_under_every_order_meet_for_similar_sets():
    rng = np.random.default_rng(3)
    often = rng.integers(2, 50, 4000)
    tokens = np.arange(4000).astype(np.uint64)
    for _ in range(200):
        n = int(rng.integers(1, 80))
        a = rng.choice(4000, n, replace=False)
        b = np.unique(np.concatenate([a[int(n * rng.random() * 0.2):], rng.choice(4000, int(n * 0.2 * rng.random()))]))
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        shown = [[set(x[p][:ngram_join.prefix_length(len(x), 80)].tolist()) for p in ngram_join.ordered(tokens[x], often[x])]
                 for x in (a, b)]
        assert all(x & y for x, y in zip(*shown, strict=True))


def test_ngram_join_on_odd_rows(spark, make):
    got = ngram_join.similar_groups(make(ROWS))
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(got) == grouped(ROWS)
    assert ngram_join.similar_groups(make([])).collect() == []


# Spelling variants

def spelled(docs, ratio=5, min_count=5, damage=199):
    counts = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            counts[run[:h % len(run)] + run[h % len(run) + 1:] if h % damage == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 6 and c >= min_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    others = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(((-n[x], x) for x in others[w]), default=None)
        form[w] = best[1] if best and -best[0] >= ratio * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(others[w]), n[form[w]] if form[w] else None)
    return out


def word_rows(df):
    rows = df.collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(got) == len(rows)
    return got


@pytest.mark.parametrize("size", [spelling.PARTITION, 2])
def test_spelling_variants_equal_brute_force(spark, make, size):
    rng = random.Random(9)
    stems = ["banana", "aaaaaa", "letter", "lettre", "garçons", "combination", "ÀÿÉéÀÿÉ", "xyzxyzxyz"]
    words = []
    for stem in stems:
        for _ in range(25):
            word = stem
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(word) + 1)
                word = rng.choice([word[:at] + rng.choice("abelÿ") + word[at:], word[:at] + word[at + 1:],
                                   word[:at] + rng.choice("abelÿ") + word[at + 1:]])
            words += [word] * rng.choice([4, 5, 6, 30, 40, 200, 900])
    rng.shuffle(words)
    docs = [(i, rng.choice(" ,-\n7").join(words[i * 50:i * 50 + 50])) for i in range(len(words) // 50 + 1)]
    want = spelled(docs)
    assert sum(v[3] for v in want.values()) > 200 and any(v[0] != v[1] for v in want.values() if v[0])
    counts = spelling.word_counts(make(docs))
    assert word_rows(spelling.variants(counts, size=size)) == want


def test_composition_lists_each_pair_once_from_a_minimal_acceptor():
    rng = random.Random(2)
    for _ in range(200):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 60))})
        acceptor = spelling.Acceptor(words)
        pairs = [tuple(sorted(p)) for p in spelling.one_edit_pairs(acceptor)]
        want = {(a, b) for a, b in itertools.combinations(words, 2)
                if (len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1)
                or (abs(len(a) - len(b)) == 1 and any(
                    max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1:] == min(a, b, key=len) for i in range(7)))}
        assert sorted(pairs) == sorted(want)
    # One state for each different set of endings: four letters, then the same end.
    assert len({id(a) for a in [spelling.Acceptor(["ax", "bx", "cx", "dx"]).arcs[0]]}) == 1
    start = spelling.Acceptor(["ax", "bx", "cx", "dx"])
    assert len(set(start.arcs[0].values())) == 1


def test_spelling_on_odd_rows(spark, make):
    long = "ab" * 5000
    docs = ROWS + [(20, " ".join([long] * 5 + [long[:4000] + "c" + long[4000:]] * 30 + ["key here words"] * 5)), (20, None)]
    got = word_rows(spelling.spelling_variants(make(docs)))
    assert got == spelled(docs) and max(map(len, got)) >= 10_000
    assert spelling.spelling_variants(make([])).collect() == []
    assert spelling.spelling_variants(make([(1, LONG[:99])])).collect() == []


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE", 7)
    letter = re.compile("[a-z]")
    text = "one two three-four fivesixseveneight nine"
    parts = list(spelling._slices(text, letter))
    assert "".join(parts) == text and len(parts) > 3
    assert [w for p in parts for w in re.findall("[a-z]+", p)] == re.findall("[a-z]+", text)


# Hard negatives

def mined(points, every=10, k=5, n=10):
    rows = {}
    for i, vec, label in points:
        if i is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        whole = (label, [math.floor(256 * x) for x in vec])
        rows[i] = min(whole, rows.get(i, whole))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for i in (i for i in rows if i % every == 0):
        label, vec = rows[i]
        scored = sorted((-dot(vec, v), j, x) for j, (x, v) in rows.items() if j != i)
        for score, j, _ in [s for s in scored if s[2] == label][:k]:
            inside = [s for s in scored if s[2] != label and 30 * -score <= 100 * -s[0] <= 90 * -score]
            out += [(i, j, r, s[1], -score, -s[0]) for r, s in enumerate(inside[:n], 1)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("rows, anchors", [(hard_negatives.ROWS, hard_negatives.ANCHORS), (16, 4)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(hard_negatives, "ROWS", rows)
    monkeypatch.setattr(hard_negatives, "ANCHORS", anchors)
    rng = random.Random(1)
    centers = [[rng.gauss(0, 1) for _ in range(21)] for _ in range(4)]
    points = []
    for i in range(400):
        # Two thirds have one label; a tenth are copies of one vector.
        label = rng.choice([0, 0, 0, 0, 1, 2])
        vec = centers[0] if i % 10 == 3 else [c + rng.gauss(0, 0.7) for c in rng.choice(centers)]
        points.append((i, [float(np.float32(x)) for x in vec], label))
    got = hard_negatives.mine(spark.createDataFrame(points, VECTORS), F.col("id") % 10 == 0)
    want = mined(points)
    assert len(want) > 200 and sorted(map(tuple, got.collect())) == want


def test_hard_negatives_on_odd_rows(spark):
    points = [
        (0, [1.0, 1.0], 1), (10, [1.0, 0.5], 1), (20, [], 1), (1, [0.5], 2), (2, [0.5, None], 2), (3, None, 2), (None, [1.0], 2),
        (4, [float("nan"), 1.0], 2), (5, [float("inf")], 2), (6, [0.5, 0.25, 3.0], 2), (7, [0.9, 0.2], None),
        (8, [0.5, 0.2], 2), (8, [0.5, 0.2], 2), (9, [-1.0, -1.0], 2), (30, [0.4, 0.4], 3), (40, [0.0], 2)]
    df = spark.createDataFrame(points, VECTORS).withColumns({c: F.lit("clash") for c in ("id", "rank", "block", "group", "row")})
    got = hard_negatives.mine(df, F.col("id") % 10 == 0)
    assert sorted(map(tuple, got.collect())) == mined(points)
    assert hard_negatives.mine(df.limit(0), F.col("id") % 10 == 0).collect() == []


def test_a_scan_leaves_rows_out_before_it_has_read_all():
    rng = np.random.default_rng(4)
    columns = rng.integers(-3, 4, (64, 500))
    columns[:8] *= 100
    anchor = columns[:, 0].copy()
    seen = []

    def keep(least, most, inner=hard_negatives.among_best(3)):
        seen.append(len(least))
        return inner(least, most)

    rows, score = hard_negatives.vertical_scan(anchor, columns, columns.min(axis=1), columns.max(axis=1), np.ones(500, bool), keep)
    true = anchor @ columns
    assert seen[0] == 500 and seen[-1] < 50
    assert set(np.argsort(-true)[:3]) <= set(rows.tolist()) and (score == true[rows]).all()
