"""The operators' methods: long segments, ledgers over deliveries, automata, models on odd labels, posteriors."""

import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwell.llm import language_id, minmax, piece_sampling, secret_ledger, toxicity


@pytest.fixture(scope="module")
def pieces():
    with open(piece_sampling.MODEL, "rb") as f:
        return piece_sampling.Pieces(f.read())


def ends_of(pieces, text):
    """The exact chance of a piece to end behind each character, over all segmentations."""
    spelled = "▁" + text
    weight = {p: Decimal(float(pieces.weight[i])) for p, i in pieces.ids.items()}
    n = len(spelled)
    one, none = Decimal(1), Decimal(0)
    before, after = [one] + [none] * n, [none] * n + [one]
    for j in range(1, n + 1):
        before[j] = sum(before[i] * weight.get(spelled[i:j], none) for i in range(max(0, j - pieces.longest), j))
    for i in range(n - 1, -1, -1):
        after[i] = sum(after[j] * weight.get(spelled[i:j], none) for j in range(i + 1, min(n, i + pieces.longest) + 1))
    return np.array([float(before[j] * after[j] / before[n]) for j in range(1, n + 1)])


@pytest.mark.parametrize("text", ["a" * 90, "thequickbrownfoxjumpsoverthelazydog" * 3, "xqzjkvwpyx" * 9])
def test_long_segments_follow_the_exact_distribution(pieces, text):
    assert len(text) > pieces.short
    spelled = {i: p for p, i in pieces.ids.items()}
    n, got = 3000, np.zeros(len(text) + 1)
    for ids in pieces.encode([text] * n, list(range(n))):
        got[np.cumsum([len(spelled[i]) for i in ids.tolist()]) - 1] += 1
    assert np.abs(got / n - ends_of(pieces, text)).max() < 0.05


def test_unspaced_texts_are_cut_and_come_back(pieces, monkeypatch):
    rng = random.Random(3)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFabcdef0123456789+/", "".join(map(chr, range(0x4E00, 0x4F00))), "a"]
    texts = ["".join(rng.choice(a) for _ in range(4000)) for a in alphabets] + ["x\0" * 500]
    whole = pieces.encode(texts, [1, 2, 3, 4, 5])
    for text, ids in zip(texts, whole, strict=True):
        data, _ = pieces.decode(ids, np.array([0, len(ids)]))
        assert bytes(data).decode() == text
    # The same draws on the uncut segment give the same pieces, but for a rounding at the edge of a draw.
    monkeypatch.setattr(piece_sampling.Pieces, "_cut", lambda self, codes, start, size: (start, size))
    for a, b in zip(whole, pieces.encode(texts, [1, 2, 3, 4, 5]), strict=True):
        assert abs(len(a) - len(b)) <= 2 and np.mean(a[:len(b)] == b[:len(a)]) > 0.5


def test_a_ledger_over_deliveries_scans_each_blob_once(spark, make):
    key = "password = hunter2hunter2"
    first = make([(1, key), (2, "plain"), (3, None), (3, None)])
    second = make([(4, key), (5, "token: abcdefgh12"), (6, ""), (None, "plain"), (7, key)])
    ledger, findings = secret_ledger.deliver([first, second])
    assert ledger.count() == ledger.select("blob").distinct().count() == 4
    assert findings.count() == 2
    # Sent again, nothing is scanned and nothing stands twice; other rules scan all.
    again, same = secret_ledger.deliver([second, first], ledger, findings)
    assert again.count() == 4 and same.count() == 2
    assert secret_ledger.unseen(second, ledger).count() == 0
    both, more = secret_ledger.deliver([second], ledger, findings, rules="2")
    assert both.filter("rules = '2'").count() == 4 and more.filter("rules = '2'").count() == 2
    rows = {r.doc_id: r.n_assign for r in secret_ledger.by_path(first.unionByName(second), findings).collect()}
    assert rows == {1: 1, 2: 0, 3: 0, 4: 1, 5: 1, 6: 0, None: 0, 7: 1}
    # One delivery gives what two give.
    alone = secret_ledger.deliver([first.unionByName(second)])[1]
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, findings.collect()))


def test_ledgers_of_nothing(spark, make):
    nothing = spark.createDataFrame([], secret_ledger.LEDGER)
    nulls = spark.createDataFrame([(None, None), (None, "1")], secret_ledger.LEDGER)
    docs = make([(1, "secret: abcdefgh1234"), (2, None)])
    for ledger in (None, nothing, nulls):
        entries, findings = secret_ledger.update(docs, ledger)
        assert entries.count() == 2 and findings.count() == 1
    entries, findings = secret_ledger.update(make([]), nothing)
    assert entries.count() == 0 and findings.count() == 0
    assert secret_ledger.deliver([make([])])[1].count() == 0


def test_letters_of_no_term_share_one_step():
    plain, odd = toxicity.Automaton(["moron", "idiot"], ["stupi"]), toxicity.Automaton(["moron", "idiot"], ["stupi"])
    for i in range(20_000):
        odd.read("mor" + chr(0x4E00 + i) + "n")
    assert len(odd.sets) < 200 and max(map(len, odd.steps)) <= len(odd.letters) + 1
    for word in ("morön", "moronx", "stupid", "x", "idiót", "idio"):
        assert odd.read(word) == plain.read(word)
    assert odd.read("mor中n") == [("moron", 1)]


def test_models_of_odd_labels(spark, make):
    docs = make([(i, ["you moron", None, "", "clean words"][i % 4]) for i in range(80)] + [(4, "you moron")])
    label = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    cases = {
        "none": [], "all clean": [(i, 1, 0) for i in range(80)], "all toxic": [(i, 0, 1) for i in range(80)],
        "nulls": [(None, 1, 1), (1, 1, None), (2, None, 0)],
        "repeated": [(i, 0, int(i % 4 == 0)) for i in range(80)] * 2,
    }
    for name, rows in cases.items():
        scores = {r.doc_id: r.score for r in toxicity.scored(docs, toxicity.fit(docs, label(rows))).collect()}
        assert all(0 <= s <= 1 for s in scores.values())
        if name == "repeated":
            assert scores[0] > 0.5 > scores[1]
        elif name != "all toxic":
            assert len(set(scores.values())) == 1


def test_posteriors_equal_a_plain_recomputation(spark):
    rng = random.Random(5)
    say = {"de": "und der die das ist nicht ein haus", "en": "and the this that is not a house", "fr": "et le la les est pas une maison"}
    text = lambda lang, n: " ".join(rng.choice(say[lang].split()) for _ in range(n))
    likelihoods = language_id.fit(spark.createDataFrame(
        [(i, text(lang, 30), lang) for i, lang in enumerate(list(say) * 20)], "doc_id long, text string, lang string"))
    names = likelihoods.languages
    assert names == sorted(say)
    rows = []
    for i in range(120):
        lang = rng.choice(names)
        host = rng.choice([f"a.{lang}.net", f"b.{lang}.net", "mixed.org", None])
        rows.append((i, rng.choice([text(lang, 12), text(lang, 2), "", None]), rng.choice([lang, lang, "en", None]), host,
                     host and ".".join(host.split(".")[-2:]), host and host.split(".")[-1]))
    got = language_id.identify(spark.createDataFrame(
        rows, "id long, text string, declared string, host string, domain string, suffix string"), likelihoods)

    evidence = np.array([likelihoods.evidence((r[1] or "").encode()) for r in rows])
    share = np.exp(evidence - evidence.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    columns = {"declared": 2, "host": 3, "domain": 4, "suffix": 5}
    size, smooth = len(names), language_id.PRIOR

    def rest(i, column=None, value=None):
        """Posteriors of the other rows: all, those with the column, or those with its value."""
        held = [share[j] for j, r in enumerate(rows) if j != i and (
            column is None or (r[column] is not None if value is None else r[column] == value))]
        return np.sum(held, axis=0) if held else np.zeros(size)

    want = {}
    for i, row in enumerate(rows):
        prior = (rest(i) + smooth / size) / (rest(i).sum() + smooth)
        for kind in ("domain", "host"):
            if (value := row[columns[kind]]) is not None:
                own = rest(i, columns[kind], value)
                prior = (own + smooth * prior) / (own.sum() + smooth)
        logits = evidence[i] + np.log(prior)
        for kind in ("declared", "suffix"):
            if (value := row[columns[kind]]) is not None:
                own, whole = rest(i, columns[kind], value), rest(i, columns[kind])
                often = (own.sum() + 1) / (whole.sum() + 2)
                logits = logits + np.log((own + smooth * often) / (whole + smooth))
        p = np.exp(logits - logits.max())
        want[i] = (names[int(np.argmax(logits))], float(p.max() / p.sum()))
    moved = 0
    for r in got.collect():
        assert math.isclose(r.probability, want[r.id][1], rel_tol=1e-6) and (r.lang == want[r.id][0] or r.probability < 0.51)
        moved += r.lang != r.text_lang
    assert moved > 5


def test_near_copies_of_a_template_stand_alone(spark, make):
    template = [f"t{i}" for i in range(38)]
    docs = [(i, " ".join([*template[:9], f"own{i}a", *template[9:19], f"own{i}b", *template[19:30], f"own{i}c", *template[30:]]))
            for i in range(600)]
    docs += [(1000 + i, docs[i][1] + " end") for i in range(0, 600, 7)]
    got = {r.doc_id: r.component_id for r in minmax.near_copies(make(docs), words=2).collect()}
    assert got == {k: k - 1000 if k >= 1000 else k for k, _ in docs}
