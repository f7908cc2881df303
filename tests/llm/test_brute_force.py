"""Operators beside brute force, exact round trips and held-out accuracy."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwell.llm import (
    decontaminate, language_id, minmax, pii, piece_sampling, quality_ledger, queries, secret_ledger, shingles, suffix_dedup, toxicity,
)
from tests.llm.conftest import SF_DIR


def removed(docs, length=100):
    """Op 3 by a set of all windows, in order of the documents."""
    seen, out = set(), {}
    for key, text in sorted(docs):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for i in range(len(body) - length + 1):
            window = body[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out[key] = (len(body), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 1])
def test_substrings_equal_brute_force(spark, make, group):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    passages = [text(n) for n in (99, 100, 101, 160, 400)]
    docs = [(i, text(rng.randint(0, 80)) + rng.choice(passages) + text(rng.randint(0, 80)) + rng.choice(passages))
            for i in range(60)] + [(90, "ab" * 400), (91, "é" * 130), (92, text(50)), (93, passages[4]), (94, passages[4])]
    got = suffix_dedup.dedup(make(docs), group=group).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(docs)


def test_longest_previous_factors_equal_their_definition():
    rng = random.Random(1)
    text = bytes(rng.choice(b"ab") for _ in range(200)) + b"\0" * 12
    suffixes = np.array([text[i:i + 12] for i in range(200)], "S12")
    got = suffix_dedup.factors(suffixes, np.arange(200))
    for i in range(200):
        best = 0
        for j in range(i):
            n = 0
            while n < 12 and text[i + n] == text[j + n]:
                n += 1
            best = max(best, n)
        assert got[i] == best


def test_strings_of_a_text_cover_each_window_once_and_meet_where_it_repeats():
    rng = random.Random(2)
    shared = bytes(rng.choice(b"abcdefgh") for _ in range(300))
    keys = []
    for _ in range(2):
        body = bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(0, 200))) + shared + b"zz" * 60
        start, windows, gram, _ = suffix_dedup.strings(body)
        assert [s for a, n in zip(start, windows, strict=True) for s in range(a, a + n)] == list(range(len(body) - 99))
        keys.append({body[s:s + 100]: g for a, n, g in zip(start, windows, gram, strict=True) for s in range(a, a + n)})
    both = keys[0].keys() & keys[1].keys()
    assert len(both) >= 201 and all(keys[0][w] == keys[1][w] for w in both)


def similar(a, b, percent=80):
    return a and b and 100 * len(a & b) >= percent * len(a | b)


def test_near_copies_equal_all_pairs(spark, make):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for family in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 60))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append((len(docs), " ".join(copy) + (" the common line of all of them" if family % 2 else "")))
    docs += [(500, ""), (501, "W1 w2"), (502, "w1\tW2"), (503, "w1")]
    sets = {k: set(shingles.shingle_set(t.encode(), 2).tolist()) for k, t in docs}
    parent = {k: k for k, _ in docs}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minmax.near_copies(make(docs), words=2).collect()}
    assert got == {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_min_max_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 200).astype(np.uint64)])
    (la, ha), (lb, hb) = minmax.signature(np.unique(a)), minmax.signature(np.unique(b))
    assert abs(np.mean(np.concatenate([la == lb, ha == hb])) - 700 / 1100) < 0.15


def test_shingles_take_ascii_space_and_case_only():
    same = lambda a, b: np.array_equal(shingles.shingle_set(a.encode(), 2), shingles.shingle_set(b.encode(), 2))
    assert same("A b\x0bC", "a  B\nc ") and not same("É b c", "é b c") and not same("a b c", "a b c")
    long = "x y " * 600_000
    assert len(shingles.shingle_set(long.encode(), 2)) == 2


def test_windows_of_items_across_blocks(spark, make):
    words = [f"t{i}" for i in range(30)]
    bench = spark.createDataFrame([(1, " ".join(words[:14])), (2, "t20 t21"), (10, "T5")], "item_id long, text string")
    docs = make([(1, "x " + " ".join(words[2:13]) + " y"), (2, "T20, t21!"), (3, "t5 t5"), (4, " ".join(words[:9]))])
    for block in (1, 3, decontaminate.BLOCK_WINDOWS):
        marked, out = decontaminate.hits(docs, bench, block_windows=block)
        got = {r.doc_id: (r[out].n_hit, r[out]["items"]) for r in marked.collect()}
        assert got == {1: (11, ["1", "10"]), 2: (2, ["2"]), 3: (2, ["10"]), 4: (1, ["10"])}


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = []
    for kind, pattern in PII.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))
                    or kind == "card" and 16 <= len(digits) <= 19 and pii.luhn(digits)
                    or kind == "phone" and 8 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return out


def test_anchors_find_what_the_patterns_find():
    rng = random.Random(5)
    for _ in range(4000):
        text = "".join(rng.choice("aZ1290.@+- ()%é_") for _ in range(rng.randint(0, 60)))
        assert [s for s in pii.find(text) if s[0] in PII] == plain_pii(text)
    for text in ("a@b.c@d.e@f.g", "1.2.3.4.5.6.7.8.9", "4111 1111-1111 1111x", "+1 (415) 555-2671.", "9" * 500 + ".1.2.3", "a" * 500 + "@"):
        assert [s for s in pii.find(text) if s[0] in PII] == plain_pii(text)
    # Time in proportion to the length, where backtracking would take its square.
    assert pii.find("9" * 300_000 + "." + "a" * 300_000 + "@" + "+1" + "(" * 300_000) == []


def test_added_kinds_and_redaction():
    text = "see https://x.example/a?b=1. IBAN GB82 WEST 1234 5698 7654 32 account no: 12345678, mail a@b.example"
    kinds = {k for k, _, _ in pii.find(text)}
    assert {"url", "iban", "account", "email"} <= kinds
    clean = pii.redact(text, pii.find(text))
    assert "b.example" not in clean and "[URL]." in clean and "[IBAN]" in clean and "[ACCOUNT]" in clean


@pytest.mark.parametrize(("text", "clean"), [
    ("IBAN DE89370400440532013000 Please pay", "IBAN [IBAN] Please pay"),
    ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "IBAN [IBAN] BIC COBADEFF"),
    ("IBAN: GB82 WEST 1234 5698 7654 32 5 days", "IBAN: [IBAN] 5 days"),
    ("IBAN NO9386011117947 A", "IBAN [IBAN] A"),
    ("IBAN DE89370400440532013000", "IBAN [IBAN]"),
    # No registered length: the last end at which the check digits hold.
    ("IBAN ZZ22370400440532013000 Y", "IBAN [IBAN] Y"),
    ("IBAN DE00 3704 0044 IBAN DE89370400440532013000", "IBAN DE00 3704 0044 IBAN [IBAN]"),
    ("IBAN DE88370400440532013000 Please pay", None),
    ("Account Number: 12345678", "Account Number: [ACCOUNT]"),
    ("ACCOUNT NO. 12345678", "ACCOUNT NO. [ACCOUNT]"),
    ("account Nr 12345678", "account Nr [ACCOUNT]"),
])
def test_accounts_end_where_they_end(text, clean):
    assert pii.redact(text, pii.find(text)) == (clean or text)


def test_ledger_scans_each_blob_once_per_rules(spark, make):
    key = "password = hunter2hunter2"
    docs = make([(1, key), (2, key), (3, "nothing"), (4, None)])
    entries, findings = secret_ledger.update(docs, None)
    assert entries.count() == 3 and findings.count() == 1
    assert {r.doc_id for r in secret_ledger.by_path(docs, findings).filter("n_assign = 1").collect()} == {1, 2}
    more = docs.unionByName(make([(5, "AKIA" + "Q" * 16), (6, key)]))
    entries2, findings2 = secret_ledger.update(more, entries)
    assert entries2.count() == 1 and [r.kind for r in findings2.collect()] == ["access"]
    entries3, findings3 = secret_ledger.update(more, entries, rules="2")
    assert entries3.count() == 4 and findings3.count() == 2


def test_ablations_count_what_each_rule_alone_rejects(spark, documents):
    entries = quality_ledger.ledger(documents).cache()
    rows = entries.collect()
    for r in quality_ledger.ablations(entries).collect():
        policy = next(p for p in quality_ledger.POLICIES if p.version == r.policy)
        bit = 1 << next(x.bit for x in quality_ledger.RULES if x.name == r.rule)
        masked = [x.fail_bits & policy.mask() for x in rows]
        assert (r.n_failed, r.n_alone, r.n_kept) == (
            sum(bool(m & bit) for m in masked), masked.count(bit), masked.count(0))


def test_samples_follow_the_exact_distribution_and_decode():
    with open(piece_sampling.MODEL, "rb") as f:
        pieces = piece_sampling.Pieces(f.read())
    spelled, all_ways = "▁hello", {}

    def ways(at, ids, weight):
        if at == len(spelled):
            all_ways[tuple(ids)] = weight
        for end in range(at + 1, len(spelled) + 1):
            if (i := pieces.ids.get(spelled[at:end])) is not None:
                ways(end, [*ids, i], weight * pieces.weight[i])

    ways(0, [], 1.0)
    total = sum(all_ways.values())
    drawn = collections.Counter(tuple(x.tolist()) for x in pieces.encode(["hello"] * 20_000, list(range(20_000))))
    assert set(drawn) <= set(all_ways)
    assert max(abs(drawn[w] / 20_000 - p / total) for w, p in all_ways.items()) < 0.015
    texts = ["", " ", "a▁ b", "\0\n\t", "é\U0001F600 ß" * 40, "x" * 300 + " y", "ab " * 50]
    seeds = list(range(len(texts)))
    together = pieces.encode(texts, seeds)
    for text, seed, ids in zip(texts, seeds, together, strict=True):
        data, _ = pieces.decode(ids, np.array([0, len(ids)]))
        assert bytes(data).decode() == text
        assert np.array_equal(pieces.encode([text], [seed])[0], ids)


def test_round_trip_of_a_table_is_lossless_and_alike_in_any_partitioning(spark, documents):
    one = piece_sampling.round_trip(documents.coalesce(1)).collect()
    many = {r.doc_id: r.pieces for r in piece_sampling.round_trip(documents.repartition(5)).collect()}
    assert all(r.lossless and many[r.doc_id] == r.pieces for r in one)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(6)
    terms = ["moron", "idiot", "scum", "stupid", "stupor"]
    machine = toxicity.Automaton(terms, ["achli"])
    for _ in range(5000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            at, kind = rng.randrange(len(word)), rng.randrange(3)
            word[at:at + (kind != 1)] = [] if kind == 0 else [rng.choice("mopdxs")]
            word = word or ["x"]
        word = "".join(word)
        want = {(t, d) for t in terms if (d := edit_distance(t, word)) <= (1 if len(t) >= 5 else 0)}
        assert {x for x in machine.read(word) if x[0][-1] != "*"} == want
    assert machine.read("achlich") == [("achli*", 0)] and machine.read("achli") == []


def test_quotation_is_not_abuse():
    reader = toxicity.Reader(["moron"], [])
    assert list(reader.hits("you moron")) == [("moron", 0, False)]
    assert list(reader.hits('she wrote "what a moron" yesterday')) == [("moron", 0, True)]


def test_a_harmless_neighbour_does_not_excuse_other_spellings(spark, make):
    clean = [f"plain words of number{'abcdefghij'[i % 10]} about oron" for i in range(200)]
    toxic = ["you moron"] * 60 + ["you morron"] * 3
    ids = [i for i in range(1000) if zlib.crc32(str(i).encode()) % 5]
    rows = list(zip(ids, clean + toxic, [0] * len(clean) + [1] * len(toxic)))
    model = toxicity.fit(make([r[:2] for r in rows]), spark.createDataFrame(
        [(i, t) for i, _, t in rows], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.scored(make(
        [(1, "see oron"), (2, "see morron"), (3, "see moroon"), (4, "see moron"), (5, "see")]), model).collect()}
    assert score[1] < 0.1 and score[5] < 0.1
    # 'moroon' stands in no labelled document.
    assert score[2] > 0.5 and score[3] > 0.5 and score[4] > 0.5


def test_toxicity_and_language_on_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    rows = queries.op8_toxicity(spark, sf_dir).join(labels, "doc_id").filter("held_out").collect()
    toxic, rest = ([r.score for r in rows if r.toxic == t] for t in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in rest]) > 0.9
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.filter("doc_id % 2 = 0"))
    told = language_id.identify(language_id.text_rows(docs.filter("doc_id % 2 = 1")), model)
    right = told.join(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")), "id")
    assert right.filter("lang = label").count() / right.count() > 0.97


def test_every_labelled_language_gives_texts(spark):
    rows = [(i, "the house and the tree", "en") for i in range(1000)] + [(1000 + i, f"qx{i} zq{i}", f"l{i:03}") for i in range(210)]
    rows.append((2000, "", "none"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, sample=250)
    assert model.languages == ["en", *(f"l{i:03}" for i in range(210))]
    assert all(model.languages[model.evidence(t.encode()).argmax()] == lang for _, t, lang in rows[999:-1])
    drawn = language_id._drawn(docs.filter("text <> ''").select("doc_id", "lang").toDF("id", "lang"),
                               {"en": 1000} | {f"l{i:03}": 1 for i in range(210)}, 250).collect()
    assert collections.Counter(r.lang for r in drawn) == {"en": 40} | {f"l{i:03}": 1 for i in range(210)}
    assert language_id._quota([3, 1, 9], 7) == 3 and language_id._quota([5] * 9, 4) == 1


def test_hosts_and_declarations_decide_where_the_text_does_not(spark):
    likelihoods = language_id.fit(spark.createDataFrame(
        [(i, t * 20, l) for i, (t, l) in enumerate([("the house and the tree ", "en"), ("das haus und der baum ", "de")] * 5)],
        "doc_id long, text string, lang string"))
    page = "<html lang='{}'><body>{}</body></html>"
    rows = [(i, "http://www.eins.example/", page.format("de", "das haus und der baum " * 9)) for i in range(20)]
    rows += [(i, "http://two.example.uk/", page.format("en", "the house and the tree " * 9)) for i in range(20, 40)]
    rows += [(50, "http://www.eins.example/x", page.format("de", "42")), (51, "http://two.example.uk/y", "<html>42</html>"), (52, None, None)]
    got = language_id.identify(language_id.page_rows(spark.createDataFrame(
        rows, "page_id long, url string, html string")), likelihoods)
    lang = {r.id: r.lang for r in got.collect()}
    assert lang[50] == "de" and lang[51] == "en" and lang[52] in ("de", "en") and len(lang) == 43


def test_pipeline_stages_equal_brute_force(spark, documents):
    """Each stage beside a plain version on the rows that the stage before it kept."""
    rows = {r.doc_id: r.text for r in documents.collect()}
    entries = {r.doc_id: r.fail_bits for r in quality_ledger.ledger(documents).collect()}
    stages = dict(corpus_pipeline.STAGES)
    docs = stages["quality"](spark, documents, SF_DIR)
    kept = {k for k, b in entries.items() if not b & quality_ledger.PRODUCTION.mask()}
    assert {r.doc_id for r in docs.collect()} == kept

    sets = {k: set(shingles.shingle_set(rows[k].encode(), 5).tolist()) for k in kept}
    parent = {k: k for k in kept}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in kept:
        for b in kept:
            if a < b and similar(sets[a], sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    docs = stages["near_copies"](spark, docs, SF_DIR)
    kept = {k for k in kept if root(k) == k}
    assert {r.doc_id for r in docs.collect()} == kept

    windows = set()
    for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect():
        w = decontaminate.words_of((r.text or "").encode())
        windows |= {tuple(w[i:i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    assert {len(w) for w in windows} == {10}

    def hit(text):
        w = decontaminate.words_of(text.encode())
        return any(tuple(w[i:i + 10]) in windows for i in range(len(w) - 9))

    docs = stages["decontamination"](spark, docs, SF_DIR)
    kept = {k for k in kept if not hit(rows[k])}
    assert {r.doc_id for r in docs.collect()} == kept

    docs = stages["personal_data"](spark, docs, SF_DIR)
    got = {r.doc_id: r for r in docs.collect()}
    assert {k: r.text for k, r in got.items()} == {k: pii.redact(rows[k], pii.find(rows[k])) for k in kept}
    assert all(r.n_chars == len(r.text) and not plain_pii(r.text) for r in got.values())

    last = corpus_pipeline.run(spark, SF_DIR)
    back, text = piece_sampling.decoded(last, "pieces")
    assert {r.doc_id: r[text] for r in back.collect()} == {k: r.text for k, r in got.items()}
