"""Every operator on nulls, empty and long texts, repeated rows, empty tables and clashing names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairwell.llm import (
    chat, decontaminate, language_id, minmax, pii, piece_sampling, quality_ledger, secret_ledger, suffix_dedup, toxicity,
)

LONG = "word and more of it " * 20_000
ROWS = [(1, None), (2, ""), (3, " \n "), (4, "one"), (4, "one"), (None, "no key here"), (5, LONG), (6, "a\0b ▁ é")]
BENCH = "item_id long, text string"

OPERATORS = {
    "quality": lambda d, s: quality_ledger.ledger(d),
    "kept": lambda d, s: quality_ledger.keep(d),
    "secrets": lambda d, s: secret_ledger.by_path(d, secret_ledger.scan(secret_ledger.unseen(d, None))),
    "pii": lambda d, s: pii.digest(d),
    "redacted": lambda d, s: pii.redacted(d),
    "decontaminated": lambda d, s: decontaminate.report(d, s.createDataFrame([(1, "one"), (None, "x"), (2, None)], BENCH)),
    "clean": lambda d, s: decontaminate.clean(d, s.createDataFrame([], BENCH)),
    "near copies": lambda d, s: minmax.near_copies(d),
    "first of each": lambda d, s: minmax.first_of_each(d),
    "suffixes": lambda d, s: suffix_dedup.dedup(d),
    "pieces": lambda d, s: piece_sampling.round_trip(d),
    "toxicity": lambda d, s: toxicity.scored(d, toxicity.Model({"moron": 5.0})),
    "language": lambda d, s: language_id.identify(
        language_id.text_rows(d.withColumn("source", F.lit(None).cast("string"))),
        language_id.fit(d.withColumn("lang", F.when(F.length("text") > 2, "en")))),
}
FILTERS = {"kept", "clean", "first of each"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, make, name):
    rows = OPERATORS[name](make(ROWS), spark).collect()
    assert len(rows) <= len(ROWS) if name in FILTERS else len(rows) == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, make, name):
    assert OPERATORS[name](make([]), spark).collect() == []


def test_values_of_odd_rows(spark, make):
    docs = make(ROWS)
    quality = {r.doc_id: r for r in quality_ledger.ledger(docs).collect()}
    assert quality[1].n_words == quality[3].n_words == 0 and quality[1].fail_bits & 1
    assert quality[5].n_words == quality[5].n_repeat_words == 100_000
    near = {r.doc_id: r for r in minmax.near_copies(docs).collect()}
    assert near[1].component_id == 1 and near[1].kept and near[1].n_shingles == 0
    assert near[4].component_id == 4 and near[None].component_id is None and near[None].kept
    cut = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    assert cut[1].n_bytes == 0 and cut[4].n_removed == 0 and cut[5].n_removed == len(LONG) - 20
    pieces = {r.doc_id: r for r in piece_sampling.round_trip(docs).collect()}
    assert pieces[1].pieces is None and all(r.lossless for r in pieces.values())
    hits = {r.doc_id: r for r in decontaminate.report(docs, spark.createDataFrame([(1, "one")], BENCH)).collect()}
    assert hits[4].n_hit == 1 and hits[4]["items"] == ["1"] and hits[1].n_words == 0


def test_filters_keep_the_columns_of_their_input(spark, make):
    docs = make(ROWS + [(9, "clean words that nobody else has written " * 2)])
    for name in sorted(FILTERS | {"redacted"}):
        assert OPERATORS[name](docs, spark).columns == docs.columns


def test_chat_odd_rows(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "a\\n<|im_end|>"), (1, 1, "assistant", "a\\n<|im_end|>"),
            (None, None, "user\nx", "hi"), (2, 0, "assistant", "")]
    given = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("example", F.lit(1))
    made = chat.examples(given)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert back[1].n_turns == 3 and back[1].loss_chars == 2 * len(rows[1][3]) and back[1].n_examples == 2
    assert back[None].n_turns == 1 and back[None].loss_chars == 0 and back[2].n_examples == 1
    turns = {tuple(t) for r in made.select(chat.parse(F.col("text")).alias("t")).collect() for t in r.t}
    assert ("user\nx", "hi") in turns and ("assistant", rows[1][3]) in turns
    for r in made.filter("loss_start is not null").collect():
        assert r.text[r.loss_end:] == "<|im_end|>\n"
    assert chat.read_back(chat.examples(given.limit(0))).collect() == []


def test_pipeline_on_odd_rows(spark, make, tmp_path):
    clean = " ".join(f"clean{i} prose{i * 7}" for i in range(40))
    mail = clean.replace("clean", "other") + " write to a.b@c.example"
    docs = make([*ROWS, (20, clean), (21, clean), (22, mail)])
    spark.createDataFrame([(1, "never found " * 6)], BENCH).write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept) == {20, 22} and kept[22].endswith("write to [EMAIL]")
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.columns[:-1] == docs.columns and last.count() == 2
