"""Cases in which an operator once did less than the whole job."""

import random

import corpus_pipeline
from weftscan.llm import chat, toxicity

SF = "/root/testdata/sf0.001"


def _chat(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string").selectExpr("*", "'user' as role")
    return {(r.conv_id, r.turn): r for r in chat.format_chat(table).collect()}


def test_partial_and_trimmed_quotes_link(spark):
    rows = [
        (1, 0, "In the drawer.\nOn top."),
        (1, 1, "> in the drawer.\nThanks"),
        (1, 2, "A first paragraph\nof two lines.\n\nThe second one. It has two sentences.\r\n\r\nThe third."),
        (1, 3, "> The second one.   It has\n> two sentences.\nyes"),
        (1, 4, "> paragraph\n> of two lines.\n>\n> The second one. It has\nno"),
        (1, 5, "> It has two sentences.\nwhy"),
        (1, 6, "> said by nobody\nx"),
        (2, 0, "On top.\nAll of it, said here."),
        (2, 1, "> On top.\n> All of it, said here.\ny"),
        # all lines are said inside, the whole passage elsewhere
        (3, 0, "head\nOn top.\nAll of it, said here.\ntail"),
        (3, 1, "> On top.\n> All of it, said here.\nz"),
        # elsewhere more of it is said than inside
        (4, 0, "On top."),
        (4, 1, "> On top.\n> The third.\n> A first paragraph\n> of two lines.\nz"),
    ]
    got = _chat(spark, rows)
    assert {k: r.parent_turn for k, r in got.items() if r.parent_turn is not None} == {(1, 1): 0, (1, 3): 2, (1, 4): 2, (1, 5): 2, (2, 1): 0, (3, 1): 0}
    assert (got[1, 1].source_conv, got[1, 1].n_linked, got[1, 1].thread, got[1, 1].depth, got[1, 1].body) == (1, 1, 0, 1, "Thanks")
    assert (got[1, 6].n_quotes, got[1, 6].n_linked, got[1, 6].source_conv) == (1, 0, None)
    assert (got[4, 1].source_conv, got[4, 1].source_turn, got[4, 1].n_linked) == (1, 2, 1)
    assert len(got) == len(rows)


def test_near_duplicate_stage_keeps_rows_without_id_and_one_of_copies(spark):
    long = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "no id", "x"), (None, "no id either", "x"), (None, "no id", "x"), (None, None, "x"), (1, long, "x"), (1, long, "x"), (2, long + " end", "x"), (3, "one text", "x"), (3, "another text here", "x"), (4, None, "x"), (4, None, "x"), (5, "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, "no id"), (None, "no id either"), (None, None), (1, long), (3, "one text"), (3, "another text here"), (4, None), (5, "alone")]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert corpus_pipeline.near_duplicate_stage(spark, docs.where("false"), "").count() == 0


def test_stages_keep_columns_whose_names_clash(spark):
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("abcdeiou") for _ in range(rng.randrange(3, 9))) for _ in range(60))
    rows = [(1, long, 5, "a", "b", 0.5, "c"), (None, long, 6, "d", None, None, "e"), (2, None, 7, None, None, None, None), (2, "", 8, None, None, None, None), (2, "# " * 50, 9, None, None, None, None)]
    fields = "doc_id long, text string, n_words int, kept string, _counts string, toxicity double, text_ string"
    docs = spark.createDataFrame(rows, fields).withColumnRenamed("text_", "odd `name`.x")
    first = corpus_pipeline.quality_stage(spark, docs, SF)
    assert first.columns == docs.columns and sorted(map(tuple, first.collect()), key=repr) == sorted(rows[:2], key=repr)
    second = corpus_pipeline.toxicity_stage(spark, docs, SF)
    assert second.columns == docs.columns and sorted(map(tuple, second.collect()), key=repr) == sorted(rows, key=repr)
    none = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_source_outside_the_conversation(spark):
    rows = [(1, 0, "> said later\na"), (1, 3, "said later"), (2, 0, "said later"), (None, 0, "no conversation"), (5, None, "no conversation"), (6, 1, "no conversation"), (7, 0, "> no conversation\nb"), (8, 0, "> only here\nc"), (8, 1, "only here")]
    got = _chat(spark, rows)
    assert (got[1, 0].source_conv, got[1, 0].source_turn, got[1, 0].n_linked) == (2, 0, 1)
    assert (got[7, 0].source_conv, got[7, 0].source_turn, got[7, 0].n_linked) == (6, 1, 1)
    assert (got[8, 0].source_conv, got[8, 0].n_quotes, got[8, 0].n_linked) == (None, 1, 0)


def test_toxicity_learns_every_feature_with_evidence(spark):
    # tokens of a letter and six digits, half of them in toxic rows only, so that stems tell nothing
    tokens = [f"{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{k:06d}" for k in range(52_000)]
    halves = [" ".join(tokens[k] for k in range(len(tokens)) if hash((k, 1)) % 2 == c) for c in (0, 1)]
    rows = spark.createDataFrame([(i, halves[i % 2], i % 2) for i in range(32)], "doc_id long, text string, toxic int")
    model = toxicity.train(rows)
    assert sum(t in model.weights for t in tokens) == len(tokens)
