import __spark_entry__
import corpus_pipeline
import numpy as np
import public_tokenizers
import sentencepiece

from leafmill.llm import quality, stages
from leafmill.llm.decontaminate import Items
from leafmill.llm.decontaminate import plain as plain_words
from leafmill.llm.secrets import redact, spans_of
from tests.llm.test_ngram_join import slow_components

SF = "/root/testdata/sf0.001"


def test_stages_equal_slow_versions(spark):
    """Each stage on what the one before kept, against a plain Python version of its decision."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    columns = docs.columns

    def stage(k):
        return corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame(rows, docs.schema), SF)

    def same(df, want):
        assert df.columns == columns
        assert sorted(map(tuple, df.collect())) == sorted(want)
        return want

    model = quality.fit(spark, docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = same(stage(0), [r for r in rows if quality.score_of(r[1], *model) >= 0.3])
    assert 0.8 * docs.count() < len(rows) < docs.count()
    group = {d: c for d, _, c in slow_components([r[:2] for r in rows])}
    rows = same(stage(1), [r for r in rows if group[r[0]] == r[0]])
    items = Items([tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()])
    rows = same(stage(2), [r for r in rows if not items.met_by(plain_words(r[1]))])
    n = columns.index("n_chars")
    fixed = [(r, redact(r[1], spans_of(r[1]))) for r in rows]
    rows = same(stage(3), [tuple(t if i == 1 else len(t) if i == n and t != r[1] else v for i, v in enumerate(r)) for r, t in fixed])
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    last = {r["doc_id"]: r for r in stage(4).collect()}
    assert len(last) == len(rows) and all(np.frombuffer(last[r[0]]["piece_ids"], "<u4").tolist() == library.encode(r[1]) and last[r[0]]["round_trip"] for r in rows)
    whole = {r["doc_id"]: r for r in __spark_entry__.queries()["pipeline"](spark, SF).collect()}
    assert whole == last


def test_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13, 0.5), (1, "a b c d e f g", "en", "s", 13, 0.5), (2, None, None, None, None, None), (None, "null id", "en", "s", 7, 0.1), (3, "token=abcdefghijkl", "en", "s", 18, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double")
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, SF)
        assert k == 4 or docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in docs.collect() if r["text"]) == [(0, "null id"), (1, "a b c d e f g"), (3, "[SECRET]")]
    empty = spark.createDataFrame([], docs.drop("piece_ids", "n_pieces", "round_trip").schema)
    for _, f in corpus_pipeline.STAGES:
        empty = f(spark, empty, SF)
    assert empty.count() == 0


def test_the_quality_limit_is_the_one_of_the_query():
    assert stages.QUALITY == 0.3


def test_near_copies_under_repeated_and_null_ids(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(60))
    near = lambda c: text(c) + " more"
    rows = [(1, text("a")), (2, near("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (None, text("e")), (None, near("d")), (4, text("f")), (4, text("f")), (4, near("f")), (5, ""), (None, None), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in stages.one_of_near_copies(spark, docs, SF).collect()]
    assert len(got) == 9
    f = {r for r in got if r[0] == 4}
    assert len(f) == 1 and f <= {(4, text("f")), (4, near("f"))}
    assert sorted((r for r in got if r not in f), key=str) == sorted([(1, text("a")), (2, text("b")), (3, text("c")), (3, text("d")), (None, text("e")), (5, ""), (None, None), (None, None)], key=str)


def test_columns_whose_names_clash(spark):
    names = ["__score", "__key", "__rows", "__items", "__distances", "__ids", "__round_trip", "piece_ids", "N_Pieces", "round_trip", "group", "score", "component_id", "n_shingles", "quality", "__a"]
    rows = [(i, f"text {i} of a quiet river and its {i} hills", *[f"{n}{i}" for n in names]) for i in range(4)] + [(9, "text 3 of a quiet river and its 3 hills", *names), (None, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    for _, f in corpus_pipeline.STAGES[:4]:
        docs = f(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", *names]
    assert sorted(tuple(r) for r in docs.collect() if r["doc_id"] is not None) == rows[:4]
    last = corpus_pipeline.STAGES[4][1](spark, docs, SF)
    assert last.columns == ["doc_id", "text", *names, "piece_ids_", "round_trip_", "n_pieces_"]
    assert all(r["piece_ids"] == f"piece_ids{r['doc_id']}" and r["round_trip_"] and r["n_pieces_"] > 5 for r in last.collect() if r["doc_id"] is not None)
