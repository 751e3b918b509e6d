"""The pipeline's stages, each against what it should do with its own input."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from test_pairs_of_texts import brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from pairbench.llm import mixing, toxicity
from pairbench.llm.common import stage, table

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark):
    """The output of every stage, beginning with the documents."""
    docs = [table(spark, FOLDER, "documents")]
    for _, step in corpus_pipeline.STAGES:
        docs.append(stage(step(spark, docs[-1], FOLDER)))
    return docs


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_names_and_columns(kept):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "mixing", "token_id_output"]
    assert all(df.columns == COLUMNS for df in kept[:-1])
    assert all(set(ids(b)) <= set(ids(a)) for a, b in zip(kept, kept[1:]))


def test_toxic_rows_go(spark, kept):
    model = toxicity.fit(toxicity.labelled(kept[0], table(spark, FOLDER, "labels")))
    rude = {r.doc_id for r in toxicity.score(kept[0], model).collect() if r.score >= toxicity.THRESHOLD}
    assert rude and sorted(ids(kept[1])) == sorted(set(ids(kept[0])) - rude)


def test_one_of_each_component_stays(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    want = {component for _, component in brute_components(rows, 5, 80).values()}
    assert sorted(ids(kept[2])) == sorted(want)


def test_contaminated_rows_go(spark, kept):
    def plain(text):
        return re.sub(r"\s+", " ", text.lower()).strip()

    items = [plain(r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    whole = {r.doc_id for r in kept[2].collect() if any(i in plain(r.text) for i in items)}
    gone = set(ids(kept[2])) - set(ids(kept[3]))
    assert whole <= gone and len(gone) <= len(whole) + 2


def test_all_rows_are_mixed(kept):
    assert sorted(ids(kept[3])) == sorted(ids(kept[4]))
    placed = mixing.interleave(kept[3], mixing.proportions(kept[3])).collect()
    order = [r.doc_id for r in sorted(placed, key=lambda r: (r.slot, r.start_char, r.order))]
    written = kept[4].select("doc_id", "_metadata.file_name", "_metadata.row_index").collect()
    assert [r.doc_id for r in sorted(written, key=lambda r: (r.file_name, r.row_index))] == order


def test_tokens_in_order_of_the_mix(kept):
    placed = mixing.interleave(kept[3], mixing.proportions(kept[3])).collect()
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(placed, key=lambda r: (r.slot, r.start_char, r.order)):
        found = [*tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        want.append((r.doc_id, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    got = sorted(map(tuple, kept[5].select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == want


def test_edges_of_the_stages(spark, docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (2, None), (3, "")]
    made = stage(docs(rows).drop("id"))
    for _, step in corpus_pipeline.STAGES[:-1]:
        made = stage(step(spark, made, FOLDER))
        assert made.columns == COLUMNS
    # The row without an id is a copy of the first.
    assert sorted(ids(made)) == [1, 2, 3]
    last = corpus_pipeline.STAGES[-1][1](spark, made, FOLDER)
    assert sorted(r.n_tokens for r in last.collect()) == [1, 1, 7]
    empty = stage(docs([]).drop("id"))
    for _, step in corpus_pipeline.STAGES:
        empty = stage(step(spark, empty, FOLDER))
        assert empty.count() == 0


def test_rows_that_share_an_id_or_have_none(spark, docs):
    first, other = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    item = table(spark, FOLDER, "benchmark").first().text
    rows = [(1, first, "en", "b"), (1, first, "en", "a"), (1, other), (2, other), (None, first), (None, "all alone here")]
    rows += [(None, f"before {item} after"), (7, f"words {item} words"), (None, None), (8, None)]
    kept = stage(corpus_pipeline.without_near_duplicates(spark, stage(docs(rows).drop("id")), FOLDER))
    got = {(r.doc_id, r.text, r.source) for r in kept.collect()}
    assert got >= {(1, first, "a"), (1, other, None), (None, "all alone here", None), (8, None, None), (None, None, None)}
    assert (1, first, "b") not in got and (2, other, None) not in got and (None, first, None) not in got
    clean = [r.text for r in corpus_pipeline.without_benchmark(spark, kept, FOLDER).collect()]
    assert len(clean) == 5 and not any(item in (t or "") for t in clean)


def test_names_of_the_mix_may_be_columns(spark, docs):
    from pyspark.sql import functions as F

    made = docs([(i, f"text {i} " * 9, "en", "xy"[i % 2]) for i in range(20)]).drop("id")
    for name in ("slot", "block", "order", "start_char", "in_mix", "row", "key", "path", "part", "file", "score", "rank", "n"):
        made = made.withColumn(name, F.lit("x"))
    made = stage(made)
    columns = made.columns
    for _, step in corpus_pipeline.STAGES[:-1]:
        made = stage(step(spark, made, FOLDER))
        assert made.columns == columns and made.count() == 20
    assert corpus_pipeline.STAGES[-1][1](spark, made, FOLDER).count() == 20


def test_parts_of_more_than_five_digits(spark):
    from pyspark.sql import functions as F

    names = [f"part-{n:05d}-x.c000.parquet" for n in (99998, 99999, 100000, 100001, 7)]
    df = spark.createDataFrame([(n, 0) for n in names], "name string, at long")
    order = corpus_pipeline.written_order(F.col("name"), F.col("at"))
    assert [r.name[5:11].strip("-") for r in df.orderBy(*order).collect()] == ["00007", "99998", "99999", "100000", "100001"]
