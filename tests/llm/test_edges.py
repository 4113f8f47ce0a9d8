"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

from onomast.llm import chat, decontaminate, mixing, pii, quality, sharding, simhash, template, tokens, warc

LONG = "lorem ipsum dolor " * 40_000 + "x" * 300_000 + " a@b.co " + "1" * 50_000
#: Names that the operators use inside.
CLASH = "row id key size order fp bucket role hot parts h0 h1 shard bytes kind start end value left base __marks __items marks items c0 c1 __uid __row uid f0 file at __mix __times __copy copy source_key last whole path record_no host block".split()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "one two three four five", "s"), (2, None, "s"), (3, "", None), (None, "no id here at all", "s"), (None, None, None),
        (4, " \n\t ", "t"), (5, LONG, "t"), (6, "one two three four five", "s"), (1, "one two three four five", "s"), (7, "é" * 50 + " ü@", "u"),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).cache()


def ids(frame):
    return sorted((r[0] for r in frame.select("doc_id").collect()), key=str)


EXPECTED_IDS = sorted([1, 2, 3, None, None, 4, 5, 6, 1, 7], key=str)


@pytest.mark.parametrize(
    "run",
    [
        lambda d: mixing.taken(d), lambda d: tokens.counts(d), lambda d: pii.digest(pii.spans(d)), lambda d: simhash.groups(d),
        lambda d: quality.quality(d), lambda d: sharding.shards_of(d)[0],
        lambda d: decontaminate.contamination(d, d.select(F.col("doc_id").alias("item_id"), "text")),
    ],
)
def test_every_row_once_and_empty_tables(docs, run):
    assert ids(run(docs)) == EXPECTED_IDS
    empty = run(docs.where("false"))
    assert empty.count() == 0 and empty.columns == run(docs).columns


@pytest.mark.parametrize("run", [quality.keep_good, simhash.one_of_each, mixing.mix, lambda d: decontaminate.clean(d, d.where("doc_id = 5").withColumnRenamed("doc_id", "item_id"))])
def test_stages_return_the_columns_of_documents(docs, run):
    out = run(docs)
    assert out.columns == docs.columns and out.count() <= 2 * docs.count()
    assert run(docs.where("false")).count() == 0


def test_empty_benchmark(docs):
    none = decontaminate.contamination(docs, docs.where("false").withColumnRenamed("doc_id", "item_id"))
    assert none.where("contaminated").count() == 0 and none.count() == docs.count()


def test_sharding_keeps_columns(docs):
    out = sharding.with_shards(docs)
    assert out.columns == [*(c for c in docs.columns if c != "shard"), "shard"] and out.where("shard IS NULL").count() == 0
    assert out.schema["shard"].dataType.simpleString() == "string" and ids(out) == EXPECTED_IDS
    assert sharding.with_shards(docs.where("false")).count() == 0


def test_an_end_that_is_a_token_is_an_error(docs):
    with pytest.raises(ValueError, match="is a token"):
        tokens.counts(docs, end=100)


def test_files_of_lost_attempts_are_not_read(spark, docs):
    """A rerun writes other files; what an attempt that does not count has left is not read."""
    folder, manifest, dtype = tokens.write(docs)
    with open(f"{folder.removeprefix('file:')}/lost.tokens", "wb") as f:
        f.write(b"\x01\x02\x03")
    again, other, _ = tokens.write(docs)
    rows = [sorted((r.ordinal, r.n_tokens) for r in tokens.scan(spark, f, dtype=dtype, files=m.select("file")).collect()) for f, m in ((folder, manifest), (again, other))]
    assert rows[0] == rows[1] and len(rows[0]) == docs.count()


def test_archives_come_back_alike_from_each_write(pages):
    one, two = (sorted(map(str, warc.round_trip(pages).collect())) for _ in range(2))
    assert one == two


def test_a_cluster_without_a_shared_folder_is_an_error():
    from onomast.sources.scratch import shared_dir

    class Session:
        class conf:
            get = staticmethod(lambda key, default: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session)


def test_rows_out_of_a_shuffle_have_one_place(docs):
    """Places are written once, whatever order a rerun of the input would have."""
    dealt = docs.repartition(3)
    assert ids(pii.digest(pii.spans(dealt))) == EXPECTED_IDS
    assert ids(sharding.with_shards(dealt)) == EXPECTED_IDS
    assert simhash.one_of_each(dealt).count() == simhash.one_of_each(docs).count()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [
        (1, "http://a.x/1", "<p>" + "k" * 2000 + "</p>"), (2, None, "<p>" + "k" * 2000 + "</p>"), (3, "http://a.x/3\r\nX: y", None), (None, "http://b.x", ""),
        (4, "not a url", "<article><p>t" + " w" * 400_000 + "</article>"), (None, None, "<p>" + "k" * 2000), (2, None, "<p>" + "k" * 2000 + "</p>"),
        (5, "http://a.x/5", "<div <p \"' <!-- x"), (6, "http://a.x/6", "<" * 5000 + "a href='"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)]).cache()


def test_pages(pages):
    out = template.main_texts(pages)
    assert out.count() == pages.count() and out.where("text IS NULL OR n_chars <> length(text)").count() == 0
    assert template.main_texts(pages.where("false")).count() == 0
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()}
    assert (1, "revisit", 2, 2007) in got and (2, "response", None, 2007) in got and (3, "response", None, 0) in got
    assert warc.round_trip(pages).count() == pages.count() and warc.round_trip(pages.where("false")).count() == 0
    assert warc.round_trip(pages).where("NOT intact").count() == 0


def test_conversations(spark):
    rows = [(1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "x"), (2, 0, "assistant", "")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("formatted", F.lit(""))
    out = {r.conv_id: r for r in chat.summary(chat.render(talks)).collect()}
    assert out[1].n_turns == 4 and out[1].loss_chars == 2 and out[None].n_turns == 1 and out[2].loss_chars == 0
    assert chat.render(talks.where("false")).count() == 0
