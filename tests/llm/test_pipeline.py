"""The five stages against plain Python, stage by stage, on the smallest tables."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from onomast.llm.quality import QualityRules
from tests.llm.test_brute_force import fill, plain_hits, plain_quality, plain_similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with clean texts, exact and near copies, junk and benchmark passages."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    bench = [(i, " ".join(word() for _ in range(14))) for i in range(5)]
    texts = [" ".join(word() for _ in range(rng.randrange(60, 140))) for _ in range(60)]
    for i in range(0, 30, 3):
        copy = texts[i].split()
        copy[5] = "changed"
        texts += [texts[i], " ".join(copy)]
    texts += ["too short", "", None, "again and again " * 60]
    texts += [f"{' '.join(word() for _ in range(80))} {bench[i][1]} {word()}" for i in range(5)]
    rows = [(i, t, "en", rng.choice(["a", "a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path), {r[0]: r for r in rows}, bench


def order(doc_id, text):
    inner = hashlib.md5((text or "").encode()).hexdigest()
    return hashlib.md5(f"mix|{doc_id}|{inner}".encode()).hexdigest()


def test_stages(spark, folder):
    path, rows, bench = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    outs = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path).cache()
        outs.append(docs)
        assert docs.columns[:5] == columns and (len(docs.columns) == 5 or name == "sharding")

    good = [i for i, r in rows.items() if plain_quality(r[1], QualityRules())[8]]
    assert sorted(r.doc_id for r in outs[0].collect()) == good and len(good) < len(rows)

    roots = plain_similar([rows[i][1] for i in good])
    single = [good[k] for k in sorted(set(roots))]
    assert sorted(r.doc_id for r in outs[1].collect()) == single and len(single) < len(good)

    clean = [i for i in single if not plain_hits(rows[i][1], bench)[1]]
    assert sorted(r.doc_id for r in outs[2].collect()) == clean and len(clean) < len(single)

    size = {i: len(rows[i][1].split()) for i in clean}
    sources = Counter()
    for i in clean:
        sources[rows[i][3]] += size[i]
    names = [*sorted(s for s in sources if s is not None), *[None] * (None in sources)]
    target = fill(sources, {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    want = Counter()
    for s in names:
        whole = int(target[s] // sources[s])
        rest, upto = target[s] - whole * sources[s], 0
        for i in sorted((i for i in clean if rows[i][3] == s), key=lambda i: order(i, rows[i][1])):
            want[i] += whole + (upto + size[i] / 2 <= rest)
            upto += size[i]
    assert Counter(r.doc_id for r in outs[3].collect()) == +want

    assert Counter(r.doc_id for r in outs[4].collect()) == +want
    bytes_of = outs[4].groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b")).collect()
    assert all(r.shard is not None and r.b <= 16 << 20 for r in bytes_of)


def test_run_equals_its_stages(spark, folder):
    path, _, _ = folder
    once, twice = (Counter(tuple(r) for r in corpus_pipeline.run(spark, path).collect()) for _ in range(2))
    assert once == twice and once


def test_documents_that_stay_are_untouched(spark, folder):
    path, rows, _ = folder
    for r in corpus_pipeline.run(spark, path).collect():
        assert tuple(r)[:5] == rows[r.doc_id]


def test_nothing_outside_imports_the_subpackage():
    top = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    for folder, _, names in os.walk(os.path.join(top, "onomast")):
        if os.path.basename(folder) != "llm":
            for name in (n for n in names if n.endswith(".py")):
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    assert "onomast.llm" not in f.read(), name
