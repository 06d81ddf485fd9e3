"""The pipeline's stages, each on its predecessor's output, and a repository without this package."""

import math
import os
import re
import shutil
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import entry, toxicity
from tests.conftest import SF


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] > sizes[3] == sizes[4] > 0
    texts = [r.text for r in docs.collect()]
    assert not any("@mail" in t for t in texts) and len(set(texts)) == len(texts)
    packed = corpus_pipeline.run(spark, SF)
    assert packed.select("doc_id").distinct().count() == sizes[4]


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    stages, texts = dict(corpus_pipeline.STAGES), {r.doc_id: r.text for r in docs.collect()}

    def rows(name, given):
        return {r.doc_id: r.text for r in stages[name](spark, given, SF).select("doc_id", "text").collect()}

    kept = {r.doc_id for r in entry.op4_quality(spark, SF).collect() if r.kept}
    assert rows("quality rules", docs) == {i: texts[i] for i in kept}

    model = toxicity.fit_toxicity(docs, labels)
    weight = model.lookup()

    def score(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text):
            if sentence.strip():
                clean *= 1 - 1 / (1 + math.exp(-model.bias - sum(weight(t) for t in set(sentence.split()))))
        return 1 - clean

    toxic = {i for i, t in texts.items() if score(t) >= 0.3}
    assert 0 < len(toxic) < len(texts)
    assert rows("toxicity", docs) == {i: t for i, t in texts.items() if i not in toxic}

    sets = {}
    for i, text in texts.items():
        words = text.lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else {i}
    least = {i: i for i in texts}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and least[i] != least[j]:
                low, high = sorted((least[i], least[j]))
                least = {k: low if c == high else c for k, c in least.items()}
    assert any(i != c for i, c in least.items())
    assert rows("near-duplicates", docs) == {i: texts[i] for i, c in least.items() if i == c}

    library, pieces, ends = Tokenizer.from_file(entry.WORD_BPE), {}, {}
    for r in stages["packing"](spark, docs, SF).collect():
        pieces[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
        ends.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    want = {}
    for i, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        for n, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            want[i, n] = (at, len(part), zlib.crc32(part.tobytes()))
    assert pieces == want
    for places in ends.values():
        places.sort()
        assert places[0][0] == 0 and places[-1][1] <= 4096 and all(a[1] == b[0] for a, b in zip(places, places[1:]))


CLASHING = ["row", "key", "score", "kept", "spans", "ids", "node", "_row0"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of documents with nulls, empty and repeated texts, repeated ids and columns that operators name so too."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    good = base.where("lang = 'en'").orderBy(F.length("text").desc()).first().asDict()
    rows = [(None, good["text"]), (-1, None), (-2, ""), (-3, " \n "), (-4, good["text"]), (-4, good["text"]), (-5, "write to a@b.co")]
    schema = "doc_id long, text string"
    added = spark.createDataFrame(rows, schema).selectExpr("doc_id", "text", "NULL AS lang", "NULL AS source", "length(text) AS n_chars")
    docs = base.where(F.col("doc_id") == good["doc_id"]).unionByName(added).withColumn("n_chars", F.col("n_chars").cast("long"))
    return docs.withColumns({c: F.lit("x") for c in CLASHING}), good


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage_on_odd_rows(spark, odd, name, tmp_path):
    """With labels that say what has to happen: the good text is trusted, and no text of theirs is toxic."""
    docs, good = odd
    stage, where = dict(corpus_pipeline.STAGES)[name], str(tmp_path)
    labels = [(good["doc_id"], 1, 0), (-4, 1, 0), (-5, 0, 0), (None, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    rows = stage(spark, docs, where).collect()
    assert stage(spark, docs.limit(0), where).count() == 0
    if name != "packing":
        assert [*rows[0].asDict()] == docs.columns
    texts = sorted((r.doc_id or 0, r.text) for r in rows if r.text and r.text.strip()) if name != "packing" else None
    if name == "quality rules":  # short and empty texts go, equal ones are judged alike
        assert {r.text for r in rows} == {good["text"]} and len(rows) == 4
    elif name == "toxicity":
        assert len(rows) == 8
    elif name == "near-duplicates":  # the smallest id of the four equal texts, once
        assert texts == [(-5, "write to a@b.co"), (-4, good["text"])] and len(rows) == 5
    elif name == "personal data":
        assert len(rows) == 8 and {r.doc_id: r.text for r in rows}[-5] == "write to [EMAIL]"
        assert {r.doc_id: r.n_chars for r in rows}[-1] is None and {r.doc_id: r.n_chars for r in rows}[-5] == 16
    else:
        assert {r.doc_id for r in rows} == {None, -1, -2, -3, -4, -5, good["doc_id"]}
        assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
        assert {r.length for r in rows if r.doc_id in (-1, -2)} == {1}


def test_no_text_is_lost_to_a_repeated_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, b), (4, a), (4, b)], "doc_id long, text string")
    kept = corpus_pipeline.remove_near_duplicates(spark, docs, SF).collect()
    assert sorted(map(tuple, kept)) == [(1, b), (4, a)]


def test_toxicity_stage_follows_the_operator(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = entry.op3_toxicity(spark, sf).collect()
    assert any(0.3 <= r.score < 0.5 for r in rows)
    kept = sorted(r.doc_id for r in corpus_pipeline.remove_toxic(spark, docs, sf).collect())
    assert kept == sorted(r.doc_id for r in rows if r.score < 0.3)


def test_repository_without_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(os.path.join(root, "millrace"), tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
