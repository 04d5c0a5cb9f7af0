"""The corpus pipeline, stage by stage, against plain versions."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lattispark.llm import bpe, mix, quality, secrets

from .test_operators import SCHEMA, WORDS, labelled, plain_join, plain_spans


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents good and bad, with copies, near copies and secrets, and labels for half of them."""
    path = tmp_path_factory.mktemp("sf")
    docs, labels = labelled(spark, 240)
    rows = [tuple(r) for r in docs.collect()]
    rng = random.Random(2)
    for k in range(40):
        key, text, lang, source, _ = rows[rng.randrange(240)]
        if k % 2:
            words = text.split(" ")
            words[3] = "edited"
            text = " ".join(words)
        if k % 5 == 0:
            text += " password = hunter2hunter2"
        rows.append((1000 + k, text, lang, source, len(text)))
    rows += [(2000, None, None, None, None), (2001, "", "en", "s1", 0), (None, rows[1][1], "en", "s1", 1), (1000, rows[240][1], "en", "s0", 1)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"file://{path}/documents.parquet")
    labels.write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}"


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]
    stages = dict(P.STAGES)

    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = quality.score(docs, model, keep=("doc_id", "text", "score0") if "score0" in docs.columns else ("doc_id", "text"))
    wanted = Counter((r["doc_id"], r["text"]) for r in scores.collect() if r["score"] >= quality.KEEP)
    first = stages["quality"](spark, docs, folder).cache()
    assert Counter((r["doc_id"], r["text"]) for r in first.collect()) == wanted
    clean = {r["doc_id"] for r in first.collect()}
    assert sum(k in clean for k in range(240) if k % 3) >= 158  # clean documents stay
    assert sum(k in clean for k in range(240) if k % 3 == 0) <= 2

    kept = stages["near_duplicates"](spark, first, folder).cache()
    rows = [(r["doc_id"], r["text"]) for r in first.collect()]
    component = plain_join({k: t for k, t in rows if k is not None})
    heads = {k for k, (_, c) in component.items() if k == c}
    got = Counter(r["doc_id"] for r in kept.collect())
    assert got == Counter(heads) + Counter(k for k, _ in rows if k is None)

    clear = stages["secrets"](spark, kept, folder).cache()
    before = {r["doc_id"]: r for r in kept.collect()}
    scanner = secrets.Scanner()
    for r in clear.collect():
        old = before[r["doc_id"]]
        if plain_spans(old["text"]):
            assert not [s for s in scanner(r["text"])] and "[REDACTED]" in r["text"] and r["n_chars"] == len(r["text"])
        else:
            assert tuple(r[c] for c in P.COLUMNS) == tuple(old[c] for c in P.COLUMNS)

    mixed = stages["mix"](spark, clear, folder).cache()
    taken = Counter(r["doc_id"] for r in mixed.collect())
    sizes = {r["doc_id"]: (len(WORDS.findall(r["text"] or "")), r["source"]) for r in clear.collect()}
    assert max(taken.values()) <= 2 and set(taken) <= set(sizes)
    targets = {r["source"]: r["target"] for r in mix.targets(mix.sized(clear)).collect()}
    words, largest = Counter(), Counter()
    for key, n in taken.items():
        words[sizes[key][1]] += n * sizes[key][0]
    for n, s in sizes.values():
        largest[s] = max(largest[s], n)
    for s, t in targets.items():
        assert abs(words[s] - t) <= largest[s] + mix.BLOCK

    final = stages["tokens"](spark, mixed, folder).collect()
    encoder = bpe.Encoder(*bpe.vocabulary())
    texts = {r["doc_id"]: r["text"] for r in clear.collect()}
    assert Counter(r["doc_id"] for r in final) == taken
    for r in final:
        assert r["ids"] == encoder(texts[r["doc_id"]]) and r["n_tokens"] == len(r["ids"]) // 4
        assert r["text_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()

    whole = Counter((r["doc_id"], r["text_sha256"]) for r in P.run(spark, folder).collect())
    assert whole == Counter((r["doc_id"], r["text_sha256"]) for r in final)


def test_columns_of_documents_stay(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("slices", F.lit(1)).withColumn("score", F.lit(2.0))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs.limit(20), folder)
        assert tuple(out.columns) == P.COLUMNS, name
        assert [out.schema[c].dataType for c in P.COLUMNS] == [docs.schema[c].dataType for c in P.COLUMNS]


def test_empty_documents(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert np.isfinite(0.0)
