"""Vector, keyword and hybrid search against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from erario.operators import keywords, ranked_scan, vectors as v


def _unit(x):
    return x / np.linalg.norm(x)


def _frames(spark, questions, corpus, partitions=5):
    asked = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(questions)], "id_consulta int, embedding array<double>")
    rows = [(i, None if x is None else [float(a) for a in x]) for i, x in enumerate(corpus)]
    return asked, spark.createDataFrame(rows, "id int, embedding array<float>").repartition(partitions)


def _brute(questions, corpus, k, threshold):
    found = {}
    for number, asked in enumerate(questions):
        scored = []
        for i, x in enumerate(corpus):
            if x is not None and np.linalg.norm(x) > 0:
                s = round(float(_unit(asked) @ _unit(np.asarray(x, dtype=np.float32).astype(float))), 9)
                if threshold is None or s >= threshold:
                    scored.append((-s, i))
        found[number] = [i for _, i in sorted(scored)[:k]]
    return found


def _ranked(df):
    found = {}
    for r in df.orderBy("id_consulta", "posicao").collect():
        found.setdefault(r.id_consulta, []).append(r.id)
    return found


@pytest.mark.parametrize("k, threshold", [(1, None), (7, None), (20, 0.3), (400, 0.1)])
def test_semantic_topk_against_brute_force(spark, k, threshold):
    rng = np.random.RandomState(1)
    corpus = list(rng.standard_normal((200, 8))) + [None, np.zeros(8)]
    corpus += [corpus[3]] * 60  # a third of the rows are copies of one vector
    questions = [corpus[3], *rng.standard_normal((4, 8))]
    asked, rows = _frames(spark, questions, corpus)
    assert _ranked(v.semantic_topk(asked, rows, k, threshold)) == {q: x for q, x in _brute(questions, corpus, k, threshold).items() if x}


def test_many_questions_are_answered_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(ranked_scan, "BLOCK_QUESTIONS", 4)
    monkeypatch.setattr(ranked_scan, "CHUNK_CELLS", 50)
    rng = np.random.RandomState(2)
    corpus, questions = list(rng.standard_normal((90, 6))), list(rng.standard_normal((13, 6)))
    asked, rows = _frames(spark, questions, corpus)
    assert _ranked(v.semantic_topk(asked, rows, 5, None)) == _brute(questions, corpus, 5, None)


def test_no_question_gives_no_row(spark):
    asked, rows = _frames(spark, [np.ones(3)], [np.ones(3)])
    assert v.semantic_topk(asked.filter("id_consulta < 0"), rows).count() == 0


def test_keys_limit_the_rows_of_a_question(spark):
    rng = np.random.RandomState(3)
    corpus, questions = list(rng.standard_normal((100, 5))), list(rng.standard_normal((3, 5)))
    asked, rows = _frames(spark, questions, corpus)
    keyed = rows.withColumn("chave", F.col("id") % 10)
    found = _ranked(v.semantic_topk(asked.withColumn("chaves", F.array("id_consulta", F.col("id_consulta") + 5)), keyed, 4, None))
    for number, asked_vector in enumerate(questions):
        allowed = [x if i % 10 in (number, number + 5) else None for i, x in enumerate(corpus)]
        assert found[number] == _brute([asked_vector], allowed, 4, None)[0]


def test_approximate_search(spark, tmp_path):
    rng = np.random.RandomState(4)
    corpus, questions = list(rng.standard_normal((300, 8))), list(rng.standard_normal((6, 8)))
    asked, rows = _frames(spark, questions, corpus)
    exact = v.semantic_topk(asked, rows, 10, None)
    cells = v.with_cells(rows, 4, 8)
    whole = v.approximate_topk(asked, cells, 4, 8, radius=4, k=10, threshold=None)
    assert _ranked(whole) == _ranked(exact)
    shares = {}
    for radius in (0, 1, 2, 3):
        near = v.approximate_topk(asked, cells, 4, 8, radius=radius, k=10, threshold=None)
        shares[radius] = v.recall(near, exact).agg(F.avg("revocacao")).first()[0]
    assert shares[0] <= shares[1] <= shares[2] <= shares[3] <= 1
    assert shares[2] > 0.8

    cells.write.partitionBy("chave").parquet(str(tmp_path / "cells"))
    stored = spark.read.schema(cells.schema).parquet(str(tmp_path / "cells"))
    near = v.approximate_topk(asked.limit(1), stored, 4, 8, radius=1, k=10, threshold=None)
    assert "PartitionFilters: [chave" in near._jdf.queryExecution().executedPlan().toString()


def test_nearest_classification_threshold(spark):
    asked, rows = _frames(spark, [[1, 0], [0, 1]], [[1, 0.1], [1, 0.05], [-1, 0.3]])
    found = v.nearest_classification(asked, rows.withColumn("funcao", F.concat(F.lit("F"), "id")), 0.45)
    assert {r.id_consulta: r.funcao for r in found.collect()} == {0: "F1", 1: None}


def test_hybrid_prefilter_of_nothing_is_empty(spark):
    asked, rows = _frames(spark, [[1, 0]], [[1, 0], [0, 1]])
    assert v.hybrid_prefilter(asked, rows, rows.filter("id > 5")).count() == 0
    assert _ranked(v.hybrid_prefilter(asked, rows, rows.filter("id = 1"))) == {0: [1]}


def test_hybrid_fill_keeps_structured_rows_first_and_ids_unique(spark):
    rng = np.random.RandomState(5)
    corpus, questions = list(rng.standard_normal((50, 4))), list(rng.standard_normal((3, 4)))
    asked, rows = _frames(spark, questions, corpus)
    structured = {0: [4, 9, 2, 7, 1], 1: [8, 3]}
    given = spark.createDataFrame([(q, i, n) for q, ids in structured.items() for n, i in enumerate(ids, 1)], "id_consulta int, id int, posicao int")
    found = _ranked(v.hybrid_fill(given, asked, rows, k=5, threshold=-1.0))
    similar = _brute(questions, corpus, 5, -1.0)
    for q in range(3):
        own = structured.get(q, [])
        assert found[q] == (own + [i for i in similar[q] if i not in own])[:5]


def test_hashed_embedding_against_a_plain_count(spark):
    def murmur3(data, seed=42):
        h, mask = seed, 0xFFFFFFFF
        for i in range(0, len(data) // 4 * 4, 4):
            h = _mix(h, int.from_bytes(data[i : i + 4], "little"))
        tail = 0
        rest = data[len(data) // 4 * 4 :]
        for i, byte in enumerate(rest):
            tail ^= byte << (8 * i)
        if rest:
            h ^= ((((tail * 0xCC9E2D51) & mask) << 15 | ((tail * 0xCC9E2D51) & mask) >> 17) & mask) * 0x1B873593 & mask
        h ^= len(data)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = ((h ^ h >> shift) * factor) & mask
        h ^= h >> 16
        return h - (1 << 32) if h >> 31 else h

    def _mix(h, k):
        mask = 0xFFFFFFFF
        k = (k * 0xCC9E2D51) & mask
        k = ((k << 15 | k >> 17) & mask) * 0x1B873593 & mask
        h ^= k
        h = (h << 13 | h >> 19) & mask
        return (h * 5 + 0xE6546B64) & mask

    texts = ["ANA | Saúde | Saúde | UF: AC | Ano: 2024", "investimento em segurança pública", "a a a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, texto string")
    for r in v.embed(rows, dim=16).collect():
        counts = np.zeros(16)
        for word in "".join(c if c.isalnum() else " " for c in r.texto.lower()).split():
            counts[murmur3(word.encode()) % 16] += 1
        assert np.allclose(r.embedding, counts / np.linalg.norm(counts), atol=1e-6)


def test_plugged_encoder_is_normalised(spark):
    def factory():
        return lambda texts: [[len(t), 0.0] for t in texts]

    rows = spark.createDataFrame([(1, "abc"), (2, None)], "id int, texto string")
    assert {r.id: r.embedding for r in v.embed(rows, encoder=factory).collect()} == {1: [1.0, 0.0], 2: [0.0, 0.0]}


def test_write_back_fills_only_what_is_missing(spark):
    rows = spark.createDataFrame([(1, [1.0]), (2, None), (3, None)], "id int, embedding array<float>")
    fresh = spark.createDataFrame([(1, [9.0]), (2, [8.0])], "id int, embedding array<float>")
    filled = v.write_back(rows, fresh)
    assert {r.id: r.embedding for r in filled.collect()} == {1: [1.0], 2: [8.0], 3: None}
    assert [r.id for r in v.pending(filled).collect()] == [3]


def test_keyword_topk_against_brute_force(spark):
    random.seed(6)
    letters = [f"p{i}" for i in range(30)] + ["saúde", "educação"]
    texts = [" ".join(random.choices(letters, k=random.randint(0, 12))) for _ in range(150)]
    asked = ["P1 p2, p3!", "Saúde e educação", "zzz", "", "p1 p1 p4 p5 p6"]
    questions = spark.createDataFrame(list(enumerate(asked)), "id_consulta int, texto string")
    corpus = spark.createDataFrame(list(enumerate(texts)), "id int, texto string").repartition(4)

    def split(text):
        return {w for w in "".join(c if c.isalnum() else " " for c in text.lower()).split()}

    got = {}
    for r in keywords.keyword_topk(questions, corpus, 6).orderBy("id_consulta", "posicao").collect():
        got.setdefault(r.id_consulta, []).append((r.id, r.termos))
    want = {}
    for q, text in enumerate(asked):
        scored = sorted((-len(split(text) & split(t)), i) for i, t in enumerate(texts))
        best = [(i, -s) for s, i in scored if s < 0][:6]
        if best:
            want[q] = best
    assert got == want


def test_search_never_pairs_everything(spark):
    asked, rows = _frames(spark, [[1, 0]], [[1, 0]])
    plan = v.semantic_topk(asked, rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Cartesian" not in plan and "NestedLoop" not in plan
    assert plan.count("Exchange hashpartitioning") == 1
    assert not math.isnan(v.semantic_topk(asked, rows).first().similaridade)
