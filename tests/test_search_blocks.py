"""Questions as a table: many blocks in one scan, and filter sets of their own for each question."""

import numpy as np
from pyspark.sql import functions as F

from erario.operators import operations, questions as q, ranked_scan, vectors as v


def _best(questions, corpus, k, allowed=lambda question, row: True):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.rint(unit(np.array(questions)) @ unit(np.array(corpus)).T * 1e9)
    return {a: [int(i) for i in np.lexsort((np.arange(len(corpus)), -scores[a])) if allowed(a, i)][:k] for a in range(len(questions))}


def _found(frame):
    out = {}
    for r in frame.orderBy("id_consulta", "posicao").collect():
        out.setdefault(r.id_consulta, []).append(r.id)
    return out


def test_many_blocks_read_the_corpus_once(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ranked_scan, "BLOCK_QUESTIONS", 7)
    monkeypatch.setattr(ranked_scan, "CHUNK_ROWS", 16)
    monkeypatch.setattr(ranked_scan, "HELD_BLOCKS", 3)
    rng = np.random.RandomState(11)
    corpus, asked = rng.standard_normal((300, 6)).round(1), rng.standard_normal((60, 6)).round(1)
    spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(corpus)], "id int, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "corpus"))
    rows = spark.read.parquet(str(tmp_path / "corpus"))
    questions = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "id_consulta int, embedding array<double>")
    found = v.semantic_topk(questions, rows, k=5, threshold=None)
    assert _found(found) == _best(asked, corpus, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/corpus]") == 1 and "Union" not in plan and "NestedLoop" not in plan


def test_no_questions_and_no_corpus(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0])], "id_consulta int, embedding array<double>")
    corpus = questions.withColumnRenamed("id_consulta", "id")
    assert v.semantic_topk(questions.limit(0), corpus).count() == 0 == v.semantic_topk(questions, corpus.limit(0)).count()


def test_cells_near_are_flips(spark):
    near = spark.range(1).select(v.cells_near(F.lit(5), 4, 2).alias("c")).first().c
    assert sorted(near) == [c for c in range(16) if bin(c ^ 5).count("1") <= 2]
    assert len(spark.range(1).select(v.cells_near(F.lit(0), 40, 2).cast("array<long>").alias("c")).first().c) == 1 + 40 + 780


def test_filters_of_each_question(spark):
    rng = np.random.RandomState(12)
    corpus, asked = rng.standard_normal((200, 5)).round(2), rng.standard_normal((140, 5)).round(2)
    facts = [(i, i % 4, 2019 + i % 5, ("AC", "AM")[i % 2], ("10", "12", "26")[i % 3], "s", "Individual", "ANA" if i % 4 else "BETO") for i in range(200)]
    amendments = spark.createDataFrame(facts, "id int, cod_autor int, ano int, uf string, funcao string, subfuncao string, tipo_emenda string, nome_autor string")
    people = spark.createDataFrame([(0, "BETO", "PL"), (1, "ANA", "PT"), (2, "ANA", "PT")], "cod_autor int, nome string, partido string")
    party = {0: "PL", 1: "PT", 2: "PT", 3: None}
    sets = [{"ano_inicio": 2015 + k // 7, "ano_fim": 2019 + k % 7} | ({"funcao": "10"} if k % 3 else {}) | ({"autor": "an"} if k % 5 == 0 else {}) | ({"partido": "PT"} if k % 4 == 0 else {}) | ({"ufs": ["AC"]} if k % 2 else {}) for k in range(139)] + [{}]

    def allowed(a, i):
        s, f = sets[a], facts[i]
        return (
            s.get("ano_inicio", 0) <= f[2] <= s.get("ano_fim", 9999) and s.get("funcao", f[4]) == f[4] and s.get("autor", "").upper() in f[7]
            and s.get("partido", party[f[1]]) == party[f[1]] and f[3] in s.get("ufs", [f[3]])
        )

    schema = "id_consulta int, embedding array<double>, " + ", ".join(f"{c} {t}" for c, t in q.FILTER_SCHEMA.items())
    questions = spark.createDataFrame([(a, asked[a].tolist(), *[sets[a].get(c) for c in q.FILTER_SCHEMA]) for a in range(140)], schema).repartition(5)
    numbered, passed = operations.passed_filters(questions, amendments, people)
    assert {r.filtro for r in numbered.collect()} == set(range(len({repr(sorted(s.items())) for s in sets})))  # one number a set, without gaps
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(corpus)], "id int, embedding array<double>")
    found = v.hybrid_prefilter_filters(numbered.join(questions.select("id_consulta", "embedding"), "id_consulta"), rows, passed, k=4)
    assert _found(found) == {a: best for a, best in _best(asked, corpus, 4, allowed).items() if best}
    nobody, nothing = operations.passed_filters(questions.limit(0), amendments, people)
    assert nobody.count() == 0 == nothing.count()


def test_a_grid_of_tasks_shares_the_pairs(spark, monkeypatch):
    for name, value in {"BLOCK_QUESTIONS": 7, "HELD_BLOCKS": 3, "CELL_PAIRS": 500, "SMALL_PAIRS": 1, "CHUNK_ROWS": 16}.items():
        monkeypatch.setattr(ranked_scan, name, value, raising=False)
    rng = np.random.RandomState(13)
    corpus, asked = rng.standard_normal((200, 6)).round(1), rng.standard_normal((50, 6)).round(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(corpus)], "id int, embedding array<double>").coalesce(1)
    questions = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(asked)], "id_consulta int, embedding array<double>")
    for size in (0, 8 << 20):  # blocks by shuffle and by broadcast
        monkeypatch.setattr(ranked_scan, "BROADCAST_BYTES", size, raising=False)
        found = v.semantic_topk(questions, rows, k=5, threshold=None)
        assert _found(found) == _best(asked, corpus, 5)
        assert ranked_scan._met(rows, questions).rdd.getNumPartitions() > 20
