"""The figure of every question of a table, against plain Python over all pairs."""

from decimal import ROUND_HALF_UP, Decimal

import pytest

from erario.operators import operations
from erario.sources import writers

PEOPLE = [(1, "ANA LIMA", "PT"), (2, "BETO CRUZ", "PL"), (3, "ANA SOUZA", "PT"), (4, "DORA", None)]
SCHEMA = "id long, cod_autor int, ano int, uf string, funcao string, subfuncao string, tipo_emenda string, valor_empenhado decimal(15,2), valor_pago decimal(15,2)"
FILTERS = "id_consulta string, ano int, ano_inicio int, ano_fim int, uf string, ufs array<string>, autor string, partido string, funcao string, tipo_emenda string, operacao string, dimensao string"


@pytest.fixture(scope="module")
def facts():
    return [(i, 1 + i % 4, 2019 + i % 5, ("AC", "AM", "SP")[i % 3], ("10", "12")[i % 2], ("301", "361")[i % 2], ("Individual", "Bancada")[i % 7 == 0], Decimal(i * 37 % 1000) + Decimal("0.25"), Decimal(i % 11)) for i in range(240)]


def asked():
    sets = [
        {}, {"ano": 2021}, {"uf": "AC", "partido": "PT"}, {"ufs": ["AC", "AM"], "ano_inicio": 2020, "ano_fim": 2022}, {"autor": "ana"}, {"autor": "ANA", "ano_inicio": 2020, "ano_fim": 2021, "ufs": ["SP", "AC"]},
        {"autor": "a", "tipo_emenda": "indiv"}, {"ano": 1999}, {"partido": "XX"}, {"funcao": "12", "ano_inicio": 2019, "ano_fim": 2023}, {"autor": "_RUZ"},
    ]
    return [(f"{k}|{op}|{dim}", s, op, dim) for k, s in enumerate(sets) for op in operations.OPERATIONS for dim in ((None, "uf") if op in operations.GROUPED_BY else (None,))]


def holds(s, row):
    name, party = {p[0]: p[1:] for p in PEOPLE}[row[1]]
    text = s.get("autor", "").upper()
    found = any(name[i + 1 :].startswith(text[1:]) for i in range(len(name))) if text.startswith("_") else text in name
    return (
        found and s.get("ano", row[2]) == row[2] and ("ano_inicio" not in s or s["ano_inicio"] <= row[2] <= s["ano_fim"]) and s.get("uf", row[3]) == row[3]
        and row[3] in s.get("ufs", [row[3]]) and s.get("partido", party) == party and s.get("funcao", row[4]) == row[4] and s.get("tipo_emenda", "").lower() in row[6].lower()
    )


def by_definition(s, op, dim, facts, n):
    people = {p[0]: p[1:] for p in PEOPLE}
    rows = [r for r in facts if holds(s, r)]
    value = {"autor": lambda r: people[r[1]][0], "uf": lambda r: r[3], "tipo_emenda": lambda r: r[6], "funcao": lambda r: r[4]}
    group = value.get(dim or operations.GROUPED_BY.get(op))
    total = lambda some: sum((r[7] for r in some), Decimal("0.00"))
    if op in ("total", "media", "proporcao"):
        mean = (total(rows) / len(rows)).quantize(Decimal("0.01"), ROUND_HALF_UP) if rows else Decimal("0.00")
        ratio = round(float(sum(r[8] for r in rows)) / float(total(rows)), 6) if op == "proporcao" and rows else None
        return [(None, None, mean if op == "media" and rows else None if op == "media" else total(rows), len(rows), ratio, None)]
    if op == "contagem_distinta":
        return [(None, None, total(rows), len({group(r) for r in rows}), None, None)]
    years = op in ("comparacao", "tendencia")
    keys = sorted({((group(r) if op != "tendencia" else None), (r[2] if years else None)) for r in rows}, key=repr)
    cells = {k: [r for r in rows if (op == "tendencia" or group(r) == k[0]) and (not years or r[2] == k[1])] for k in keys}
    if op == "ranking":
        best = sorted(cells.items(), key=lambda x: (-total(x[1]), x[0][0]))[:n]
        return [(k[0], None, total(v), len(v), None, i) for i, (k, v) in enumerate(best, 1)]
    if op == "crescimento":
        if "ano_inicio" not in s:
            return []
        ends = {k: [r for r in v if r[2] in (s["ano_inicio"], s["ano_fim"])] for k, v in cells.items()}
        grown = {k: (total(r for r in v if r[2] == s["ano_fim"]), v) for k, v in ends.items() if v}
        gain = {k: float(last - total(r for r in v if r[2] == s["ano_inicio"])) for k, (last, v) in grown.items()}
        return [(k[0], s["ano_fim"], grown[k][0], len(grown[k][1]), gain[k], i) for i, k in enumerate(sorted(grown, key=lambda k: (-gain[k], k[0])), 1)]
    out, last = [], None
    for k, v in cells.items():
        change = float(total(v) - last) if op == "tendencia" and last is not None else None
        out.append((k[0], k[1], total(v), len(v), change, None))
        last = total(v)
    return out


def test_figures(spark, facts):
    people = {p[0]: p[1] for p in PEOPLE}
    amendments = spark.createDataFrame(facts, SCHEMA).repartition(3)
    names = spark.createDataFrame([(k, v) for k, v in people.items()], "cod_autor int, nome_autor string")
    legislators = spark.createDataFrame(PEOPLE, "cod_autor int, nome string, partido string")
    fields = [f.split()[0] for f in FILTERS.split(", ")][1:-2]
    questions = spark.createDataFrame([(q, *[s.get(f) for f in fields], op, dim) for q, s, op, dim in asked()] + [("s", *[None] * len(fields), "busca", None)], FILTERS)
    got = {}
    for r in operations.figures(questions, amendments.join(names, "cod_autor"), legislators, n=2).collect():
        got.setdefault(r.id_consulta, []).append((r.grupo, r.ano, r.valor, r.qtd, r.variacao, r.posicao))
    assert set(got) <= {q for q, *_ in asked()}
    for q, s, op, dim in asked():
        assert sorted(got.get(q, []), key=repr) == sorted(by_definition(s, op, dim, facts, 2), key=repr), q


def test_no_question_asks_for_a_figure(spark, facts):
    amendments = spark.createDataFrame(facts, SCHEMA).selectExpr("*", "'X' AS nome_autor")
    legislators = spark.createDataFrame(PEOPLE, "cod_autor int, nome string, partido string")
    plain = spark.createDataFrame([("a", 2020, "busca")], "id_consulta string, ano int, operacao string")
    assert operations.figures(plain, amendments, legislators).count() == 0
    assert operations.figures(plain.limit(0), amendments, legislators).count() == 0
    nothing = operations.figures(plain.replace("busca", "total"), amendments.limit(0), legislators).collect()
    assert [(r.valor, r.qtd) for r in nothing] == [(0, 0)]


def _stored_rows(monkeypatch):
    """Rows of each table that the operators store on the way."""
    counts = {}

    def counted(df, name):
        stored = writers.written(df, name)
        counts[name] = max(counts.get(name, 0), stored.count())
        return stored

    monkeypatch.setattr(operations, "written", counted)
    return counts


def _many_authors(spark):
    facts = spark.range(600).selectExpr("cast(id as int) id", "cast(id % 300 as int) cod_autor", "concat('ANA ', id % 300) nome_autor", "cast(2020 + id % 2 as int) ano", "'AC' uf",
                                        "'10' funcao", "'101' subfuncao", "'Individual' tipo_emenda", "cast(1 as decimal(15,2)) valor_empenhado")
    return facts, spark.range(300).selectExpr("cast(id as int) cod_autor", "'PT' partido")


def test_text_keys_do_not_grow_with_the_names_that_hold_them(spark, monkeypatch):
    counts, (facts, people) = _stored_rows(monkeypatch), _many_authors(spark)
    asked = spark.createDataFrame([(i, "ana", "indiv", 2000 + i, 2021, "total") for i in range(10)], "id_consulta int, autor string, tipo_emenda string, ano_inicio int, ano_fim int, operacao string")
    found = operations.figures(asked, facts, people).collect()
    assert sorted((r.id_consulta, int(r.valor), r.qtd) for r in found) == [(i, 600, 600) for i in range(10)]
    assert counts["chaves"] == 10 * 2


def test_passed_filters_store_no_pairs(spark, monkeypatch):
    counts, (facts, people) = _stored_rows(monkeypatch), _many_authors(spark)
    asked = spark.createDataFrame([(i, "ana", 2000 + i, 2020) for i in range(10)], "id_consulta int, autor string, ano_inicio int, ano_fim int")
    numbered, passed = operations.passed_filters(asked, facts, people)
    assert {r.id for r in passed.collect()} == set(range(0, 600, 2)) and {tuple(r.filtros) for r in passed.collect()} == {(2**10 - 1,)}
    assert max(counts.values()) <= 10 and numbered.count() == 10


def test_cells_hold_only_the_keys_asked_for(spark, monkeypatch):
    counts, (facts, people) = _stored_rows(monkeypatch), _many_authors(spark)
    asked = spark.createDataFrame([(1, "PT", "comparacao")], "id_consulta int, partido string, operacao string")
    found = operations.figures(asked, facts, people).collect()
    assert sorted((r.grupo, r.ano, int(r.valor), r.qtd) for r in found) == [("Individual", 2020, 300, 300), ("Individual", 2021, 300, 300)]
    assert counts["celulas"] == 2
