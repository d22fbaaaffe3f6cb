"""Readers, normalisation, deduplication, upsert, linking."""

import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from erario import schemas
from erario.operators import integrity, normalize
from erario.plans.ingest import load_amendments
from erario.sources import partitions, readers, writers
from erario.sources.partitions import read_partitioned
from erario.streaming.landing import land

RECORD = {
    "codigoEmenda": "202011970001", "nomeAutor": " Roberto Duarte ", "ano": 1, "tipoEmenda": "Individual", "funcao": "Saúde",
    "subfuncao": "301 - Atenção básica", "nomeSubfuncao": "Atenção básica", "localidadeDoGasto": "ACRE (UF)", "valorEmpenhado": "1.234,56",
    "valorPago": 99.5,
}


def _land(folder, year, records, name="pagina1.json"):
    path = folder / f"ano={year}"
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(json.dumps(records, ensure_ascii=False), encoding="utf-8")


def test_amendment_pages(spark, tmp_path):
    _land(tmp_path, 2023, [RECORD, dict(RECORD, codigoEmenda="2", nomeAutor=None, autor="ana", valorEmpenhado="1234.56", valorPago=None)])
    _land(tmp_path, 2024, [dict(RECORD, codigoEmenda="3")])
    rows = normalize.normalize_amendments(readers.read_amendments(spark, str(tmp_path))).orderBy("codigo_emenda").collect()
    assert [(r.codigo_emenda, r.ano, r.nome_autor) for r in rows] == [("2", 2023, "ANA"), ("202011970001", 2023, "ROBERTO DUARTE"), ("3", 2024, "ROBERTO DUARTE")]
    assert [r.valor_empenhado for r in rows] == [Decimal("123456.00"), Decimal("1234.56"), Decimal("1234.56")]
    assert [r.valor_pago for r in rows] == [Decimal("0.00"), Decimal("99.50"), Decimal("99.50")]
    first = rows[1]
    assert (first.funcao, first.subfuncao, first.uf, first.valor_liquidado, first.fonte) == ("10", "301", "AC", 0, "Portal da Transparência")
    only = readers.read_amendments(spark, str(tmp_path), [2024])
    assert [r.codigoEmenda for r in only.collect()] == ["3"]
    assert "PartitionFilters: [isnotnull(ano" in only._jdf.queryExecution().executedPlan().toString()


def test_legislator_pages_and_details(spark, tmp_path):
    page = {"dados": [{"id": 99, "nome": "Ana", "siglaPartido": "PT", "siglaUf": "AC", "urlFoto": "u", "extra": 1}]}
    (tmp_path / "p" / "legislatura=56").mkdir(parents=True)
    (tmp_path / "p" / "legislatura=56" / "a.json").write_text(json.dumps(page, indent=1))
    people = normalize.normalize_legislators(readers.read_legislators(spark, str(tmp_path / "p"), multi_line=True))
    row = people.first()
    assert (row.cod_autor, row.nome, row.partido, row.uf, row.legislaturas) == (99, "ANA", "PT", "AC", [56])
    (tmp_path / "d.json").write_text(json.dumps({"dados": {"id": 99, "nomeCivil": "Ana Maria", "dataNascimento": "1970-01-02"}}))
    joined = readers.with_details(people, readers.read_legislator_details(spark, str(tmp_path / "d.json"))).first()
    assert (joined.nome_civil, joined.data_nascimento, joined.escolaridade) == ("Ana Maria", "1970-01-02", "")


def test_legislator_list_defaults_to_the_current_legislature(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps([{"id": 1, "nome": "a", "siglaPartido": None}], indent=1))
    row = normalize.normalize_legislators(readers.read_json_array(spark, str(tmp_path / "l.json"), schemas.RAW_LEGISLATORS)).first()
    assert (row.nome, row.partido, row.legislaturas) == ("A", "", [57])


def test_classification_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text("CodFuncao;Funcao;CodSubfuncao;Subfuncao;CodPrograma;Programa\n4;Administração;31;Controle;7;P\n4;Administração;31;Controle;7;Q\n", encoding="utf-8")
    raw = readers.read_classification(spark, str(tmp_path / "c.csv")).withColumn("linha", F.monotonically_increasing_id())
    rows = integrity.dedup_classification(normalize.normalize_classification(raw, "linha"), "linha").collect()
    assert [(r.funcao, r.subfuncao, r.programa, r.descricao) for r in rows] == [("04", "031", "7", "Administração - Controle - P")]


def test_yearly_files_skip_absent_years(spark, tmp_path):
    for year in (2019, 2021, 2024):
        (tmp_path / f"emendas_{year}.json").write_text(json.dumps([dict(RECORD, ano=None)], indent=1), encoding="utf-8")
    assert sorted(r.ano for r in readers.read_years(spark, str(tmp_path)).collect()) == [2019, 2021, 2024]
    assert sorted(r.ano for r in readers.read_years(spark, str(tmp_path), 2020, 2024).collect()) == [2021, 2024]


def test_first_and_last_win(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, o int, v string")
    assert {r.v for r in integrity.dedup_first(rows, "k", "o").collect()} == {"x", "z"}
    assert {r.v for r in integrity.dedup_last(rows, "k", "o").collect()} == {"y", "z"}
    once = integrity.dedup_first(rows, "k", "o")
    assert once.exceptAll(integrity.dedup_first(once, "k", "o")).count() == 0


def test_dedup_cuts_hot_keys_before_the_shuffle(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
    plan = integrity.dedup_first(rows, "k", "id")._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Partial", plan.index("Exchange")) > plan.index("Exchange")
    assert integrity.dedup_first(rows, "k", "id").count() == 667


def test_invalid_codes(spark):
    rows = spark.createDataFrame([(None,), ("",), ("S/I",), ("1",)], "codigo_emenda string")
    assert [r[0] for r in integrity.drop_invalid_codes(rows).collect()] == ["1"]


def test_upsert_changes_the_party(spark):
    schema = "cod_autor int, nome string, partido string, uf string, legislaturas array<int>, url_foto string"
    stored = spark.createDataFrame([(99, "TESTE", "PT", "SP", [56], "f"), (1, "B", "X", "AC", [57], "g")], schema)
    batch = spark.createDataFrame([(99, "TESTE", "PL", "SP", [56, 57]), (5, "C", "Y", None, [57])], "cod_autor int, nome string, partido string, uf string, legislaturas array<int>")
    once = integrity.upsert(stored, batch, "cod_autor")
    rows = {r.cod_autor: r for r in once.collect()}
    assert (rows[99].partido, rows[99].legislaturas, rows[99].url_foto) == ("PL", [56, 57], "f")
    assert (rows[1].partido, rows[5].nome, rows[5].url_foto) == ("X", "C", None)
    assert sorted(map(str, integrity.upsert(once, batch, "cod_autor").collect())) == sorted(map(str, once.collect()))


def test_upsert_overwrites_with_null_but_keeps_vectors(spark):
    stored = spark.createDataFrame([("1", "a", [1.0]), ("2", "b", None)], "k string, v string, embedding array<double>")
    batch = spark.createDataFrame([("1", None, [9.0]), ("2", "c", [8.0]), ("3", "d", [7.0])], stored.schema)
    rows = {r.k: (r.v, r.embedding) for r in integrity.upsert_keep(stored, batch, "k").collect()}
    assert rows == {"1": (None, [1.0]), "2": ("c", None), "3": ("d", [7.0])}


def test_upsert_stamps_new_and_changed_rows(spark):
    schema = "k string, v int, created_at timestamp, updated_at timestamp"
    stored = spark.sql("SELECT 'a' AS k, 1 AS v, timestamp'2020-01-01' AS created_at, timestamp'2020-01-01' AS updated_at UNION ALL SELECT 'b', 2, timestamp'2020-01-01', timestamp'2020-01-01'")
    batch = spark.createDataFrame([("a", 5), ("c", 6)], "k string, v int")
    rows = integrity.upsert_stamped(normalize.conform(stored, schema), batch, "k", F.lit("2024-05-05").cast("timestamp"))
    got = {r.k: (r.v, str(r.created_at.date()), str(r.updated_at.date())) for r in rows.collect()}
    assert got == {"a": (5, "2020-01-01", "2024-05-05"), "b": (2, "2020-01-01", "2020-01-01"), "c": (6, "2024-05-05", "2024-05-05")}


def test_conform_to_the_stored_tables(spark):
    row = normalize.conform(spark.createDataFrame([("1", "2024")], "codigo_emenda string, ano string"), schemas.AMENDMENTS)
    assert row.columns[:3] == ["id", "codigo_emenda", "cod_autor"] and len(row.columns) == 21
    first = row.first()
    assert (first.ano, first.valor_pago, first.uf) == (2024, 0, None)
    for schema in (schemas.LEGISLATORS, schemas.CLASSIFICATION, schemas.MOVEMENTS, schemas.QUESTION_LOG, schemas.VECTORS):
        assert normalize.conform(spark.range(1), schema).count() == 1


def test_insert_if_absent_is_idempotent(spark):
    stored = spark.createDataFrame([("EMD000", 1)], "codigo_emenda string, v int")
    batch = spark.createDataFrame([("EMD000", 2), ("EMD001", 3)], "codigo_emenda string, v int")
    once = integrity.insert_if_absent(stored, batch, "codigo_emenda")
    assert sorted(map(tuple, once.collect())) == [("EMD000", 1), ("EMD001", 3)]
    assert integrity.insert_if_absent(once, batch, "codigo_emenda").count() == 2


def test_touched_partitions_include_the_one_a_row_leaves(spark):
    stored = spark.createDataFrame([("1", 2020), ("2", 2021)], "k string, ano int")
    batch = spark.createDataFrame([("1", 2023)], "k string, ano int")
    assert sorted(r.ano for r in integrity.touched_partitions(stored, batch, "k", "ano").collect()) == [2020, 2023]


def _brute_link(author, people):
    found = [code for code, name in people if author and author.upper() in name.upper()]
    return min(found) if found else None


def test_link_author_against_brute_force(spark):
    people = [(7, "ANA MARIA"), (3, "Mariana Costa"), (9, "João d'Ávila"), (2, "JOÃO"), (11, "A_A%")]
    authors = ["MARIA", "ana", "", "joão", "D'ÁVILA", "Costa", "ZÉ", "a", "%", "_", "ANA MARIA JOSÉ", "n"]
    rows = spark.createDataFrame([(i, n, 77) for i, n in enumerate(authors)] + [(99, None, 77)], "id int, nome_autor string, cod_autor int")
    linked = integrity.link_author(rows, spark.createDataFrame(people, "cod_autor int, nome string"))
    got = {r.id: r.cod_autor for r in linked.collect()}
    assert got == {**{i: _brute_link(n, people) for i, n in enumerate(authors)}, 99: None}
    assert "NestedLoop" not in linked._jdf.queryExecution().executedPlan().toString()


def test_load_report_counts_every_row_once(spark):
    rows = [("1", 2020, 1), ("1", 2020, 2), ("1", 2021, 3), ("2", 2021, 4), ("S/I", 2020, 5), (None, 2021, 6), ("3", 2021, 7)]
    batch = spark.createDataFrame(rows, "codigo_emenda string, ano int, ordem int")
    target = spark.createDataFrame([("2",)], "codigo_emenda string")
    got = {r.ano: (r.inseridas, r.atualizadas, r.ignoradas) for r in integrity.load_report(batch, target, ["ano", "ordem"]).collect()}
    assert got == {2020: (1, 0, 2), 2021: (1, 1, 2)}


def test_orphans_and_cascade(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "emenda_id int, v string")
    parent = spark.createDataFrame([(1,)], "id int")
    assert {r.v for r in integrity.orphans(child, parent, "emenda_id", "id").collect()} == {"b", "c"}
    assert {r.v for r in integrity.cascade_delete(child, parent, "emenda_id", "id").collect()} == {"b", "c"}


def test_write_and_replace_one_year(spark, tmp_path):
    rows = spark.createDataFrame([("1", 2020), ("2", 2021)], "k string, ano int")
    writers.write_table(rows, str(tmp_path / "t"))
    writers.replace_partitions(spark.createDataFrame([("9", 2021)], rows.schema), str(tmp_path / "t"))
    assert sorted(map(tuple, spark.read.schema(rows.schema).parquet(str(tmp_path / "t")).collect())) == [("1", 2020), ("9", 2021)]


def test_load_run(spark, tmp_path):
    _land(tmp_path, 2023, [RECORD, dict(RECORD, valorEmpenhado=5), dict(RECORD, codigoEmenda="S/I"), dict(RECORD, codigoEmenda="4", nomeAutor="ninguém")])
    raw = readers.read_amendments(spark, str(tmp_path)).withColumn("linha", F.col("valorEmpenhado").cast("string"))
    people = spark.createDataFrame([(1, "DEPUTADO ROBERTO DUARTE"), (5, "ROBERTO DUARTE")], "cod_autor int, nome string")
    stored = spark.createDataFrame([("4", [0.5])], "codigo_emenda string, embedding array<float>")
    rows = {r.codigo_emenda: r for r in load_amendments(raw, people, stored, ["ano", "linha"]).collect()}
    assert sorted(rows) == ["202011970001", "4"]
    assert (rows["202011970001"].valor_empenhado, rows["202011970001"].cod_autor) == (Decimal("1234.56"), 1)
    assert (rows["4"].embedding, rows["4"].cod_autor) == ([0.5], None)


def test_stream_landing_survives_a_lost_checkpoint(spark, tmp_path):
    people = spark.createDataFrame([(5, "ROBERTO DUARTE")], "cod_autor int, nome string")
    landing, table = tmp_path / "in", str(tmp_path / "out")
    _land(landing, 2023, [RECORD, dict(RECORD, codigoEmenda="2")])
    land(spark, str(landing), people, table, str(tmp_path / "c1")).awaitTermination()
    _land(landing, 2024, [dict(RECORD, codigoEmenda="3"), dict(RECORD, codigoEmenda="2")])
    land(spark, str(landing), people, table, str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.codigo_emenda for r in spark.read.parquet(table).collect()) == ["2", "202011970001", "3"]
    land(spark, str(landing), people, table, str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(table).count() == 3


def _files_of(path):
    return {str(f.relative_to(path)): f.read_bytes() for f in path.rglob("*.parquet")}


def _partitioned(spark, path):
    rows = read_partitioned(spark, str(path), StructField("ano", IntegerType()))
    return sorted((r.k, r.v, r.ano) for r in rows.collect())


@pytest.fixture
def years(spark, tmp_path):
    """A stored table of four years, null among them, and a batch that changes, adds and re-dates rows."""
    stored = spark.createDataFrame([("1", 1, 2020), ("2", 2, 2021), ("3", 3, 2022), ("4", 4, None), ("5", 5, 2022)], "k string, v int, ano int")
    writers.write_table(stored, str(tmp_path / "t"))
    batch = spark.createDataFrame([("1", 10, 2022), ("3", 30, 2022), ("6", 60, 2023), ("7", 70, None)], stored.schema)
    return tmp_path / "t", batch


LOADED = [("1", 10, 2022), ("2", 2, 2021), ("3", 30, 2022), ("4", 4, None), ("5", 5, 2022), ("6", 60, 2023), ("7", 70, None)]


def test_partition_load_leaves_other_files(spark, years):
    path, batch = years
    before = _files_of(path)
    assert partitions.stage(batch, str(path), "k") and partitions.complete(spark, str(path))
    assert _partitioned(spark, path) == LOADED
    after = _files_of(path)
    kept = {name: data for name, data in before.items() if name.startswith("ano=2021/")}
    assert kept and kept.items() <= after.items()
    assert not [name for name in after if name.startswith("ano=2020/")]  # its only row was re-dated
    assert not any(name in after for name in before if not name.startswith("ano=2021/"))
    assert partitions.stage(batch, str(path), "k") and partitions.complete(spark, str(path))
    assert _partitioned(spark, path) == LOADED


def test_partition_load_after_a_crash(spark, years, monkeypatch):
    """Dead before the manifest: the table is as it was.  Dead while partitions are replaced: a rerun completes the load."""
    path, batch = years
    before = _files_of(path)
    (path.parent / "t.staged" / "rows").mkdir(parents=True)
    (path.parent / "t.staged" / "rows" / "part").write_text("half")
    assert not partitions.complete(spark, str(path)) and _files_of(path) == before and not (path.parent / "t.staged").exists()
    assert partitions.stage(batch, str(path), "k") and _files_of(path) == before

    def dies(rows, target, partition_by):
        writers.replace_partitions(rows.filter("ano = 2022"), target, partition_by)
        raise OSError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(partitions, "replace_partitions", dies)
        with pytest.raises(OSError):
            partitions.complete(spark, str(path))
    assert partitions.complete(spark, str(path)) and _partitioned(spark, path) == LOADED
    assert not partitions.complete(spark, str(path))


def test_partition_load_of_nothing_and_into_nothing(spark, years, tmp_path):
    path, batch = years
    before = _files_of(path)
    assert not partitions.stage(batch.limit(0), str(path), "k") and not partitions.complete(spark, str(path)) and _files_of(path) == before
    assert partitions.stage(batch, str(tmp_path / "first"), "k") and partitions.complete(spark, str(tmp_path / "first"))
    assert _partitioned(spark, tmp_path / "first") == sorted(((r.k, r.v, r.ano) for r in batch.collect()))


def test_partition_names_and_new_columns(spark, tmp_path):
    """Text partitions keep leading zeros and marks; columns that a load brings are null in the other partitions."""
    path, schema = str(tmp_path / "t"), "k string, uf string"
    writers.write_table(spark.createDataFrame([("1", "01"), ("2", "a/b=c"), ("3", "02")], schema), path, "uf")
    batch = spark.createDataFrame([("2", "01", 5)], schema + ", v int")
    assert partitions.stage(batch, path, "k", "uf") and partitions.complete(spark, path, "uf")
    rows = read_partitioned(spark, path, batch.schema["uf"]).select("k", "uf", "v").collect()
    assert sorted(map(tuple, rows)) == [("1", "01", None), ("2", "01", 5), ("3", "02", None)]


def test_landed_arrays_fill_their_pages(spark, tmp_path, monkeypatch):
    from erario.plans import queries_ingest

    monkeypatch.setattr(queries_ingest, "PAGE_ROWS", 10)
    rows = spark.range(300).selectExpr("id", "cast(id as string) codigoEmenda", "concat('emendas_', 2000 + id % 6, '.json') arquivo")
    queries_ingest.land_arrays(rows, str(tmp_path / "anos"), "arquivo")
    pages = [json.loads(p.read_text()) for p in (tmp_path / "anos").rglob("part-*")]
    assert sorted(int(r["codigoEmenda"]) for page in pages for r in page) == list(range(300)) and max(map(len, pages)) == 10 and len(pages) == 30


def test_preparing_a_load_writes_its_rows_once(spark, tmp_path, monkeypatch):
    from erario.plans import ingest

    stored = []
    monkeypatch.setattr(ingest, "written", lambda df, name: stored.append(name) or writers.written(df, name))
    _land(tmp_path, 2023, [RECORD, dict(RECORD, nomeAutor="outro"), dict(RECORD, codigoEmenda="4", nomeAutor="ninguém")])
    raw = readers.read_amendments(spark, str(tmp_path)).withColumn("linha", F.col("nomeAutor"))
    people = spark.createDataFrame([(5, "ROBERTO DUARTE"), (6, "OUTRO")], "cod_autor int, nome string")
    rows = ingest.prepare_amendments(raw, people, ["ano", "linha"]).collect()
    assert sorted((r.codigo_emenda, r.cod_autor) for r in rows) == [("202011970001", 5), ("4", None)] and stored == ["vinculadas"]
