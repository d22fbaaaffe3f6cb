"""The 30 evaluation questions with the entities they must yield."""

from pyspark.sql import DataFrame, SparkSession, functions as F

# Id, question, expected entities. A: direct, B: semantic, C: complex.
QUESTIONS = [
    ("A1", "Qual o valor total das emendas individuais do deputado Roberto Duarte em 2024?", {"autor": "ROBERTO DUARTE", "ano": 2024}),
    ("A2", "Quantas emendas foram destinadas ao Acre em 2023?", {"uf": "AC", "ano": 2023}),
    ("A3", "Qual deputado do PT mais destinou emendas em 2024?", {"partido": "PT", "ano": 2024, "operacao": "ranking"}),
    ("A4", "Quanto foi pago em emendas de bancada para o Amazonas em 2022?", {"uf": "AM", "ano": 2022, "tipo_emenda": "bancada"}),
    ("A5", "Quantas emendas individuais foram empenhadas em 2020?", {"ano": 2020, "tipo_emenda": "individual"}),
    ("A6", "Qual o valor total das emendas de comissão em 2024?", {"ano": 2024, "tipo_emenda": "comissao"}),
    ("A7", "Quais parlamentares do Acre tiveram emendas em 2023?", {"uf": "AC", "ano": 2023}),
    ("A8", "Qual o valor médio das emendas individuais em 2024?", {"ano": 2024, "tipo_emenda": "individual", "operacao": "media"}),
    ("A9", "Quantos parlamentares distintos tiveram emendas em 2021?", {"ano": 2021, "operacao": "contagem_distinta"}),
    ("A10", "Qual o total empenhado em emendas para Roraima em 2024?", {"uf": "RR", "ano": 2024}),
    ("B1", "Quais emendas para saúde foram executadas no Acre em 2023?", {"area": "saude", "uf": "AC", "ano": 2023}),
    ("B2", "Qual partido destinou mais recursos para educação na região Norte?", {"area": "educacao", "uf": "norte", "operacao": "ranking"}),
    ("B3", "Quanto foi investido em segurança pública em São Paulo em 2024?", {"area": "seguranca", "uf": "SP", "ano": 2024}),
    ("B4", "Quais emendas para transporte foram pagas no Pará?", {"area": "transporte", "uf": "PA"}),
    ("B5", "Qual deputado mais investiu em meio ambiente em 2023?", {"area": "meio ambiente", "ano": 2023, "operacao": "ranking"}),
    ("B6", "Emendas para assistência social no Nordeste em 2022?", {"area": "assistencia social", "uf": "nordeste", "ano": 2022}),
    ("B7", "Quanto foi pago em emendas para cultura no Rio de Janeiro?", {"area": "cultura", "uf": "RJ"}),
    ("B8", "Quais parlamentares destinaram emendas para agricultura no Sul?", {"area": "agricultura", "uf": "sul"}),
    ("B9", "Valor total das emendas para habitação em Minas Gerais em 2024?", {"area": "habitacao", "uf": "MG", "ano": 2024}),
    ("B10", "Emendas para saneamento básico na região Centro-Oeste?", {"area": "saneamento basico", "uf": "centro-oeste"}),
    ("C1", "Houve aumento nas emendas para saneamento básico no Norte entre 2022 e 2024?", {"area": "saneamento", "uf": "norte", "ano_inicio": 2022, "ano_fim": 2024}),
    ("C2", "Compare as emendas para educação entre PT e PL em 2024.", {"area": "educacao", "ano": 2024, "operacao": "comparacao"}),
    ("C3", "Qual a tendência das emendas para saúde no Acre de 2020 a 2024?", {"area": "saude", "uf": "AC", "ano_inicio": 2020, "ano_fim": 2024, "operacao": "tendencia"}),
    ("C4", "Quais estados do Nordeste mais receberam emendas para educação em 2023?", {"area": "educacao", "uf": "nordeste", "ano": 2023, "operacao": "ranking"}),
    ("C5", "Como evoluíram as emendas de bancada vs individuais entre 2020 e 2024?", {"ano_inicio": 2020, "ano_fim": 2024, "operacao": "comparacao"}),
    ("C6", "Top 3 deputados do PSDB que mais destinaram para saúde no Sudeste?", {"partido": "PSDB", "area": "saude", "uf": "sudeste", "operacao": "ranking"}),
    ("C7", "As emendas para segurança pública cresceram no Rio de Janeiro entre 2021 e 2024?", {"area": "seguranca", "uf": "RJ", "ano_inicio": 2021, "ano_fim": 2024, "operacao": "tendencia"}),
    ("C8", "Compare os investimentos em transporte entre Norte e Sudeste em 2023.", {"area": "transporte", "ano": 2023, "operacao": "comparacao"}),
    ("C9", "Quais áreas tiveram mais crescimento em emendas no Amazonas de 2020 a 2024?", {"uf": "AM", "ano_inicio": 2020, "ano_fim": 2024, "operacao": "tendencia"}),
    ("C10", "Qual a proporção entre valor empenhado e valor pago nas emendas de 2024?", {"ano": 2024, "operacao": "comparacao"}),
]


def evaluation_questions(spark: SparkSession) -> DataFrame:
    """(id_consulta, consulta, esperado) of the fixed question set."""
    rows = [(number, asked, {k: str(x) for k, x in expected.items()}) for number, asked, expected in QUESTIONS]
    return spark.createDataFrame(rows, "id_consulta string, consulta string, esperado map<string,string>")


def without_accents(text):
    """Plain Latin letters for the accented ones of Portuguese."""
    return F.translate(text, "áàâãéêíóôõúüç", "aaaaeeiooouuc")
