"""Codes, names, word lists and addresses that decide results.

They are published budget codes, state codes, dictionary terms and public
portal addresses.  Everything here is a constant; no logic lives in this file.
"""

# State name -> two-letter code (27).
STATE_CODES = {
    "ACRE": "AC",
    "ALAGOAS": "AL",
    "AMAPÁ": "AP",
    "AMAZONAS": "AM",
    "BAHIA": "BA",
    "CEARÁ": "CE",
    "DISTRITO FEDERAL": "DF",
    "ESPÍRITO SANTO": "ES",
    "GOIÁS": "GO",
    "MARANHÃO": "MA",
    "MATO GROSSO": "MT",
    "MATO GROSSO DO SUL": "MS",
    "MINAS GERAIS": "MG",
    "PARÁ": "PA",
    "PARAÍBA": "PB",
    "PARANÁ": "PR",
    "PERNAMBUCO": "PE",
    "PIAUÍ": "PI",
    "RIO DE JANEIRO": "RJ",
    "RIO GRANDE DO NORTE": "RN",
    "RIO GRANDE DO SUL": "RS",
    "RONDÔNIA": "RO",
    "RORAIMA": "RR",
    "SANTA CATARINA": "SC",
    "SÃO PAULO": "SP",
    "SERGIPE": "SE",
    "TOCANTINS": "TO",
}

# Budget function name -> code; the first name contained in a text wins (18).
FUNCTION_CODES = {
    "Saúde": "10",
    "Educação": "12",
    "Segurança Pública": "06",
    "Transporte": "26",
    "Assistência Social": "08",
    "Cultura": "13",
    "Defesa Nacional": "05",
    "Agricultura": "20",
    "Ciência e Tecnologia": "19",
    "Meio Ambiente": "18",
    "Direitos da Cidadania": "14",
    "Desporto e Lazer": "27",
    "Habitação": "16",
    "Saneamento": "17",
    "Trabalho": "11",
    "Previdência Social": "09",
    "Comunicações": "24",
    "Turismo": "23",
}

# Dictionary term -> budget function code (68).
FUNCTION_TERMS = {
    "saude": "10", "saúde": "10", "hospital": "10", "posto de saude": "10",
    "educacao": "12", "educação": "12", "escola": "12", "ensino": "12",
    "seguranca": "06", "segurança": "06", "segurança publica": "06", "policia": "06",
    "transporte": "26", "estrada": "26", "rodovia": "26", "mobilidade": "26",
    "assistencia social": "08", "assistência social": "08", "social": "08",
    "cultura": "13", "patrimonio cultural": "13",
    "meio ambiente": "18", "ambiental": "18", "ecologia": "18",
    "ciencia e tecnologia": "19", "ciência e tecnologia": "19", "pesquisa": "19",
    "defesa": "05", "defesa nacional": "05", "militar": "05",
    "agricultura": "20", "agropecuaria": "20", "agropecuária": "20", "rural": "20",
    "habitacao": "16", "habitação": "16", "moradia": "16",
    "esporte": "27", "desporto": "27", "esportes": "27",
    "turismo": "23",
    "comunicacoes": "24", "comunicações": "24",
    "trabalho": "11", "emprego": "11",
    "previdencia": "09", "previdência": "09",
    "direitos da cidadania": "14", "direitos humanos": "14",
    "urbanismo": "15", "cidade": "15",
    "saneamento": "17", "saneamento basico": "17",
    "energia": "25", "energia eletrica": "25",
    "industria": "22", "indústria": "22", "comercio": "22",
    "organizacao agraria": "21", "organização agrária": "21", "reforma agraria": "21",
    "legislativa": "01",
    "judiciaria": "02", "judiciária": "02", "justica": "02",
    "administracao": "04", "administração": "04",
    "relacoes exteriores": "03",
}

# Dictionary term -> budget subfunction code (29).
SUBFUNCTION_TERMS = {
    "saneamento basico": "512", "saneamento básico": "512",
    "atencao basica": "301", "atenção básica": "301", "posto de saude": "301",
    "ensino fundamental": "361",
    "ensino superior": "364", "universidade": "364",
    "ensino medio": "362", "ensino médio": "362",
    "infraestrutura urbana": "451",
    "saneamento basico rural": "511",
    "transporte rodoviario": "782", "rodovia": "782",
    "assistencia hospitalar": "302", "assistência hospitalar": "302",
    "vigilancia sanitaria": "304", "vigilância sanitária": "304",
    "educacao infantil": "365", "educação infantil": "365", "creche": "365",
    "educacao especial": "367", "educação especial": "367",
    "policiamento": "181",
    "defesa civil": "182",
    "alimentacao e nutricao": "306", "alimentação e nutrição": "306",
    "empregabilidade": "334",
    "formacao de recursos humanos": "128",
}

# Region name -> state codes (5).
REGION_STATES = {
    "norte": ["AC", "AM", "AP", "PA", "RO", "RR", "TO"],
    "nordeste": ["AL", "BA", "CE", "MA", "PB", "PE", "PI", "RN", "SE"],
    "centro-oeste": ["DF", "GO", "MT", "MS"],
    "sudeste": ["ES", "MG", "RJ", "SP"],
    "sul": ["PR", "RS", "SC"],
}

# Words that name an operation or an amendment type in a question.
OPERATION_TERMS = {
    "total": "total", "soma": "total",
    "ranking": "ranking", "mais": "ranking", "top": "ranking",
    "compare": "comparacao", "comparacao": "comparacao", "comparação": "comparacao",
    "vs": "comparacao", "proporcao": "comparacao", "proporção": "comparacao",
    "tendencia": "tendencia", "tendência": "tendencia", "cresceram": "tendencia",
    "crescimento": "tendencia", "aumento": "tendencia",
    "medio": "media", "médio": "media", "media": "media", "média": "media",
    "distintos": "contagem_distinta", "distintas": "contagem_distinta",
}
AMENDMENT_TYPE_TERMS = {
    "individual": "individual", "individuais": "individual",
    "bancada": "bancada",
    "comissao": "comissao", "comissão": "comissao",
}

# Money phases of an execution movement.
MOVEMENT_PHASES = ["empenho", "liquidacao", "pagamento"]

# Words that mark a stored SQL text as not read-only.
FORBIDDEN_SQL_WORDS = ["drop", "delete", "update", "insert", "alter", "truncate"]

# Text and addresses of the public portals.
PORTAL = "https://portaldatransparencia.gov.br"
PORTAL_DETAIL = "https://portaldatransparencia.gov.br/emendas/detalhe?codigoEmenda="
PORTAL_SEARCH = "https://portaldatransparencia.gov.br/emendas/consulta"
CHAMBER_DATA = "https://dadosabertos.camara.leg.br"
CHAMBER_LEGISLATOR = "https://www.camara.leg.br/deputados/"
SOURCE_NAME = "Portal da Transparência"
INVALID_CODE = "S/I"

# Defaults of the retrieval settings.
SIMILARITY_THRESHOLD = 0.45
RESULT_LIMIT = 20
EMBEDDING_DIM = 384
DEFAULT_LEGISLATURE = 57
