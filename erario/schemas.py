"""Explicit schemas of the stored tables and of the raw inputs."""

AMENDMENTS = (
    "id bigint, codigo_emenda string, cod_autor int, nome_autor string, ano int, tipo_emenda string, funcao string, "
    "funcao_nome string, subfuncao string, subfuncao_nome string, programa string, acao string, localidade string, "
    "uf string, valor_empenhado decimal(15,2), valor_liquidado decimal(15,2), valor_pago decimal(15,2), "
    "descricao string, fonte string, created_at timestamp, updated_at timestamp"
)
LEGISLATORS = (
    "cod_autor int, nome string, nome_civil string, partido string, uf string, legislaturas array<int>, "
    "url_foto string, created_at timestamp, updated_at timestamp"
)
CLASSIFICATION = (
    "id bigint, funcao string, funcao_nome string, subfuncao string, subfuncao_nome string, programa string, "
    "programa_nome string, descricao string, embedding array<float>, created_at timestamp"
)
MOVEMENTS = (
    "id bigint, emenda_id bigint, data_movimento date, valor decimal(15,2), fase string, documento string, "
    "created_at timestamp"
)
QUESTION_LOG = (
    "consulta_nl string, entidades_json string, sql_gerada string, modo_busca string, num_resultados int, "
    "latencia_ms int, sucesso boolean, erro string, created_at timestamp"
)
VECTORS = "codigo string, texto string, embedding array<float>"

# Raw inputs. Money is VARIANT: a number and a text with the same characters mean different amounts.
RAW_AMENDMENTS = (
    "codigoEmenda string, nomeAutor string, autor string, ano int, tipoEmenda string, funcao string, "
    "subfuncao string, nomeSubfuncao string, localidadeDoGasto string, valorEmpenhado variant, "
    "valorLiquidado variant, valorPago variant"
)
RAW_LEGISLATORS = (
    "id bigint, uri string, nome string, siglaPartido string, uriPartido string, siglaUf string, "
    "idLegislatura int, urlFoto string, email string"
)
RAW_DETAILS = (
    "id bigint, nomeCivil string, dataNascimento string, municipioNascimento string, escolaridade string"
)
RAW_CLASSIFICATION = (
    "CodFuncao string, Funcao string, CodSubfuncao string, Subfuncao string, CodPrograma string, Programa string"
)
