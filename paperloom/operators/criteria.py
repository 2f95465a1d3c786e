"""A fixed schema of criteria, flattened in its own order, and the prompts that ask for verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups, fields and labels of the criteria, in the report's order.
CRITERIA = [
    ("elementos_pre_textuais", "capa", "Capa"),
    ("elementos_pre_textuais", "folha_de_rosto", "Folha de rosto"),
    ("elementos_pre_textuais", "natureza_do_trabalho", "Natureza do trabalho"),
    ("elementos_pre_textuais", "resumo", "Resumo"),
    ("elementos_pre_textuais", "abstract", "Abstract"),
    ("elementos_pre_textuais", "palavras_chave", "Palavras-chave"),
    ("elementos_pre_textuais", "sumario", "Sumário"),
    ("citacoes", "citacao_direta_curta", "Citação direta curta"),
    ("citacoes", "citacao_direta_longa", "Citação direta longa"),
    ("citacoes", "citacao_indireta", "Citação indireta"),
    ("citacoes", "sistema_de_chamada", "Sistema de chamada"),
    ("citacoes", "indicacao_da_fonte", "Indicação da fonte"),
    ("referencias_bibliograficas", "estrutura_das_referencias", "Estrutura das referências"),
    ("referencias_bibliograficas", "padronizacao", "Padronização"),
    ("referencias_bibliograficas", "ordenacao", "Ordenação"),
    ("referencias_bibliograficas", "correspondencia", "Correspondência"),
    ("ilustracoes", "identificacao", "Identificação"),
    ("ilustracoes", "numeracao", "Numeração"),
    ("ilustracoes", "legenda", "Legenda"),
    ("ilustracoes", "fonte", "Fonte"),
    ("ilustracoes", "tipografia", "Tipografia"),
    ("paginacao", "contagem_das_paginas", "Contagem das páginas"),
    ("paginacao", "exibicao_da_numeracao", "Exibição da numeração"),
    ("paginacao", "posicionamento", "Posicionamento"),
    ("paginacao", "formatacao", "Formatação"),
    ("resumo", "conteudo", "Conteúdo"),
    ("resumo", "extensao", "Extensão"),
    ("resumo", "paragrafo_unico", "Parágrafo único"),
    ("resumo", "palavras_chave", "Palavras-chave"),
    ("numeracao_progressiva_das_secoes", "estrutura_hierarquica", "Estrutura hierárquica"),
    ("numeracao_progressiva_das_secoes", "numeracao_progressiva", "Numeração progressiva"),
    (
        "numeracao_progressiva_das_secoes",
        "correspondencia_entre_titulos_e_numeracao",
        "Correspondência entre títulos e numeração",
    ),
    ("numeracao_progressiva_das_secoes", "padronizacao_dos_titulos", "Padronização dos títulos"),
    ("numeracao_progressiva_das_secoes", "consistencia_da_hierarquia", "Consistência da hierarquia"),
    ("sumario", "presenca_do_sumario", "Presença do sumário"),
    ("sumario", "correspondencia_estrutural", "Correspondência estrutural"),
    ("sumario", "numeracao_das_secoes", "Numeração das seções"),
    ("sumario", "indicacao_das_paginas", "Indicação das páginas"),
    ("sumario", "ordem_das_secoes", "Ordem das seções"),
    ("sumario", "padronizacao_visual", "Padronização visual"),
]
REFERENCE_HINTS = ("referências", "pós-textuais")


def flattened(results: DataFrame, key: str) -> DataFrame:
    """(key, ord, criteria_item, standard, justification, passed) in the report's order, of results (key, group, field,
    norma, justificativa, match); results of other fields go, a criterion without one stays with nulls."""
    rows = [(i, *c) for i, c in enumerate(CRITERIA)]
    table = results.sparkSession.createDataFrame(rows, "ord int, group string, field string, criteria_item string")
    every = results.select(key).distinct().select(key, F.explode(F.array(*[F.lit(i) for i, *_ in rows])).alias("ord"))
    every = every.join(F.broadcast(table), "ord")  # forty rows
    out = every.join(results, [key, "group", "field"], "left")
    return out.select(
        key, "ord", "criteria_item", F.col("norma").alias("standard"), F.col("justificativa").alias("justification"),
        F.col("match").alias("passed"),
    )


def incomplete(flat: DataFrame, key: str) -> DataFrame:
    """(key, n): keys of which not every criterion has a verdict."""
    n = flat.groupBy(key).agg(F.count("passed").alias("n"))
    return n.where(F.col("n") != len(CRITERIA))


def is_references_label(label: Column) -> Column:
    low = F.lower(label)
    return F.coalesce(low.rlike("|".join(REFERENCE_HINTS)), F.lit(False))


def rendered(template: str, flags: dict[str, Column] | None = None, **values: Column) -> Column:
    """A template with ``{{ name }}`` for values and ``{% if flag %}...{% endif %}`` blocks that stay where the flag holds.

    A line of a block's own tag goes with its line break; null values are empty."""
    import re

    out, at = [], 0
    pattern = re.compile(r"[ \t]*\{% if (\w+) %\}\n?(.*?)[ \t]*\{% endif %\}\n?|\{\{ (\w+) \}\}", re.DOTALL)
    for m in pattern.finditer(template):
        out.append(F.lit(template[at : m.start()]))
        if m[3]:
            out.append(F.coalesce(values[m[3]].cast("string"), F.lit("")))
        else:
            out.append(F.when((flags or {})[m[1]], rendered(m[2], flags, **values)).otherwise(""))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))
