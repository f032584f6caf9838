"""Schemas, constants and the class catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# They appear in results and must stay as they are.
THRESHOLD = 0.60
HEALTHY, DISEASED, UNDETERMINED = "saudável", "doente", "indeterminado"
CONDITIONS = [HEALTHY, DISEASED, UNDETERMINED]
CNN, VLM = "CNN especializado", "Gemini (VLM)"
MISSING = "—"
ROUTINE = "Manter o monitoramento periódico e as práticas culturais de rotina."
# idx is the position: id, patterns, cultura, diagnostico, condicao, agente, sintomas, manejo
CATALOGUE = [
    ("apple_healthy", ["apple", "healthy"], "Maçã", "Saudável", HEALTHY, MISSING, "Folha com coloração uniforme, sem lesões, manchas ou deformações no limbo.", ROUTINE),
    ("apple_scab", ["apple", "scab"], "Maçã", "Sarna-da-macieira", DISEASED, "Fungo (Venturia inaequalis)", "Manchas oliva a marrom-escuras, de aspecto aveludado, que evoluem para lesões necróticas.", "Eliminar folhas caídas, melhorar a ventilação da copa por poda e aplicar fungicida preventivo nos períodos úmidos."),
    ("corn_healthy", ["corn", "healthy"], "Milho", "Saudável", HEALTHY, MISSING, "Folha verde uniforme, sem pústulas ou estrias ao longo das nervuras.", ROUTINE),
    ("corn_common_rust", ["corn", "common", "rust"], "Milho", "Ferrugem comum", DISEASED, "Fungo (Puccinia sorghi)", "Pústulas pulverulentas marrom-avermelhadas nas duas faces da folha, que rompem a epiderme.", "Priorizar híbridos resistentes e aplicar fungicida no aparecimento das primeiras pústulas."),
    ("grape_healthy", ["grape", "healthy"], "Uva", "Saudável", HEALTHY, MISSING, "Limbo íntegro, sem manchas concêntricas nem bordas necrosadas.", ROUTINE),
    ("grape_black_rot", ["grape", "black", "rot"], "Uva", "Podridão-negra", DISEASED, "Fungo (Guignardia bidwellii)", "Manchas circulares pardas com borda escura e pontuações negras (picnídios) no centro.", "Remover e destruir bagas mumificadas e ramos infectados; aplicar fungicida do início da brotação até a formação dos cachos."),
    ("potato_healthy", ["potato", "healthy"], "Batata", "Saudável", HEALTHY, MISSING, "Folíolos verdes e túrgidos, sem lesões concêntricas ou áreas encharcadas.", ROUTINE),
    ("potato_early_blight", ["potato", "early", "blight"], "Batata", "Pinta-preta", DISEASED, "Fungo (Alternaria solani)", "Lesões escuras com anéis concêntricos, em alvo, começando pelas folhas mais velhas.", "Fazer rotação de cultura, manter a adubação equilibrada e aplicar fungicida protetor no início dos sintomas."),
    ("tomato_healthy", ["tomato", "healthy"], "Tomate", "Saudável", HEALTHY, MISSING, "Folíolos verdes uniformes, sem manchas, encharcamento ou pontuações claras.", ROUTINE),
    ("tomato_late_blight", ["tomato", "late", "blight"], "Tomate", "Requeima", DISEASED, "Oomiceto (Phytophthora infestans)", "Manchas grandes de aspecto encharcado, verde-escuras a marrons, com mofo esbranquiçado na face inferior.", "Doença de evolução rápida em clima úmido e ameno: eliminar plantas afetadas, reduzir a molhagem foliar e aplicar fungicida sistêmico com urgência."),
    ("tomato_septoria", ["tomato", "septoria"], "Tomate", "Mancha de septória", DISEASED, "Fungo (Septoria lycopersici)", "Muitas manchas pequenas e circulares, de centro claro e borda escura, iniciando nas folhas baixeiras.", "Retirar as folhas baixeiras afetadas, evitar irrigação por aspersão e aplicar fungicida protetor."),
    ("tomato_spider_mites", ["tomato", "spider", "mite"], "Tomate", "Ácaro-rajado", DISEASED, "Praga (Tetranychus urticae)", "Pontuações claras e finas por toda a folha, que amarelece e seca; teia fina na face inferior.", "Praga favorecida por tempo quente e seco: elevar a umidade, preservar ácaros predadores e recorrer a acaricida específico apenas se o nível de dano exigir."),
]
UNDETERMINED_RECORD = {"especie": MISSING, "diagnostico": "Indeterminado", "condicao": UNDETERMINED, "agente": MISSING}
OUT_OF_DOMAIN = "Imagem fora do domínio treinado ou de baixa qualidade: nenhuma das 12 classes atingiu a confiança mínima de %s."
OUT_OF_DOMAIN_ADVICE = "Esta cultura provavelmente não está entre as 12 classes do modelo especializado. Use o motor de visão generalista para analisar esta imagem."
NO_PLANT = {"especie": MISSING, "diagnostico": "Não é uma planta", "condicao": UNDETERMINED, "agente": MISSING, "manejo": "Envie uma foto da planta que deseja analisar."}
NO_PLANT_SYMPTOMS = "A imagem não mostra material vegetal."
EXPORT_COLUMNS = ["arquivo", "data_hora", "motor", "especie", "diagnostico", "condicao", "confianca", "confianca_texto", "agente_causal", "sintomas_observados", "manejo_recomendado", "alternativa_1", "confianca_alternativa_1", "alternativa_2", "confianca_alternativa_2", "observacoes", "modelo_versao"]
EXCLUDED_DIRS = [".venv", "__pycache__", ".git", ".claude", "entrega", "exportacoes", "node_modules"]
EXCLUDED_FILES = [".env", ".env.local", "historico.db"]
EXCLUDED_SUFFIXES = [".pyc", ".zip", ".pdf"]

RANKING = T.ArrayType(T.StructType([T.StructField("id_classe", T.StringType()), T.StructField("confianca", T.DoubleType())]))
#: The record that both engines produce.
RECORD = T.StructType([T.StructField(c, T.DoubleType() if c == "confianca" else RANKING if c == "ranking" else T.StringType()) for c in ["arquivo", "data_hora", "motor", "especie", "diagnostico", "condicao", "confianca", "confianca_texto", "agente", "sintomas", "manejo", "modelo_versao", "observacoes", "ranking"]])
#: What the remote vision engine answers; all fields are required.
VLM_ANSWER = T.StructType([T.StructField(c, T.BooleanType() if c == "e_planta" else T.StringType()) for c in ["e_planta", "especie", "parte_analisada", "condicao", "diagnostico", "agente_causal", "sintomas_observados", "manejo_recomendado", "confianca", "observacoes"]])
VLM_CONFIDENCE = ["baixa", "média", "alta"]


def catalogue(spark: SparkSession) -> DataFrame:
    """(idx, id, padroes, cultura, diagnostico, condicao, agente, sintomas, manejo): twelve rows."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(CATALOGUE)], "idx int, id string, padroes array<string>, cultura string, diagnostico string, condicao string, agente string, sintomas string, manejo string")


def check_class_order(ids: list[str]) -> None:
    """A model's outputs must come in the catalogue's order."""
    if ids != [c[0] for c in CATALOGUE]:
        raise ValueError("the model's classes are not those of the catalogue, in its order")
