"""Small fixed tables of the reference configuration, as DataFrames.

Fixed values (must equal the reference for the same routing / roll-ups):
language codes, alignment routing lists, fine-tuning language groups,
special tokens per backbone, evaluation split priority, the seven task
types and the fixed instructions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# ---- fixed values: language -> ISO-639-3 codes
LANG_TO_CODES = {
    "ar": ["ara"], "bn": ["ben"], "de": ["deu"], "es": ["spa"], "en": ["eng"], "fa": ["fas"],
    "fi": ["fin"], "fr": ["fra"], "hi": ["hin"], "id": ["ind"], "ja": ["jpn"], "ko": ["kor"],
    "ru": ["rus"], "sw": ["swa"], "te": ["tel"], "vi": ["vie"], "yo": ["yor"], "zh": ["cmn", "cmo", "zho"],
}

# ---- fixed values: evaluation split priority
SPLIT_PRIORITY = ["test", "test.full", "test_expert", "validation", "dev", "train"]

# ---- fixed values: task types of the English catalogue
TASK_TYPES = ["Classification", "Clustering", "PairClassification", "Reranking", "Retrieval", "STS", "Summarization"]

# ---- fixed values: instructions used by alignment routing
RECONSTRUCT_INSTRUCTION = "Please reconstruct the following text."
QUESTION_INSTRUCTION = "Please write a question based on this passage."

# ---- fixed values: alignment routing lists
PRETRAINING_RECONSTRUCT = [
    "wikitext-103-filtered", "Reddit-clustering", "StackExchange-clustering",
    "biorxivS2S", "biorxivP2P", "ArxivS2S", "ArxivP2P", "imdb",
]
PRETRAINING_PASSAGE2QUERY = [
    "MSMarco", "PubMedQA", "Arguana", "Fever", "FiQA",
    "HotpotQA", "NFCorpus", "NQ", "SciFact", "TREC-COVID",
    "Touche2020", "en_MIRACL", "en_MrTidy", "PQA", "SQuAD",
]
PRETRAINING_QUERY2PASSAGE = [
    "Amazon-Counterfactual", "Amazon-Review", "Banking77", "Emotion",
    "imdb", "MTOP-Intent", "Toxic-conversation", "Tweet-Sentiment",
    "dureader", "t2ranking", "zh_MIRACL",
]

# ---- fixed values: fine-tuning dataset groups per language
EN_CROSS_BATCH = [
    "Arguana", "CQADupStack", "DBPedia", "Fever", "FiQA",
    "HotpotQA", "MSMarco", "NFCorpus", "NQ", "Quora",
    "SciDocs", "SciFact", "TREC-COVID", "Touche2020",
    "en_MIRACL", "en_MrTidy", "PQA", "PubMedQA", "snli",
    "SQuAD", "STS",
]
EN_NON_CROSS_BATCH = [
    "ArxivP2P", "ArxivS2S", "biorxivP2P", "biorxivS2S", "20NewsGroups",
    "medrxivP2P", "medrxivS2S", "Reddit-clustering", "StackExchange-clustering",
    "Amazon-Counterfactual", "Amazon-Review", "Banking77", "Emotion",
    "imdb", "MTOP-Intent", "Toxic-conversation", "Tweet-Sentiment",
]
LANG_GROUPS = {
    "en": EN_CROSS_BATCH + EN_NON_CROSS_BATCH,
    "ar": ["ar_MIRACL", "ar_MrTidy"], "bn": ["bn_MIRACL", "bn_MrTidy"],
    "de": ["de_MIRACL"], "es": ["es_MIRACL"], "fa": ["fa_MIRACL"],
    "fi": ["fi_MIRACL", "fi_MrTidy"], "fr": ["fr_MIRACL"], "hi": ["hi_MIRACL"],
    "id": ["id_MIRACL", "id_MrTidy"],
    "ko": ["ko_MIRACL", "ko_MrTidy"], "ru": ["ru_MIRACL", "ru_MrTidy"],
    "sw": ["sw_MIRACL", "sw_MrTidy"], "te": ["te_MIRACL", "te_MrTidy"],
    "th": ["th_MIRACL", "th_MrTidy"], "vi": ["vi-HealthQA"], "yo": ["yo_MIRACL"],
    "zh": ["zh_MIRACL", "dureader", "t2ranking"],
}

# ---- fixed values: special tokens per backbone family
SPECIAL_TOKENS = {
    "t5": {"eos": "</s>"},
    "xlm-r": {"bos": "<s>", "eos": "</s>"},
    "mistral": {"bos": "<s>", "eos": "</s>"},
    "llama": {"bos": "<|begin_of_text|>", "eos": "<|end_of_text|>", "pad": "<|finetune_right_pad_id|>",
              "mask": "<|reserved_special_token_0|>"},
    "nvidia/NV-Embed-v2": {"bos": "<s>", "eos": "</s>"},
}


def lang_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, code) for lang, codes in LANG_TO_CODES.items() for code in codes],
                                 "lang string, code string")


def lang_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(lang, i, n) for lang, names in LANG_GROUPS.items() for i, n in enumerate(names)],
                                 "lang string, pos int, name string")


def alignment_routes(spark: SparkSession) -> DataFrame:
    """name -> route, first match wins in the order reconstruct, passage->query,
    query->passage (a name in two lists keeps the first)."""
    rows, seen = [], set()
    for route, names in (("reconstruct", PRETRAINING_RECONSTRUCT), ("passage2query", PRETRAINING_PASSAGE2QUERY),
                         ("query2passage", PRETRAINING_QUERY2PASSAGE)):
        for n in names:
            if n not in seen:
                seen.add(n)
                rows.append((n, route))
    return spark.createDataFrame(rows, "name string, route string")


def special_tokens(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, v.get("bos", ""), v.get("eos", "")) for k, v in SPECIAL_TOKENS.items()],
                                 "backbone string, bos string, eos string")
