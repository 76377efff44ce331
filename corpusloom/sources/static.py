"""Small fixed tables: data mix, vocabulary options, fertility targets, phases, benchmark groups, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHARES = {"web": 28, "code": 22, "books": 12, "scimath": 10, "gov": 5, "indic-lit": 5, "news": 5, "wiki": 5, "qa": 4, "synthetic": 4}
#: thousands of entries: (fertility, training cost, inference cost)
VOCABULARIES = {32: (1.42, 100, 100), 64: (1.27, 96, 95), 96: (1.19, 93, 92), 128: (1.14, 91, 90), 160: (1.11, 92, 92), 256: (1.06, 98, 100)}
RECOMMENDED = 128
TARGETS = {
    ("language", "English"): 1.1, ("language", "Hindi"): 1.18, ("language", "Bengali"): 1.18, ("language", "Marathi"): 1.18, ("language", "Telugu"): 1.2,
    ("language", "Tamil"): 1.2, ("language", "Kannada"): 1.22, ("language", "Gujarati"): 1.22, ("language", "Malayalam"): 1.23,
    ("code", "Code"): 1.05, ("math", "Mathematics"): 1.05, ("science", "Science"): 1.08, ("agentic", "Agentic Tasks"): 1.08,
}
BENCHMARKS = {
    "Coding": "HumanEval+|LiveCodeBench|SWE-bench Verified", "Mathematics": "GSM8K|MATH|AIME", "Science": "GPQA", "General Knowledge": "MMLU-Pro",
    "Agentic": "ToolBench|BrowserBench", "Indic": "FLORES-200|BharatBench|Native Human Evaluation",
}
PHASES = ("pretrain", "sft", "prefs")
CLEANING = ("raw", "langid", "normalize", "dedup", "quality", "safety", "code", "corpus")
TRAINING = ("pretrain", "sft", "dpo", "agentic", "safety", "eval")
#: verb: subject-object pairs
SENTENCES = {
    "chase": "cat-cow cat-dog cow-cat cow-dog dog-cat dog-cow",
    "eat": "apple-cow banana-dog cat-mango cow-apple cow-banana cow-mango dog-apple dog-banana mango-cat",
    "see": "apple-cow banana-dog cat-apple cat-dog cow-cat cow-mango dog-banana dog-cow mango-cat",
}
CATEGORIES = {"Animals": "cat cow dog", "Fruits": "apple banana mango", "Verbs": "chase eat see"}


#: Names of languages by their codes.
NAMES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish", "hi": "Hindi", "te": "Telugu", "ta": "Tamil"}


def display_name(code: Column) -> Column:
    """A language's name, or its code where it has none here."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), code), code)


def data_mix(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SHARES.items()), "id string, share int")


def vocabulary_options(spark: SparkSession) -> DataFrame:
    rows = [(f"{k}K", k * 1024, *v, True if k == RECOMMENDED else None) for k, v in VOCABULARIES.items()]
    return spark.createDataFrame(rows, "label string, vocab int, fertility double, train_cost int, infer_cost int, recommended boolean")


def fertility_targets(spark: SparkSession) -> DataFrame:
    rows = [(i, d, t, c) for i, ((c, d), t) in enumerate(TARGETS.items())]
    return spark.createDataFrame(rows, "ordinal int, domain string, target double, category string")


def benchmark_groups(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(g, b.split("|")) for g, b in BENCHMARKS.items()], "title string, benchmarks array<string>")


def stages(spark: SparkSession) -> DataFrame:
    rows = [(kind, i, s) for kind, ids in (("data", PHASES), ("cleaning", CLEANING), ("training", TRAINING)) for i, s in enumerate(ids)]
    return spark.createDataFrame(rows, "kind string, ordinal int, id string")


def sentences(spark: SparkSession) -> DataFrame:
    rows = [(v, p.split("-")) for v, ps in SENTENCES.items() for p in ps.split()]
    return spark.createDataFrame([(i, [s, v, o]) for i, (v, (s, o)) in enumerate(rows)], "sent_id int, tokens array<string>")


def token_categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, c) for c, ts in CATEGORIES.items() for t in ts.split()], "token string, category string")
