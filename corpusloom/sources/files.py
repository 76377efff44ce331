"""Readers of text folders and of tokenizer files."""

from __future__ import annotations

import json
import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as tx


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def language_texts(spark: SparkSession, folder: str, lang: str) -> DataFrame:
    """(lang, path, text): a document a ``*.txt`` file, cleaned, without byte order mark; a missing folder is empty."""
    if not _exists(spark, folder):
        return spark.createDataFrame([], "lang string, path string, text string")
    raw = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    text = F.regexp_replace("value", "^﻿", "")
    return raw.select(F.lit(lang).alias("lang"), "path", tx.clean_text(text).alias("text")).where("text <> ''")


def corpus(spark: SparkSession, root: str, languages: list[str]) -> DataFrame:
    """The texts of ``root/<lang>/*.txt``; at least one language must have some, and those that have none are warned of."""
    out = reduce(DataFrame.unionByName, [language_texts(spark, f"{root}/{lang}", lang) for lang in languages])
    found = {r["lang"] for r in out.select("lang").distinct().collect()}
    if not found:
        raise ValueError(f"no text in any of {languages} under {root}")
    if missing := [x for x in languages if x not in found]:
        warnings.warn(f"no text under {root} for: {', '.join(missing)}", stacklevel=2)
    return out


def document_counts(texts: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, num_documents) of every language asked for; one without texts has 0."""
    asked = texts.sparkSession.createDataFrame([(x,) for x in languages], "lang string")
    return asked.join(texts.groupBy("lang").agg(F.count("*").alias("num_documents")), "lang", "left").na.fill(0)


def faithful_text(spark: SparkSession, root: str, lang: str) -> DataFrame:
    """The text of ``<lang>.faithful.txt``; no row where the file is missing."""
    path = f"{root}/{lang}.faithful.txt"
    if not _exists(spark, path):
        return spark.createDataFrame([], "lang string, text string")
    return spark.read.text(path, wholetext=True).select(F.lit(lang).alias("lang"), F.col("value").alias("text"))


def merges(spark: SparkSession, path: str) -> DataFrame:
    """(rank, left, right, result) from a JSON file of merges; pairs as arrays or as ``"a b"``."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.get_json_object("value", "$.merges"), "array<string>")).alias("m"))
    m = F.col("m")
    pair = F.coalesce(F.from_json(F.get_json_object(m, "$.pair"), "array<string>"), F.from_json(m, "array<string>"), F.split(m, " "))
    found = rows.select(F.get_json_object(m, "$.rank").cast("int").alias("rank"), pair.alias("p")).select("rank", F.col("p")[0].alias("left"), F.col("p")[1].alias("right"))
    return found.withColumn("result", F.concat("left", "right"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, id) from ``{tokens: {id: token}, special_tokens: {token: id}}``; special tokens win."""
    raw = spark.read.text(path, wholetext=True)
    plain = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.tokens"), "map<string,string>")).alias("id", "token")).select("token", F.col("id").cast("int").alias("id"), F.lit(0).alias("special"))
    special = raw.select(F.explode(F.from_json(F.get_json_object("value", "$.special_tokens"), "map<string,int>")).alias("token", "id")).select("token", "id", F.lit(1).alias("special"))
    return plain.unionByName(special).groupBy("token").agg(F.max_by("id", "special").alias("id"))


class Missing(FileNotFoundError):
    """A file that training would have made isn't there."""


_READ: dict[str, tuple[int, DataFrame]] = {}


def artifact(spark: SparkSession, path: str) -> DataFrame:
    """(content) of a file of an artifact set, read anew when its time has changed; says what is missing where it isn't there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise Missing(f"{path} is missing: train a tokenizer and write its artifacts first")
    changed = fs.getFileStatus(p).getModificationTime()
    if path not in _READ or _READ[path][0] != changed:
        _READ[path] = changed, spark.read.text(path, wholetext=True).withColumnRenamed("value", "content")
    return _READ[path][1]


def health(spark: SparkSession, folder: str) -> DataFrame:
    """(file, present) of an artifact set."""
    return spark.createDataFrame([(f, _exists(spark, f"{folder}/{f}")) for f in ARTIFACTS], "file string, present boolean")


ARTIFACTS = ("vocab.json", "merges.json", "tokenizer_config.json", "eval_report.json", "tokenizer.json")


def config(spark: SparkSession, folder: str) -> dict:
    """The training config of an artifact set; empty where there is none."""
    path = f"{folder}/tokenizer_config.json"
    return json.loads(artifact(spark, path).first()[0]) if _exists(spark, path) else {}


def page_extracts(payloads: DataFrame) -> DataFrame:
    """``payloads(lang, title, body)`` with ``extract``: the first page's plain text of a stored answer, '' where it has none."""
    page = F.map_values(F.from_json(F.get_json_object("body", "$.query.pages"), "map<string,string>"))[0]
    return payloads.select("lang", "title", F.coalesce(F.get_json_object(page, "$.extract"), F.lit("")).alias("extract"))


def linked_titles(titles: DataFrame, links: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(en_title, lang, title) for every one of ``titles(en_title)`` and language; null where ``links(en_title, lang, title)`` has none."""
    asked = titles.crossJoin(F.broadcast(titles.sparkSession.createDataFrame([(x,) for x in languages], "lang string")))
    return asked.join(links, ["en_title", "lang"], "left").select("en_title", "lang", F.nullif("title", F.lit("")).alias("title"))


def language_links(payloads: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """(lang, title) of stored answers ``payloads(body)`` that list a page's links to other languages."""
    page = F.map_values(F.from_json(F.get_json_object("body", "$.query.pages"), "map<string,string>"))[0]
    links = F.from_json(F.get_json_object(page, "$.langlinks"), "array<struct<lang:string,`*`:string>>")
    return payloads.select(F.explode(links).alias("l")).select("l.lang", F.col("l").getField("*").alias("title")).where(F.col("lang").isin(*languages))
