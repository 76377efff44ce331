"""Writers of tokenizer files, reports and append-only text folders."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import markup
from corpusloom.functions import text as tx


def _one_file(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").text(path)


def write_vocabulary(vocab: DataFrame, path: str, specials: tuple[str, ...] = ("<pad>", "<bos>", "<eos>", "<unk>")) -> None:
    """``{vocab_size, special_tokens, tokens: {id: token}}``: a vocabulary fits one row."""
    special = F.col("token").isin(*specials)
    entries = lambda cond, a, b: F.map_from_entries(F.array_sort(F.filter(F.collect_list(F.when(cond, F.struct(a, b))), lambda x: x.isNotNull())))
    doc = vocab.agg(F.count("*").alias("vocab_size"), entries(special, F.col("token"), F.col("id")).alias("special_tokens"), entries(F.lit(True), F.col("id").cast("string"), F.col("token")).alias("tokens"))
    _one_file(doc.select(F.to_json(F.struct("*")).alias("value")), path)


def write_merges(merges: DataFrame, path: str, flat: bool = False) -> None:
    """Merges in order of rank, as objects or, ``flat``, as ``"a b"``."""
    row = F.concat_ws(" ", "left", "right") if flat else F.struct("rank", F.array("left", "right").alias("pair"), "result")
    doc = merges.agg(F.array_sort(F.collect_list(F.struct("rank", row.alias("m")))).alias("l")).select(F.transform("l", lambda x: x["m"]).alias("merges"))
    _one_file(doc.select(F.to_json(F.struct("*")).alias("value")), path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def append_texts(texts: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    """Appends ``texts(lang, title, text)`` by language; titles already there and empty texts are skipped."""
    new = texts.where("text <> ''")
    if existing is not None:
        new = new.join(existing.select("lang", "title").distinct(), ["lang", "title"], "left_anti")
    new.write.mode("append").partitionBy("lang").parquet(path)


def snapshot(df: DataFrame, path: str, partition: str) -> DataFrame:
    """A frozen copy by partition; returns the manifest (partition, rows, hash)."""
    df.write.mode("errorifexists").partitionBy(partition).parquet(path)
    rows = df.sparkSession.read.parquet(path)
    return rows.groupBy(partition).agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)")).alias("hash"))


def training_config(stats: DataFrame, vocabulary: int, target: int, merges: int, seconds: float, alpha: float = 0.5, boosts: dict[str, float] | None = None) -> dict:
    """What a training was asked for and did, from ``stats(language, num_documents, raw_word_count, weight)``: a row for each language."""
    rows = sorted(stats.collect(), key=lambda r: r["language"])
    return {
        "target_vocab_size": target, "achieved_vocab_size": vocabulary, "languages": [r["language"] for r in rows], "alpha": alpha, "language_boosts": boosts or {}, "num_merges": merges,
        "training_seconds": round(seconds, 2), "language_stats": {r["language"]: {"num_documents": r["num_documents"], "raw_word_count": r["raw_word_count"], "weight": round(r["weight"], 4)} for r in rows},
    }


def _json_file(spark: SparkSession, value: dict, path: str) -> None:
    """``value`` as one file of that name, on any file system that Spark writes to."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    finally:
        out.close()


def write_artifacts(vocab: DataFrame, merges: DataFrame, config: dict, report: DataFrame, folder: str, specials: tuple[str, ...] = ("<pad>", "<bos>", "<eos>", "<unk>")) -> None:
    """The artifact set that is served: vocabulary, merges, config, report, and all of the tokenizer in one file.

    A vocabulary and its merges are some ten thousand rows; they are gathered to be written as named files.
    """
    spark = vocab.sparkSession
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    pairs = [[r["left"], r["right"]] for r in sorted(merges.collect(), key=lambda r: r["rank"])]
    special = {t: i for t, i in ids.items() if t in specials}
    tokens = {str(i): t for t, i in sorted(ids.items(), key=lambda x: x[1])}
    ranked = [{"rank": k, "pair": p, "result": "".join(p)} for k, p in enumerate(pairs)]
    _json_file(spark, {"vocab_size": len(ids), "special_tokens": special, "tokens": tokens}, f"{folder}/vocab.json")
    _json_file(spark, {"merges": ranked}, f"{folder}/merges.json")
    _json_file(spark, config, f"{folder}/tokenizer_config.json")
    _json_file(spark, {"per_language": {r["language"]: r.asDict() for r in report.collect()}}, f"{folder}/eval_report.json")
    _json_file(spark, {"model": {"type": "BPE", "vocab": ids, "merges": [" ".join(p) for p in pairs]}, "special_tokens": special, "replacement": "▁"}, f"{folder}/tokenizer.json")


UNITS = "runs of letters, marks and digits, and every other visible character by itself"


def page_files(pages: DataFrame) -> DataFrame:
    """(lang, slug, html, markdown, text, metadata) of ``pages(lang, title, url, html)``: what is kept of a page, the metadata as JSON."""
    md = pages.withColumn("markdown", markup.markdown(F.col("html"))).withColumn("slug", markup.slug(F.col("title")))
    meta = F.struct(
        "lang", "title", F.col("url").alias("source_url"), F.lit("markdown of the whole page").alias("variant"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"),
        F.length("markdown").alias("chars"), tx.faithful_units(F.col("markdown")).alias("faithful_units"), F.lit(UNITS).alias("unit_policy"),
    )
    return md.select("lang", "slug", "html", "markdown", F.col("markdown").alias("text"), F.to_json(meta).alias("metadata"))


def write_page_files(pages: DataFrame, folder: str) -> None:
    """The four files of each page as columns of one partitioned table."""
    page_files(pages).write.mode("overwrite").partitionBy("lang").parquet(folder)
