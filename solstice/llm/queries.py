"""The thin ``opN_<name>`` queries: operator over its whole table, then digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from solstice.llm import byte_bpe, conversation_repair, decontamination, html_text, license_scan, packing, periodic_runs, pii, quality, url_filter
from solstice.llm.jaccard_join import jaccard_components
from solstice.llm.substring_dedup import remove_repeats
from solstice.llm.topk_search import top_k


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = quality.fit(docs, labels.filter(~held_out), label_col="quality")
    out = quality.score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.with_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=3, percent=90).select("doc_id", "n_shingles", "component_id")


#: (verdict, host, path) of the fixed url rules.
URL_RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mined from the pages outside the held-out third: the fixed rules' verdicts, else the quality label of the page's number (0: bad)."""
    pages, labels = _table(spark, sf_dir, "pages").select("page_id", "url"), _table(spark, sf_dir, "labels")
    bad = labels.select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    held_out = F.coalesce(F.crc32(F.col("page_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    mined = url_filter.mine(url_filter.labelled(pages, URL_RULES, bad).filter(~held_out))
    return url_filter.judge(pages, URL_RULES, mined)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and license notice in it."""
    return license_scan.licenses(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs))
    n = lambda k: F.size(F.filter("base_spans", lambda x: x["kind"] == pii.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[n(k) for k in pii.KINDS], F.sha2(pii.spelled(F.col("base_spans")), 256).alias("base_sha256"),
                        pii.spelled(F.col("spans")).alias("spans"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that leaked into it."""
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN).drop("text")
    out = byte_bpe.decode(ids, ranks)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")])
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("damage", F.crc32(F.concat_ws(":", *spelled).cast("binary")) % 20)
    rows = rows.withColumn("copy", F.explode(F.when(F.col("damage") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    damaged = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") != 0).alias("stays"))
    return conversation_repair.audits(damaged, present=F.col("stays"))


def _with_period(text: Column, doc_id: Column) -> Column:
    """The words of a tenth of the documents, from one of them on, repeated with a period; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = F.floor((n - a) / (g % 8 + 3)).cast("int") + 1
        unit = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, F.lit(1), a), F.slice(unit, F.lit(1), n - a)))

    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda x: x != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), repeated)[0]).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = periodic_runs.with_runs(docs.select("doc_id", _with_period(F.col("text"), F.col("doc_id")).alias("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best_run.start", "best_run.length", "best_run.period",
                        F.floor(F.col("best_run.length") * 1000 / F.col("best_run.period")).cast("long").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the tokens bind: 4,096 pieces and 4,096 squared of attention cost are the most that 4,096 tokens can hold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, length=4096, with_ids=False)
    return packing.pack(cut, packing.Limits(4096, 4096, 4096 * 4096))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_html_text": op3_html_text,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_url_filter": op5_url_filter,
    "op6_license_scan": op6_license_scan,
    "op7_pii": op7_pii,
    "op8_topk_search": op8_topk_search,
    "op9_decontamination": op9_decontamination,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_best_fit_packing": op13_best_fit_packing,
}
