"""The operators as named queries over the supplied tables, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import crosstok, language, quality, toxicity
from .frames import stored, table
from .htmltext import extract_text
from .leaks import leaks
from .lmscore import cross_entropy_difference
from .nearcopies import near_copies
from .nearest import nearest
from .packing import pack
from .periodic import mark_runs
from .repeats import cut_repeats
from .urls import Rule, judge

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each piece of each document in a sequence of 2048 tokens."""
    return pack(table(spark, folder, "documents"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit(docs)).select("doc_id", "lang", "language", "confidence", "accepted")


def op3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest vectors of every hundredth vector, among all."""
    return nearest(table(spark, folder, "embeddings"), lambda key: key % 100 == 0)


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return extract_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Words left in each document once passages of 35 words that occur twice are cut."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return cut_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Cross-entropy difference of every document; the target is documents labelled good and not toxic."""
    labels = table(spark, folder, "labels").filter("quality = 1 and toxic = 0")
    return cross_entropy_difference(table(spark, folder, "documents"), labels)


URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's url."""
    return judge(table(spark, folder, "pages").select("page_id", "url"), URL_RULES).drop("url")


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """Component of near copies of each document."""
    return near_copies(table(spark, folder, "documents")).drop("text_key")


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, folder, "documents")
    rated = quality.rate(docs, quality.fit(docs, table(spark, folder, "labels")))
    return rated.select("doc_id", "source", "lang", "text_quality", "site_quality", "quality", "good")


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, and which."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """How two tokenizers' tokens of every document align, and how common its linked pairs of ids are."""
    import public_tokenizers

    docs = table(spark, folder, "documents").select("doc_id", "text")
    aligned = crosstok.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_groups") == 0, "").otherwise(F.sha2("groups", 256))
    kept = stored(aligned.select("doc_id", "block", "n_a", "n_b", "n_groups", "n_links", "pairs", digest.alias("groups_sha256")))
    return crosstok.weigh(kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _looped(docs: DataFrame) -> DataFrame:
    """Texts of ``doc_id`` and ``text``, of which those with a checksum that ends in 0 repeat a stretch of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    made = docs.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, words))
    made = made.withColumn("n", F.size("words")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    made = made.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    looped = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1), lambda i: F.element_at("words", (place(i) + 1).cast("int")))
    return made.select("doc_id", F.when(F.col("n") > 0, F.array_join(looped, " ")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document."""
    found = mark_runs(_looped(table(spark, folder, "documents").select("doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))
    longest = F.array_min(order)
    found = found.withColumn("longest", longest)
    length = -F.col("longest.less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"), length.alias("length"),
        F.col("longest.period").alias("period"), F.floor(1000 * length / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document; labels of a third of the ids are held out."""
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    docs = table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, folder, "labels").filter(third != 1))
    return toxicity.score(docs, model).select("doc_id", (third == 1).alias("held_out"), "score", "predicted")


NEAREST = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND vec_id IS NOT NULL),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(
           list_prepend(0.0::DOUBLE, list_transform(range(1, len(c.e) + 1), lambda i: (q.e[i] - c.e[i]) * (q.e[i] - c.e[i]))),
           lambda s, x: s + x)) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

SUBSTRING_DEDUP = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
starts AS (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS p FROM d),
windows AS (SELECT r, p, md5(array_to_string(ws[p:p+34], ' ')) AS h FROM starts),
twice AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT r, p + o AS q
  FROM (SELECT r, p FROM windows SEMI JOIN twice USING (h)), range(35) AS t(o)),
words AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM d),
kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY q) AS k
  FROM words ANTI JOIN covered USING (r, q) GROUP BY r)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x20\x09-\x0D]+'), []) AS ws
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[p:p+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
  WHERE 100 * shared >= 75 * (a.n + b.n - shared)),
reach(x, y) AS (
  SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id,
       d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON least.x = d.doc_id
"""

QUERIES: dict[str, Query] = {f.__name__: f for f in (
        op1_packing, op2_language, op3_nearest, op4_main_text, op5_substring_dedup,
        op6_lm_score, op7_url_filter, op8_near_duplicates,
        op9_quality, op10_decontamination,
        op11_alignment, op12_periodic_runs, op13_toxicity,
    )}

ORACLES: dict[str, str] = {
    "op3_nearest": NEAREST,
    "op5_substring_dedup": SUBSTRING_DEDUP,
    "op8_near_duplicates": NEAR_DUPLICATES,
}
