"""One query for each operator, on its whole table, with comparison SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairspan.llm import collocations, decontaminate, exact_dedup, html_extract, langid, licenses, line_dedup, mixing, secrets, simhash, token_align, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with words: lines, lines that go, links of its lines to other texts, and the places of the lines that go."""
    found = line_dedup.line_matches(_table(spark, sf_dir, "documents"))
    gone = F.sort_array(F.collect_list(F.when(F.col("gone"), F.col("line"))))
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum(F.col("gone").cast("long")).alias("n_gone"), F.sum("links").alias("n_links"),
        F.sum(F.when(F.col("gone"), F.col("words")).otherwise(0)).alias("words_gone"), gone.alias("lines_gone"),
    )


@query
def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items that the document holds, with the score of the alignment."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLES["op3_exact_dedup"] = r"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(n.body) AS text_sha256 FROM n JOIN g ON n.body = g.body"""


@query
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of all documents; the digest stands for the value, which isn't shown."""
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("at").cast("long").alias("word_no"), F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "secret")


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(~toxicity.held_out(docs["doc_id"])), labels)
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.fit(pages))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    found = langid.predict(docs, model)
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


ORACLES["op9_warc"] = """WITH p AS (SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return met.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


ORACLES["op10_mixing"] = r"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, 3 * source_size AS cap, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight::DOUBLE, source NULLS LAST) AS k FROM w),
c AS (SELECT k, cap / weight::DOUBLE AS ratio, ((SELECT sum(source_size) FROM s) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / (sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM o),
l AS (SELECT level FROM c WHERE level <= ratio ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight * level) AS target FROM w, l),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
  ('0x' || substr(md5('42|' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r"""


@query
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(_table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLES["op11_phrase_collocations"] = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang,
  unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
x AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, 1 AS words, unnest(w) AS phrase FROM x
  UNION ALL SELECT lang, 2, unnest([array_to_string(w[i:i+1], ' ') FOR i IN range(1, len(w))]) FROM x WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest([array_to_string(w[i:i+2], ' ') FOR i IN range(1, len(w) - 1)]) FROM x WHERE len(w) > 2),
c AS (SELECT lang, words, phrase, count(*) AS f, string_split(phrase, ' ') AS w FROM g GROUP BY lang, words, phrase),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE words = 1 GROUP BY lang),
k AS (SELECT lang, phrase, f, unnest(range(1, words)) AS k, words, w FROM c WHERE words > 1 AND f >= 10),
s AS (SELECT k.lang, k.phrase, k.k, l.f AS l, r.f AS r, (1000000::HUGEINT * k.f * k.f) // (l.f::HUGEINT * r.f) AS score FROM k
  JOIN c AS l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1:k.k], ' ') JOIN c AS r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k.k+1:k.words], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, phrase, max(f) AS longer FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM c WHERE words = 3 AND f >= 10) GROUP BY 1, 2),
t AS (SELECT c.lang, c.phrase, c.f AS a, b.l, b.r, b.score FROM c JOIN b ON b.lang = c.lang AND b.phrase = c.phrase LEFT JOIN o ON o.lang = c.lang AND o.phrase = c.phrase
  WHERE c.words > 1 AND c.f >= 10 AND (c.words = 3 OR o.longer IS NULL OR 100 * o.longer < 50 * c.f)),
q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT q.lang, rank, phrase, a, l, r, n.n, score::BIGINT AS score FROM q JOIN n ON n.lang = q.lang WHERE rank <= 2000"""


@query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents")).drop("matches")


@query
def op13_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.cross_align(_table(spark, sf_dir, "documents"))
