"""The registered queries of the training-data operators: each applies its operator to its
whole tables and derives the result's columns from the operator's output."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelake.llm import (alignment, chat, decontaminate, embeddings, lm, packing, periodic, quality, simhash, suffixes,
                          token_counts, toxicity, urls)
from carelake.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, cut = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.held_out)
    scored = toxicity.flag(toxicity.score(docs, model), cut)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flagged")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are all pages, fetched at a time that follows from their id; all events are list entries
    about a page, dealt round by their id: errors and purchases add and remove its domain on the block list,
    clicks add the page itself, sign-ups and views add and remove its first folder on the allow list."""
    pages = table(spark, sf_dir, "pages")
    about = F.col("event_id") % pages.select(F.count(F.lit(1))).scalar()
    captures = pages.select("page_id", "url", F.timestamp_seconds(
        F.lit(1704067200) + F.col("page_id") * 7919 % 2592000).alias("fetched_at"))
    of = table(spark, sf_dir, "events").withColumn("about", about).join(
        pages.select("page_id", "url"), F.col("about") == F.col("page_id"))
    h, segs, kind = urls.host(F.col("url")), urls.segments(F.col("url")), F.col("event_type")
    entries = of.select(
        F.col("event_id").alias("entry_id"), F.col("ts").cast("timestamp").alias("effective_at"),
        F.when(kind.isin("signup", "view"), "allow").otherwise("block").alias("list_name"),
        kind.isin("error", "click", "signup").alias("adds"),
        F.when(kind.isin("error", "purchase"), F.concat(F.lit("d:"), h))
         .when(kind == "click", urls.prefix_key(h, segs, F.size(segs)))
         .otherwise(urls.prefix_key(h, segs, F.lit(1))).alias("key"))
    r = urls.evaluate(captures, entries)
    stamp = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    return r.select(F.col("id").alias("page_id"), "url", F.date_format("fetched_at", stamp).alias("fetched_at"), "host",
                    "verdict", "entry_id", F.col("list").alias("list_name"), "key",
                    F.date_format("valid_from", stamp).alias("valid_from"), F.date_format("valid_to", stamp).alias("valid_to"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.filter("items", lambda i: i != "\0")
    return r.select(F.col("id").alias("doc_id"), F.col("n_words").cast("bigint").alias("n_words"), "n_hit",
                    F.size("items").cast("bigint").alias("n_items"),
                    F.sha2(F.array_join(F.sort_array(names), ","), 256).alias("items_sha256"), "contaminated")


def op4_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = suffixes.removed(table(spark, sf_dir, "documents"), length=400)
    return r.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans",
                    F.sha2("kept", 256).alias("kept_sha256"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lm.score(table(spark, sf_dir, "documents"))
    return r.select(F.col("id").alias("doc_id"), "n_words", F.round("log_score", 5).alias("log_score"),
                    F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.held_out)
    return quality.score(docs, model).select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
    return groups.select(F.col("id").alias("doc_id"),
                         F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat.rotate(table(spark, sf_dir, "conversations"))
    ranges = F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))
    return r.withColumn("mask", F.array_join(ranges, ","))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), limit=1024).withColumnRenamed("id", "doc_id")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents repeat a period, which follows from their id, from a word that does too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    tail = docs.select("*", F.floor(crc / 10).alias("g"), F.when(crc % 10 == 0, words).alias("w")).select(
        "*", F.when(F.size("w") > 0, F.size("w")).alias("n")).select("*", (F.col("g") % F.col("n")).alias("a")).select(
        "*", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).alias("p"))
    moved = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(
        i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    r = periodic.periodic_runs(tail.select("doc_id", F.when(F.col("n") > 0, F.array_join(moved, " ")).otherwise(F.col("text")).alias("text")))
    longest = F.array_min(F.transform("runs", lambda x: F.struct(
        (-x["length"]).alias("l"), x["start"].alias("start"), x["period"].alias("period"))))
    lines = F.transform("runs", lambda x: F.concat(F.concat_ws(",", *[x[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    return r.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("bigint").alias("n_runs"), longest["start"].alias("start"),
        (-longest["l"]).alias("length"), longest["period"].alias("period"),
        F.floor(F.lit(-1000) * longest["l"] / longest["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filters, op3_decontamination, op4_suffixes, op5_lm_scoring, op6_quality, op7_simhash, op8_chat, op9_embeddings, op10_packing, op11_token_counts, op12_periodic_runs, op13_alignment, pipeline)}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op3_decontamination": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS m, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
starts AS (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT DISTINCT m FROM windows)
           WHERE len(w) >= m),
hits AS (SELECT r, i, s.m, item FROM (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS win FROM starts) s
         JOIN windows USING (m, win)),
cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + m)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT r, item FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM words LEFT JOIN cover USING (r) LEFT JOIN named USING (r)""",
    "op5_lm_scoring": f"""
WITH words AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
tokens AS (SELECT r, i, w[i] AS w1, CASE WHEN i > 1 THEN w[i - 1] || ' ' || w[i] END AS w2,
                  CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] || ' ' || w[i] END AS w3,
                  CASE WHEN i > 1 THEN w[i - 1] END AS h1, CASE WHEN i > 2 THEN w[i - 2] || ' ' || w[i - 1] END AS h2
           FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM words)),
c1 AS (SELECT w1 AS g, count(*) AS n FROM tokens GROUP BY 1), c2 AS (SELECT w2 AS g, count(*) AS n FROM tokens GROUP BY 1),
c3 AS (SELECT w3 AS g, count(*) AS n FROM tokens GROUP BY 1),
scored AS (
  SELECT r, CASE WHEN c3.n >= 2 THEN ln(c3.n / hh.n)
                 WHEN c2.n >= 2 THEN ln(c2.n / h.n) + least(i - 2, 1) * ln(0.4)
                 ELSE ln(c1.n / (SELECT count(*) FROM tokens)) + least(i - 1, 2) * ln(0.4) END AS s
  FROM tokens t JOIN c1 ON t.w1 = c1.g LEFT JOIN c2 ON t.w2 = c2.g LEFT JOIN c3 ON t.w3 = c3.g
  LEFT JOIN c1 h ON t.h1 = h.g LEFT JOIN c2 hh ON t.h2 = hh.g),
sums AS (SELECT r, sum(s) AS s FROM scored GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(coalesce(s, 0), 5) AS log_score,
       round(s / nullif(len(w), 0), 6) AS mean_log_score
FROM words LEFT JOIN sums USING (r)""",
    "op8_chat": """
WITH base AS (SELECT conv_id, turn, role, coalesce(text, '') AS said, coalesce(CAST(floor(turn / 64) AS BIGINT), -1) AS part FROM conversations),
heads AS (SELECT conv_id, min(part) AS first FROM base GROUP BY 1),
own AS (SELECT b.*, 0 AS carried, first FROM base b JOIN heads h ON b.conv_id IS NOT DISTINCT FROM h.conv_id),
t AS (SELECT * FROM own UNION ALL
      SELECT o.conv_id, turn, role, said, p.part, 1, first FROM own o JOIN (SELECT DISTINCT conv_id, part FROM own) p
      ON o.conv_id IS NOT DISTINCT FROM p.conv_id WHERE o.part = first AND p.part > first AND role = 'system'),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, part ORDER BY carried DESC, turn NULLS FIRST, role NULLS FIRST, said) AS k FROM t),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
cells AS (
  SELECT k.conv_id, perspective, part, k, said, carried, coalesce(role = perspective, false) AS mine,
         '<|' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
                      ELSE 'user name=' || coalesce(role, 'unknown') END || '|>' || chr(10) AS head
  FROM k JOIN people p ON k.conv_id IS NOT DISTINCT FROM p.conv_id),
placed AS (SELECT *, coalesce(sum(length(head) + length(said) + 9) OVER (PARTITION BY conv_id, perspective, part ORDER BY k
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS start FROM cells),
done AS (
SELECT conv_id, perspective, part, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (mine) AS INTEGER) AS n_trained,
       CAST(sum(carried) AS INTEGER) AS carried, sum(length(head) + length(said) + 9) FILTER (carried = 0) AS own_size,
       string_agg(head || said || chr(10) || '<|end|>' || chr(10), '' ORDER BY k) AS text,
       coalesce(string_agg(CAST(start AS BIGINT) || '-' || CAST(start + length(said) AS BIGINT), ',' ORDER BY k) FILTER (mine), '') AS mask
FROM placed GROUP BY conv_id, perspective, part)
SELECT * EXCLUDE (own_size), CAST(coalesce(sum(own_size) OVER (PARTITION BY conv_id, perspective ORDER BY part
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS text_offset FROM done""",
    "op2_url_filters": r"""
WITH p AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_seconds(page_id * 7919 % 2592000) AS fetched,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS segs
  FROM pages),
e AS (
  SELECT event_id AS entry_id, ts AS valid_from, CASE WHEN event_type IN ('signup', 'view') THEN 'allow' ELSE 'block' END AS list_name,
         event_type IN ('error', 'click', 'signup') AS adds,
         CASE WHEN event_type IN ('error', 'purchase') THEN 'd:' || host
              WHEN event_type = 'click' THEN 'p:' || array_to_string(list_concat([host], segs), '/')
              ELSE 'p:' || array_to_string(list_concat([host], segs[1:1]), '/') END AS key
  FROM events JOIN p ON event_id % (SELECT count(*) FROM pages) = page_id),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY list_name, key ORDER BY valid_from, entry_id) AS valid_to FROM e),
asks AS (
  SELECT page_id, fetched, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p)
  UNION ALL
  SELECT page_id, fetched, 'p:' || array_to_string(list_concat([host], segs[1:i]), '/')
  FROM (SELECT *, unnest(range(0, len(segs) + 1)) AS i FROM p)),
hits AS (
  SELECT a.page_id, v.*, row_number() OVER (PARTITION BY a.page_id ORDER BY list_name, length(v.key) DESC, v.key DESC) AS k
  FROM asks a JOIN v ON a.key = v.key AND v.valid_from <= a.fetched AND (v.valid_to IS NULL OR a.fetched < v.valid_to) WHERE adds)
SELECT p.page_id, url, strftime(fetched, '%Y-%m-%d %H:%M:%S.%f') AS fetched_at, host,
       CASE WHEN list_name IS NULL THEN 'keep' ELSE list_name END AS verdict, entry_id, list_name, key,
       strftime(valid_from, '%Y-%m-%d %H:%M:%S.%f') AS valid_from, strftime(valid_to, '%Y-%m-%d %H:%M:%S.%f') AS valid_to
FROM p LEFT JOIN hits h ON p.page_id = h.page_id AND k = 1""",
}
