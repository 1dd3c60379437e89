"""The corpus operators as queries over the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import boilerplate, bpe, codebooks, decontaminate, fixity, licenses, mixing, passages, quality, simhash, spelling, topk, urls
from .common import cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    out = topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))
    return out.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = boilerplate.drop_boilerplate(docs)
    return out.select(
        "doc_id", "source", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5")
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per removed passage, with the size and digest of what is left of its document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = passages.remove_spans(docs, passages.repeated_passages(docs)).where(F.size("removed") > 0)
    spans = out.select("doc_id", F.length("text").cast("long").alias("left_chars"), F.md5("text").alias("left_md5"), F.inline("removed"))
    return spans.select(
        "doc_id",
        F.col("start").alias("passage_start"),
        F.col("end").alias("passage_end"),
        "n_words",
        "n_units",
        F.col("kept_id").alias("kept_doc_id"),
        "kept_start",
        "left_chars",
        "left_md5",
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode_documents(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ordered = quality.order_rules(docs, quality.MORE_RULES)
    judged = quality.base_counts(docs).withColumn("base_failed", F.expr(quality.BASE_FAILED))
    # What the base rejects goes through no further rule, and what a rule rejects through none after it.
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(quality.verdict(ordered))
    return judged.withColumn("kept", kept).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = licenses.scan(docs, licenses.known_licenses(spark))
    return out.select("doc_id", "canonical_digest", "license", F.array_join("notices", ",").alias("notices"))


def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits the pages against a replica in which some records are shortened (page_id % 97 = 13) or lost (% 499 = 7)."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    short = F.when(F.col("page_id") % 97 == 13, F.expr("left(html, length(html) - 1)")).otherwise(F.col("html"))
    replica = pages.where("page_id % 499 <> 7").withColumn("html", short)
    out = fixity.audit(fixity.warc_records(pages), fixity.warc_records(replica))
    return out.select(F.col("id").alias("page_id"), "kind", "file", "offset", "length")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of urls: the number in a url is the id of the document it shows; quality 0 is bad."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    shown = pages.select("url", F.expr(r"try_cast(regexp_extract(url, r'/(\d+)', 1) as bigint)").alias("doc_id"))
    labelled = shown.join(_table(spark, sf_dir, "labels"), "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
    out = urls.judge(pages, urls.mine(labelled))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = cut(spelling.dictionary(_table(spark, sf_dir, "documents")))
    return spelling.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = codebooks.compress(_table(spark, sf_dir, "embeddings"))
    out = codes.withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {
    "op1_topk_search": op1_topk_search,
    "op2_mix_sources": op2_mix_sources,
    "op3_line_dedup": op3_line_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_merkle_fixity": op8_merkle_fixity,
    "op9_url_filter": op9_url_filter,
    "op10_simhash": op10_simhash,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_decontaminate": op13_decontaminate,
    "pipeline": corpus_pipeline.run,
}

def _codebook_sql(parts: int = codebooks.PARTS, entries: int = codebooks.ENTRIES, rounds: int = codebooks.ROUNDS) -> str:
    """All rounds, each as relations of its own; one row for each component."""
    steps = [
        rf"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({codebooks.SCALE} * x::DOUBLE)::BIGINT) AS e,
         row_number() OVER (ORDER BY vec_id, embedding) AS rid
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT rid, unnest(e) AS x, unnest(range(0, len(e))) AS i, len(e) // {parts} AS width FROM k),
v AS (SELECT rid, i // width AS part, i % width AS pos, x FROM u),
c0 AS (SELECT part, rid - 1 AS entry, pos, x FROM v WHERE rid <= {entries})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            rf"""
d{r} AS (SELECT rid, v.part, entry, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{r} c ON v.part = c.part AND v.pos = c.pos GROUP BY ALL),
r{r} AS (SELECT *, row_number() OVER (PARTITION BY rid, part ORDER BY d, entry) AS place FROM d{r}),
a{r} AS (SELECT rid, part, entry, d FROM r{r} WHERE place = 1)"""
        )
        if r < rounds:
            steps.append(
                rf"""
s{r} AS (SELECT v.part, entry, pos, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM v JOIN a{r} a ON v.rid = a.rid AND v.part = a.part GROUP BY ALL),
c{r + 1} AS (SELECT c.part, c.entry, c.pos, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x
        FROM c{r} c LEFT JOIN s{r} s ON c.part = s.part AND c.entry = s.entry AND c.pos = s.pos)"""
            )
    last = rf"""
f AS (SELECT rid, string_agg(lpad(lower(to_hex(entry)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds}) AS codebooks_sha256
FROM f JOIN k USING (rid)"""
    return ",".join([*steps, last])


#: The canonical form of a text for DuckDB; its engine needs the options of a pattern apart.
_CANON = (
    r"regexp_replace(lower({0}), '(?m)^[^\p{{L}}\p{{N}}\n]*(copyright\b[^\n]*([0-9]{{4}}|\(c\)|©)|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
)


def _canonical(text: str) -> str:
    out = _CANON.format(text)
    for a, b in licenses.SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return rf"trim(regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


def _rows(pairs) -> str:
    return ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in pairs)


ORACLES: dict[str, str] = {
    "op1_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0),
s AS (
  SELECT q.vec_id AS query_id, q.e AS query, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, query ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_line_dedup": r"""
WITH t AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS l,
                  chr(32) || chr(9) || chr(13) || chr(12) || chr(11) AS ws FROM documents),
u AS (SELECT source, unnest(list_distinct(list_filter(list_transform(l, lambda x: trim(x, ws)), lambda x: x <> ''))) AS line FROM t),
c AS (SELECT source, line, count(*) AS pages FROM u GROUP BY ALL),
h AS (SELECT source, count(*) AS host_pages FROM documents GROUP BY ALL),
b AS (SELECT c.source, list(line) AS often FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source
      WHERE pages >= 10 AND pages > host_pages * 0.02::DOUBLE GROUP BY ALL),
k AS (SELECT t.doc_id, t.source, t.text, len(list_filter(l, lambda x: trim(x, ws) <> '')) AS n_lines, len(l) AS n,
             list_filter(l, lambda x: trim(x, ws) = '' OR NOT list_contains(coalesce(often, []), trim(x, ws))) AS kept
      FROM t LEFT JOIN b ON t.source IS NOT DISTINCT FROM b.source),
o AS (SELECT *, array_to_string(kept, chr(10)) AS out FROM k)
SELECT doc_id, source, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n - len(kept), 0)::BIGINT AS n_dropped,
       length(out)::BIGINT AS kept_chars, md5(out) AS kept_md5 FROM o""",
    "op4_substring_dedup": rf"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{passages.PIECE}') AS u FROM documents),
x AS (SELECT doc_id, unnest(u) AS s, unnest(range(1, len(u) + 1)) AS i FROM t),
y AS (SELECT doc_id, i, s, sum(length(s)) OVER w AS e, len(regexp_extract_all(s, '[^\x20\x09-\x0D]+')) AS n FROM x
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
z AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c FROM y),
j AS (SELECT z.doc_id, z.e - length(z.s) AS st, min(v.e) AS e, z.c - z.n AS a, min(v.c) AS b
      FROM z JOIN z v ON z.doc_id = v.doc_id AND v.i >= z.i AND v.c >= z.c - z.n + 8 AND v.n > 0
      WHERE z.n > 0 GROUP BY z.doc_id, z.i, z.e, z.s, z.c, z.n),
k AS (SELECT j.*, trim(regexp_replace(lower(substr(text, st::BIGINT + 1, (e - st)::BIGINT)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
      FROM j JOIN t USING (doc_id)),
f AS (SELECT *, first_value(doc_id) OVER o AS kd, first_value(st) OVER o AS ks FROM k
      WINDOW o AS (PARTITION BY norm ORDER BY doc_id, st)),
g AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
      FROM f WHERE doc_id <> kd OR st <> ks),
h AS (SELECT *, sum(CASE WHEN a <= reached THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY a) AS run FROM g),
r AS (SELECT doc_id, min(st)::BIGINT AS st, max(e)::BIGINT AS e, (max(b) - min(a))::BIGINT AS n, count(*) AS m,
             arg_min(kd, a) AS kd, arg_min(ks, a)::BIGINT AS ks
      FROM h GROUP BY doc_id, run HAVING max(b) - min(a) >= 30),
l AS (SELECT r.*, text, coalesce(lag(e) OVER q, 0) AS p, lead(st) OVER q IS NULL AS final FROM r JOIN t USING (doc_id)
      WINDOW q AS (PARTITION BY doc_id ORDER BY st)),
o AS (SELECT doc_id, string_agg(substr(text, p + 1, st - p) || CASE WHEN final THEN substr(text, e + 1) ELSE '' END, '' ORDER BY st) AS left_text
      FROM l GROUP BY doc_id)
SELECT doc_id, st AS passage_start, e AS passage_end, n AS n_words, m AS n_units, kd AS kept_doc_id, ks AS kept_start,
       length(left_text)::BIGINT AS left_chars, md5(left_text) AS left_md5
FROM r JOIN o USING (doc_id)""",
    "op7_license_scan": rf"""
WITH k AS (SELECT digest, min(n) AS license FROM (
  SELECT n, sha256({_canonical('t')}) AS digest FROM (VALUES {_rows(licenses.KNOWN)}) v(n, t)
  UNION ALL SELECT * FROM (VALUES {_rows(licenses.DIGESTS)}) w(n, digest)) GROUP BY 1),
l AS (SELECT doc_id, license FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)
      JOIN k ON sha256({_canonical('x')}) = digest WHERE {_canonical('x')} <> ''),
n AS (SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM l GROUP BY 1),
d AS (SELECT doc_id, sha256({_canonical('text')}) AS canonical_digest FROM documents)
SELECT d.doc_id, canonical_digest, license, coalesce(notices, '') AS notices
FROM d LEFT JOIN k ON canonical_digest = digest LEFT JOIN n ON d.doc_id = n.doc_id""",
    "op8_merkle_fixity": r"""
WITH p AS (SELECT page_id, dense_rank() OVER (ORDER BY page_id) - 1 AS slot,
                  strlen('WARC/1.0__WARC-Type: resource__WARC-Record-ID: <urn:page:' || page_id || '>__')
                  + coalesce(strlen('WARC-Target-URI: ' || url || '__'), 0)
                  + strlen('Content-Type: text/html__Content-Length: ' || strlen(coalesce(html, '')) || '____')
                  + strlen(coalesce(html, '')) + 4 AS length FROM pages),
o AS (SELECT page_id, slot // 4096 AS file, length,
             sum(length) OVER (PARTITION BY slot // 4096 ORDER BY slot) - length AS off FROM p)
SELECT page_id, CASE WHEN page_id % 499 = 7 THEN 'missing' ELSE 'changed' END AS kind,
       file::BIGINT AS file, off::BIGINT AS "offset", length::BIGINT AS length
FROM o WHERE page_id % 499 = 7 OR page_id % 97 = 13""",
    "op6_quality_rules": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t),
k AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM g),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM k),
p AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words
      FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY doc_id),
c AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS n_letters,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_broken,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_listed
  FROM t LEFT JOIN p USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 10 * n_symbols > n_words
            OR word_chars < 3 * n_words OR word_chars > 10 * n_words OR 10 * n_letters < 8 * n_words
            OR 10 * n_dup_lines > 3 * n_lines OR 10 * n_broken > 3 * n_lines OR 10 * n_listed > 9 * n_lines) AS kept
FROM c""",
    "op12_vector_codes": _codebook_sql(),
    "op13_decontaminate": r"""
WITH t AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(range(0, greatest(0, len(w) - 10) + 1)) AS i FROM b WHERE len(w) > 0),
x AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1:i + 10], ' ') AS g FROM s),
y AS (SELECT row, n, w, unnest(range(0, len(w) - n + 1)) AS i FROM t, (SELECT DISTINCT n FROM x) WHERE len(w) >= n),
z AS (SELECT row, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM y),
m AS (SELECT row, z.n, i, item_id FROM z JOIN x ON z.g = x.g AND z.n = x.n),
h AS (SELECT row, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT row, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT row, n, i FROM m)) GROUP BY row),
o AS (SELECT row, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM m WHERE item_id IS NOT NULL) GROUP BY row)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN h USING (row) LEFT JOIN o USING (row)""",
}
