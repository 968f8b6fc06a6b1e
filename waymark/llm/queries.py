"""The training-data queries that the entry module registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import ann, decontaminate, exact_search, html_text, html_training, language_id, lexical, license_scan, merkle, mixing, sharding, simhash_dedup, token_counts, warc

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), license_scan.templates(spark))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 20 == 0)).select("query_id", "rank", "vec_id", "score")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"), html_training.trained())


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


#: Target shares of the expected tokens: of low quality almost three times as much as there is, of toxic text a quarter.
TARGETS = [("high", 0.6), ("low", 0.37), ("toxic", 0.03)]


def target_shares(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TARGETS, "domain string, share double")


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", mixing.labelled_domain(F.col("quality"), F.col("toxic")).alias("domain"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents"), domain_labels(spark, sf_dir), target_shares(spark), keep="high")
    return found.drop("text_hash")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    model = language_id.train(docs.where(~held_out))
    return language_id.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op12_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_search.search(rows, rows.where(F.col("vec_id") % 50 == 0)).select("query_id", "rank", "vec_id", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


OP2_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
q AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 20 = 0)),
p AS (SELECT k, q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS best,
    row_number() OVER (PARTITION BY h, page_id) AS copy FROM p),
t AS (SELECT *, page_id IS NOT NULL AND (page_id <> best OR copy > 1) AS again,
    list_transform(range(8), lambda i: CAST('0x' || substr(x, CAST(5 * i + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((parts[CAST(i // 4 + 1 AS INTEGER)] >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN best END AS refers_to
FROM t
"""

#: Greedy longest matches step by step on the hexadecimal bytes of each distinct word.
OP9_SQL = f"""
WITH RECURSIVE vocab AS (SELECT DISTINCT hex(from_base64(piece)) AS h FROM read_csv('{token_counts.VOCABULARY}', delim=' ', header=false, quote='', escape='', columns={{'piece': 'VARCHAR', 'rank': 'BIGINT'}})),
sizes AS (SELECT DISTINCT length(h) AS l FROM vocab),
split AS (SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS ws FROM documents),
words AS (SELECT k, '20' || hex(encode(w)) AS word FROM (SELECT k, unnest(ws) AS w FROM split)),
step(word, pos, n) AS (SELECT DISTINCT word, 1, 0 FROM words
  UNION ALL SELECT s.word, CAST(s.pos + max(z.l) AS INTEGER), s.n + 1 FROM step s JOIN sizes z ON s.pos + z.l <= length(s.word) + 1
    JOIN vocab v ON v.h = substr(s.word, s.pos, z.l) GROUP BY s.word, s.pos, s.n),
ends AS (SELECT word, max(CASE WHEN pos > length(word) THEN n END) AS n FROM step GROUP BY word),
sums AS (SELECT k, sum(coalesce(n, 1)) AS n FROM words JOIN ends USING (word) GROUP BY k)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_tokens FROM split LEFT JOIN sums USING (k)
"""

#: Every window of an item's length that shares a shingle with the item; others have similarity 0.
OP8_SQL = r"""
WITH i AS (SELECT row_number() OVER () AS i, item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS ws FROM benchmark),
items AS (SELECT i, item_id, len(ws) AS n, list_transform(range(len(ws) - 4), lambda k: array_to_string(ws[k + 1 : k + 5], ' ')) AS sh FROM i WHERE len(ws) >= 5),
known AS (SELECT DISTINCT i, n, unnest(sh) AS s FROM items),
weights AS (SELECT s, CAST(greatest(1, round(1000 * ln(((SELECT count(*) FROM items) + 1) / count(*)) / ln((SELECT count(*) FROM items) + 1.0::DOUBLE))) AS BIGINT) AS w FROM known GROUP BY s),
d AS (SELECT row_number() OVER () AS d, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
docs AS (SELECT d, doc_id, len(ws) AS m, list_transform(range(len(ws) - 4), lambda k: array_to_string(ws[k + 1 : k + 5], ' ')) AS sh FROM d WHERE len(ws) >= 5),
spots AS (SELECT d, m, unnest(sh) AS s, generate_subscripts(sh, 1) AS pos FROM docs),
starts AS (SELECT DISTINCT d, i, n, unnest(range(greatest(1, pos - (n - 5)), greatest(1, least(pos, m - n + 1)) + 1)) AS start FROM spots JOIN known USING (s)),
cuts AS (SELECT d, i, start, unnest(list_distinct(sh[start : start + n - 5])) AS s FROM starts JOIN docs USING (d)),
sums AS (SELECT c.d, c.i, c.start, sum(coalesce(w, 1000)) AS a, sum(w) FILTER (WHERE k.i IS NOT NULL) AS common
  FROM cuts c LEFT JOIN weights USING (s) LEFT JOIN known k ON k.i = c.i AND k.s = c.s GROUP BY ALL),
own AS (SELECT i, sum(w) AS b FROM known JOIN weights USING (s) GROUP BY i),
found AS (SELECT d, i, max(CAST(common AS DOUBLE) / CAST(a + b - common AS DOUBLE)) AS similarity FROM sums JOIN own USING (i) GROUP BY d, i)
SELECT doc_id, item_id, max(similarity) AS similarity FROM found JOIN docs USING (d) JOIN items USING (i) WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""


#: Every document that holds a term of an item, scored whole.
OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents WHERE text IS NOT NULL),
c AS (SELECT d, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM c),
p AS (SELECT d, t, count(*) AS tf FROM (SELECT d, unnest(ts) AS t FROM c) GROUP BY d, t),
i AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
q AS (SELECT i, t, count(*) AS r FROM (SELECT i, unnest(ts) AS t FROM i) GROUP BY i, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY t),
m AS (SELECT d, doc_id, 100 - 25 + (25 * n * docs) // l AS m FROM c, s),
f AS (SELECT i, d, CAST(sum(r * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (t) JOIN p USING (t) JOIN m USING (d) GROUP BY i, d),
k AS (SELECT i, d, score, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM f JOIN c USING (d) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k JOIN i USING (i) JOIN c USING (d) WHERE rank <= 20
"""

OP12_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256 * x)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT row_number() OVER () AS k, * FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % 50 = 0)),
p AS (SELECT k, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text))) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda r, b: list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(r, b)), 4294967295))"
#: Level by level over whole trees; the trees of the sources (g = 1, ...) and, over their roots, tree 0.
OP13_SQL = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS d, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) AS g, {_leaf("text")} AS leaf,
    CASE WHEN doc_id IS NOT NULL AND {_CRC} % 5 = 0 THEN {_leaf(_LOWER)} ELSE {_leaf("text")} END AS tampered FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
t(g, lvl, idx, h, n) AS (SELECT g, 0, pos, leaf, n FROM p
  UNION ALL SELECT g, lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM t WHERE n > 1 GROUP BY g, lvl, idx // 16, n),
sub AS (SELECT g, lvl AS top, h AS subroot FROM t WHERE n = 1),
o(lvl, idx, h, n) AS (SELECT 0, g - 1, subroot, count(*) OVER () FROM sub
  UNION ALL SELECT lvl + 1, idx // 16, sha256(string_agg(h, '' ORDER BY idx)), (n + 15) // 16 FROM o WHERE n > 1 GROUP BY lvl, idx // 16, n),
top AS (SELECT h AS root FROM o WHERE n = 1),
step AS (SELECT d, t.lvl AS lvl, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx < (p.pos >> CAST(4 * t.lvl AS BIGINT))), '') AS b, coalesce(string_agg(t.h, '' ORDER BY t.idx) FILTER (WHERE t.idx > (p.pos >> CAST(4 * t.lvl AS BIGINT))), '') AS a
    FROM p JOIN t ON t.g = p.g AND t.n > 1 AND t.idx // 16 = (p.pos >> CAST(4 * t.lvl + 4 AS BIGINT)) GROUP BY d, t.lvl
  UNION ALL SELECT d, top + o.lvl, coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx < ((p.g - 1) >> CAST(4 * o.lvl AS BIGINT))), ''), coalesce(string_agg(o.h, '' ORDER BY o.idx) FILTER (WHERE o.idx > ((p.g - 1) >> CAST(4 * o.lvl AS BIGINT))), '')
    FROM p JOIN sub USING (g) JOIN o ON o.n > 1 AND o.idx // 16 = ((p.g - 1) >> CAST(4 * o.lvl + 4 AS BIGINT)) GROUP BY d, top + o.lvl),
fold(d, lvl, h) AS (SELECT d, 0, tampered FROM p UNION ALL SELECT f.d, f.lvl + 1, sha256(b || h || a) FROM fold f JOIN step s ON s.d = f.d AND s.lvl = f.lvl),
ends AS (SELECT d, arg_max(h, lvl) AS folded FROM fold GROUP BY d),
proof AS (SELECT d, string_agg(b || a, '' ORDER BY lvl) AS proof FROM step GROUP BY d)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded AS folded_root, folded = root AS verified
FROM p JOIN sub USING (g) JOIN ends USING (d) LEFT JOIN proof USING (d), top
"""


def queries() -> dict[str, Query]:
    return {"op1_license_scan": op1_license_scan, "op2_ann": op2_ann, "op3_html_text": op3_html_text, "op4_simhash_dedup": op4_simhash_dedup, "op5_warc": op5_warc, "op6_mixing": op6_mixing, "op7_sharding": op7_sharding, "op8_decontaminate": op8_decontaminate, "op9_token_counts": op9_token_counts, "op10_language_id": op10_language_id, "op11_lexical_search": op11_lexical_search, "op12_exact_search": op12_exact_search, "op13_merkle_manifest": op13_merkle_manifest}


def oracle_sql() -> dict[str, str]:
    return {"op2_ann": OP2_SQL, "op5_warc": OP5_SQL, "op8_decontaminate": OP8_SQL, "op9_token_counts": OP9_SQL, "op11_lexical_search": OP11_SQL, "op12_exact_search": OP12_SQL, "op13_merkle_manifest": OP13_SQL}
