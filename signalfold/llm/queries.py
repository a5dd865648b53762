"""Registered queries of the subpackage, with oracle SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalfold.scale import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.langid import identify, learn

    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = learn(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_spans")


OP3_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS s FROM spot),
rep AS (SELECT s FROM win GROUP BY s HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE s IN (SELECT s FROM rep)),
word AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p FROM w),
kept AS (
  SELECT word.doc_id, count(hit.p) AS n_removed, string_agg(x, ' ' ORDER BY word.p) FILTER (hit.p IS NULL) AS t
  FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


@query("op3_substring_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.superkmers import remove_repeated_windows

    kept = remove_repeated_windows(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_token_files")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.token_files import read_token_digest, write_token_files

    path = work_dir(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return read_token_digest(spark, path)


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g0 AS (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, array_to_string(ws[i:i + 9], ' ') AS s, len(ws[i:i + 9]) AS n FROM g0),
sizes AS (SELECT DISTINCT n FROM g),
spot AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n),
win AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS s FROM spot),
m AS (SELECT win.doc_id, win.i, win.n, g.item_id FROM win JOIN g ON g.s = win.s AND g.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM
  (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.doc_id = d.doc_id LEFT JOIN item ON item.doc_id = d.doc_id
"""


@query("op6_decontaminate", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.decontaminate import digest, find_hits

    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


@query("op7_best_fit_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op9_quality_rules")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.quality_trees import fit_quality, judge_quality

    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS ws FROM documents),
spot AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[i:i + 4], ' ')) AS h FROM spot),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM w UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT w.doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(reach.r) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.doc_id = w.doc_id GROUP BY w.doc_id
"""


@query("op8_jaccard_join", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.tsearch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS j FROM documents),
t AS (SELECT doc_id, line, j, regexp_extract_all(line, '[^\s]+') AS ws FROM l),
m AS (SELECT doc_id, line, j, len(ws) AS n, array_to_string(list_transform(ws, lambda x: CASE WHEN regexp_matches(x, '[0-9]|^https?://|^www\.|^[^@]+@[^@]+\.|^(/[^/]+){2}') THEN '<*>' ELSE x END), ' ') AS k FROM t WHERE len(ws) > 0),
o AS (SELECT n, k FROM m GROUP BY n, k HAVING count(DISTINCT doc_id) >= 20),
d AS (SELECT m.doc_id, m.j, m.n, o.k IS NOT NULL AS dropped FROM m LEFT JOIN o ON o.k = m.k AND o.n = m.n),
s AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS c, 100 * coalesce(sum(n) FILTER (dropped), 0) <= 50 * sum(n) AS ok FROM d GROUP BY doc_id)
SELECT x.doc_id, coalesce(n_lines, 0) AS n_lines, CASE WHEN ok THEN c ELSE 0 END AS n_dropped,
  sha256(CASE WHEN ok AND c > 0 THEN (SELECT coalesce(string_agg(l.line, chr(10) ORDER BY l.j), '') FROM l LEFT JOIN d ON d.doc_id = l.doc_id AND d.j = l.j
    WHERE l.doc_id = x.doc_id AND NOT coalesce(d.dropped, false)) ELSE coalesce(x.text, '') END) AS text_sha256
FROM documents x LEFT JOIN s ON s.doc_id = x.doc_id
"""


@query("op2_line_dedup", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.line_templates import drop_recurring_lines

    # The SQL asks for the same masked form in 20 documents, an exact check after the merged templates.
    kept = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


@query("op4_quality_classifier")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.cotrain import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
    xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda crc, e: CASE WHEN e >= 0 THEN xor(crc, e) WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295), 4294967295) AS h
  FROM documents),
g AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, CASE WHEN len(ws) > 0 THEN (h // 10) % len(ws) END AS a, (h // 10) % 8 AS r FROM w),
x AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + r)) END]) ELSE ws END AS ws FROM g),
word AS (SELECT doc_id, n, unnest(ws) AS x, unnest(range(n)) AS i FROM x),
pair AS (SELECT u.doc_id, v.i - u.i AS q, u.i FROM word u JOIN word v ON v.doc_id = u.doc_id AND v.x = u.x AND v.i > u.i AND 4 * (v.i - u.i) <= u.n),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pair),
stretch AS (SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM island GROUP BY doc_id, q, k HAVING count(*) + q >= greatest(6, 4 * q)),
run AS (SELECT * FROM stretch z WHERE NOT EXISTS (SELECT 1 FROM stretch y WHERE y.doc_id = z.doc_id AND y.q < z.q AND y.s <= z.s AND y.s + y.l >= z.s + z.l)),
dig AS (SELECT doc_id, count(*) AS n_runs, max(struct_pack(l := l, s := -s, q := -q)) AS top, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM run),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY word.i) FILTER (gone.i IS NULL) AS t FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.i = word.i GROUP BY word.doc_id)
SELECT x.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length, CAST(-top.q AS BIGINT) AS period,
  CAST(1000 * top.l // -top.q AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256, CAST(n AS BIGINT) AS n_words
FROM x LEFT JOIN dig ON dig.doc_id = x.doc_id LEFT JOIN kept ON kept.doc_id = x.doc_id
"""


@query("op13_periodic_runs", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.periodic_runs import periodic_runs, planted_words, run_digest

    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), read_words=planted_words))


# The rules of the query contract.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


@query("op11_url_filter")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.url_models import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP12_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 10
"""


@query("op12_hard_negatives", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from signalfold.llm.cover_tree import integer_vectors, mine_hard_negatives

    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.select("vec_id", label.alias("label"), integer_vectors(F.col("embedding")).alias("vector"))
    return mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)
