"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed_dedup, langid, line_dedup, mixing, periodic_runs, pii, quality, simhash, spelling, suffix_dedup, suffix_tree, url_rules


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents),
b AS (
  SELECT coalesce(item_id::varchar, 'null') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark),
q AS (
  SELECT DISTINCT item, k, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT item, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT *, least(10, len(ws)) AS k FROM b WHERE len(ws) > 0))),
p AS (
  SELECT rid, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w
  FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM q) WHERE len(ws) >= k)),
h AS (SELECT rid, i, p.k, item FROM p JOIN q ON p.k = q.k AND p.w = q.w),
hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS pos FROM h) GROUP BY rid),
its AS (SELECT rid, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM h GROUP BY rid)
SELECT doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN its USING (rid)
"""


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_classes(_read(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::double[] AS e, list_sum(list_transform(embedding::double[], lambda x: x * x)) AS n2 FROM embeddings),
u AS (SELECT * FROM v WHERE n2 > 0 AND isfinite(n2) AND len(list_filter(e, lambda x: x IS NULL)) = 0),
l AS (
  SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid <> b.rid AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(a.n2 * b.n2) >= 0.95),
r AS (SELECT rid AS a, rid AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(v.vec_id) AS component_id FROM r JOIN v ON v.rid = r.b GROUP BY r.a),
n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0)::bigint AS n_links, c.component_id, coalesce(v.vec_id = c.component_id, c.component_id IS NULL) AS kept
FROM v JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(_read(spark, sf_dir, "documents"), remainder(7) == 2)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def remainder(n: int):
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.spans(docs, pii.fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.languages(docs, langid.fit(docs, remainder(4) != 2))
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"), remainder(5) != 0)
    scored = quality.score(docs, model).drop("text")
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_classes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents")).drop("spans")


WORD = r"[^\x20\x09-\x0D]+"


def planted_runs(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) where, for one document in ten by the crc32 of its id, the words from
    some place on repeat the first of these: what op11_periodic_runs is asked to find."""
    words, n = F.regexp_extract_all("text", F.lit(WORD), 0), F.size(F.regexp_extract_all("text", F.lit(WORD), 0))
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    held = docs.select("doc_id", "text", h.alias("h")).select("*", F.when(F.col("h") % 10 == 0, words).alias("words"), F.when(F.col("h") % 10 == 0, n).otherwise(0).alias("n"))
    g, n = F.floor(F.col("h") / 10), F.col("n")
    at = F.when(n > 0, g % n).otherwise(0).cast("int")
    period = F.lit(1) + F.floor((n - F.col("at")) / (3 + g % 8)).cast("int")
    held = held.withColumn("at", at).withColumn("period", period)
    again = F.flatten(F.array_repeat(F.slice("words", F.col("at") + 1, F.col("period")), F.ceil((n - F.col("at")) / F.col("period")).cast("int")))
    text = F.array_join(F.concat(F.slice("words", 1, F.col("at")), F.slice(again, 1, n - F.col("at"))), " ")
    return held.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(planted_runs(_read(spark, sf_dir, "documents")))
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))).alias("best")
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    listed = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"))
    length = -F.col("best.less")
    return listed.select(
        "doc_id", "n_runs", "best.start", length.alias("length"), "best.period", F.expr("(1000 * -best.less) div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )


#: SQL for crc32: a table made by its rule, then a step for each byte of UTF-8.
CRC_SQL = """t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def crc_sql(text: str) -> str:
    of_bytes = f"list_prepend(4294967295, list_transform(range(1, strlen({text}) + 1), lambda k: ('0x' || substr(hex({text}), 2 * k - 1, 2))::bigint))"
    return f"xor(list_reduce({of_bytes}, lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


OP11_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
h AS (SELECT rid, doc_id, ws, len(ws) AS n, {crc_sql("doc_id::varchar")} AS h FROM d, t),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n END AS a FROM h),
q AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM p),
w AS (SELECT rid, doc_id, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: CASE WHEN i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END) END AS ws FROM q),
g AS (SELECT rid, i, md5(array_to_string(ws[i + 1:i + 6], ' ')) AS gram FROM (SELECT rid, ws, unnest(range(len(ws) - 5)) AS i FROM w WHERE len(ws) >= 6)),
m AS (SELECT a.rid, a.i, b.i - a.i AS d FROM g a JOIN g b ON a.rid = b.rid AND a.gram = b.gram AND a.i < b.i),
k AS (SELECT rid, d, i, i - row_number() OVER (PARTITION BY rid, d ORDER BY i) AS island FROM m),
r AS (SELECT rid, start, length, min(d) AS period FROM (SELECT rid, d, min(i) AS start, count(*) + 5 + d AS length FROM k GROUP BY rid, d, island) WHERE length >= greatest(12, 2 * d) GROUP BY rid, start, length),
s AS (
  SELECT rid, count(*) AS n_runs, arg_min({{'start': start, 'length': length, 'period': period}}, (-length, start, period)) AS best,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM r GROUP BY rid),
x AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) AS i FROM r),
c AS (
  SELECT rid, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT rid, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM w) ANTI JOIN x USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0)::bigint AS n_runs, best.start::bigint AS start, best.length::bigint AS length, best.period::bigint AS period,
  (1000 * best.length // best.period)::bigint AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM w LEFT JOIN s USING (rid) LEFT JOIN c USING (rid)
"""


#: The rules of op12_url_rules, fixed by its contract.
URL_RULES = "('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')"


def op12_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {URL_RULES} AS rules(host, path, verdict)")
    return url_rules.judge_urls(_read(spark, sf_dir, "pages"), rules)


OP12_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_rules.UPPER}', '{url_rules.LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {URL_RULES}) AS rules(rule_host, rule_path, verdict)),
f AS (
  SELECT rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN f USING (rid)
"""


def planted_words(docs: DataFrame) -> DataFrame:
    """The runs of letters of docs as words (word); by the crc32 of document and run, one in 31
    has lost a code point: the variants that op13_spelling is asked to group."""
    runs = spelling.letter_runs(docs)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")).cast("binary"))
    held = runs.select("run", h.alias("h"), (h % F.length("run")).cast("int").alias("at"))
    less = F.concat(F.substring("run", F.lit(1), F.col("at")), F.substring("run", F.col("at") + 2, F.length("run")))
    return held.select(F.when(F.col("h") % 31 == 0, less).otherwise(F.col("run")).alias("word"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(planted_words(_read(spark, sf_dir, "documents"))))


OP13_SQL = f"""
WITH RECURSIVE {CRC_SQL},
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{spelling.LETTERS}]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
l AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY doc_id, run),
h AS (SELECT run, k, {crc_sql("doc_id || ':' || run")} AS h FROM l, t),
w AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS (SELECT word, sum(k)::bigint AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
d AS (SELECT word, n, place, substr(word, 1, place - 1) || substr(word, place + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM v)),
p AS (
  SELECT a.word, b.word AS other, b.n AS n_other FROM d a JOIN d b ON a.less = b.less AND a.place = b.place AND a.word <> b.word
  UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.less = v.word
  UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.less = v.word),
b AS (SELECT word, count(*) AS n_near, arg_min({{'w': other, 'n': n_other}}, (-n_other, other)) AS best FROM p GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN best.n >= 10 * v.n THEN best END AS form FROM v LEFT JOIN b USING (word)),
c AS (SELECT word, word AS root, 0 AS far FROM f UNION ALL SELECT c.word, f.form.w, far + 1 FROM c JOIN f ON c.root = f.word WHERE f.form IS NOT NULL),
e AS (SELECT word, arg_max(root, far) AS root FROM c GROUP BY word)
SELECT word, n, n_near, form.w AS form, form.n AS form_n, root FROM f JOIN e USING (word)
"""


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_embeddings": op2_embeddings,
    "op3_suffix_tree": op3_suffix_tree,
    "op4_mixing": op4_mixing,
    "op5_pii": op5_pii,
    "op6_langid": op6_langid,
    "op7_line_dedup": op7_line_dedup,
    "op8_quality": op8_quality,
    "op9_simhash": op9_simhash,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_url_rules": op12_url_rules,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_embeddings": OP2_SQL, "op11_periodic_runs": OP11_SQL, "op12_url_rules": OP12_SQL, "op13_spelling": OP13_SQL}
