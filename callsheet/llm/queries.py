"""Registered queries of the text operators, each over its whole table, with
DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callsheet.llm import decontam, jaccard, langid, licences, mixing, ngram_lm, phrases, repair, rules, sharding, substring, suffixes, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and the verdict of the rules' votes per document."""
    got = rules.quality(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return got.select("doc_id", *rules.COUNTS, "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


MIX_SQL = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST(('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 15)) AS BIGINT) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS s,
               row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1 AS k FROM sized GROUP BY source),
w AS (SELECT source, s, k, CASE k % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM src),
-- sources reach their cap in the order of size by weight; the rate is that of the first prefix it fits
o AS (SELECT *, coalesce(sum(s) OVER (ORDER BY s / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
             sum(w) OVER (ORDER BY s / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
             sum(s) OVER () AS total FROM w),
r AS (SELECT max(CASE WHEN rate * w <= 2 * s THEN rate END) AS rate FROM
      (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * held) / open AS rate,
              row_number() OVER (ORDER BY CASE WHEN (1.5::DOUBLE * total - 2.0::DOUBLE * held) / open * w <= 2 * s THEN 0 ELSE 1 END,
                                 s / w, k) AS pick FROM o) WHERE pick = 1),
t AS (SELECT source, s, least(coalesce(rate * w, 2.0::DOUBLE * s), 2.0::DOUBLE * s) AS target FROM w, r),
e AS (SELECT source, s, target, CASE WHEN s > 0 THEN floor(target / s) ELSE 0 END AS copies FROM t),
c AS (SELECT d.doc_id, d.size, e.s, e.target, e.copies, e.target - e.copies * e.s AS extra,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS own
      FROM sized d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, round(target, 6) AS target,
       CAST(size * (copies + CASE WHEN extra > 0 AND upto + upto - own <= 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c"""


@query("op2_source_mixing", MIX_SQL)
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    got = mixing.mix(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"),
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"))


DECONTAM_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
              array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS x
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS x
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT r, i, k, item_id FROM dw JOIN bw USING (k, x)),
pos AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM hit GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.s, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)"""


@query("op3_decontamination", DECONTAM_SQL)
def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and benchmark items hit per document."""
    got = decontam.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                      F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS x
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT x, min(doc_id) AS m FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM win JOIN least USING (x) WHERE doc_id > m)),
g AS (SELECT r, list(p) AS ps, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda y, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""


@query("op4_substring_dedup", SUBSTRING_SQL)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that every document loses to documents of smaller id."""
    got = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op5_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, with its size and checksum after the exchange."""
    got = sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 16)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return got.select("doc_id", size.alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _licence_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in licences.SENTENCES.items())
    tests = []
    for name, steps in licences.RULES:
        path = "p"
        for other, r in licences.RULES:
            if other != name and len(r) > len(steps) and r[:len(steps)] == steps:
                path = f"replace({path}, '/{'/'.join(r)}/', '/')"
        tests.append(f"CASE WHEN contains({path}, '/{'/'.join(steps)}/') THEN '{name}' END")
    order = "[" + ", ".join(f"'{x}'" for x in dict.fromkeys(n for n, _ in licences.RULES)) + "]"
    named = " ".join(f"WHEN regexp_matches(s, '^{licences.sentence_pattern(v)}$') THEN '{licences.SENTENCES[k]}'" for k, v in licences.NAMED.items())
    return rf"""
WITH k(id, s) AS (VALUES {known}),
d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(list_transform(string_split(
        regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)),
        lambda x: trim(lower(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))), lambda x: x <> '') AS s FROM documents),
u AS (SELECT r, CASE {named} ELSE s END AS s, i FROM (SELECT r, unnest(s) AS s, unnest(range(len(s))) AS i FROM d)),
m AS (SELECT r, string_agg(id, '/' ORDER BY i) AS ids, count(*) AS n FROM u JOIN k USING (s) GROUP BY r),
f AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n_sentences, CAST(coalesce(n, 0) AS BIGINT) AS n_known,
             coalesce(ids, '') AS sentence_ids, '/' || coalesce(ids, '') || '/' AS p FROM d LEFT JOIN m USING (r))
SELECT doc_id, n_sentences, n_known, sentence_ids,
       array_to_string(list_filter({order}, lambda x: list_contains([{", ".join(tests)}], x)), ',') AS licences
FROM f"""


@query("op6_licence_scan", _licence_sql())
def licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences and matching licences per document."""
    got = licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_sentences", F.size("sentence_ids").cast("long").alias("n_known"),
                      F.array_join("sentence_ids", "/").alias("sentence_ids"), F.array_join("licences", ",").alias("licences"))


@query("op7_quality_classifier")
def quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, its language's threshold and the verdict per document."""
    got = ngram_lm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select(F.col("id").alias("doc_id"), "lang", "trusted", F.round(F.exp("log_perplexity"), 4).alias("perplexity"),
                      F.round(F.exp("threshold"), 4).alias("threshold"), "kept")


JACCARD_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS t FROM d),
-- documents of one set are one class; only one stands for it
c AS (SELECT list_sort(t) AS t, min(doc_id) AS c, len(any_value(t)) AS n FROM s WHERE len(t) > 0 GROUP BY 1),
-- of two linked sets, each holds at least 90% of the other: they share one of the first tenth (and one) of the tokens in any order
p AS (SELECT c, n, unnest(t[1:n - (9 * n + 9) // 10 + 1]) AS x FROM c),
k AS (SELECT DISTINCT a.c AS a, b.c AS b FROM p a JOIN p b ON a.x = b.x AND a.c < b.c AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)),
l AS (SELECT a, b FROM (SELECT k.a, k.b, len(list_intersect(x.t, y.t)) AS i, x.n + y.n AS n
      FROM k JOIN c x ON x.c = k.a JOIN c y ON y.c = k.b) WHERE 100 * i >= 90 * (n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT a, min(b) AS component FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.t) AS BIGINT) AS n_shingles, coalesce(m.component, s.doc_id) AS component_id
FROM s LEFT JOIN c ON len(s.t) > 0 AND list_sort(s.t) = c.t LEFT JOIN m ON m.a = c.c"""


@query("op8_jaccard_join", JACCARD_SQL)
def jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and near-duplicate component of every document."""
    got = jaccard.similar(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


@query("op9_toxicity")
def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; labels are learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), learn=~toxicity.held_out(F.col("doc_id")))
    got = toxicity.score(docs, model)
    return got.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the held-out fold is not learned from."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, learn=~langid.held_out(F.col("doc_id")))
    got = langid.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


PHRASE_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                  'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
      FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ')
             JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, f, array_to_string(w[j:j + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS j FROM
      (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
o AS (SELECT lang, phrase, max(f) AS longer FROM i GROUP BY ALL),
z AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase COLLATE "C") AS rank
      FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN total ON total.lang = z.lang WHERE rank <= 2000"""


@query("op11_collocations", PHRASE_SQL)
def collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


REPAIR_SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) AS x(i))),
conv AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
r AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             list_concat([4294967295::UBIGINT], list_transform(string_split(coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' ||
             coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::UBIGINT)) AS b
      FROM conversations c JOIN conv ON c.conv_id IS NOT DISTINCT FROM conv.conv_id),
h AS (SELECT g, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[CAST(xor(c, x) % 256 AS BIGINT) + 1])), 4294967295::UBIGINT) % 20 AS how FROM r, tab),
d AS (SELECT g, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
             CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE WHEN how = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE how > 0),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
             row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
             regexp_matches(text, '[^ 	-
]') AS filled, regexp_matches(text, '[.!?][ 	-
]*$') AS whole FROM d),
o AS MATERIALIZED (SELECT g, i, turn, role, text, role[1] AS ini, CASE WHEN NOT filled THEN 1 WHEN nth > 1 THEN 2 WHEN NOT whole THEN 3 ELSE 0 END AS fault,
             lag(role[1]) OVER (PARTITION BY g ORDER BY i) AS last FROM f),
m AS (SELECT conv.g, conv_id, count(o.i) AS n,
             CASE WHEN max(turn) IS NULL THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
             count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
             count(*) FILTER (last IS NOT NULL AND last || ini NOT IN ('su', 'ua', 'au')) AS illegal
      FROM conv LEFT JOIN o ON o.g = conv.g GROUP BY conv.g, conv_id),
-- costs to go before row i, by state: nothing yet, after s, after u, after a
back AS (SELECT g, n + 1 AS i, [0, 10, 5, 0] AS w FROM m
  UNION ALL
  SELECT g, i, [least(b0, 5 + u), least(b1, 5 + u), u, a] FROM (SELECT g, i, b0, b1, least(b2, 5 + b3) AS u, least(b3, 5 + b2) AS a FROM (
    SELECT o.g, o.i, least(2 + w[1], x + 1 + w[3], CASE ini WHEN 's' THEN x + w[2] WHEN 'u' THEN x + w[3] END) AS b0,
           least(2 + w[2], x + 1 + w[3], CASE ini WHEN 'u' THEN x + w[3] END) AS b1, least(2 + w[3], x + 1 + w[4], CASE ini WHEN 'a' THEN x + w[4] END) AS b2,
           least(2 + w[4], x + 1 + w[3], CASE ini WHEN 'u' THEN x + w[3] END) AS b3
    FROM back JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000 END AS x FROM o) AS o ON o.g = back.g AND o.i = back.i - 1))),
here AS MATERIALIZED (SELECT b.g, b.i, b.w, a.w AS after, o.role, o.text, o.ini, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 1000 END AS x
          FROM back b LEFT JOIN o ON o.g = b.g AND o.i = b.i LEFT JOIN back a ON a.g = b.g AND a.i = b.i + 1),
walk AS (SELECT g, 1::BIGINT AS i, 0 AS s, '' AS audit, []::VARCHAR[] AS kept, 0 AS steps FROM m
  UNION ALL
  SELECT g, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN keep ELSE next END, audit || e,
         CASE e WHEN 'D' THEN kept WHEN 'K' THEN list_append(kept, role || ':' || text)
                ELSE list_append(kept, CASE next WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END) END, steps + 1
  FROM (SELECT *, CASE WHEN 2 + after[s + 1] = w[s + 1] THEN 'D' WHEN 5 + w[next + 1] = w[s + 1] THEN 'I' WHEN x + after[keep + 1] = w[s + 1] THEN 'K' ELSE 'R' END AS e
        FROM (SELECT walk.*, w, after, role, text, x, CASE s WHEN 2 THEN 3 ELSE 2 END AS next,
                     CASE WHEN ini = 's' AND s = 0 THEN 1 WHEN ini = 'u' AND s <> 2 THEN 2 WHEN ini = 'a' AND s = 2 THEN 3 END AS keep
              FROM walk JOIN here ON here.g = walk.g AND here.i = walk.i WHERE after IS NOT NULL OR w[s + 1] > 0))),
done AS (SELECT g, audit, kept FROM walk QUALIFY row_number() OVER (PARTITION BY g ORDER BY steps DESC) = 1)
SELECT conv_id, CAST(gaps AS BIGINT) AS gaps, blank, duplicate, truncated, illegal, CAST(back.w[1] AS BIGINT) AS cost, audit,
       sha256(array_to_string(kept, chr(10))) AS repaired_sha256
FROM m JOIN done ON done.g = m.g JOIN back ON back.g = m.g AND back.i = 1"""


@query("op12_conversation_repair", REPAIR_SQL)
def conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation and its cheapest repair."""
    return repair.summary(repair.damaged(table(spark, sf_dir, "conversations")))


SUFFIX_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(doc_id, 9223372036854775807) AS id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- 512 places at a time, as a place in a long text is slow to reach
cut AS (SELECT r, id, n, j, substr(h, 1024 * j + 1, 1122) AS s FROM
        (SELECT r, id, h, len(h) // 2 AS n, unnest(range(0, (len(h) // 2 + 511) // 512)) AS j FROM d)),
win AS (SELECT r, id, 512 * j + k AS i, substr(s, 2 * k - 1, 100) AS x FROM (SELECT *, unnest(range(1, least(512, n - 49 - 512 * j) + 1)) AS k FROM cut)),
least AS (SELECT x, min(id) AS m FROM win GROUP BY x HAVING min(id) < max(id)),
lost AS (SELECT r, i FROM win JOIN least USING (x) WHERE id > m),
pos AS (SELECT r, 512 * j + k AS p, substr(s, 2 * k - 1, 2) AS b FROM
        (SELECT *, unnest(range(1, least(512, n - 512 * j) + 1)) AS k FROM cut WHERE r IN (SELECT r FROM lost))),
cover AS (SELECT pos.r, p, b, coalesce(max(i) OVER (PARTITION BY pos.r ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) > 0, false) AS gone
          FROM pos LEFT JOIN lost ON lost.r = pos.r AND i = p),
edge AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS begins FROM cover),
g AS (SELECT r, count(*) FILTER (gone) AS n, count(*) FILTER (begins) AS spans, string_agg(b, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edge GROUP BY r)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN g USING (r)"""


@query("op13_suffix_dedup", SUFFIX_SQL)
def suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that every document loses to documents of smaller id."""
    got = suffixes.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    return got.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept_bytes", 256).alias("kept_sha256"))
