"""Queries of the corpus operators over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (decontaminate, digests, extract, hostgraph, langid, lengths, licenses, minhash, packing, shards, toxicity, variants,
               whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_decontaminate(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"), keep_text=False)
    n_hit = decontaminate.hit_words()
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                        decontaminate.contaminated(n_hit).alias("contaminated"))


@_query
def op2_near_dedup(spark, sf_dir):
    return minhash.near_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op3_url_filter(spark, sf_dir):
    return hostgraph.judge_urls(_table(spark, sf_dir, "pages"))


@_query
def op4_extract(spark, sf_dir):
    return extract.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


@_query
def op5_token_counts(spark, sf_dir):
    return lengths.context_table(lengths.length_histogram(_table(spark, sf_dir, "documents")))


@_query
def op6_exact_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    index = digests.DigestIndex.scratch(spark, rows=docs.count())
    found = index.append(docs)
    index.close()
    return found.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


@_query
def op7_license_scan(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scan_licenses(docs, keep_text=False)
    labels = lambda c: F.transform(c, lambda x: x["label"])
    first, last = (f(F.transform("places", lambda x: x["word"])) for f in (F.array_min, F.array_max))
    base = F.array_sort(F.array_distinct(labels("places")))
    every = F.array_sort(F.array_distinct(F.concat(labels("places"), labels(F.filter("blocks", lambda b: b["best"])))))
    part = F.coalesce(F.array_max(F.transform("blocks", lambda x: x["containment"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"), first.alias("first_word"), last.alias("last_word"),
                        F.array_join(base, ",").alias("base_labels"), F.array_join(every, ",").alias("labels"),
                        F.when(F.size("places") > 0, 1.0).otherwise(part).alias("score"))


@_query
def op8_shard(spark, sf_dir):
    dealt = shards.shard_rows(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op9_pack(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents").select("doc_id", "text"), with_ids=False)


@_query
def op10_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = langid.held_out()
    model = langid.train(docs.filter(~held_out))
    return langid.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


@_query
def op11_spelling_variants(spark, sf_dir):
    return variants.variant_groups(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op12_whitening(spark, sf_dir):
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


@_query
def op13_toxicity(spark, sf_dir):
    docs, held_out = _table(spark, sf_dir, "documents").select("doc_id", "text"), toxicity.held_out()
    model = toxicity.train(docs.filter(~held_out), _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op1_decontaminate"] = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bl AS (SELECT item, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS p FROM (SELECT item, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM bl)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS p
        FROM (SELECT doc_id, w, k, unnest(range(0, greatest(len(w) - k + 1, 0))) AS i FROM d, ks)),
occ AS (SELECT doc_id, i, pos.k, item FROM pos JOIN win ON pos.k = win.k AND pos.p = win.p),
hit AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)"""

ORACLES["op2_near_dedup"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 85 * (na.n + nb.n - common)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = d.doc_id"""

ORACLES["op6_exact_dedup"] = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
g AS (SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g"""


# crc32 by a table of 256 entries; words hold ASCII and U+00C0 to U+00FF only, of two bytes each
ORACLES["op11_spelling_variants"] = rf"""
WITH RECURSIVE tab AS (SELECT list(c ORDER BY i) AS crc FROM (
  SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
run AS (SELECT doc_id, {_LOWER.format("w")} AS w, count(*) AS k FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY ALL),
byte AS (SELECT *, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END
  FOR c IN string_split(doc_id || ':' || w, '')]) AS b FROM run),
mark AS (SELECT w, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(x AS BIGINT) FOR x IN b]),
  lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM byte, tab),
word AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
  SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, k FROM mark)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT DISTINCT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
near AS (SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM near GROUP BY word),
form AS (SELECT best.word, n_near, top, min(other) AS other FROM best JOIN near ON near.word = best.word AND near.n = top GROUP BY ALL),
own AS (SELECT word.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN other END AS form,
  CASE WHEN top >= 5 * n THEN top END AS form_n FROM word LEFT JOIN form ON form.word = word.word),
chain AS (SELECT word, word AS root, 0 AS step FROM own UNION ALL SELECT chain.word, own.form, step + 1 FROM chain JOIN own ON own.word = chain.root WHERE own.form IS NOT NULL)
SELECT own.word, form, r.root, n, n_near, form_n FROM own JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) r ON r.word = own.word"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
