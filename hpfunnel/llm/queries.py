"""One registered query an operator: each reads its whole table.

``REGISTRY`` maps a name to (function of (spark, sf_dir), DuckDB SQL or
None).  The queries derive fixed digest columns from what the operators
return; the operators keep their own, richer outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, exact_dedup, langid, licences, mixing, near_dedup, packing, ranked, secrets, topk,
               toxicity, trie, urls)
from .common import held_out, table, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_vocabulary(path: str | None = None) -> str:
    """A tokenizer file's text (default: the installed word_bpe_49k.json); tasks get it with their function."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.licence_summary(licences.scan_licences(docs), "doc_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are read once; everything after works on the 32-byte digests.
    digests = table(spark, sf_dir, "documents").select("doc_id", exact_dedup.text_digest(F.col("text")).alias("digest"))
    return exact_dedup.mark_copies(written(digests, "digests"))


OP2_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY norm) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept,
       sha256(norm) AS text_sha256
FROM t
"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.span_summary(secrets.scan_secrets(docs), "doc_id")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP4_SQL = f"""
WITH a AS (
  SELECT page_id,
         CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, translate(coalesce(raw, ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path
  FROM b),
d AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM c)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block'
    WHEN rule IS NOT NULL THEN 'allow'
    WHEN host LIKE '%adult%.%' OR host LIKE '%ads-%.%' OR host LIKE '%casino%.%' OR host LIKE '%-bets%.%'
      OR host LIKE '%-pills%.%' OR host LIKE '%spam%.%' THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
"""

def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The texts are read once, to count their words.
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("words"))
    mixed = mixing.mix(written(docs, "document-sizes"), size_col="words")
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(table(spark, sf_dir, "documents"), word_vocabulary())
    return packing.pack(pieces).drop("ids")


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.mark_near_copies(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs)
    return langid.identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), model) \
        .drop("text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.withColumn("held_out", held_out(F.col("doc_id"))), model).drop("text")


def trie_digest(nodes: DataFrame) -> DataFrame:
    """Nodes with ``ends`` as lower-case hex."""
    return nodes.withColumn("ends_sha256", F.lower(F.hex("ends"))).drop("ends")


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_digest(trie.conversation_trie(table(spark, sf_dir, "conversations")))


# crc32 bit by bit: each byte enters with the first of its eight steps.  A
# node is named by its turns' digests in a row; its subtree is found through
# the prefixes of the names.
OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))[1:32] AS said,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list({'s': said, 'w': words} ORDER BY turn NULLS FIRST, said) AS t FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, t, CAST(xor(list_reduce(
           list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
             lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
           lambda x, y: xor(xor(x, y) >> 1, CAST(3988292384 AS BIGINT) * (xor(x, y) & 1))),
         CAST(4294967295 AS BIGINT)) % 4 AS BIGINT) AS h
  FROM own),
convs AS (
  SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h + 1:]) AS t
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
members AS (
  SELECT conv_id, len(t) AS size, d AS depth,
         array_to_string(list_transform(t[1:d], lambda x: x.s), ' ') AS name,
         CASE WHEN d > 0 THEN array_to_string(list_transform(t[1:d - 1], lambda x: x.s), ' ') END AS parent,
         CASE WHEN d > 0 THEN t[d].w ELSE 0 END AS words
  FROM (SELECT conv_id, t, unnest(range(len(t) + 1)) AS d FROM convs)),
nodes AS (
  SELECT name, depth, any_value(parent) AS parent, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM members GROUP BY name, depth),
kids AS (SELECT parent AS name, depth - 1 AS depth, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY ALL),
facts AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, (n.n_convs - 1) * n.words AS saved
  FROM nodes n LEFT JOIN kids k USING (name, depth)),
above AS (
  SELECT array_to_string(string_split(name, ' ')[1:up], ' ') AS top, up AS top_depth, saved, CAST(n_children = 0 AS BIGINT) AS leaf
  FROM (SELECT *, unnest(range(depth + 1)) AS up FROM facts)),
sums AS (SELECT top, top_depth, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY ALL)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children,
       CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, f.ends_sha256
FROM facts f JOIN sums s ON s.top = f.name AND s.top_depth = f.depth
LEFT JOIN nodes p ON p.name = f.parent AND p.depth = f.depth - 1
"""


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked.ranked_search(docs, table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS length FROM d WHERE len(w) > 0),
p AS (
  SELECT no, doc_id, term, count(*) AS tf, any_value(10 + (90 * n * n_docs) // length) AS m
  FROM (SELECT no, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d), c GROUP BY no, doc_id, term),
df AS (SELECT term, count(*) AS df FROM p GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM df, c),
s AS (
  SELECT item_id, no, doc_id, CAST(sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * p.m))) AS BIGINT) AS score
  FROM q JOIN p USING (term) JOIN w USING (term) GROUP BY item_id, no, doc_id),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank
  FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan_benchmark(docs, table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(named.cast("binary"), 256).alias("items_sha256"), "contaminated")


OP13_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS no, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS said
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT no, n, p, array_to_string(w[p:p + n - 1], ' ') AS said
  FROM (SELECT no, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, lengths WHERE len(w) >= n)),
hits AS (SELECT no, n, p, item_id FROM places JOIN windows USING (n, said)),
hit_words AS (
  SELECT no, count(DISTINCT spot) AS n_hit FROM (SELECT no, unnest(range(p, p + n)) AS spot FROM hits) GROUP BY no),
items AS (
  SELECT no, count(item_id) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS named
  FROM (SELECT DISTINCT no, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY no)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(named, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit_words USING (no) LEFT JOIN items USING (no)
"""


REGISTRY = {
    "op1_license_scan": (op1_license_scan, None),
    "op2_exact_dedup": (op2_exact_dedup, OP2_SQL),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_url_filter": (op4_url_filter, OP4_SQL),
    "op5_mix": (op5_mix, None),
    "op6_best_fit_packing": (op6_best_fit_packing, None),
    "op7_top_k": (op7_top_k, OP7_SQL),
    "op8_near_dedup": (op8_near_dedup, None),
    "op9_language_id": (op9_language_id, None),
    "op10_toxicity": (op10_toxicity, None),
    "op11_conversation_trie": (op11_conversation_trie, OP11_SQL),
    "op12_ranked_search": (op12_ranked_search, OP12_SQL),
    "op13_benchmark_decontamination": (op13_benchmark_decontamination, OP13_SQL),
}
