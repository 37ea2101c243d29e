"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm import byte_bpe, chat_format, collocations, conversation_trie, decontaminate, exact_dedup, html_extract, language_id, ngram_join, secret_scan, substring_dedup, token_counts, toxicity
from bidweave.llm.common import read

QueryFunction = Callable[[SparkSession, str], DataFrame]

#: A conversation that every result of op6 holds beside those of the table.
EXTRA_TEXT = "\\### Assistant: </turn> ok"


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text")
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    made = chat_format.format_conversations(turns)
    back = made.select("*", chat_format.read_turns(F.col("formatted")).alias("turns"), chat_format.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["content"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"), keep="largest")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract_text(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(read(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["ord"] == secret_scan.KINDS.index(kind))).cast("bigint")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.written(F.col("base")), 256).alias("base_sha256"),
        secret_scan.written(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.conversation_trie(read(spark, sf_dir, "conversations"), graft=True)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read(spark, sf_dir, "labels")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE toks AS (
  SELECT doc_id, string_split(t, ' ') AS w FROM (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents) WHERE t <> ''
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM toks)
), sets AS (SELECT doc_id, md5(string_agg(g, '|' ORDER BY g)) AS s, count(*) AS q FROM grams GROUP BY doc_id),
nodes AS (SELECT s, min(doc_id) AS node, count(*) AS n_copies, any_value(q) AS q FROM sets GROUP BY s),
own AS (SELECT node, q, g FROM nodes JOIN grams ON doc_id = node),
likes AS (
  SELECT a.node AS x, b.node AS y FROM own a JOIN own b ON a.g = b.g AND a.node < b.node
  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.q) + any_value(b.q) - count(*)) - 1e-9
), ways AS (SELECT x, y FROM likes UNION ALL SELECT y, x FROM likes),
reach(a, b) AS (SELECT node, node FROM nodes UNION SELECT reach.a, ways.y FROM reach JOIN ways ON reach.b = ways.x),
classes AS (SELECT a AS node, min(b) AS class_id FROM reach GROUP BY a),
links AS (SELECT x AS node, count(*) AS n FROM ways GROUP BY x)
SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, CAST(coalesce(n_copies, 1) AS BIGINT) AS n_copies
FROM documents d LEFT JOIN sets USING (doc_id) LEFT JOIN nodes USING (s) LEFT JOIN classes USING (node) LEFT JOIN links USING (node)
"""

OP5_SQL = r"""
WITH norm AS (
  SELECT 0 AS kind, doc_id AS id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents
  UNION ALL
  SELECT 1, item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) FROM benchmark
), toks AS (SELECT kind, id, string_split(t, ' ') AS w FROM norm WHERE t <> ''),
items AS (SELECT id, w, least(len(w), 5) AS k FROM toks WHERE kind = 1),
grams AS (SELECT DISTINCT id AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM items)),
total AS (SELECT item_id, count(*) AS q FROM grams GROUP BY item_id),
sizes AS (SELECT DISTINCT k FROM grams),
found AS (
  SELECT DISTINCT id AS doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM toks, sizes WHERE kind = 0 AND len(w) >= k)
)
SELECT doc_id, item_id, CAST(any_value(q) AS BIGINT) AS n_shingles, CAST(count(*) AS BIGINT) AS n_found, count(*) / any_value(q) AS containment
FROM found JOIN grams USING (k, g) JOIN total USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(q) >= 0.8
"""

OP6_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), made AS (
  SELECT *, replace(replace(role, '\', '\s'), '|', '\p') AS r, replace(replace(text, '\', '\s'), '|', '\p') AS t FROM turns
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, t)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 18) AS BIGINT) AS formatted_chars
FROM made GROUP BY conv_id
"""

OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL
), own AS (SELECT c, count(*) AS n, c - c % 100 AS b FROM turns GROUP BY c),
heads AS (SELECT *, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda ch: ascii(ch)::UBIGINT)),
  lambda a, ch: list_reduce([xor(a, ch), 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT],
  lambda v, i: CASE WHEN v & 1::UBIGINT = 1 THEN xor(v >> 1::UBIGINT, 3988292384::UBIGINT) ELSE v >> 1::UBIGINT END)), 4294967295::UBIGINT) % 6 AS BIGINT) AS h FROM own),
made AS (
  SELECT heads.c, p, r, x FROM heads JOIN turns ON turns.c = heads.b WHERE p < h
  UNION ALL SELECT heads.c, p, r, x FROM heads JOIN turns ON turns.c = heads.c WHERE p >= h
), pre AS (
  SELECT c, row_number() OVER w AS d, string_agg(md5(CAST(length(r) AS VARCHAR) || ':' || r || x), '') OVER w AS k, length(x) AS chars FROM made WINDOW w AS (PARTITION BY c ORDER BY p)
  UNION ALL SELECT c, 0, '', 0 FROM own
), nodes AS (SELECT d, k, min(c) AS owner, count(*) AS n_convs, max(chars) AS chars FROM pre GROUP BY d, k),
linked AS (SELECT nodes.*, up.k AS pk FROM nodes LEFT JOIN pre up ON up.c = owner AND up.d = nodes.d - 1),
kids AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM linked WHERE d > 0 GROUP BY 1, 2),
full_nodes AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (d, k)),
sub AS (
  SELECT pre.d, pre.k, count(*) FILTER (w.n_children = 0) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
  FROM full_nodes w JOIN pre ON pre.c = w.owner AND pre.d <= w.d GROUP BY 1, 2
), ends AS (
  SELECT d, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, max(d) AS d FROM pre GROUP BY c) JOIN pre USING (c, d) GROUP BY 1, 2
)
SELECT f.owner AS conv_id, CAST(f.d AS BIGINT) AS depth, p.owner AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM full_nodes f JOIN sub USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN nodes p ON p.d = f.d - 1 AND p.k = f.pk
"""

OP13_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), runs AS (SELECT lang, list_filter(string_split_regex(p, '[\x20\x09]+'), lambda w: w <> '') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3]) AS k FROM runs))),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
split AS MATERIALIZED (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM f WHERE k > 1),
ways AS MATERIALIZED (SELECT lang, g, a, c, array_to_string(w[1:c], ' ') AS lg, array_to_string(w[c + 1:], ' ') AS rg FROM (SELECT *, unnest(range(1, k)) AS c FROM split)),
cuts AS (
  SELECT ways.*, l.f AS l, r.f AS r, CAST((1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM ways JOIN f l ON l.lang = ways.lang AND l.g = lg JOIN f r ON r.lang = ways.lang AND r.g = rg
), best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, c) = 1),
inside AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM split WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM split WHERE k = 3) GROUP BY 1, 2
), kept AS (SELECT best.* FROM best LEFT JOIN inside USING (lang, g) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, rank, g AS phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""


def queries() -> dict[str, QueryFunction]:
    found = (op1_language_id, op2_ngram_join, op3_token_counts, op4_substring_dedup, op5_decontaminate, op6_chat_format, op7_exact_dedup, op8_html_extract, op9_byte_bpe, op10_secret_scan, op11_conversation_trie, op12_toxicity, op13_collocations)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_join": OP2_SQL, "op5_decontaminate": OP5_SQL, "op6_chat_format": OP6_SQL, "op7_exact_dedup": OP7_SQL, "op11_conversation_trie": OP11_SQL, "op13_collocations": OP13_SQL}
