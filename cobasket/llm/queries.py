"""The queries of this package over the standard tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cobasket.llm import chat, decontam, langid, mixing, pii, prefixes, quality, simhash, spelling, suffix, tokens, topk, warc
from cobasket.llm.common import table
from cobasket.staging import stage

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record of a sharded archive, as read back from it."""
    path = warc.new_archive_path(spark)
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_archive(spark, path).select(
        F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to",
    )


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: what the rules find, and all spans."""
    docs = table(spark, sf_dir, "documents")
    found = pii.report(docs, pii.train(docs))
    return found.select("doc_id", *[f"n_{kind}" for kind in pii.KINDS], F.sha2("base", 256).alias("base_sha256"), "spans")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of weights 1, 2, 3 takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document under a public vocabulary."""
    return tokens.count_pieces(table(spark, sf_dir, "documents"), tokens.read_pieces(TOKENIZER))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to passages of 50 bytes that start in earlier ones."""
    found = suffix.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of benchmark items."""
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated")


def op8_top_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best inner products of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of clean, class and decision for every document."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their more frequent forms one edit apart."""
    found = spelling.group_variants(table(spark, sf_dir, "documents"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that tries to speak in marks, formatted and read back."""
    said = F.when(F.col("id") == 0, F.lit("user")).otherwise("assistant")
    awkward = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), said.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(awkward)
    made = stage(chat.format_chats(turns, chat.text_part(F.col("text"))), "chats")
    back = made.select("conv_id", "formatted", chat.parse(F.col("formatted")).alias("turns"), chat.masked(F.col("formatted"), F.col("loss")).alias("said"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"),
        F.length("said").cast("long").alias("loss_chars"), F.sha2("said", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct beginnings of conversations that branch off a common one."""
    return prefixes.trie(prefixes.branched(prefixes.conversations(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Query] = {
    f.__name__: f for f in (
        op1_warc_archive, op2_personal_data, op3_source_mix, op4_token_counts, op5_simhash_groups, op6_repeated_passages, op7_decontaminate, op8_top_vectors, op9_quality, op10_language,
        op11_spelling_variants, op12_chat_format, op13_prefix_trie,
    )
}

#: A table ``crc(t)`` for the unsigned CRC-32 of bytes ``b``, and the expression.
_CRC_TABLE = """crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), b) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b))"""
_CRC = """xor(list_reduce(list_transform(range(octet_length(b)), lambda i: ('0x' || hex(b)[2 * i + 1:2 * i + 2])::BIGINT),
  lambda a, x: xor(a >> 8, t[xor(a, x) % 256 + 1]), 4294967295), 4294967295)"""

TWINS: dict[str, str] = {
    "op1_warc_archive": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d GROUP BY h)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (
         list_sum(list_transform(range(5), lambda j: substr(bits, (i * 5 + j + 1)::INT, 1)::INT * (16 >> j::INT))))::INT, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, payload_bytes, h, first, unhex(h)::BIT::VARCHAR AS bits FROM d JOIN f USING (h))""",
    "op6_repeated_passages": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
l AS (SELECT doc_id, b, octet_length(b) AS n FROM d),
w AS (SELECT doc_id, unnest(range(1, n - 48)) AS p, unnest(list_transform(range(1, n - 48), lambda i: b[i:i + 49])) AS s FROM l WHERE n >= 50),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
hit AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM w JOIN f USING (s) WHERE first < doc_id),
run AS (SELECT doc_id, p, sum((before IS NULL OR p > before + 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM hit),
span AS (SELECT doc_id, min(p) AS start, max(p) + 50 AS stop FROM run GROUP BY doc_id, g),
piece AS (SELECT doc_id, start, stop, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 1) AS upto FROM span),
kept AS (SELECT doc_id, sum(stop - start)::BIGINT AS n_removed, count(*) AS n_spans, max(stop) AS tail,
                string_agg(CASE WHEN start > upto THEN hex(b[upto:start - 1]) ELSE '' END, '' ORDER BY start) AS k FROM piece JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(k, '') || CASE WHEN coalesce(tail, 1) <= n THEN hex(b[coalesce(tail, 1):n]) ELSE '' END)) AS kept_sha256
FROM l LEFT JOIN kept USING (doc_id)""",
    "op7_decontaminate": r"""
WITH dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS gram
        FROM iw, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
       FROM dw, sizes, unnest(range(1, len(ws) - n + 2)) u(i)),
occ AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
    "op8_top_vectors": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, r.vec_id, list_sum(list_transform(list_zip(q.e, r.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op11_spelling_variants": r"""
WITH """ + _CRC_TABLE + r""",
run AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents) WHERE length(w) >= 6 GROUP BY 1, 2),
hashed AS (SELECT w, n, """ + _CRC + r""" AS h
           FROM (SELECT *, encode(coalesce(doc_id::VARCHAR, '') || ':' || w) AS b FROM run), crc),
word AS (SELECT w, sum(n)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS w, n FROM hashed)
         WHERE length(w) >= 6 GROUP BY 1 HAVING sum(n) >= 5),
less AS (SELECT w, i, left(w, i) || substr(w, i + 2) AS v FROM word, unnest(range(length(w))) u(i)),
cut AS (SELECT DISTINCT l.w AS a, m.w AS b FROM less l JOIN word m ON l.v = m.w),
near AS (SELECT a AS w, b AS o FROM cut UNION ALL SELECT b, a FROM cut
         UNION ALL SELECT DISTINCT l.w, m.w FROM less l JOIN less m ON l.v = m.v AND l.i = m.i AND l.w <> m.w),
best AS (SELECT near.w, count(*) AS n_near, arg_min(struct_pack(o, m := word.n), struct_pack(m := -word.n, o)) AS top FROM near JOIN word ON word.w = o GROUP BY 1),
form AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN top.m >= 5 * n THEN top.o END AS form, CASE WHEN top.m >= 5 * n THEN top.m END AS form_n FROM word LEFT JOIN best USING (w)),
chain AS (WITH RECURSIVE c(w, r, next) AS (SELECT w, w, form FROM form UNION ALL SELECT c.w, c.next, form.form FROM c JOIN form ON form.w = c.next)
          SELECT w, r FROM c WHERE next IS NULL)
SELECT w AS word, form, r AS root, n, n_near, form_n FROM form JOIN chain USING (w)""",
    "op12_chat_format": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, t, ['user', 'assistant'][t + 1], '</s>[INST] ok [/INST]' FROM range(2) r(t)),
-- A mark is longer by one backslash, and so is a backslash.
m AS (SELECT *, length(regexp_replace(role || chr(0) || text, '\\|<s>|</s>|<\|(turn|says|end|image|audio|document|im_start|im_end|endoftext)\|>|\[/?INST\]|<</?SYS>>', '\0+', 'g')) - 1 AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       (7 + sum(n + 23))::BIGINT AS formatted_chars
FROM m GROUP BY conv_id""",
    "op13_prefix_trie": r"""
WITH """ + _CRC_TABLE + r""",
own AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
hashed AS (SELECT *, """ + _CRC + r""" % 4 AS h FROM (SELECT *, encode(conv_id::VARCHAR) AS b FROM own), crc),
conv AS (SELECT c.conv_id, coalesce(base.ts[1:h], []) || c.ts[h + 1:] AS ts FROM hashed c LEFT JOIN own base ON base.conv_id = c.conv_id - c.conv_id % 20),
node AS (SELECT ts[1:d] AS p, d, min(conv_id) AS least, count(*) AS n_convs,
                coalesce(string_agg(CASE WHEN len(ts) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
         FROM conv, unnest(range(len(ts) + 1)) u(d) GROUP BY 1, 2),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN len(regexp_extract_all(node.p[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM node LEFT JOIN kids USING (p)),
below AS (SELECT p[1:k] AS p, sum((n_children = 0)::INT)::BIGINT AS n_leaves, sum((n_convs - 1) * w)::BIGINT AS saved_tokens
          FROM full_node, unnest(range(d + 1)) u(k) GROUP BY 1)
SELECT x.least AS conv_id, x.d AS depth, up.least AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM full_node x JOIN below USING (p) LEFT JOIN node up ON x.d > 0 AND up.p = x.p[1:x.d - 1]""",
}
