"""Standard tables written in the formats of the readers, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cobasket.operators import decisions
from cobasket.operators import graph as g
from cobasket.plans import inputs as i
from cobasket.plans.graph_queries import order_edges
from cobasket.plans.registry import query
from cobasket.sources import quarantine, readers, writers
from cobasket.staging import folder, stage


def _graph_files(spark, sf_dir):
    nodes, edges = folder(spark, "nodes-csv"), folder(spark, "edges-csv")
    i.parts(spark, sf_dir).select(
        F.col("p_name").alias("name"), F.lit("ingredient").alias("node_type"), F.col("p_partkey").alias("node_id")
    ).write.csv(nodes, header=True)
    i.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("id_1"), F.col("l_suppkey").alias("id_2"), F.col("l_discount").alias("score"),
        F.when(F.col("l_linenumber") == 1, "ingr-ingr").otherwise("ingr-fcomp").alias("edge_type"),
    ).write.csv(edges, header=True)
    return readers.read_graph_csv(spark, nodes, edges)


@query("graph_csv_nodes", "SELECT p_partkey::INT AS node_id, p_name AS name, 'ingredient' AS node_type FROM part")
def graph_csv_nodes(spark, sf_dir):
    return _graph_files(spark, sf_dir)[0]


@query("graph_csv_edges", """
SELECT l_partkey::INT AS id_1, l_suppkey::INT AS id_2, l_discount AS score,
       CASE WHEN l_linenumber = 1 THEN 'ingr-ingr' ELSE 'ingr-fcomp' END AS edge_type FROM lineitem""")
def graph_csv_edges(spark, sf_dir):
    return _graph_files(spark, sf_dir)[1]


def _order_baskets(spark, sf_dir):
    """``(o_orderkey, o_orderpriority, items)``; an order holds a handful of lines."""
    lines = i.order_lines(spark, sf_dir).groupBy("basket_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]).alias("items")
    )
    orders = i.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return orders.join(lines, F.col("o_orderkey") == F.col("basket_id"))


@query("basket_jsonl", """
SELECT l_orderkey::VARCHAR AS id, trim(o_orderpriority) AS title, 'en' AS lang,
       string_agg(p_name, '|' ORDER BY l_linenumber, p_name) AS phrases, '' AS url
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY l_orderkey, o_orderpriority""")
def basket_jsonl(spark, sf_dir):
    path = folder(spark, "baskets-jsonl")
    _order_baskets(spark, sf_dir).select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit(" "), "o_orderpriority").alias("title"), F.col("items").alias("ingredients"),
    ).write.json(path)
    return readers.read_basket_jsonl(spark, [path]).select("id", "title", "lang", F.array_join("phrases", "|").alias("phrases"), "url")


@query("record_dumps", """
SELECT form, s_name AS title, 'anvil ' || s_nationkey || '|rod' AS lines, 'https://s/' || s_suppkey AS url
FROM supplier, (SELECT unnest(['jsonl', 'json', 'csv']) AS form)""")
def record_dumps(spark, sf_dir):
    """Suppliers as records in the three forms of a dump, under column names of their own."""
    rows = i.table(spark, sf_dir, "supplier").select(
        F.col("s_name").alias("nom"), F.array(F.concat(F.lit("anvil "), "s_nationkey"), F.lit("rod")).alias("liste"),
        F.concat(F.lit("https://s/"), "s_suppkey").alias("lien"), "s_nationkey",
    )
    found = None
    for form in ("jsonl", "json", "csv"):
        path = f"{folder(spark, 'records')}.{form}"
        plain = rows.drop("s_nationkey")
        if form == "jsonl":
            plain.write.json(path)
        elif form == "json":
            # One array for the suppliers of a nation, each in a file of its own.
            arrays = rows.groupBy("s_nationkey").agg(F.to_json(F.collect_list(F.struct("nom", "liste", "lien"))).alias("value"))
            arrays.repartition("s_nationkey").write.partitionBy("s_nationkey").text(path)
        else:
            plain.withColumn("liste", F.to_json("liste")).write.csv(path, header=True, escape='"')
        part = readers.read_records(spark, path, "nom", "liste", "lien")
        part = part.select(F.lit(form).alias("form"), "title", F.array_join("lines", "|").alias("lines"), "url")
        found = part if found is None else found.unionByName(part)
    return found


@query("wide_csv", """
SELECT p_name AS title, 'https://p/' || p_partkey AS url, 'caf' || chr(233) || '|' || lower(p_type) AS phrases FROM part""")
def wide_csv(spark, sf_dir):
    """Parts with a list literal in a cell, one of its entries with an escape that JSON does not know."""
    path = folder(spark, "wide-csv")
    cell = F.concat(F.lit("['caf\\xe9', '"), F.lower("p_type"), F.lit("']"))
    i.parts(spark, sf_dir).select(
        F.col("p_name").alias("title"), F.concat(F.lit("p/"), "p_partkey").alias("link"), cell.alias("NER"), F.lit("a\nb").alias("directions")
    ).write.csv(path, header=True, escape='"')
    return readers.read_wide_csv(spark, path).select("title", F.regexp_replace("url", "^https://p/", "https://p/").alias("url"), F.array_join("phrases", "|").alias("phrases"))


@query("long_csv", """
SELECT 'https://o/' || l_orderkey AS url, o_orderpriority AS title, p_name AS line
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey""")
def long_csv(spark, sf_dir):
    path = folder(spark, "long-csv")
    lines = i.order_lines(spark, sf_dir).join(i.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("basket_id"), "o_orderpriority"), "basket_id")
    lines.select(
        F.concat(F.lit("https://o/"), "basket_id").alias("url"), F.col("o_orderpriority").alias("recette"), F.col("item").alias("ingredients")
    ).write.csv(path, header=True, escape='"')
    heads, rows = readers.read_long_csv(spark, path, multi_line=False)
    return rows.join(heads.select("basket_id", "title", "url"), "basket_id").select("url", "title", "line")


@query("affinity_export", f"""
WITH {i.ORDER_EDGES_SQL},
its AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT p_name AS item FROM part)),
pl AS (SELECT a.idx, b.idx AS pid, score, row_number() OVER (PARTITION BY e.item ORDER BY score DESC, b.idx) - 1 AS place
       FROM e JOIN its a ON a.item = e.item JOIN its b ON b.item = e.partner)
SELECT idx, place // 7 AS part, place % 7 AS pos, pid, score FROM pl""")
def affinity_export(spark, sf_dir):
    """The adjacency lists of the graph in short parts."""
    lists = writers.adjacency(i.part_items(spark, sf_dir), order_edges(spark, sf_dir), part_size=7)
    return lists.select("idx", F.col("part").cast("long"), F.posexplode("partners").alias("pos", "p")).select(
        "idx", "part", F.col("pos").cast("long"), F.col("p")[0].alias("pid"), F.col("p")[1].cast("int").alias("score")
    )


@query("bad_rows", """
WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 97 = 0 THEN 'malformed' WHEN l_orderkey % 89 = 0 AND l_linenumber = 1 THEN 'id_1,score'
                  WHEN l_orderkey % 89 = 0 THEN 'score' END AS reason, l_discount FROM lineitem)
SELECT 'edges' AS form, coalesce(reason, 'good') AS reason, count(*) AS n, coalesce(round(sum(l_discount) FILTER (reason IS NULL), 6), 0) AS total FROM l GROUP BY 2
UNION ALL SELECT 'baskets', CASE WHEN o_orderkey % 31 = 0 THEN 'malformed' ELSE 'good' END, count(*), 0 FROM orders GROUP BY 2""")
def bad_rows(spark, sf_dir):
    """Edge and basket files with planted bad lines: what is read, and what is set aside for which reason."""
    edges, baskets = folder(spark, "edges-csv"), folder(spark, "baskets-jsonl")
    key, first = F.col("l_orderkey"), F.col("l_linenumber") == 1
    cells = [
        F.when((key % 89 == 0) & first, F.lit("x7")).otherwise(F.col("l_partkey").cast("string")), F.col("l_suppkey").cast("string"),
        F.when(key % 89 == 0, F.lit("n/a")).otherwise(F.col("l_discount").cast("string")), F.lit("ingr-ingr"), F.when(key % 97 == 0, F.lit("more")),
    ]
    # One column whose name is the header, so that lines are written as they are.
    lines = i.table(spark, sf_dir, "lineitem").select(F.concat_ws(",", *cells).alias("id_1,id_2,score,edge_type"))
    lines.write.csv(edges, header=True, sep="\u0001")
    record = F.to_json(F.struct(F.col("o_orderkey").cast("string").alias("id"), F.lit("t").alias("title"), F.array(F.lit("salt")).alias("ingredients")))
    broken = F.when(F.col("o_orderkey") % 31 == 0, F.substring(record, 1, 12)).otherwise(record)
    i.table(spark, sf_dir, "orders").select(broken.alias("value")).write.text(baskets)
    good, bad = quarantine.checked_csv(spark, edges, readers.EDGE_SCHEMA)
    read, unread = quarantine.checked_basket_jsonl(spark, baskets)

    def counted(form, total, good, bad):
        kept = good.agg(F.count(F.lit(1)).alias("n"), total.alias("total")).select(F.lit("good").alias("reason"), "n", "total")
        aside = quarantine.counts(bad).groupBy("reason").agg(F.sum("n").alias("n")).select("reason", "n", F.lit(0.0).alias("total"))
        return kept.unionByName(aside).select(F.lit(form).alias("form"), "reason", "n", "total")

    total = F.coalesce(F.round(F.sum("score"), 6), F.lit(0.0))
    return counted("edges", total, good, bad).unionByName(counted("baskets", F.lit(0.0), read, unread))


@query("stored_graph", f"""
WITH {i.ORDER_EDGES_SQL}, s AS (SELECT item, sum(score)::BIGINT AS freq, count(*) AS degree FROM e GROUP BY 1),
h AS (SELECT item, count(*) AS baskets FROM bi GROUP BY 1)
SELECT item, freq, degree, baskets FROM s JOIN h USING (item)""")
def stored_graph(spark, sf_dir):
    """Degree and popularity next to basket counts, from two tables bucketed by item."""
    edges, postings = store_tables(spark, sf_dir)
    sums = edges.groupBy("item").agg(F.sum("score").alias("freq"), F.count(F.lit(1)).alias("degree"))
    return sums.join(postings.groupBy("item").agg(F.count(F.lit(1)).alias("baskets")), "item")


def store_tables(spark, sf_dir, buckets=8):
    """The order graph and its baskets, both bucketed by item."""
    baskets = i.order_lines(spark, sf_dir).select("basket_id", "item").distinct()
    name = lambda label: f"{label}_{uuid.uuid4().hex}"
    edges = writers.store_graph(order_edges(spark, sf_dir), name("graph"), folder(spark, "graph"), buckets)
    return edges, writers.store_baskets(baskets, name("baskets"), folder(spark, "baskets"), "item", buckets)


def _list_text(rows, key, value):
    """``rows`` of one group as the text of a JSON list."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ",")


@query("affinity_document", f"""
WITH {i.ORDER_EDGES_SQL}, its AS (SELECT DISTINCT p_name AS item FROM part)
SELECT 0 AS context, item, partner, score, (SELECT count(*) FROM its) AS items FROM e""")
def affinity_document(spark, sf_dir):
    """The order graph as an export document, read back by pieces."""
    path = folder(spark, "affinity-document")
    lists = writers.adjacency(i.part_items(spark, sf_dir), order_edges(spark, sf_dir))
    # Part names are a few dozen, so this graph is a short text.
    entry = F.concat(F.lit('"'), "idx", F.lit('":'), F.to_json("partners"))
    texts = lists.select("idx", "item", entry.alias("entry")).agg(_list_text(lists, "idx", "entry").alias("p"))
    names = i.part_items(spark, sf_dir).agg(F.to_json(F.array_sort(F.collect_list("item"))).alias("i"), F.count(F.lit(1)).alias("n")).first()
    head = F.lit(f'{{"v":2,"meta":{{"source":"orders","ingredients":{names.n}}},"i":{names.i}')
    texts.select(F.concat(head, F.lit(',"p":{'), "p", F.lit("}}"))).write.text(path)
    items, edges, _ = readers.read_affinity_document(spark, path)
    return edges.select("context", "item", "partner", "score", F.lit(items.count()).alias("items"))


@query("encoded_document", """
SELECT l_orderkey::VARCHAR AS title, 'https://o/' || l_orderkey AS url, 'en' AS lang, 4 AS arity, 3 AS v,
       string_agg(p_name, '|' ORDER BY l_linenumber, p_name) AS items
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def encoded_document(spark, sf_dir):
    """All orders as encoded basket documents of 5,000 each with one vocabulary, read back by pieces."""
    path = folder(spark, "encoded-document")
    names = stage(g.dense_ids(i.part_items(spark, sf_dir), ["item"]), "names")
    lines = i.order_lines(spark, sf_dir).join(names, "item").select("basket_id", "pos", "item", "item_id")
    refs = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item", "item_id"))), lambda x: x["item_id"]))
    cells = lines.groupBy("basket_id").agg(refs.alias("ids"))
    row = F.concat(F.lit('["'), "basket_id", F.lit('",'), "ids", F.lit(',"https://o/'), "basket_id", F.lit('","en"]'))
    blocks = cells.select(F.floor(F.col("basket_id") / 20_000).alias("block"), "basket_id", row.alias("row"))
    docs = blocks.groupBy("block").agg(_list_text(blocks, "basket_id", "row").alias("r"))
    vocabulary = names.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("item_id", "item"))), lambda x: x["item"])).alias("ing")).first().ing
    head = F.concat(F.lit('{"v":3,"ing":'), F.lit(vocabulary), F.lit(',"r":['))
    docs.select("block", F.concat(head, "r", F.lit("]}")).alias("value")).repartition("block").write.partitionBy("block").text(path)
    baskets, refs, words = readers.read_encoded_baskets(spark, path)
    used = refs.join(words, "local_id").groupBy("basket_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda x: x["item"]), "|").alias("items")
    )
    return baskets.join(used, "basket_id").select("title", "url", "lang", "arity", "v", "items")


# -- decision files: a document for each thousand parts or orders -------------------

def _documents(docs, label):
    """``docs(block, value)`` as one file for each block."""
    path = folder(docs.sparkSession, label)
    docs.repartition("block").write.partitionBy("block").text(path)
    return path


def _object(key, value):
    """The rows of a group as one JSON object; a group has a bounded number of keys, all different."""
    return F.map_from_entries(F.collect_list(F.struct(key, value)))


def _part_blocks(spark, sf_dir):
    return i.parts(spark, sf_dir).select(
        F.floor(F.col("p_partkey") / 1000).alias("block"), F.concat_ws(" ", "p_name", "p_partkey").alias("name"), "p_name", "p_type", "p_size", "p_partkey",
    )


@query("taxonomy_files", """
SELECT p_name || ' ' || p_partkey AS item, split_part(p_name, ' ', 2) AS category, CASE WHEN p_size > 25 THEN p_name END AS base FROM part""")
def taxonomy_files(spark, sf_dir):
    entry = F.struct(F.substring_index("p_name", " ", -1).alias("c"), F.when(F.col("p_size") > 25, F.col("p_name")).alias("b"))
    docs = _part_blocks(spark, sf_dir).groupBy("block").agg(F.to_json(_object(F.col("name"), entry)).alias("value"))
    return readers.read_taxonomy(spark, _documents(docs, "taxonomy"))


@query("override_files", """
SELECT p_name || ' ' || p_partkey AS item, CASE WHEN p_size % 3 > 0 THEN p_type END AS title, p_name || '.jpg' AS file, p_size > 25 AS scan,
       CASE WHEN p_size % 7 = 0 THEN true END AS skip FROM part""")
def override_files(spark, sf_dir):
    size = F.col("p_size")
    entry = F.struct(
        F.when(size % 3 > 0, F.col("p_type")).alias("title"), F.concat("p_name", F.lit(".jpg")).alias("file"), (size > 25).alias("scan"),
        F.when(size % 7 == 0, F.lit(True)).alias("skip"),
    )
    docs = _part_blocks(spark, sf_dir).groupBy("block").agg(F.to_json(_object(F.col("name"), entry)).alias("value"))
    return readers.read_overrides(spark, _documents(docs, "overrides"))


@query("manifest_files", "SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS slug FROM part")
def manifest_files(spark, sf_dir):
    slugs = F.collect_list(F.concat_ws("-", F.replace("p_name", F.lit(" "), F.lit("-")), "p_partkey"))
    docs = _part_blocks(spark, sf_dir).groupBy("block").agg(F.to_json(F.struct(slugs.alias("slugs"))).alias("value"))
    return readers.read_manifest(spark, _documents(docs, "manifest"))


def _order_blocks(spark, sf_dir):
    orders = i.table(spark, sf_dir, "orders")
    return orders.select(F.floor(F.col("o_orderkey") / 4000).alias("block"), "o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")


@query("judgment_files", """
SELECT 'o' || l_orderkey AS probe, 'p' || l_linenumber AS candidate, max(l_partkey % 3)::INT AS grade FROM lineitem GROUP BY ALL""")
def judgment_files(spark, sf_dir):
    lines = i.table(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / 4000).alias("block"), F.concat(F.lit("o"), "l_orderkey").alias("probe"),
        F.concat(F.lit("p"), "l_linenumber").alias("candidate"), (F.col("l_partkey") % 3).alias("grade"),
    ).groupBy("block", "probe", "candidate").agg(F.max("grade").alias("grade"))
    grades = lines.groupBy("block", "probe").agg(_object(F.col("candidate"), F.col("grade")).alias("grades"))
    docs = grades.groupBy("block").agg(F.to_json(F.struct(_object(F.col("probe"), F.col("grades")).alias("judgments"))).alias("value"))
    return readers.read_judgments(spark, _documents(docs, "judgments"))


@query("pool_files", """
SELECT 'o' || l_orderkey AS probe, CASE WHEN l_orderkey % 5 = 0 THEN 'test' ELSE 'dev' END AS split,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS ord, 'p' || l_partkey AS candidate FROM lineitem""")
def pool_files(spark, sf_dir):
    lines = i.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("x"))
    probes = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.concat(F.lit("p"), x["l_partkey"])).alias("candidates"))
    split = F.when(F.col("l_orderkey") % 5 == 0, F.lit("test")).otherwise("dev")
    probe = F.struct(F.concat(F.lit("o"), "l_orderkey").alias("name"), split.alias("split"), "candidates")
    blocks = probes.select(F.floor(F.col("l_orderkey") / 4000).alias("block"), probe.alias("p"))
    docs = blocks.groupBy("block").agg(F.to_json(F.struct(F.collect_list("p").alias("probes"))).alias("value"))
    return readers.read_pool(spark, _documents(docs, "pool")).select("probe", "split", F.col("ord").cast("long").alias("ord"), "candidate")


@query("decision_log", """
WITH d AS (SELECT o_orderkey // 4000 AS block, 'c' || o_custkey AS k, o_custkey, max(o_orderkey) AS o FROM orders GROUP BY 1, 2, 3),
e AS (SELECT 'merged' AS field, k AS key, 't' || o AS value, block FROM d
      UNION ALL SELECT 'validated', k, NULL, block FROM d WHERE o_custkey % 2 = 0
      UNION ALL SELECT 'deleted', k, NULL, block FROM d WHERE o_custkey % 9 = 0
      UNION ALL SELECT 'badPairs', '["' || k || '","x' || o_custkey % 5 || '"]', NULL, block FROM d WHERE o_custkey % 11 = 0)
SELECT field, key, value FROM (SELECT *, row_number() OVER (PARTITION BY field, key ORDER BY block % 3 DESC, block::VARCHAR || '/' DESC) AS r FROM e) WHERE r = 1""")
def decision_log(spark, sf_dir):
    """Curation files of many curators in three versions, replayed."""
    own = _order_blocks(spark, sf_dir).groupBy("block", "o_custkey").agg(F.max("o_orderkey").alias("o")).withColumn("k", F.concat(F.lit("c"), "o_custkey"))
    number = F.col("o_custkey")
    some = lambda on, value: F.collect_list(F.when(on, value))
    pair = F.array(F.concat(F.lit("x"), number % 5), F.col("k"))
    docs = own.groupBy("block").agg(F.struct(
        some(number % 2 == 0, F.col("k")).alias("validated"), some(number % 9 == 0, F.col("k")).alias("deleted"),
        _object(F.col("k"), F.concat(F.lit("t"), "o")).alias("merged"), some(number % 11 == 0, pair).alias("badPairs"),
    ).alias("d"))
    text = F.to_json(F.struct((F.col("block") % 3).alias("v"), "d.*"))
    return decisions.replay(readers.read_decision_log(spark, _documents(docs.select("block", text.alias("value")), "curation")))
