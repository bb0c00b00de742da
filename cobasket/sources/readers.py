"""Readers for the graph, basket and decision formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cobasket.functions.lines import cell_to_lines, cell_to_list, normalise_url, parse_line
from cobasket.operators.graph import dense_ids

NODE_SCHEMA = "node_id INT, name STRING, node_type STRING"
EDGE_SCHEMA = "id_1 INT, id_2 INT, score DOUBLE, edge_type STRING"
BASKET_SCHEMA = (
    "id STRING, title STRING, lang STRING, ingredients ARRAY<STRING>, ner ARRAY<STRING>, url STRING, source STRING"
)


def read_graph_csv(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    """Raw node and edge CSV files; columns are taken by header name."""
    read = spark.read.option("header", True).option("enforceSchema", False)
    pick = lambda path, schema: _typed(read.csv(path), schema)
    return pick(nodes, NODE_SCHEMA), pick(edges, EDGE_SCHEMA)


def _typed(df: DataFrame, schema: str) -> DataFrame:
    fields = T._parse_datatype_string(schema).fields
    return df.select(*[F.col(f.name).cast(f.dataType) for f in fields])


def _document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")).select("d.*")


def _pieces(spark: SparkSession, path: str, between: str) -> DataFrame:
    """``(ord, value)``: a document cut at ``between``, by as many tasks as its size asks for."""
    return spark.read.option("lineSep", between).text(path).select(source_order().alias("ord"), "value")


AFFINITY_HEAD = "v INT, meta STRUCT<source:STRING,ingredients:INT,recipes:INT>, i ARRAY<STRING>"
#: A list of partners: its key, and its numbers up to where the document was cut.
_LIST = r',?\s*"(\d+(?:,\d+)?)"\s*:\s*(\[\s*\]|\[\s*\[[\d\s,\[\]]*)'


def read_affinity_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The exported graph document: ``items(item, item_id)``, ``edges``, ``meta``.

    Keys with two numbers are ``context,index``; then edges keep a ``context`` column. The
    document is cut behind the lists of partners, so many tasks read it; what is no list, items
    and meta data, is put together again and parsed by itself. A folder may hold several
    documents with the same items.
    """
    pieces = _pieces(spark, path, "]],")
    lists = pieces.select(F.explode(F.arrays_zip(
        F.regexp_extract_all("value", F.lit(_LIST), F.lit(1)).alias("k"), F.regexp_extract_all("value", F.lit(_LIST), F.lit(2)).alias("v"),
    )).alias("l"))
    raw = lists.select("l.k", F.explode(F.from_json(F.regexp_replace("l.v", r"[\s,\]]*$", "]]"), "array<array<int>>")).alias("e"))
    # A piece that does not end with a list was cut inside a string.
    rest = F.concat(F.regexp_replace("value", _LIST, ""), F.when(F.col("value").rlike(_LIST + "$"), F.lit("")).otherwise(F.lit("]],")))
    rests = pieces.select("ord", rest.alias("rest")).where("rest <> ''").groupBy("ord.file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "rest"))), lambda x: x["rest"]), "").alias("text")
    )
    first = rests.agg(F.min_by("text", "file").alias("text"))
    doc = first.select(F.from_json(F.regexp_replace("text", r"\]\],$", ""), AFFINITY_HEAD).alias("d")).select("d.*")
    items = doc.select(F.posexplode("i").alias("item_id", "item"))
    parts = F.split("k", ",")
    spread = raw.select(
        F.when(F.size(parts) > 1, parts[0].cast("int")).otherwise(F.lit(0)).alias("context"),
        F.element_at(parts, -1).cast("int").alias("a"), F.col("e")[0].alias("b"), F.col("e")[1].alias("score"),
    )
    named = spread.join(items.select(F.col("item_id").alias("a"), "item"), "a").join(
        items.select(F.col("item_id").alias("b"), F.col("item").alias("partner")), "b"
    )
    return items.select("item", "item_id"), named.select("context", "item", "partner", "score"), doc.select("v", "meta")


def source_order():
    """File, place of the split in it, row in the split: the order of the lines whatever the packing of splits."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )


def read_basket_jsonl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Basket records, one per line; ``src_ord`` follows the order of files and lines."""
    parts = None
    for n, path in enumerate(paths):
        part = spark.read.schema(BASKET_SCHEMA).json(path).withColumns({
            "src_ord": F.struct(F.lit(n).alias("input"), *[source_order()[c].alias(c) for c in ("file", "start", "row")]),
        })
        parts = part if parts is None else parts.unionByName(part)
    return basket_records(parts)


def basket_records(rows: DataFrame) -> DataFrame:
    """Rows of ``BASKET_SCHEMA`` with ``src_ord`` as baskets, missing fields filled in."""
    phrases = F.when(F.size("ingredients") > 0, F.col("ingredients")).otherwise(
        F.coalesce("ner", F.array().cast("array<string>"))
    )
    return rows.select(
        "src_ord",
        F.concat_ws(":", F.col("src_ord.input").cast("string"), F.col("src_ord.row").cast("string")).alias("basket_id"),
        "id", F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce("lang", F.lit("en")).alias("lang"),
        F.transform(phrases, lambda p: p.cast("string")).alias("phrases"),
        F.trim(F.coalesce("url", F.lit(""))).alias("url"), "source",
    )


_STRING = r'"(?:[^"\\]++|\\.)*+"'


def _json_records(spark: SparkSession, path: str, record: T.StructType) -> DataFrame:
    """``(src_ord, j)``: the records of JSON arrays, or of ``recipes`` in an object.

    Files are cut between records and read by many tasks. Where that does not give whole
    records (line ends between them, brackets in a string), a file is one value of one task.
    """
    pieces = _pieces(spark, path, "},{")
    opens, ends = r'(?s)^\s*(?:\{\s*"recipes"\s*:\s*)?\[\s*\{', r"\}\s*\]\s*\}?\s*$"
    opened, ended = F.col("value").rlike(opens), F.col("value").rlike(ends)
    inner = F.regexp_replace(F.regexp_replace("value", opens, ""), ends, "")
    flat = ~F.regexp_replace(inner, _STRING, "").rlike(r"\}\s*,\s*\{")
    cut = pieces.select(F.col("ord").alias("src_ord"), opened.alias("opened"), ended.alias("ended"), F.when(flat, F.from_json(F.concat(F.lit("{"), inner, F.lit("}")), record)).alias("j"))
    # A broken piece has no field at all.
    broken = F.coalesce(*[F.col("j").getField(f.name) for f in record]).isNull()
    odd, n_opened, n_ended, files = cut.agg(F.count_if(broken), F.count_if("opened"), F.count_if("ended"), F.count_distinct("src_ord.file")).first()
    if not odd and n_opened == n_ended == files:
        return cut.select("src_ord", "j")
    whole = spark.read.schema(T.StructType(list(record.fields)).add("recipes", T.ArrayType(record))).json(path, multiLine=True)
    one = F.array(F.struct(*[F.col(f"`{f.name}`") for f in record]))
    # Records of a file in their order: the place in the file is part of it.
    return whole.select(source_order().alias("src_ord"), F.posexplode(F.coalesce("recipes", one)).alias("at", "j")).select(
        F.struct("src_ord.file", "src_ord.start", (F.col("src_ord.row") + F.col("at")).alias("row")).alias("src_ord"), "j",
    )


def read_records(
    spark: SparkSession, path: str, title_key: str = "title", items_key: str = "ingredients", url_key: str = "url",
    multi_line: bool = True,
) -> DataFrame:
    """A dump with user-named columns: ``.jsonl``, ``.json`` or CSV, by suffix.

    The items may be a list, a JSON list in a cell or delimited text. A ``.json`` file is
    an array of records, or an object with one in ``recipes``. CSV files without line ends in
    cells can be split over tasks: give ``multi_line=False``.
    """
    ordered = source_order().alias("src_ord")
    if path.endswith(".jsonl"):
        text = F.get_json_object
        raw = spark.read.text(path).where(F.trim("value") != "").select(ordered, F.col("value").alias("j"))
        raw = raw.select("src_ord", *[text("j", f"$['{k}']").alias(n) for k, n in ((title_key, "title"), (items_key, "cell"), (url_key, "url"))])
    elif path.endswith(".json"):
        keys = {title_key: "title", items_key: "cell", url_key: "url"}
        raw = _json_records(spark, path, T.StructType([T.StructField(k, T.StringType()) for k in keys]))
        raw = raw.select("src_ord", *[F.col("j").getField(k).alias(n) for k, n in keys.items()])
    else:
        csv = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
        raw = csv.select(ordered, F.col(title_key).alias("title"), F.col(items_key).alias("cell"), F.col(url_key).alias("url"))
    return raw.select(
        "src_ord",
        F.trim(F.coalesce("title", F.lit(""))).alias("title"),
        F.coalesce(cell_to_lines(F.col("cell")), F.array().cast("array<string>")).alias("lines"),
        F.trim(F.coalesce("url", F.lit(""))).alias("url"),
    ).where(F.col("title") != "")


def lines_to_phrases(records: DataFrame, lang: str = "fr", source: str = "french", **lists) -> DataFrame:
    """Free-text line items to bare phrases; records with none left drop out."""
    phrases = F.filter(F.transform("lines", lambda s: parse_line(s, **lists)), lambda p: p != "")
    return records.withColumn("phrases", phrases).where(F.size("phrases") > 0).select(
        "src_ord", "title", F.lit(lang).alias("lang"), "phrases", "url", F.lit(source).alias("source")
    )


def read_wide_csv(spark: SparkSession, path: str, source: str = "wide", multi_line: bool = True) -> DataFrame:
    """``title, link, NER`` with a list in the cell; the other columns are not parsed."""
    csv = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return csv.select(
        source_order().alias("src_ord"),
        F.trim(F.coalesce("title", F.lit(""))).alias("title"), F.lit("en").alias("lang"),
        cell_to_list(F.col("NER")).alias("phrases"), normalise_url(F.col("link")).alias("url"),
        F.lit(source).alias("source"),
    ).where((F.col("title") != "") & (F.size("phrases") > 0))


def read_long_csv(
    spark: SparkSession, path: str, url_key: str = "url", title_key: str = "recette", item_key: str = "ingredients",
    multi_line: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """One row per line item; rows of a url form a record. Returns heads and lines."""
    csv = spark.read.csv(path, header=True, multiLine=multi_line, escape='"')
    return split_lines(
        csv.select(
            source_order().alias("ord"), F.trim(F.coalesce(url_key, F.lit(""))).alias("url"),
            F.trim(F.coalesce(title_key, F.lit(""))).alias("title"), F.coalesce(item_key, F.lit("")).alias("line"),
        )
    )


def split_lines(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows(ord, url, title, line)`` -> record heads and their lines.

    ``(basket_id, src_ord, title, url)`` with the first title of each url, and
    ``(basket_id, pos, line)``. Lines stay rows, so a record of any length is fine.
    """
    keyed = rows.where(F.col("url") != "").withColumnRenamed("url", "basket_id")
    heads = (
        keyed.groupBy("basket_id")
        .agg(F.min("ord").alias("src_ord"), F.min_by("title", "ord").alias("title"))
        .where(F.col("title") != "")
        .select("basket_id", "src_ord", "title", normalise_url(F.col("basket_id")).alias("url"))
    )
    lines = keyed.select("basket_id", F.col("ord").alias("pos"), "line").join(
        heads.select("basket_id"), "basket_id", "left_semi"
    )
    return heads, lines


def parsed_lines(lines: DataFrame, **lists) -> DataFrame:
    """``(basket_id, pos, line)`` -> ``(basket_id, pos, phrase)`` without empty phrases."""
    return lines.select("basket_id", "pos", parse_line(F.col("line"), **lists).alias("phrase")).where(
        F.col("phrase") != ""
    )


def _basket_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Head and rows ``(ord, f)`` of an encoded document by pieces; none where its layout is another."""
    pieces = _pieces(spark, path, "],[")
    start = r'(?s)^(.*"r"\s*:\s*)\[\s*\[(.*)$'
    opens = F.col("value").rlike(start)
    inner = F.when(opens, F.regexp_extract("value", start, 2)).otherwise(F.col("value"))
    ends = F.col("value").rlike(r"\]\s*\]\s*\}\s*$")
    inner = F.when(ends, F.regexp_replace(inner, r"\]\s*\]\s*\}\s*$", "")).otherwise(inner)
    cells = F.from_json(F.concat(F.lit("["), inner, F.lit("]")), "array<string>", {"mode": "PERMISSIVE"})
    # Without its strings a row is flat but for lists of numbers.
    flat = F.regexp_replace(inner, r'"(?:[^"\\]++|\\.)*+"', "").rlike(r"^[^\[\]]*+(?:\[[^\[\]]*+\][^\[\]]*+)*+$")
    rows = pieces.select("ord", opens.alias("opens"), ends.alias("ends"), F.when(flat, cells).alias("f"))
    # Cut inside a string, or in another order of keys: then some piece is no list of cells.
    odd, n_opens, n_ends, files = rows.agg(
        F.count_if(F.col("f").isNull()), F.count_if("opens"), F.count_if("ends"), F.count_distinct("ord.file"),
    ).first()
    if odd or n_opens != files or n_ends != files:
        return None
    head = pieces.where(opens).agg(F.min_by(F.regexp_extract("value", start, 1), "ord").alias("text"))
    return head.select(F.from_json(F.concat("text", F.lit("[]}")), "v INT, ing ARRAY<STRING>").alias("d")).select("d.*"), rows.select("ord", "f")


def read_encoded_baskets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The exported basket document: ``baskets``, ``refs(basket_id, pos, local_id)``, ``vocabulary``.

    Baskets carry the version ``v`` of the document and their number of fields ``arity``,
    for ``quality.check_baskets``: a short row has nulls where fields are missing. The usual
    layout, rows last, is cut between rows and read by many tasks; a folder may hold several
    documents with one vocabulary. Any other layout is one row of one task.
    """
    cut = _basket_rows(spark, path)
    if cut:
        doc, cells = cut
        numbered = dense_ids(cells, ["ord"]).select(F.col("item_id").alias("basket_id"), "f")
        rows = numbered.withColumn("v", F.lit(doc.first().v).cast("int"))
    else:
        doc = _document(spark, path, "v INT, ing ARRAY<STRING>, r ARRAY<STRING>")
        rows = doc.select("v", F.posexplode("r").alias("basket_id", "row")).select(
            "v", "basket_id", F.from_json("row", "array<string>").alias("f")
        )
    vocabulary = doc.select(F.posexplode("ing").alias("local_id", "item"))
    baskets = rows.select(
        F.col("basket_id").cast("long").alias("basket_id"), F.get("f", F.lit(0)).alias("title"),
        F.get("f", F.lit(2)).alias("url"), F.get("f", F.lit(3)).alias("lang"), F.size("f").alias("arity"), "v",
    )
    refs = rows.select(
        F.col("basket_id").cast("long").alias("basket_id"),
        F.posexplode(F.from_json(F.get("f", F.lit(1)), "array<int>")).alias("pos", "local_id"),
    )
    return baskets, refs, vocabulary


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,struct<c:string,b:string>>")).alias("item", "e")
    )
    return raw.select("item", F.col("e.c").alias("category"), F.col("e.b").alias("base"))


def read_string_map(spark: SparkSession, path: str, key: str = "src", value: str = "tgt") -> DataFrame:
    """A JSON object of strings as two columns and the order of its entries."""
    raw = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("ord", "e")
    )
    return raw.select(F.col("e.key").alias(key), F.col("e.value").alias(value), "ord")


def read_curation(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``validated(item)``, ``deleted(item)``, ``merged(src, tgt, ord)``, ``bad_pairs(names)``."""
    doc = _document(
        spark, path,
        "validated ARRAY<STRING>, deleted ARRAY<STRING>, merged MAP<STRING,STRING>, badPairs ARRAY<STRING>",
    )
    return {
        "validated": doc.select(F.explode("validated").alias("item")),
        "deleted": doc.select(F.explode("deleted").alias("item")),
        "merged": doc.select(F.posexplode(F.map_entries("merged")).alias("ord", "e")).select(
            F.col("e.key").alias("src"), F.col("e.value").alias("tgt"), "ord"
        ),
        # A pair that is no list becomes an empty one and is ignored downstream.
        "bad_pairs": doc.select(F.explode("badPairs").alias("j")).select(
            F.coalesce(F.from_json("j", "array<string>"), F.array().cast("array<string>")).alias("names")
        ),
    }


def read_decision_log(spark: SparkSession, path: str) -> DataFrame:
    """Curation documents of many curators as one log: ``(field, key, value, version, file, ord)``.

    Fields are ``validated`` and ``deleted`` (no value), ``merged`` (the target is the value) and ``badPairs``
    (the two names, sorted, as a JSON list). ``version`` is the document's ``v``, 0 without one.
    """
    schema = "v INT, validated ARRAY<STRING>, deleted ARRAY<STRING>, merged MAP<STRING,STRING>, badPairs ARRAY<ARRAY<STRING>>"
    docs = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"), F.col("_metadata.file_path").alias("file"))
    entry = lambda field, key, value: F.struct(F.lit(field).alias("field"), key.alias("key"), value.cast("string").alias("value"))
    plain = lambda field: F.transform(F.coalesce(f"d.{field}", F.array()), lambda x: entry(field, x, F.lit(None)))
    merged = F.transform(F.map_entries(F.coalesce("d.merged", F.create_map().cast("map<string,string>"))), lambda e: entry("merged", e["key"], e["value"]))
    pairs = F.transform(
        F.filter(F.coalesce("d.badPairs", F.array().cast("array<array<string>>")), lambda p: F.size(p) == 2),
        lambda p: entry("badPairs", F.to_json(F.array_sort(p)), F.lit(None)),
    )
    rows = docs.select(
        F.coalesce("d.v", F.lit(0)).alias("version"), "file", F.posexplode(F.concat(plain("validated"), plain("deleted"), merged, pairs)).alias("ord", "e"),
    )
    return rows.where("e.key IS NOT NULL").select("e.field", "e.key", "e.value", "version", "file", "ord")


def read_judgments(spark: SparkSession, path: str) -> DataFrame:
    doc = _document(spark, path, "judgments MAP<STRING,MAP<STRING,INT>>")
    return doc.select(F.explode("judgments").alias("probe", "m")).select(
        "probe", F.explode("m").alias("candidate", "grade")
    )


def read_pool(spark: SparkSession, path: str) -> DataFrame:
    doc = _document(spark, path, "probes ARRAY<STRUCT<name:STRING,split:STRING,candidates:ARRAY<STRING>>>")
    return doc.select(F.explode("probes").alias("p")).select(
        F.col("p.name").alias("probe"), F.col("p.split").alias("split"),
        F.posexplode("p.candidates").alias("ord", "candidate"),
    )


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,struct<title:string,file:string,scan:boolean,skip:boolean>>")).alias("item", "o")
    )
    return raw.select("item", "o.title", "o.file", "o.scan", "o.skip")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return _document(spark, path, "slugs ARRAY<STRING>").select(F.explode("slugs").alias("slug"))


