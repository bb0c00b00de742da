import json

from pyspark.sql import functions as F

from cobasket.operators.graph import dense_ids
from cobasket.operators.match import usable_baskets
from cobasket.plans.source_queries import store_tables
from cobasket.sources import quarantine, readers, writers


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_graph_csv_by_header(spark, tmp_path):
    nodes = put(tmp_path / "n.csv", "node_id,name,id,node_type\n1,salt,x,ingredient\n")
    edges = put(tmp_path / "e.csv", "id_1,id_2,score,edge_type\n1,2,0.5,ingr-ingr\n")
    n, e = readers.read_graph_csv(spark, nodes, edges)
    assert n.collect()[0].asDict() == {"node_id": 1, "name": "salt", "node_type": "ingredient"}
    assert e.collect()[0].asDict() == {"id_1": 1, "id_2": 2, "score": 0.5, "edge_type": "ingr-ingr"}


def test_affinity_documents_of_both_formats(spark, tmp_path):
    new = put(tmp_path / "2.json", {"v": 2, "meta": {"source": "s"}, "i": ["a", "b"], "p": {"0": [[1, 30]], "1": [[0, 30]]}})
    items, edges, meta = readers.read_affinity_document(spark, new)
    assert sorted(map(tuple, items.collect())) == [("a", 0), ("b", 1)]
    assert sorted(map(tuple, edges.collect())) == [(0, "a", "b", 30), (0, "b", "a", 30)]
    assert meta.first().meta.source == "s"
    old = put(tmp_path / "1.json", {"c": ["x", "y"], "i": ["a", "b"], "p": {"1,0": [[1, 30]]}})
    assert [tuple(r) for r in readers.read_affinity_document(spark, old)[1].collect()] == [(1, "a", "b", 30)]


def test_graph_export_round_trip(spark, tmp_path):
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 9), ("b", "a", 3), ("c", "a", 9)], "item string, partner string, score int")
    items = dense_ids(edges.select("item").distinct(), ["item"])
    lists = {r["item"]: (r.idx, r.partners) for r in writers.adjacency(items, edges).collect()}
    assert [r.part for r in writers.adjacency(items, edges, 1).where("item = 'a'").collect()] in ([0, 1], [1, 0])
    assert lists == {"a": (0, [[2, 9], [1, 3]]), "b": (1, [[0, 3]]), "c": (2, [[0, 9]])}
    writers.write_graph(edges, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 4
    writers.write_affinity_export(items, edges, str(tmp_path / "x"), "test")
    assert spark.read.json(str(tmp_path / "x/meta")).first().ingredients == 3


def test_jsonl_keeps_file_and_line_order(spark, tmp_path):
    one = put(tmp_path / "1.jsonl", '{"id":"p","title":" A ","lang":"fr","ingredients":["x","y"],"url":"u"}\n\n{"id":"q","title":"B","ner":["z"]}\n')
    two = put(tmp_path / "2.jsonl", '{"id":"r","title":"C","ingredients":[]}\n')
    rows = readers.read_basket_jsonl(spark, [one, two]).orderBy("src_ord").collect()
    assert [(r.id, r.title, r.lang, r.phrases) for r in rows] == [("p", "A", "fr", ["x", "y"]), ("q", "B", "en", ["z"]), ("r", "C", "en", [])]
    assert len({r.basket_id for r in rows}) == 3


def test_records_in_all_forms(spark, tmp_path):
    recs = [{"nom": "Tarte", "ing": ["200 g de sucre", "2 oeufs"], "lien": "u"}, {"nom": "", "ing": []}]
    keys = {"title_key": "nom", "items_key": "ing", "url_key": "lien"}
    files = [
        put(tmp_path / "a.jsonl", "\n".join(map(json.dumps, recs))), put(tmp_path / "a.json", recs),
        put(tmp_path / "b.json", {"recipes": recs}), put(tmp_path / "a.csv", 'nom,ing,lien\nTarte,200 g de sucre;2 oeufs,u\n,x,u\n'),
    ]
    for path in files:
        got = readers.lines_to_phrases(readers.read_records(spark, path, **keys)).collect()
        assert [(r.title, r.phrases, r.url, r.lang) for r in got] == [("Tarte", ["sucre", "oeufs"], "u", "fr")], path


def test_wide_and_long_csv(spark, tmp_path):
    wide = put(tmp_path / "w.csv", 'title,directions,link,NER\nPie,"a\nb",x.org/1,"[""egg"", ""milk""]"\nNone,,y,\n,,z,"[""a""]"\n')
    assert [(r.title, r.phrases, r.url) for r in readers.read_wide_csv(spark, wide).collect()] == [("Pie", ["egg", "milk"], "https://x.org/1")]
    long = put(tmp_path / "l.csv", "url,recette,quantites,ingredients\nb.fr/1,Soupe,2,2 poireaux\nb.fr/1,Autre,1,sel\n,x,1,y\nb.fr/2,,1,eau\n")
    heads, lines = readers.read_long_csv(spark, long)
    assert [(r.title, r.url) for r in heads.collect()] == [("Soupe", "https://b.fr/1")]
    assert [r.phrase for r in readers.parsed_lines(lines).orderBy("pos").collect()] == ["poireaux", "sel"]


def test_encoded_baskets_drop_dead_names(spark, tmp_path):
    path = put(tmp_path / "r.json", {"v": 2, "ing": ["a", "dead", "b"], "r": [["T", [2, 0, 2, 1], "u", "fr"], ["E", [1], "u", "en"]]})
    baskets, refs, vocab = readers.read_encoded_baskets(spark, path)
    live = spark.createDataFrame([("a",), ("b",)], "item string")
    got = usable_baskets(refs, vocab, live).orderBy("basket_id", "pos").collect()
    assert [(r.basket_id, r.pos, r["item"]) for r in got] == [(0, 0, "b"), (0, 1, "a")]
    assert baskets.where("lang = 'fr'").first().title == "T"


def test_basket_export(spark, tmp_path):
    kept = spark.createDataFrame([(1, "T", "en", "u", 1, ["b", "a"]), (2, "S", "fr", "u", 2, ["a"])],
                                 "basket_id int, title string, lang string, url string, src_ord int, items array<string>")
    writers.write_baskets(kept, str(tmp_path / "o"), "src")
    rows = {r.title: r.ids for r in spark.read.json(str(tmp_path / "o/baskets")).collect()}
    assert rows == {"T": [0, 1], "S": [1]}
    man = spark.read.json(str(tmp_path / "o/manifest")).first()
    assert (man.recipes, man.en, man.fr, man.vocabulary) == (2, 1, 1, 2)
    assert spark.read.json(str(tmp_path / "o/sample/baskets")).count() == 2


def test_decision_files(spark, tmp_path):
    cur = readers.read_curation(spark, put(tmp_path / "c.json", {
        "validated": ["v"], "deleted": ["d"], "merged": {"a": "b"}, "badPairs": [["a", "b"], "oops", ["x"]], "extra": 1,
    }))
    assert [tuple(r) for r in cur["merged"].collect()] == [("a", "b", 0)]
    assert sorted(len(r.names) for r in cur["bad_pairs"].collect()) == [0, 1, 2]
    tax = readers.read_taxonomy(spark, put(tmp_path / "t.json", {"x": {"c": "meat", "b": "y"}, "z": {"c": "egg"}}))
    assert sorted(map(tuple, tax.collect()), key=str) == [("x", "meat", "y"), ("z", "egg", None)]
    jud = readers.read_judgments(spark, put(tmp_path / "j.json", {"v": 1, "judgments": {"p": {"c": 2, "d": 0}}}))
    assert sorted(map(tuple, jud.collect())) == [("p", "c", 2), ("p", "d", 0)]
    ov = readers.read_overrides(spark, put(tmp_path / "o.json", {"n": {"title": "T", "scan": True}}))
    assert ov.first().asDict() == {"item": "n", "title": "T", "file": None, "scan": True, "skip": None}
    pool = readers.read_pool(spark, put(tmp_path / "p.json", {"probes": [{"name": "p", "split": "dev", "candidates": ["c"]}]}))
    assert tuple(pool.first()) == ("p", "dev", 0, "c")
    assert readers.read_manifest(spark, put(tmp_path / "m.json", {"slugs": ["s"]})).first().slug == "s"
    assert tuple(readers.read_string_map(spark, put(tmp_path / "s.json", {"a": "b"})).select(F.col("src"), "tgt").first()) == ("a", "b")


def test_encoded_baskets_of_wrong_shape_are_reported(spark, tmp_path):
    from cobasket.operators import quality

    path = put(tmp_path / "s.json", {"v": 1, "ing": ["a"], "r": [["T", [0], "u", "fr"], ["E", [0], "u"], ["F", [0], "u", "en", 5]]})
    baskets, refs, vocab = readers.read_encoded_baskets(spark, path)
    live = spark.createDataFrame([("a",)], "item string")
    found = {r.check: r.violations for r in quality.check_baskets(baskets, refs, vocab, live, version=2).collect()}
    assert found["wrong arity"] == 2 and found["wrong document version"] == 3 and found["unknown language"] == 1
    found = {r.check: r.violations for r in quality.check_baskets(baskets, refs, vocab, live, langs=None, version=1).collect()}
    assert found["wrong document version"] == 0 and found["no items"] == 0


def test_large_documents_are_read_by_many_tasks(spark, tmp_path):
    """Awkward names and every place a cut may fall on; the same rows as from the whole document."""
    names = ["a]],", 'q"]],"5":[[1,2', "b\\", "],[", "é" * 30] + [f"n{k}" for k in range(400)]
    lists = {str(k): [[(k * 7 + j) % 405, j + 1] for j in range(k % 9)] for k in range(405)}
    for layout in ((",", ":"), (", ", ": ")):
        path = put(tmp_path / f"g{len(layout[0])}.json", json.dumps({"v": 2, "meta": {"source": "s]],"}, "i": names, "p": lists}, separators=layout, ensure_ascii=False))
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            items, edges, meta = readers.read_affinity_document(spark, path)
            tasks = readers._pieces(spark, path, "]],").rdd.getNumPartitions()
            got = sorted((r["item"], r.partner, r.score) for r in edges.collect())
            assert [r["item"] for r in items.orderBy("item_id").collect()] == names and meta.first().meta.source == "s]],"
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == sorted((names[int(k)], names[b], s) for k, v in lists.items() for b, s in v)
        assert tasks > 5
    pieces = readers._pieces(spark, str(tmp_path / "g1.json"), "]],")
    assert pieces.count() > 300


def test_encoded_documents_are_read_by_many_tasks(spark, tmp_path):
    rows = [[f"t{k} é", [j % 50 for j in range(k % 7)], f"u{k}", "en"] for k in range(600)] + [["short", [1]], ["none"]]
    vocabulary = [f"w{k}" for k in range(50)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for odd in (False, True):
        doc = {"v": 3, "ing": vocabulary, "r": rows + ([["x],[", [3], "],[", "fr"]] if odd else [])}
        path = put(tmp_path / f"e{odd}.json", json.dumps(doc, separators=(",", ":"), ensure_ascii=False))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            assert (readers._basket_rows(spark, path) is None) == odd
            baskets, refs, vocab = readers.read_encoded_baskets(spark, path)
            got = {r.basket_id: (r.title, r.url, r.lang, r.arity, r.v) for r in baskets.collect()}
            ids = {}
            for r in refs.orderBy("basket_id", "pos").collect():
                ids.setdefault(r.basket_id, []).append(r.local_id)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == {k: (*(r + [None] * 4)[:1], *(r + [None] * 4)[2:4], len(r), 3) for k, r in enumerate(doc["r"])}
        assert ids == {k: r[1] for k, r in enumerate(doc["r"]) if len(r) > 1 and r[1]}
        assert [r["item"] for r in vocab.orderBy("local_id").collect()] == vocabulary


def test_large_json_dumps_are_read_by_many_tasks(spark, tmp_path):
    recs = [{"title": f"t{k}", "ingredients": [f"salt {k}", 'a "b"'], "url": f"u{k}", "more": {"x": [1]}} for k in range(300)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for n, (doc, layout) in enumerate([
        (recs, (",", ":")), ({"recipes": recs}, (",", ":")), (recs, (", ", ": ")), (recs + [{"title": "odd },{ x", "ingredients": [], "url": ""}], (",", ":")),
    ]):
        path = put(tmp_path / f"{n}.json", json.dumps(doc, separators=layout))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        try:
            rows = readers.read_records(spark, path).orderBy("src_ord").collect()
            assert (readers._pieces(spark, path, "},{").count() > 200) == (n != 2)
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        want = doc["recipes"] if isinstance(doc, dict) else doc
        assert [(r.title, r.lines, r.url) for r in rows] == [(d["title"], d["ingredients"], d["url"]) for d in want]


def test_jsonl_order_of_a_folder_follows_its_files(spark, tmp_path):
    for k in range(5):
        put(tmp_path / f"{k}.jsonl", "".join(f'{{"id":"{k}{j}","title":"t","ingredients":["x"]}}\n' for j in range(4)))
    rows = readers.read_basket_jsonl(spark, [str(tmp_path)]).orderBy("src_ord").collect()
    assert [r.id for r in rows] == [f"{k}{j}" for k in range(5) for j in range(4)]


def test_bad_rows_are_set_aside(spark, tmp_path):
    nodes = put(tmp_path / "n.csv", "node_id,name,node_type\n1,salt,ingredient\nx,oil,ingredient\n,rye,ingredient\n")
    edges = put(tmp_path / "e.csv", 'id_1,id_2,score,edge_type\n1,2, 0.5 ,ingr-ingr\n1,2\n1,y,z,ingr-ingr\n1,2,0.5,a,b\n1,2,,"ingr-ingr"\n')
    n, e, bad = quarantine.checked_graph_csv(spark, nodes, edges)
    assert sorted(map(tuple, n.collect()), key=str) == [(1, "salt", "ingredient"), (None, "rye", "ingredient")]
    assert sorted(map(tuple, e.collect()), key=str) == [(1, 2, 0.5, "ingr-ingr"), (1, 2, None, "ingr-ingr")]
    found = sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in bad.collect())
    assert found == [("e.csv", "1,2", "malformed"), ("e.csv", "1,2,0.5,a,b", "malformed"), ("e.csv", "1,y,z,ingr-ingr", "id_2,score"), ("n.csv", "x,oil,ingredient", "node_id")]
    assert {(r.reason, r.n) for r in quarantine.counts(bad).collect()} == {("malformed", 2), ("id_2,score", 1), ("node_id", 1)}
    lines = put(tmp_path / "b.jsonl", '{"id":"p","title":"A","ingredients":["x"]}\n{"id":"q"\n[1]\n{"id":"r","title":"B","ingredients":"none"}\n')
    good, bad = quarantine.checked_basket_jsonl(spark, lines)
    assert [(r.id, r.title, r.phrases) for r in good.collect()] == [("p", "A", ["x"])]
    assert bad.count() == 3 and {r.reason for r in bad.collect()} == {"malformed"}


def test_bucketed_tables_are_joined_where_they_lie(spark):
    edges, postings = store_tables(spark, "/root/testdata/sf0.001")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = edges.join(postings, "item").groupBy("item").agg(F.count("*").alias("n"))
        joined.collect()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
