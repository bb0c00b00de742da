import hashlib

from pyspark.sql import functions as F

from cobasket.functions import display, lines, localise, media_text, text


def one(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
    return [r[0] for r in df.orderBy("k").select(expr(F.col("v"))).collect()]


def test_norm_folds_and_keeps_what_does_not_decompose(spark):
    got = one(spark, ["Crème  Brûlée ", "ŒUF", "ﬁne Ñandú", "½ tasse", "éte", "straße"], text.norm)
    assert got == ["creme brulee", "œuf", "fine nandu", "1⁄2 tasse", "ete", "straße"]


def test_stems_in_order(spark):
    got = one(spark, ["berries", "chevaux", "choux", "moules", "gas", "pies", "as"], text.stems)
    assert got == [
        ["berries", "berry", "berri", "berrie"], ["chevaux", "cheval", "chevau"], ["choux", "chou"],
        ["moules", "moul", "moule"], ["gas"], ["pies", "pie"], ["as"],
    ]


def test_slug_drops_letters_without_a_base(spark):
    assert one(spark, ["Crème fraîche!", "œuf dur", "--A  b--", "7 up"], text.slugify) == ["creme-fraiche", "uf-dur", "a-b", "7-up"]


def test_tokens_and_key_terms(spark):
    assert one(spark, ["Cherry Tomatoes", "half-and/half", "couscous bus", "molasses"], text.tokens) == [
        ["cherry", "tomato"], ["half", "and", "half"], ["couscous", "bus"], ["molasse"],
    ]
    got = one(spark, ["fresh red berries", "wolves knives", "cloves of garlic", "tomatoes tomato", "b-12 oil"], text.key_terms)
    assert got == [["berry"], ["wolfe", "knive"], ["clove", "garlic"], ["tomato"], ["oil"]]


def test_split_is_the_digest_modulo_five(spark):
    words = [f"name {k}" for k in range(40)]
    want = ["holdout" if int(hashlib.sha1(w.encode()).hexdigest(), 16) % 5 < 2 else "dev" for w in words]
    assert one(spark, words, text.eval_split) == want


def test_parse_line(spark):
    table = {
        "250 g de crème fraîche épaisse": "crème fraîche épaisse",
        "2 cuillères à soupe d'huile d'olive": "huile d'olive",
        "1/2 c. à café de sel": "sel",
        "3 gousses d'ail hachées": "ail",
        "1,5 kg de veau, coupé en dés": "veau",
        "de la farine tamisée": "farine tamisée",
        "4 oeufs": "oeufs",
        "les pommes en tranches fines": "pommes",
        "g": "g",
        "  ": "",
        "½ Citron vert.": "citron vert",
        "20 cl de l'eau": "eau",
    }
    assert one(spark, list(table), lines.parse_line) == list(table.values())


def test_list_cells(spark):
    got = one(spark, ['["a", "b"]', "a;b|c\nd", "plain", "['x']", '"text"'], lines.cell_to_lines)
    assert got[:3] == [["a", "b"], ["a", "b", "c", "d"], ["plain"]]
    assert one(spark, ['["a"]', "['a', 'b']", "nothing", "", None], lines.cell_to_list) == [["a"], ["a", "b"], [], [], []]


def test_urls_and_tags(spark):
    assert one(spark, [" www.x.fr/1 ", "http://a", "", None], lines.normalise_url) == ["https://www.x.fr/1", "http://a", "", ""]
    assert one(spark, ["<b>x</b> y ", None], text.strip_tags) == ["x y", ""]


def test_badges_buckets_labels(spark):
    assert one(spark, [0.83, 0.5, 0.14, 1.4, -1.0], display.badge, "double") == [82, 50, 14, 99, 0]
    assert one(spark, [0.25, 0.1, 0.05], display.fit_bucket, "double") == ["great", "good", "weak"]
    assert one(spark, ["legume-nut", "mystery"], lambda c: display.category_label(c, "fr")) == ["Légumineuses & noix", "Mystery"]


def test_licences(spark):
    table = {"CC BY-SA 4.0": True, "CC BY-NC 2.0": False, "Public domain": True, "": False, "GFDL and more": False, "All rights": False, "CC0": True}
    assert one(spark, list(table), media_text.license_ok) == list(table.values())


def test_localise_cascade(spark):
    words = spark.createDataFrame(
        [("garlic", "ail"), ("tomato", "tomate"), ("almond", "amande"), ("eggs", "oeufs"), ("red pepper", "piment"), ("x", "")],
        "name string, translated string",
    )
    table = {
        "Garlic": "ail", "fresh garlic": "ail frais", "red tomato": "tomate rouge", "red pepper": "piment",
        "egg": "oeufs", "tomatos": "tomate", "almond oil": "huile d'amande", "corn oil": "huile de corn",
        "onion powder": "onion en poudre", "tomato sauce": "sauce tomate", "x": "x", "blue cheese": "blue cheese",
    }
    names = spark.createDataFrame([(n,) for n in table], "name string")
    assert {r.name: r.localised for r in localise.localise(names, words).collect()} == table


def test_folding_all_characters(spark):
    import unicodedata

    chars = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x30000, 7))]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").repartition(8)
    got = {r.c: r.f for r in rows.select("c", text.fold_accents(F.col("c")).alias("f")).collect()}
    want = {c: "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in chars}
    assert [c for c in chars if got[c] != want[c]] == []
    mixed = spark.createDataFrame([("\u1f04\u03bb\u03c6\u03b1 \u0439\u0451 \ud55c\uae00 \u2122 \ufb01n",)], "c string")
    assert mixed.select(text.fold_accents(F.col("c"))).first()[0] == "\u03b1\u03bb\u03c6\u03b1 \u0438\u0435 \u1112\u1161\u11ab\u1100\u1173\u11af TM fin"
