"""Part names are found once and read from a small table."""

from cobasket.plans import inputs as i


def test_part_names_are_read_from_a_staged_table(spark):
    names = i.part_items(spark, "/root/testdata/sf0.001")
    assert all("/part-names-" in f for f in names.inputFiles())
    assert sorted(r["item"] for r in names.collect()) == sorted({r.p_name for r in i.parts(spark, "/root/testdata/sf0.001").collect()})
