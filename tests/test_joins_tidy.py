import pytest
from pyspark.sql import functions as F

import axisframe as ax
from axisframe import AxisTable
from axisframe.errors import DuplicateNameError, JoinRelationshipError, NameRepairError, SelectionError, SizeMismatchError, UnknownColumnError


@pytest.fixture(scope="module")
def left(spark):
    return AxisTable(spark.createDataFrame([(0, "A", 1.0), (1, "B", 2.0), (2, None, 3.0), (3, "A", 4.0)], "i long, batch string, v double"), order_by="i")


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_left_and_inner(left, spark):
    right = spark.createDataFrame([("A", "x"), (None, "y")], "batch string, treatment string")
    assert rows(left.left_join(right, by="batch").select(obs=["i", "treatment"]).obs_frame(), "i") == [(0, "x"), (1, None), (2, "y"), (3, "x")]
    assert rows(left.left_join(right, by="batch", na_matches="never").select(obs=["i", "treatment"]).obs_frame(), "i") == [(0, "x"), (1, None), (2, None), (3, "x")]
    assert rows(left.inner_join(right).select(obs="i").obs_frame(), "i") == [(0,), (2,), (3,)]
    assert rows(left.semi_join(right, by="batch").select(obs="i").obs_frame(), "i") == [(0,), (2,), (3,)]
    assert rows(left.anti_join(right, by="batch").select(obs="i").obs_frame(), "i") == [(1,)]
    assert rows(left.left_join({"batch": ["B"], "v": [9.0]}, by="batch").select(obs=["i", "v", "v_right"]).obs_frame(), "i")[1] == (1, 2.0, 9.0)


def test_relationships(left, spark):
    twice = spark.createDataFrame([("A", 1), ("A", 2), ("C", 3)], "batch string, w int")
    for policy in ({}, {"multiple": "all", "relationship": "many-to-many"}, {"multiple": "all", "relationship": "many-to-one"}, {"relationship": "no"}, {"multiple": "first", "unmatched": "error"}, {"na_matches": "maybe"}):
        with pytest.raises(JoinRelationshipError):
            left.left_join(twice, by="batch", **policy)
    got = left.left_join(twice, by="batch", multiple="first", right_order=["w"]).select(obs=["i", "w"]).obs_frame()
    assert rows(got, "i") == [(0, 1), (1, None), (2, None), (3, 1)]
    with pytest.raises(JoinRelationshipError):
        left.left_join(twice.where("w = 1"), by="batch", relationship="one-to-one")
    with pytest.raises(JoinRelationshipError):
        left.right_join(twice.where("w > 1"), by="batch")
    with pytest.raises(JoinRelationshipError):
        left.full_join(spark.createDataFrame([("A", 1), ("B", 1), (None, 1), ("D", 1)], "batch string, w int"), by="batch")
    whole = spark.createDataFrame([("B", 1), (None, 2), ("A", 3)], "batch string, w int")
    out = left.right_join(whole, by="batch", right_order=["w"])
    assert [r["i"] for r in out.obs_frame(ordered=True).collect()] == [1, 2, 0, 3]
    with pytest.raises(DuplicateNameError):
        left.left_join(whole.withColumn("v", F.lit(1)), by="batch", suffixes=("", ""))
    with pytest.raises(UnknownColumnError):
        left.left_join(whole, by="nothing")


def test_grouped_join_follows_suffix(left, spark):
    g = left.group_by(obs="batch").left_join(spark.createDataFrame([(0, "q")], "i long, batch string"), by="i", suffixes=("_l", "_r"))
    assert g.group_vars() == ["batch_l"]


def test_nest_chop(spark):
    df = spark.createDataFrame([(0, "b", 1), (1, "a", None), (2, "b", 3)], "i int, k string, v int")
    nested = ax.nest(df, by="k", order_by="i")
    assert [(r["k"], [x["v"] for x in r["data"]]) for r in nested.collect()] == [("b", [1, 3]), ("a", [None])]
    assert rows(ax.unnest(nested, "data"), "i") == [("b", 0, 1), ("a", 1, None), ("b", 2, 3)]
    assert rows(ax.chop(df.drop("i").withColumn("i", F.col("v")), ["v"], by="k", order_by="i")) == [("b", [1, 3]), ("a", [None])]
    lists = spark.createDataFrame([(1, [1, 2], ["x"]), (2, [], None), (3, None, ["y", "z"])], "i int, a array<int>, b array<string>")
    assert rows(ax.unchop(lists, ["a", "b"]), "i", "b") == [(1, 2, None), (1, 1, "x"), (3, None, "y"), (3, None, "z")]
    assert ax.unchop(lists, ["a", "b"], keep_empty=True).count() == 5
    assert rows(ax.unnest_longer(lists.select("i", "a"), "a", indices_to="k", keep_empty=True), "i", "k") == [(1, 1, 0), (1, 2, 1), (2, None, 0), (3, None, 0)]
    assert ax.unnest_wider(lists.select("i", "a"), "a").columns == ["i", "0", "1"]
    maps = spark.createDataFrame([({"p": 1},), ({"q": 2, "p": 3},)], "m map<string,int>")
    assert sorted(rows(ax.unnest_wider(maps, "m")), key=str) == [(1, None), (3, 2)]
    assert sorted(rows(ax.hoist(maps, "m", q="q").select("q")), key=str) == [(2,), (None,)]
    assert rows(ax.hoist(lists, "a", last=-1).select("i", "last"), "i") == [(1, 2), (2, None), (3, None)]


def test_pack_separate_unite(spark):
    df = spark.createDataFrame([("A_1", "A", 1, 1.0), ("B_2", None, 2, None), (None, "B", 3, 3.0)], "sample string, batch string, replicate long, value double")
    packed = ax.pack(df, "p", ["batch", "replicate"])
    assert packed.columns == ["sample", "p", "value"] and ax.unpack(packed, "p").columns == df.columns
    assert ax.unpack(packed, "p", names_sep="_", remove=False).columns == ["sample", "p", "value", "p_batch", "p_replicate"]
    assert rows(ax.separate(df, "sample", ["s", "r"]).select("s", "r")) == [("A", "1"), ("B", "2"), (None, None)]
    assert rows(ax.separate(df, "sample", ["s"]).select("s")) == [("A",), ("B",), (None,)]
    assert rows(ax.unite(df, "u", ["batch", "replicate"]).select("u")) == [("A_1",), ("_2",), ("B_3",)]
    assert rows(ax.unite(df, "u", ["batch", "replicate"], na_rm=True).select("u")) == [("A_1",), ("2",), ("B_3",)]
    assert ax.unite(df, "u", ["batch", "replicate"]).columns == ["sample", "u", "value"]
    assert rows(ax.extract(df, "sample", ["l", "n", "more"], r"([A-Z])_(\d)").select("l", "n", "more")) == [("A", "1", None), ("B", "2", None), (None, None, None)]
    assert ax.drop_na(df).count() == 1 and ax.drop_na(df, "batch").count() == 2
    genes = spark.createDataFrame([(1, "a,b", "1,2"), (2, None, None)], "i int, g string, h string")
    assert rows(ax.separate_rows(genes, ["g", "h"]), "i", "g") == [(1, "a", "1"), (1, "b", "2"), (2, None, None)]
    with pytest.raises(Exception, match="unlike"):
        ax.separate_rows(spark.createDataFrame([("a,b", "1")], "g string, h string"), ["g", "h"]).collect()


def test_fill_and_pivots(spark):
    df = spark.createDataFrame([(0, None), (1, 5), (2, None), (3, 7)], "i int, v int")
    got = lambda how: [r["v"] for r in ax.fill(df, "v", how, order_by="i").orderBy("i").collect()]
    assert got("down") == [None, 5, 5, 7] and got("up") == [5, 5, 7, 7] and got("downup") == [5, 5, 5, 7]
    with pytest.raises(SelectionError):
        ax.fill(df, "v")
    long = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "y", 3)], "id int, k string, v int")
    assert rows(ax.pivot_wider(long, id_cols="id", names_from="k", values_from="v"), "id") == [(1, 1, 2), (2, None, 3)]
    with pytest.raises(DuplicateNameError):
        ax.pivot_wider(long.union(long), id_cols="id", names_from="k", values_from="v")
    assert ax.pivot_longer(spark.createDataFrame([(1, 2, 3)], "id int, a int, b int"), ["a", "b"]).count() == 2
    with pytest.raises(NameRepairError):
        ax.pivot_longer(spark.createDataFrame([(1, 2, "3")], "id int, a int, b string"), ["a", "b"])


def test_utilities(spark):
    t = AxisTable(spark.createDataFrame([("r0", "s1", "d", 1), ("r1", "s1", "d", 2), ("r2", "s2", "e", 3), ("r0", "s2", "e", 4)], "name string, sample string, donor string, v int"), order_by="v", obs_name="name")
    assert rows(ax.sample_meta(t, "sample", include=["donor"])) == [("s1", "d"), ("s2", "e")]
    with pytest.raises(SelectionError):
        ax.sample_meta(t, "sample", include=["v"])
    assert rows(ax.sample_meta(t, "sample", include=["v"], on_conflict="first")) == [("s1", 1), ("s2", 3)]
    assert rows(ax.name_duplicates(t)) == [("r0", 2, [0, 3])]
    with pytest.raises(DuplicateNameError):
        ax.add_name_prefix(t, "p")
    u = t.slice_head(3)
    assert sorted(r["name"] for r in ax.add_name_prefix(u, "p").obs_frame().collect()) == ["p_r0", "p_r1", "p_r2"]
    assert sorted(r["name"] for r in ax.replace_name_suffix(u, "0", "9").obs_frame().collect()) == ["r1", "r2", "r9"]
    assert sorted(r["name"] for r in ax.rename_obs_names(u, {"z": "r1"}).obs_frame().collect()) == ["r0", "r2", "z"]
    assert sorted(r["name"] for r in ax.rename_obs_names(u, str.upper).obs_frame().collect()) == ["R0", "R1", "R2"]
    p = ax.store_palette(t, "sample", {"s1": "#1", "s2": "#2"})
    assert ax.get_palette(p, "sample") == {"s1": "#1", "s2": "#2"}
    with pytest.raises(SizeMismatchError):
        ax.store_palette(t, "sample", ["#1"])
    assert rows(ax.add_sample_meta(t, {"id": ["s1", "s2"], "age": [5, 6]}, sample="sample", by="id").select(obs=["v", "age"]).obs_frame(), "v") == [(1, 5), (2, 5), (3, 6), (4, 6)]
