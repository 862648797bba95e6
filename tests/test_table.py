"""Verbs on small fixtures: five observations and four features, and six rows in groups with missing keys."""

import pytest
from pyspark.sql import functions as F

import axisframe as ax
from axisframe import AxisTable, col
from axisframe.errors import AxisFrameError, DuplicateNameError, IncompatibleAxisError, JoinRelationshipError, NameRepairError, SelectionError, UnknownColumnError, UnknownSourceError

X = [[1, 0, 5, 2], [2, 3, 0, 1], [0, 1, 4, 0], [5, 2, 3, 8], [3, 0, 1, 4]]
PCA = [[0.1, 1], [-0.2, 0], [0.3, -1], [1, 2], [0.5, 1.5]]


@pytest.fixture(scope="module")
def cells(spark):
    rows = [(f"c{i}", b, s, t, [float(v) for v in X[i]], [10.0 * v for v in X[i]], [float(v) for v in PCA[i]]) for i, (b, s, t) in enumerate(zip("AABBA", [1.0, 2.0, 0.5, 3.0, 2.5], ["T", "B", "T", "Mono", "B"]))]
    obs = spark.createDataFrame(rows, "obs_name string, batch string, score double, cell_type string, x array<double>, counts array<double>, pca array<double>")
    var = spark.createDataFrame([("g0", "rna", "chr1", 100, [0.5, 2.0]), ("g1", "rna", "chr2", 200, [-0.1, 3.0]), ("g2", "protein", "chr1", 150, [0.3, 1.0]), ("g3", "rna", "chr3", 80, [1.2, 0.0])], "var_name string, feature_type string, chrom string, length long, loadings array<double>")
    return AxisTable(obs, order_by="obs_name", x="x", layers={"counts": "counts"}, obsm={"X_pca": "pca"}, var=var, var_order_by="var_name", varm={"loadings": "loadings"}, obs_name="obs_name")


@pytest.fixture(scope="module")
def groups(spark):
    rows = list(zip(range(6), ["b", "a", "b", None, "a", "b"], [3, 2, 1, 5, 4, 3], [1, None, 3, 4, None, 6], [True, None, False, True, False, None]))
    return AxisTable(spark.createDataFrame(rows, "pos long, group string, value long, nullable long, flag boolean"), order_by="pos")


def names(table, column="obs_name"):
    return [r[column] for r in table.obs_frame(ordered=True).collect()]


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()]


def test_filter_sources_intersect(cells):
    assert names(cells.filter(obs=col("score") > 1, x=col("g0") >= 3)) == ["c3", "c4"]
    assert names(cells.filter(x=col("g1") > 20, layer="counts")) == ["c1"]
    assert names(cells.filter(obsm={"X_pca": col("0") > 0.2})) == ["c2", "c3", "c4"]
    assert names(cells.filter(obs_names=["c4", "c1"])) == ["c1", "c4"]


def test_filter_aggregate_and_groups(cells):
    assert names(cells.filter(obs=col("score") > ax.mean("score"))) == ["c1", "c3", "c4"]
    assert names(cells.filter(x=col("g0") == ax.max("g0"))) == ["c3"]
    grouped = cells.group_by(obs="batch").filter(obs=ax.row_number() == 1)
    assert names(grouped) == ["c0", "c2"]


def test_filter_var_axis_keeps_alignment(cells):
    out = cells.filter(var=col("feature_type") == "rna", varm={"loadings": col("0") > 0})
    assert [n for n, _ in out.features()] == ["g0", "g3"]
    assert values(out.to_df(x=ax.everything(), ordered=True), "g0", "g3") == [(r[0], r[3]) for r in X]


def test_select_rename_relocate(cells):
    assert cells.select(obs=["score", ax.starts_with("cell")]).obs_frame().columns == ["score", "cell_type"]
    out = cells.select(x=["g3", "g0"]).rename(obs={"lot": "batch"}, x={"first": "g3"})
    assert [n for n, _ in out.features()] == ["first", "g0"] and "lot" in out.obs_frame().columns
    assert cells.relocate(obs="cell_type", after="obs_name").obs_frame().columns == ["obs_name", "cell_type", "batch", "score"]
    assert [n for n, _ in cells.relocate(x="g2").features()] == ["g2", "g0", "g1", "g3"]
    with pytest.raises(DuplicateNameError):
        cells.rename(obs={"score": "batch"})
    with pytest.raises(SelectionError):
        cells.relocate(obs="score", before="batch", after="batch")
    with pytest.raises(UnknownColumnError):
        cells.select(obs="nothing")


def test_mutate_is_sequential_within_a_source(cells):
    out = cells.mutate(obs={"a": col("score") * 2, "b": col("a") + ax.mean("a"), "a2": col("b") - col("a")}, x={"g": col("g0") + col("g1")})
    assert values(out.obs_frame(ordered=True), "a2") == [pytest.approx(3.6)] * 5
    assert values(out.obs_frame(ordered=True), "g") == [1, 5, 1, 7, 3]
    assert cells.transmute(obs={"z": ax.lit(1)}).obs_frame().columns == ["z"]
    again = cells.mutate(obs={"score": col("score") + 1, "twice": col("score") * 2})
    assert values(again.obs_frame(ordered=True), "twice") == [4.0, 6.0, 3.0, 8.0, 7.0]


def test_mutated_key_and_order(groups):
    out = groups.group_by(obs="group").mutate(obs={"group": ax.lit("z"), "k": ax.row_number()})
    assert values(out.ungroup().obs_frame(ordered=True), "k") == [1, 1, 2, 1, 2, 3]
    out = groups.mutate(obs={"pos": -col("pos"), "k": ax.row_number()})
    assert sorted(values(out.obs_frame(), "pos", "k")) == [(-5, 6), (-4, 5), (-3, 4), (-2, 3), (-1, 2), (0, 1)]


def test_group_order_is_first_seen_with_missing_key(groups):
    g = groups.group_by(obs="group")
    assert values(g.group_keys(), "group") == ["b", "a", None]
    assert values(g.group_data(), "group", ".rows") == [("b", [0, 2, 5]), ("a", [1, 4]), (None, [3])]
    assert values(g.count(), "group", "n") == [("b", 3), ("a", 2), (None, 1)]
    assert values(g.arrange(obs="value").ungroup().obs_frame(ordered=True), "pos") == [2, 0, 5, 1, 4, 3]
    assert values(g.slice_max("value", 1).ungroup().obs_frame(ordered=True), "pos") == [0, 4, 3]
    assert values(g.slice_tail(1).ungroup().obs_frame(ordered=True), "pos") == [5, 4, 3]
    assert values(g.slice(1, -1).ungroup().obs_frame(ordered=True), "pos") == [2, 5, 4, 4, 3]
    assert [k["group"] for k, _ in g] == ["b", "a", None]
    assert values(g.mutate(obs={"m": ax.mean("value")}).ungroup().obs_frame(ordered=True), "pos") == list(range(6))


def test_summarize(groups, cells):
    out = groups.summarize(obs={"n": ax.n(), "s": ax.sum("nullable"), "u": ax.n_distinct("nullable"), "f": ax.first("nullable"), "l": ax.last("nullable"), "q": ax.nth("value", -1), "w": ax.nth("value", 9, -1)}, by="group")
    assert [tuple(r) for r in out.collect()] == [("b", 3, 10, 3, 1, 6, 3, -1), ("a", 2, 0, 1, None, None, 4, -1), (None, 1, 4, 1, 4, 4, 5, -1)]
    both = cells.summarize(obs={"n": ax.n()}, x={"m": ax.mean("g0")}, by="batch")
    assert [tuple(r) for r in both.collect()] == [("A", 3, 2.0), ("B", 2, 2.5)]
    assert [tuple(r) for r in cells.summarize(var={"total": ax.sum("length")}, by="feature_type").collect()] == [("rna", 380), ("protein", 150)]
    assert groups.summarize(obs={"any": col("flag").any(), "all": col("flag").all()}).first()["any"]
    with pytest.raises(IncompatibleAxisError):
        cells.summarize(obs={"n": ax.n()}, var={"m": ax.n()})
    with pytest.raises(SelectionError):
        groups.summarize(obs={"v": col("value")}, by="group")


def test_counts(groups):
    assert values(groups.count("group", sort=True), "n") == [3, 2, 1]
    assert values(groups.count("group", wt="nullable"), "n") == [10, 0, 4]
    assert values(groups.add_count("group").obs_frame(ordered=True), "n") == [3, 2, 3, 1, 2, 3]
    assert groups.tally().first()["n"] == 6


def test_distinct_and_slices(groups):
    assert values(groups.distinct(obs="group").obs_frame(ordered=True), "pos") == [0, 1, 3]
    assert groups.distinct(obs="group", keep_all=False).obs_frame().columns == ["group"]
    assert values(groups.slice(4, [0, 0], -1).obs_frame(ordered=True), "pos") == [4, 0, 0, 5]
    assert values(groups.slice(slice(1, 4, 2)).obs_frame(ordered=True), "pos") == [1, 3]
    assert values(groups.slice([True, False, False, False, False, True]).obs_frame(ordered=True), "pos") == [0, 5]
    assert values(groups.slice_min("nullable", 2).obs_frame(ordered=True), "pos") == [0, 2]
    assert values(groups.slice_max("nullable", 5).obs_frame(ordered=True), "pos") == [5, 3, 2, 0, 1]
    assert values(groups.slice_head(2).obs_frame(ordered=True), "pos") == [0, 1]
    assert values(groups.slice_tail(2).obs_frame(ordered=True), "pos") == [4, 5]
    with pytest.raises(SelectionError):
        groups.slice(6)
    with pytest.raises(SelectionError):
        groups.slice_head(-1)


def test_slice_sample(groups):
    a = values(groups.slice_sample(3, random_state=1).obs_frame(), "pos")
    assert len(a) == 3 and sorted(a) == sorted(values(groups.slice_sample(3, random_state=1).obs_frame(), "pos"))
    assert groups.slice_sample(prop=0.5).obs_frame().count() == 3
    assert groups.slice_sample(10, replace=True, random_state=2).obs_frame().count() == 10
    assert groups.group_by(obs="group").slice_sample().obs_frame().count() == 3
    for bad in ({"n": 7}, {"n": 1, "prop": 0.5}, {"n": -1}):
        with pytest.raises(SelectionError):
            groups.slice_sample(**bad)


def test_arrange_missing_last_and_stable(groups):
    assert values(groups.arrange(obs="nullable").obs_frame(ordered=True), "pos") == [0, 2, 3, 5, 1, 4]
    assert values(groups.arrange(obs=ax.desc("nullable")).obs_frame(ordered=True), "pos") == [5, 3, 2, 0, 1, 4]
    assert values(groups.arrange(obs=["group", ax.desc("value")]).obs_frame(ordered=True), "pos") == [4, 1, 0, 5, 2, 3]
    desc_text = groups.arrange(obs=ax.desc("group"))
    assert desc_text.summarize(obs={"f": ax.first("pos")}).first()["f"] == 0


def test_extraction(cells):
    assert values(cells.pull(x="g2"), "g2") == [5, 0, 4, 3, 1]
    assert values(cells.pull(obsm={"X_pca": "1"}), "1") == [1, 0, -1, 2, 1.5]
    assert cells.to_df(obs="batch", x=["g0"], obsm={"X_pca": ["0"]}).columns == ["batch", "g0", "X_pca_0"]
    tidy = cells.to_tidy(obs="batch", x=["g0", "g1"])
    assert tidy.columns == ["obs_name", "feature", "value", "batch"] and tidy.count() == 10
    assert cells.pivot_longer(obs="batch", x=["g0"]).columns == ["obs_name", "batch", "name", "value"]
    assert cells.as_frame("varm", key="loadings").columns == ["var_name", "0", "1"]
    with pytest.raises(SelectionError):
        cells.to_tidy()
    with pytest.raises(NameRepairError):
        cells.to_tidy(obs="batch", x="g0", feature="batch")
    with pytest.raises(UnknownSourceError):
        cells.pull(obsm={"other": "0"})
    with pytest.raises(SelectionError):
        cells.pull(obs="batch", x="g0")


def test_budget(cells):
    assert cells.to_df(x=["g0", "g1"], max_matrix_values=10).count() == 5
    with pytest.raises(AxisFrameError):
        cells.to_df(x=["g0", "g1"], max_matrix_values=9)
    with pytest.raises(AxisFrameError):
        cells.filter(x=col("g0") > 1, max_matrix_values=-1)


def test_sparse_and_wide_layouts(spark, cells):
    rows = [(i, {"indices": [k for k, v in enumerate(r) if v], "values": [float(v) for v in r if v]}, *map(float, r)) for i, r in enumerate(X)]
    df = spark.createDataFrame(rows, "i long, x struct<indices:array<int>,values:array<double>>, a double, b double, c double, d double")
    want = [tuple(map(float, r)) for r in X]
    sparse = AxisTable(df, order_by="i", x="x", layout="sparse_struct", features=["g0", "g1", "g2", "g3"])
    assert values(sparse.to_df(x=ax.everything(), ordered=True), "g0", "g1", "g2", "g3") == want
    wide = AxisTable(df.drop("x"), order_by="i", x=["a", "b", "c", "d"], layout="wide")
    assert values(wide.to_df(x=ax.everything(), ordered=True), "a", "b", "c", "d") == want
    assert sorted(values(sparse.feature_means(), "feature", "mean")) == sorted(values(cells.feature_means(), "feature", "mean"))


def test_pairwise_and_unstructured(spark):
    obs = spark.createDataFrame([("a", 1), ("b", 2)], "name string, v int")
    pairs = spark.createDataFrame([("a", "b", 0.5)], "row string, col string, value double")
    t = AxisTable(obs, order_by="name", obs_name="name", obsp={"near": pairs}, uns={"info": {"k": [1, 2]}, "text": "no table"})
    assert values(t.to_df(obs="name", obsp={"near": ["b"]}, ordered=True), "near_b") == [0.5, 0.0]
    assert values(t.pull(uns={"info": "k"}), "k") == [1, 2]
    with pytest.raises(UnknownSourceError):
        t.as_frame("uns", key="text")


def test_needs_order(spark):
    t = AxisTable(spark.createDataFrame([(1,)], "v int"))
    with pytest.raises(SelectionError):
        t.mutate(obs={"k": ax.row_number()})
    with pytest.raises(TypeError):
        bool(col("v") > 1)


def test_pushdown_and_no_single_partition_aggregate(spark, tmp_path):
    spark.range(100).selectExpr("id", "id % 7 as g", "id * 2 as v", "'x' as unused").write.parquet(f"{tmp_path}/t")
    t = AxisTable.from_parquet(spark, f"{tmp_path}/t", order_by="id")
    plan = t.filter(obs=col("v") > 10).select(obs="g").obs_frame()._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(v), GreaterThan(v,10)]" in plan and "unused" not in plan.split("ReadSchema")[-1].splitlines()[0]
    plan = t.mutate(obs={"c": col("v") - ax.mean("v")}).obs_frame()._jdf.queryExecution().toString()
    assert "Window" not in plan.split("== Physical Plan ==")[-1]


def test_running_aggregates_in_parts(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101 / 3.0 if i % 9 else None, i % 4 == 0) for i in range(200)], "i long, v double, b boolean")
    new = {"r": ax.row_number(), "s": ax.cum_sum("v"), "lo": ax.cum_min("v"), "hi": ax.cum_max("v"), "p": ax.cum_prod(1 + col("v") / 1e4), "c": col("v").cum_count(), "m": ax.cummean("v"), "a": ax.cumall(~col("b")), "x": ax.max(ax.cum_sum("v"))}
    one, many = (AxisTable(df, order_by="i", order_parts=k).mutate(obs=new) for k in (1, 7))
    for a, b in zip(one.obs_frame(ordered=True).collect(), many.obs_frame(ordered=True).collect()):
        assert [pytest.approx(x) if isinstance(x, float) else x for x in a] == list(b)
    back = AxisTable(df, order_by="i", order_parts=5).arrange(obs=ax.desc("v")).mutate(obs={"r": ax.row_number()})
    assert values(back.obs_frame(ordered=True), "r") == list(range(1, 201))
    assert values(AxisTable(df, order_by="i", order_parts=5).slice(0, -1, 7).obs_frame(ordered=True), "i") == [0, 199, 7]


def test_written_and_read_back(spark, cells, tmp_path):
    cells.mutate(obs={"s2": col("score") * 2}).write_parquet(f"{tmp_path}/m")
    back = AxisTable.from_parquet(spark, f"{tmp_path}/m/obs", order_by="obs_name", x="matrix__x", features=["g0", "g1", "g2", "g3"])
    assert values(back.filter(x=col("g0") >= 3).obs_frame(ordered=True), "s2") == [6.0, 5.0]
    assert F is not None


def test_feature_axis_verbs(cells):
    by_length = cells.arrange(var=ax.desc("length"))
    assert [n for n, _ in by_length.features()] == ["g1", "g2", "g0", "g3"]
    assert values(by_length.slice_head(2, axis="var").to_df(x=ax.everything(), ordered=True), "g1", "g2") == [(r[1], r[2]) for r in X]
    assert [n for n, _ in cells.slice(3, 0, axis="var").features()] == ["g3", "g0"]
    assert [n for n, _ in cells.slice_max("length", 1, axis=1).features()] == ["g1"]
    assert [n for n, _ in cells.distinct(var="feature_type").features()] == ["g0", "g2"]
    assert [n for n, _ in cells.filter(var_names=["g2", "g3"]).features()] == ["g2", "g3"]
    assert values(cells.mutate(var={"kb": col("length") / 1000}, varm={"loadings": {"l0": col("0")}}).var_frame(ordered=True), "kb", "l0") == [(0.1, 0.5), (0.2, -0.1), (0.15, 0.3), (0.08, 1.2)]
    assert values(cells.count("feature_type", axis="var"), "n") == [3, 1]
    grouped = cells.group_by(var="feature_type").slice_max("length", 1)
    assert [n for n, _ in grouped.features()] == ["g1", "g2"]
    with pytest.raises(IncompatibleAxisError):
        grouped.mutate(obs={"a": ax.lit(1)})
    with pytest.raises(IncompatibleAxisError):
        cells.group_by(obs="batch", var="chrom")
    with pytest.raises(SelectionError):
        cells.group_by(obs=col("score") + 1)
    joined = cells.left_join({"chrom": ["chr1", "chr2"], "arm": ["p", "q"]}, by="chrom", axis="var")
    assert values(joined.var_frame(ordered=True), "arm") == ["p", "q", "p", None]
    assert [n for n, _ in cells.semi_join({"chrom": ["chr1"]}, axis="var").features()] == ["g0", "g2"]


def test_grouped_columns(groups):
    g = groups.group_by(obs="group")
    assert g.select(obs="value").obs_frame().columns == ["group", "value"]
    assert g.rename(obs={"k": "group"}).group_vars() == ["k"]
    assert g.transmute(obs={"twice": col("value") * 2}).obs_frame().columns == ["group", "twice"]
    assert g.relocate(obs="value").obs_frame().columns[0] == "value"
    assert g.distinct(obs="value", keep_all=False).obs_frame().columns == ["group", "value"]
    assert values(g.add_count().ungroup().obs_frame(ordered=True), "n") == [3, 2, 3, 1, 2, 3]
    assert values(g.summarize(obs={"m": ax.mean("value")}), "m") == [pytest.approx(7 / 3), 3.0, 5.0]
    assert g.pipe(lambda t, k: (type(t).__name__, k), 3) == ("GroupedAxisTable", 3)
    assert groups.pipe((lambda a, table: table.tally().first()["n"] + a, "table"), 1) == 7
    assert groups.group_by() is groups


def test_names_in_expressions(cells):
    assert names(cells.filter(obs=ax.obs_names == "c2")) == ["c2"]
    nested = cells.nest_by("batch", obs="score").collect()
    assert [(r["batch"], [x["score"] for x in r["data"]]) for r in nested] == [("A", [1.0, 2.0, 2.5]), ("B", [0.5, 3.0])]
    whole = cells.summarize(obs={"n": ax.n()}, by={"high": col("score") > 1})
    assert sorted(tuple(r) for r in whole.collect()) == [(False, 2), (True, 3)]
    with pytest.raises(DuplicateNameError):
        cells.summarize(obs={"n": ax.n()}, by={"batch": col("score") > 1})


# -- order, scale and round trips ------------------------------------------------------------------------------------------


def physical(df):
    return df._jdf.queryExecution().toString().split("== Physical Plan ==")[-1]


def test_counts_sorted_with_ties_as_first_seen(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate("zabzabcdc")], "i long, k string").repartition(4)
    t = AxisTable(df, order_by="i")
    assert values(t.count("k", sort=True), "k", "n") == [("z", 2), ("a", 2), ("b", 2), ("c", 2), ("d", 1)]
    assert values(t.group_by(obs="k").count(sort=True), "k") == ["z", "a", "b", "c", "d"]
    assert values(t.arrange(obs=ax.desc("i")).count("k", sort=True, wt="i", name="w"), "k", "w") == [("c", 14), ("d", 7), ("b", 7), ("a", 5), ("z", 3)]


def test_right_joins_have_the_right_order(spark):
    left = AxisTable(spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "i long, k string"), order_by="i")
    right = {"k": ["c", "a", "b"], "w": [1, 2, 3]}
    assert values(left.right_join(right, by="k").obs_frame(ordered=True), "i") == [2, 0, 1]
    frame = spark.createDataFrame([(k, w) for k, w in zip(right["k"], right["w"])], "k string, w long")
    with pytest.raises(JoinRelationshipError, match="right_order"):
        left.right_join(frame, by="k")
    assert values(left.right_join(frame, by="k", right_order="w").obs_frame(ordered=True), "i", "w") == [(2, 1), (0, 2), (1, 3)]
    table = AxisTable(frame, order_by="w").arrange(obs=ax.desc("w"))
    out = left.right_join(table, by="k")
    assert values(out.obs_frame(ordered=True), "i") == [1, 0, 2] and out.obs_frame().columns == ["i", "k", "w"]
    twice = spark.createDataFrame([("a", 5), ("a", 4)], "k string, w long")
    with pytest.raises(JoinRelationshipError, match="right_order"):
        left.left_join(twice, by="k", multiple="first")
    assert values(left.left_join({"k": ["a", "a"], "w": [5, 4]}, by="k", multiple="first").obs_frame(ordered=True), "w") == [5, None, None]


def test_unknown_names_are_no_renames(cells):
    with pytest.raises(UnknownColumnError, match="nobody"):
        ax.rename_obs_names(cells, {"x": "nobody"})
    assert values(ax.rename_obs_names(cells, {"x": "c1"}).obs_frame(ordered=True), "obs_name")[1] == "x"
    assert values(ax.rename_var_names(cells, str.upper).var_frame(ordered=True), "var_name")[0] == "G0"


def test_whole_tables_are_written_and_read(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2, float(i), -float(i), [1.0 * i, 2.0 * i], [0.5, 1.5]) for i in range(6)], "i long, g long, w0 double, w1 double, pca array<double>, counts array<double>")
    var = spark.createDataFrame([("w0", "a", [1.0, 2.0]), ("w1", "b", [3.0, 4.0])], "name string, kind string, load array<double>")
    pairs = spark.createDataFrame([(0, 1, 0.5)], "a long, b long, v double")
    t = AxisTable(df, order_by="i", x=["w0", "w1"], layout="wide", obsm={"pca": "pca"}, var=var, var_name="name", varm={"load": "load"}, obsp={"near": pairs}, varp={"far": pairs}, uns={"note": "n", "levels": {"a": [1, 2]}, "side": pairs}, obs_name="i")
    t = t.arrange(obs=["g", ax.desc("i")]).select(x=["w1", "w0"])
    t.write_parquet(f"{tmp_path}/t")
    back = AxisTable.read_parquet(spark, f"{tmp_path}/t")
    assert values(back.to_df(obs="i", x=ax.everything(), obsm={"pca": "1"}, obsp={"near": [1]}, ordered=True), "i", "w1", "w0", "pca_1", "near_1") == [(4, -4.0, 4.0, 8.0, 0.0), (2, -2.0, 2.0, 4.0, 0.0), (0, 0.0, 0.0, 0.0, 0.5), (5, -5.0, 5.0, 10.0, 0.0), (3, -3.0, 3.0, 6.0, 0.0), (1, -1.0, 1.0, 2.0, 0.0)]
    assert [n for n, _ in back.features()] == ["w1", "w0"] and back.obs_frame().columns == t.obs_frame().columns
    assert values(back.as_frame("varm", key="load"), "1") == values(t.as_frame("varm", key="load"), "1")
    assert back.as_frame("varp", key="far").count() == 1 and values(back.as_frame("uns", key="levels"), "a") == [1, 2] and back._uns["note"] == "n" and back.as_frame("uns", key="side").count() == 1
    back.write_parquet(f"{tmp_path}/u", partition_by=["g"])
    again = AxisTable.read_parquet(spark, f"{tmp_path}/u")
    assert values(again.obs_frame(ordered=True), "i", "g") == [(4, 0), (2, 0), (0, 0), (5, 1), (3, 1), (1, 1)]
    other = AxisTable(spark.createDataFrame([(1, [1, 2])], "i long, m array<int>"), order_by="i", x="m")
    other.write_parquet(f"{tmp_path}/v")
    assert AxisTable.read_parquet(spark, f"{tmp_path}/v").to_df(x=["f1"]).first()[0] == 2


def test_group_aggregates_are_joined_not_windows(spark):
    df = spark.createDataFrame([(i, i % 3 if i % 7 else None, float(i)) for i in range(40)], "i long, g long, v double")
    t = AxisTable(df, order_by="i")
    g = t.group_by(obs="g")
    out = g.mutate(obs={"c": col("v") - ax.mean("v"), "u": ax.n_distinct("v"), "m": ax.median("v")}).ungroup().obs_frame()
    assert "Window" not in physical(out) and out.count() == 40
    by = {}
    for i in range(40):
        by.setdefault(i % 3 if i % 7 else None, []).append(float(i))
    got = {r["i"]: (r["c"], r["u"]) for r in out.collect()}
    assert all(got[int(v)] == (pytest.approx(v - sum(vs) / len(vs)), len(vs)) for vs in by.values() for v in vs)
    assert "Window" not in physical(t.add_count("g").obs_frame())
    kept = g.filter(obs=col("v") > ax.mean("v")).ungroup().obs_frame()
    assert sorted(values(kept, "i")) == sorted(int(v) for vs in by.values() for v in vs if v > sum(vs) / len(vs))
    # beside functions of the order, which bring the group together anyway, they are windows of one shuffle
    both = g.mutate(obs={"c": col("v") - ax.mean("v"), "k": ax.row_number()}).ungroup().obs_frame()
    assert "Join" not in physical(both)
    deep = t
    for k in range(5):  # a frame is read twice for each join, so their number is bounded
        deep = deep.group_by(obs="g").mutate(obs={f"m{k}": ax.max("v") + k}).ungroup()
    assert physical(deep.obs_frame()).count("Scan ExistingRDD") <= 4 and values(deep.obs_frame(ordered=True), "m4")[1] == 41.0
    over = t.transmute(obs={"i": col("i"), "a": ax.mean("v").over("g"), "b": ax.max("v")}).obs_frame()
    assert "Window" not in physical(over) and over.where("b = 39").count() == 40


def test_places_without_sorting_the_table(spark):
    df = spark.range(1000).selectExpr("id as i", "id * 2 as v")
    t = AxisTable(df, order_by="i")
    out = t.mutate(obs={"a": ax.nth("v", 3), "z": ax.nth("v", -2), "no": ax.nth("v", 2000, default=-1)}).slice_head(1).obs_frame()
    assert out.first()[2:] == (6, 1996, -1)
    assert "TakeOrderedAndProject" in physical(t.mutate(obs={"a": ax.nth("v", 3)}).obs_frame())
    assert "collect_list" not in physical(t.mutate(obs={"a": ax.nth("v", 3)}).obs_frame())
    assert t.summarize(obs={"a": ax.nth("v", 5), "n": ax.n()}).first()[:] == (10, 1000)
    empty = AxisTable(df.where("i < 0"), order_by="i")
    assert empty.summarize(obs={"a": ax.nth("v", 0, default=7)}).first()[0] == 7


def test_slices_are_conditions_on_positions(spark):
    df = spark.range(50).selectExpr("id as i", "id % 2 as g")
    t = AxisTable(df, order_by="i")
    everything = t.slice(slice(None))
    assert "Join" not in physical(everything.obs_frame()) and everything.obs_frame().count() == 50
    for s in (slice(3, 9), slice(-7, None), slice(2, -3, 4), slice(60, 90), slice(None, 5, 2), slice(-100, 3)):
        assert values(t.slice(s).obs_frame(ordered=True), "i") == list(range(50))[s], s
        got = t.group_by(obs="g").slice(s).ungroup().obs_frame(ordered=True)
        assert sorted(values(got, "i")) == sorted([*range(0, 50, 2)][s] + [*range(1, 50, 2)][s]), s
    assert values(t.slice(slice(8, 2, -2)).obs_frame(ordered=True), "i") == [8, 6, 4]
    assert values(t.slice(col("i") > 47).obs_frame(ordered=True), "i") == [48, 49]
    assert values(t.group_by(obs="g").slice(-1, 0, 0).ungroup().obs_frame(ordered=True), "i") == [48, 0, 0, 49, 1, 1]


def test_ranks_in_ranges_agree_with_one_window(spark):
    df = spark.createDataFrame([(i, (i * 37) % 23 if i % 9 else None, (i * 7) % 11) for i in range(300)], "i long, v long, w long")
    new = {"a": ax.min_rank("v"), "b": ax.max_rank("v", descending=True), "c": ax.average_rank("v"), "d": ax.dense_rank("v"), "e": ax.dense_rank("v", descending=True), "f": ax.percent_rank("w"), "g": ax.cume_dist("v"), "h": ax.ntile("v", 5), "k": col("v").rank("ordinal", descending=True)}
    one, many = (AxisTable(df, order_by="i", order_parts=k).mutate(obs=new).obs_frame(ordered=True).collect() for k in (1, 6))
    assert one == many


def test_neighbours_across_ranges(spark):
    """Lags, leads and rolling functions in ranges of the order agree with one window; a range too short falls back to it."""
    df = spark.createDataFrame([(i, (i * 37) % 101 / 3.0 if i % 9 else None, -i) for i in range(200)], "i long, v double, d long")
    new = {"a": ax.lag("v"), "b": ax.lead("v", 3, -1.0), "c": ax.lag("i", 9, 0), "s": col("v").rolling_sum(5, min_samples=1), "m": col("v").rolling_max(4), "t": col("v").diff() + ax.lead("i"), "r": ax.row_number(), "z": ax.max(ax.lag("i"))}
    for order in ("i", "d"):
        one, many = (AxisTable(df, order_by=order, order_parts=k).mutate(obs=new).obs_frame(ordered=True) for k in (1, 7))
        assert [[None if x is None else pytest.approx(x) for x in r] for r in one.collect()] == [list(r) for r in many.collect()]
    back = AxisTable(df, order_by="i", order_parts=6).arrange(obs=ax.desc("i"))
    assert values(back.mutate(obs={"w": ax.lag("i", 2)}).obs_frame(ordered=True), "w") == [None, None, *range(199, 1, -1)]
    short = AxisTable(df, order_by="i", order_parts=7).mutate(obs={"w": ax.lag("i", 60)}).obs_frame(ordered=True)
    assert values(short, "w") == [None] * 60 + list(range(140))


def test_exponential_means_of_long_groups(spark):
    import random

    r = random.Random(3)
    rows = [(i, i % 2, r.random() * 10 if r.random() > 0.2 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "i long, g long, v double")
    new = {"a": col("v").ewm_mean(0.9), "b": col("v").ewm_mean(com=1.5), "c": col("v").ewm_mean(half_life=300.0), "d": col("v").ewm_mean(span=9, adjust=False, ignore_nulls=True), "e": col("v").ewm_mean(alpha=1.0, min_samples=2)}
    got = AxisTable(df, order_by="i").group_by(obs="g").mutate(obs=new).ungroup().obs_frame(ordered=True).collect()
    how = {"a": (0.9, True, False, 1), "b": (0.4, True, False, 1), "c": (1 - 0.5 ** (1 / 300), True, False, 1), "d": (0.2, False, True, 1), "e": (1.0, True, False, 2)}
    for name, (alpha, adjust, ignore, least) in how.items():
        for g in (0, 1):
            s = w = 0.0
            seen = 0
            for row in (x for x in got if x["g"] == g):
                if row["v"] is None:
                    assert row[name] is None
                    if not ignore:
                        s, w = s * (1 - alpha), w * (1 - alpha)
                    continue
                seen += 1
                mine = 1.0 if adjust or seen == 1 else alpha
                s, w = s * (1 - alpha) + row["v"] * mine, w * (1 - alpha) + mine
                assert row[name] == (pytest.approx(s / w) if seen >= least else None), (name, row)
    with pytest.raises(SelectionError):
        col("v").ewm_mean()


def test_float_filters_reach_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i) if i % 5 else float("nan"), i % 3) for i in range(60)], "i long, v double, g long")
    df.write.parquet(f"{tmp_path}/f")
    t = AxisTable.from_parquet(spark, f"{tmp_path}/f", order_by="i")
    out = t.filter(obs=[(col("v") > 10) & (col("g") == 1), ax.col("v") != 13]).filter(obs=col("v") < 40)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = physical(out.obs_frame())
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThan(v,10" in plan and "LessThan(v,40" in plan and "EqualTo(g,1)" in plan
    assert sorted(values(out.obs_frame(), "i")) == [i for i in range(11, 40) if i % 5 and i % 3 == 1 and i != 13]
    mean = t.filter(obs=[col("v") > 10, col("v") > ax.mean("v")])  # the mean is of all rows
    assert sorted(values(mean.obs_frame(), "i")) == [i for i in range(60) if i % 5 and i > 30]
    changed = t.mutate(obs={"v": col("v") * 2}).filter(obs=col("v") > 10)
    assert sorted(values(changed.obs_frame(), "i")) == [i for i in range(6, 60) if i % 5]
    renamed = t.rename(obs={"w": "v"}).filter(obs=col("w") >= 58)
    assert sorted(values(renamed.obs_frame(), "i")) == [58, 59]


def test_python_aggregates_beside_others(spark):
    t = AxisTable(spark.createDataFrame([(i, i % 2, float(i)) for i in range(10)], "i long, g long, v double"), order_by="i")
    spread = col("v").map_batches(lambda v: float(v.max() - v.min()), returns_scalar=True)
    assert values(t.summarize(obs={"s": spread, "n": ax.n()}, by="g"), "s", "n") == [(8.0, 5), (8.0, 5)]
    assert t.summarize(obs={"s": spread}).first()[0] == 9.0
    assert set(values(t.group_by(obs="g").mutate(obs={"s": spread + ax.min("v")}).ungroup().obs_frame(), "s")) == {8.0, 9.0}


def test_groups_as_first_seen_in_ranges(spark, monkeypatch):
    """Places after a grouped arrange: the groups' first rows are found by an aggregation, and no task sorts all rows or a group."""
    from axisframe.plans import compiler

    monkeypatch.setattr(compiler, "RANGE_ROWS", 30)
    df = spark.createDataFrame([(i, "abcd"[(i * i) % 4], f"n{i * 29 % 83}", (i * 37) % 101 / 3.0 if i % 9 else None) for i in range(200)], "i long, g string, t string, v double")
    for by, order in ((None, lambda r: r["i"]), (ax.desc("t"), lambda r: (-int(ord(r["t"][1])), [-ord(c) for c in r["t"][2:]] + [1], r["i"]))):
        t = AxisTable(df, order_by="i")
        out = (t if by is None else t.arrange(obs=by)).group_by(obs="g").arrange(obs=ax.desc("v")).ungroup().mutate(obs={"place": ax.row_number()}).obs_frame()
        plan = physical(out)
        assert "SinglePartition" not in plan and plan.count("Window") == 1
        rows = sorted(df.collect(), key=order)
        seen = list(dict.fromkeys(r["g"] for r in rows))
        want = [r["i"] for r in sorted(rows, key=lambda r: (seen.index(r["g"]), r["v"] is None, -(r["v"] or 0)))]
        assert [r["i"] for r in sorted(out.collect(), key=lambda r: r["place"])] == want


def test_every_kind_of_order_in_ranges(spark, monkeypatch):
    """Without order_parts, ranges follow the rows: texts, falling orders, ties of leading keys and missing values as in one window."""
    from axisframe.plans import compiler

    df = spark.range(200).selectExpr("id as i", "if(id % 11 = 0, null, concat(repeat('é', cast(id % 3 as int)), 'ab', id % 5)) as t", "id % 2 = 0 as b", "case when id % 13 = 0 then double('NaN') when id % 7 > 0 then id % 7 / 2.0D end as v", "cast(id % 9 as decimal(20, 3)) as d", "timestamp_ntz'2020-01-01' + make_interval(0, 0, 0, id % 17) as n", "timestamp_seconds(id % 19 * 86400) as s", "encode(string(id % 23), 'utf-8') as y", "date_from_unix_date(id % 6) as e")
    one, auto = AxisTable(df, order_by="i", order_parts=1, nan="keep"), AxisTable(df, order_by="i", nan="keep")
    for rows, by in ((10, ["t", ax.desc("v")]), (10, [ax.desc("t"), "v", ax.desc("i")]), (40, [ax.desc("b"), ax.desc("n"), "y"]), (10, [ax.desc("d"), ax.desc("y"), "n"]), (10, [ax.desc("s"), "e"]), (10, [ax.desc("e"), "s"])):
        monkeypatch.setattr(compiler, "RANGE_ROWS", rows)
        want, got = (t.arrange(obs=by).mutate(obs={"place": ax.row_number()}).select(obs=["i", "place"]).obs_frame() for t in (one, auto))
        assert "SinglePartition" in physical(want) and "SinglePartition" not in physical(got)
        assert sorted(want.collect()) == sorted(got.collect())
