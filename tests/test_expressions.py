import pytest

import axisframe as ax
from axisframe import AxisTable, col
from axisframe.errors import DuplicateNameError, SelectionError, UnknownColumnError


@pytest.fixture(scope="module")
def frame(spark):
    return AxisTable(spark.createDataFrame(list(zip(range(6), [5, 2, 7, 2, 9, 5], [None, 2.5, 4.0, None, 1.5, 4.0], [False, False, True, False, True, False])), "pos long, x long, nullable double, flag boolean"), order_by="pos")


CASES = {
    "min_rank": (ax.min_rank("x"), [3, 1, 5, 1, 6, 3]),
    "max_rank": (ax.max_rank("x"), [4, 2, 5, 2, 6, 4]),
    "average_rank": (ax.average_rank("x"), [3.5, 1.5, 5.0, 1.5, 6.0, 3.5]),
    "dense_rank": (ax.dense_rank("x"), [2, 1, 3, 1, 4, 2]),
    "dense_rank_desc": (ax.dense_rank("x", descending=True), [3, 4, 2, 4, 1, 3]),
    "rank_missing": (ax.min_rank("nullable"), [None, 2, 3, None, 1, 3]),
    "percent_rank": (ax.percent_rank("x"), [0.4, 0.0, 0.8, 0.0, 1.0, 0.4]),
    "cume_dist": (ax.cume_dist("x"), [4 / 6, 2 / 6, 5 / 6, 2 / 6, 1.0, 4 / 6]),
    "ntile": (ax.ntile("x", 4), [2, 1, 3, 1, 4, 3]),
    "cum_sum": (ax.cum_sum("nullable"), [None, 2.5, 6.5, None, 8.0, 12.0]),
    "cum_prod": (ax.cum_prod("x"), [5.0, 10.0, 70.0, 140.0, 1260.0, 6300.0]),
    "cum_min": (ax.cum_min("x"), [5, 2, 2, 2, 2, 2]),
    "cummean": (ax.cummean("x"), [5.0, 3.5, 14 / 3, 4.0, 5.0, 5.0]),
    "cumany": (ax.cumany("flag"), [False, False, True, True, True, True]),
    "cumall": (ax.cumall(~col("flag")), [True, True, False, False, False, False]),
    "lead": (ax.lead("nullable", 1, 9.0), [2.5, 4.0, None, 1.5, 4.0, 9.0]),
    "lag": (ax.lag("x", 2, -1), [-1, -1, 5, 2, 7, 2]),
    "lag0": (ax.lag("x", 0), [5, 2, 7, 2, 9, 5]),
    "lag_negative": (ax.lag("x", -1), [2, 7, 2, 9, 5, None]),
    "row_number": (ax.row_number(), [1, 2, 3, 4, 5, 6]),
    "n": (ax.n(), [6] * 6),
    "n_distinct": (ax.n_distinct("nullable"), [4] * 6),
    "first": (ax.first("nullable"), [None] * 6),
    "last": (ax.last("nullable"), [4.0] * 6),
    "nth": (ax.nth("x", -2), [9] * 6),
    "nth_missing": (ax.nth("nullable", 3, default=1.0), [None] * 6),
    "sum": (ax.sum("nullable"), [12.0] * 6),
    "median": (ax.median("x"), [5.0] * 6),
    "coalesce": (ax.coalesce("nullable", 0.0), [0.0, 2.5, 4.0, 0.0, 1.5, 4.0]),
    "na_if": (ax.na_if("x", 2), [5, None, 7, None, 9, 5]),
    "is_na": (ax.is_na("nullable"), [True, False, False, True, False, False]),
    "if_else": (ax.if_else(col("nullable") > 2, "a", "b"), ["b", "a", "a", "b", "b", "a"]),
    "case_match": (ax.case_match("x", ([2, 9], "s"), (7, "t")), [None, "s", "t", "s", "s", None]),
    "recode": (ax.recode("x", {2: 20}), [5, 20, 7, 20, 9, 5]),
    "between": (ax.between("x", 2, 7, closed="right"), [True, False, True, False, False, True]),
    "near": (ax.near("x", "nullable", 3.0), [None, True, True, None, False, True]),
    "floordiv": (-col("x") // 2, [-3, -1, -4, -1, -5, -3]),
    "mod": ((-col("x") % 4), [3, 2, 1, 2, 3, 3]),
    "mod_neg": ((col("x") % -4), [-3, -2, -1, -2, -3, -3]),
    "div0": (col("x") / (col("x") - 2), [5 / 3, None, 7 / 5, None, 9 / 7, 5 / 3]),
    "pow": (col("x") ** 3, [125, 8, 343, 8, 729, 125]),
    "round": ((col("x") + 0.5).round(), [6.0, 2.0, 8.0, 2.0, 10.0, 6.0]),
    "clip": (col("x").clip(3, 6), [5, 3, 6, 3, 6, 5]),
    "shift": (col("x").shift(1), [None, 5, 2, 7, 2, 9]),
    "diff": (col("x").diff(), [None, -3, 5, -5, 7, -4]),
    "rolling": (col("x").rolling_sum(3), [None, None, 14, 11, 18, 16]),
    "nested": (ax.mean(col("x") - ax.mean("x")), [0.0] * 6),
    "agg_of_window": (ax.max(ax.row_number()), [6] * 6),
    "spark": (col("x").spark(lambda c: c + 1), [6, 3, 8, 3, 10, 6]),
    "std0": (col("x").std(ddof=0), [pytest.approx((38 / 6) ** 0.5)] * 6),
}


@pytest.mark.parametrize("name", CASES)
def test_values(frame, name):
    e, want = CASES[name]
    got = [r["v"] for r in frame.mutate(obs={"v": e}).obs_frame(ordered=True).collect()]
    assert got == [w if w is None or isinstance(w, (str, bool)) else pytest.approx(w) if isinstance(w, float) else w for w in want]


def test_ntile_formula(spark):
    t = AxisTable(spark.range(7).toDF("i"), order_by="i")
    assert [r["v"] for r in t.mutate(obs={"v": ax.ntile("i", 5)}).obs_frame(ordered=True).collect()] == [1, 1, 2, 3, 3, 4, 5]
    with pytest.raises(UnknownColumnError):
        ax.ntile("i", 0)


def test_selectors(spark):
    t = AxisTable(spark.createDataFrame([(1, 2, 3, "a")], "dose1 long, dose2 long, site long, note string"))
    cols = lambda s: t.select(obs=s).obs_frame().columns
    assert cols(ax.starts_with("dose")) == ["dose1", "dose2"]
    assert cols(ax.ends_with("2") | ax.where(lambda k: k.typeName() == "string")) == ["dose2", "note"]
    assert cols(ax.contains("s") & ~ax.matches("^dose")) == ["site"]
    assert cols(ax.num_range("dose", [2, 1])) == ["dose2", "dose1"]
    assert cols(ax.last_col(1)) == ["site"]
    assert cols(ax.any_of(["nothing", "site"])) == ["site"]
    assert cols(ax.pick("note", ax.last_col(1))) == ["note", "site"]
    for bad in (ax.all_of(["nothing"]), ax.last_col(9)):
        with pytest.raises(UnknownColumnError):
            cols(bad)
    with pytest.raises(SelectionError):
        cols(ax.where(lambda k: 1))


def test_across_and_quantifiers(frame):
    out = frame.summarize(obs=ax.across(["x", "nullable"], {"mean": ax.mean, "n": lambda e: e.count()}))
    assert out.columns == ["x_mean", "x_n", "nullable_mean", "nullable_n"] and tuple(out.first()) == (5.0, 6, 3.0, 4)
    with pytest.raises(DuplicateNameError):
        frame.summarize(obs=ax.across(["x", "nullable"], ax.mean, names="same"))
    assert frame.filter(obs=ax.if_any([], lambda e: e > 0)).obs_frame().count() == 0
    assert frame.filter(obs=ax.if_all([], lambda e: e > 0)).obs_frame().count() == 6
    assert frame.filter(obs=ax.if_all(["x", "nullable"], lambda e: e >= 1)).obs_frame().count() == 4
