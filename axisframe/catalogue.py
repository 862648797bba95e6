"""Queries of the library's own operators over the driver's tables, each beside the SQL that it must agree with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import axisframe as ax
from axisframe import AxisTable, col

from .session import ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


class Data:
    """The tables of a folder, and the annotated matrices made of them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.at = ship(spark), sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.at}/{name}.parquet")

    def events_table(self) -> AxisTable:
        return AxisTable(self.events, order_by="event_id")

    def by_type(self) -> ax.GroupedAxisTable:
        return self.events_table().group_by(obs="event_type")

    def by_user(self) -> ax.GroupedAxisTable:
        return self.events_table().group_by(obs="user_id")

    def lineitem_table(self) -> AxisTable:
        df = self.lineitem
        return AxisTable(df, order_by=df.columns)

    def orders_table(self) -> AxisTable:
        return AxisTable(self.orders, order_by="o_orderkey")

    def vectors(self, **how) -> AxisTable:
        return AxisTable(self.embeddings, order_by="vec_id", x="embedding", obs_name="vec_id", features=[f"f{k}" for k in range(64)], **how)

    def features(self, spark=None) -> DataFrame:
        """Names, kinds and loadings of the 64 features."""
        k = F.col("id").cast("int")
        return self.spark.range(64).select(F.concat(F.lit("f"), k.cast("string")).alias("name"), F.when(k % 2 == 0, "even").otherwise("odd").alias("kind"), (k * k).alias("square"), F.array(k.cast("double"), (-k).cast("double")).alias("loadings"), k.alias("k"))

    def rich(self, **how) -> AxisTable:
        """Vectors with every kind of source: a layer, raw values, a two-place map, features with loadings, pairs of rows."""
        e = F.col("embedding")
        df = self.embeddings.select("vec_id", "label", "embedding", F.transform(e, lambda x: x * 2).alias("twice"), F.slice(e, 1, 3).alias("few"), F.slice(e, 5, 2).alias("pca"))
        pairs = self.embeddings.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("label").cast("double").alias("v"))
        return AxisTable(df, order_by="vec_id", obs_name="vec_id", x="embedding", layers={"twice": "twice"}, raw="few", raw_features=["r0", "r1", "r2"], obsm={"pca": ("pca", ["p0", "p1"])}, var=self.features(), var_name="name", var_order_by="k", varm={"loadings": "loadings"}, obsp={"next": pairs}, **how)

    def sparse(self) -> AxisTable:
        e = F.transform(F.slice("embedding", 1, 4), lambda x, i: F.struct(i.alias("i"), x.alias("v")))
        e = F.filter(e, lambda x: x["v"] > 0)
        df = self.embeddings.select("vec_id", "label", F.struct(F.transform(e, lambda x: x["i"]).alias("indices"), F.transform(e, lambda x: x["v"]).alias("values")).alias("m"))
        return AxisTable(df, order_by="vec_id", obs_name="vec_id", x="m", features=["g0", "g1", "g2", "g3"], layout="sparse_struct")

    def wide(self) -> AxisTable:
        df = self.embeddings.select("vec_id", "label", *(F.get("embedding", k).alias(f"w{k}") for k in range(3)))
        return AxisTable(df, order_by="vec_id", obs_name="vec_id", x=["w0", "w1", "w2"], layout="wide")

    def labelled(self) -> AxisTable:
        return AxisTable(self.documents.select("doc_id", "lang", "source", "n_chars"), order_by="doc_id").left_join(self.labels, by="doc_id")

    def customers(self) -> AxisTable:
        return AxisTable(self.customer, order_by="c_custkey")


def query(name: str, sql: str | None = None):
    def keep(func):
        QUERIES[name] = lambda spark, sf_dir: func(Data(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return func

    return keep


def six(c):
    """Six digits; what is added keeps values that lie midway from being rounded either way by different engines."""
    return F.round(c.cast("double") + 1.23e-7, 6)


def r6(c: str):
    return six(F.col(c)).alias(c)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(r6(c) if c in names else F.col(c) for c in df.columns))


def _placed(df: DataFrame) -> DataFrame:
    """The rows of a small result with their place in it (from 1), as the comparison with SQL ignores order."""
    rows = [(*r, k) for k, r in enumerate(df.collect(), 1)]
    return df.sparkSession.createDataFrame(rows, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, place int")


def flagship(d: Data) -> DataFrame:
    out = d.vectors().summarize(obs={"cells": ax.n(), "med_id": ax.median("vec_id")}, x={"mean_f0": ax.mean("f0"), "mean_f1": ax.mean("f1")}, by="label")
    return rounded(out, "mean_f0", "mean_f1")


query("summarize_multi_source", "select label, count(*) cells, median(vec_id)::double med_id, round(avg(embedding[1]::double) + 1.23e-7, 6) mean_f0, round(avg(embedding[2]::double) + 1.23e-7, 6) mean_f1 from embeddings group by label")(flagship)

# -- projection ----------------------------------------------------------------------------------------------------------

query("select", "select event_id, event_type, value from events")(lambda d: d.events_table().select(obs=["event_id", ax.starts_with("event_t"), ax.any_of(["value", "nothing"])]).obs_frame())
query("rename", "select event_id as id, ts, user_id as \"user\", event_type, value, props from events")(lambda d: d.events_table().rename(obs={"id": "event_id", "user": "user_id"}).obs_frame())
query("rename_with", "select r_regionkey as R_REGIONKEY, r_name from region")(lambda d: AxisTable(d.region, order_by="r_regionkey").rename_with(str.upper, obs=ax.ends_with("key")).obs_frame())
query("relocate", "select value, event_id, ts, user_id, event_type, props from events")(lambda d: d.events_table().relocate(obs="value").obs_frame())
query("mutate_seq", "select event_id, value * 2 as a, value * 2 + 1 as b, (value * 2 + 1) * (value * 2) as c from events")(lambda d: d.events_table().mutate(obs={"a": col("value") * 2, "b": col("a") + 1, "c": col("b") * col("a")}).select(obs=["event_id", "a", "b", "c"]).obs_frame())
query("mutate_scalar", "select event_id, 7 as k, round(value - avg(value) over () + 1.23e-7, 6) as centred from events")(lambda d: rounded(d.events_table().mutate(obs={"k": ax.lit(7), "centred": col("value") - ax.mean("value")}).select(obs=["event_id", "k", "centred"]).obs_frame(), "centred"))
query("transmute", "select upper(event_type) as kind, value > 0 as positive from events")(lambda d: d.events_table().transmute(obs={"kind": col("event_type").str.to_uppercase(), "positive": col("value") > 0}).obs_frame())
query("mutate_operators", "select event_id, user_id + 3 as add_, 3 - user_id as rsub, user_id * -2 as mul, user_id / 4 as div, floor(user_id / 4)::bigint as fdiv, (user_id - (-7) * floor(user_id / -7))::bigint as mod_, user_id * user_id as sq, -user_id as neg, abs(user_id - 50)::bigint as abs_ from events")(
    lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "add_": col("user_id") + 3, "rsub": 3 - col("user_id"), "mul": col("user_id") * -2, "div": col("user_id") / 4, "fdiv": col("user_id") // 4, "mod_": (col("user_id") % -7).cast("long"), "sq": col("user_id") ** 2, "neg": -col("user_id"), "abs_": (col("user_id") - 50).abs()}).obs_frame()
)

# -- rows ----------------------------------------------------------------------------------------------------------------

query("filter_multi", "select * from events where event_type in ('click', 'view') and value > 10 and user_id % 2 = 0")(lambda d: d.events_table().filter(obs=[col("event_type").is_in(["click", "view"]), col("value") > 10, col("user_id") % 2 == 0]).obs_frame())
query("filter_agg", "select * from events where value > (select avg(value) from events)")(lambda d: d.events_table().filter(obs=col("value") > ax.mean("value")).obs_frame())
query("filter_x", "select vec_id, label from embeddings where embedding[1] > 0 and embedding[3] < 0.5 and label >= 2")(lambda d: d.vectors().filter(obs=col("label") >= 2, x=[col("f0") > 0, col("f2") < 0.5]).obs_frame())
query("filter_obs_names", "select vec_id, label from embeddings where vec_id in (3, 5, 8)")(lambda d: d.vectors().filter(obs_names=[3, 5, 8]).obs_frame())
query("grouped_filter", "select e.* from events e join (select event_type t, avg(value) m from events group by 1) g on e.event_type = g.t where value > m")(lambda d: d.by_type().filter(obs=col("value") > ax.mean("value")).obs_frame())
query("distinct", "select distinct user_id, event_type from events")(lambda d: d.events_table().distinct(obs=["user_id", "event_type"], keep_all=False).obs_frame())
query("distinct_keep_all", "select * exclude (r) from (select *, row_number() over (partition by user_id, event_type order by event_id) r from events) where r = 1")(lambda d: d.events_table().distinct(obs=["user_id", "event_type"]).obs_frame())
query("slice", "select event_id, event_type from (select *, row_number() over (order by event_id) - 1 p, count(*) over () n from events) where p in (0, 5, 7) or p = n - 1")(lambda d: d.events_table().slice(5, 0, [7, -1]).select(obs=["event_id", "event_type"]).obs_frame())
query("slice_range", "select event_id, event_type from (select *, row_number() over (order by event_id) - 1 p, count(*) over () n from events) where p >= 10 and p < n - 20 and (p - 10) % 3 = 0")(lambda d: d.events_table().slice(slice(10, -20, 3)).select(obs=["event_id", "event_type"]).obs_frame())
query("slice_mask", "select event_id from events where user_id = 3")(lambda d: d.events_table().slice(col("user_id") == 3).select(obs="event_id").obs_frame())
query("slice_var", "select ['f5', 'f0', 'f63'][k] as name, ['odd', 'even', 'odd'][k] as kind from range(1, 4) t(k)")(lambda d: d.rich().slice(5, 0, -1, axis="var").var_frame().select("name", "kind"))
query("filter_null", "select event_id from events where event_type <> 'click' and value > 50")(lambda d: d.events_table().filter(obs=[ax.na_if("event_type", "click") != "none", col("value") > 50]).select(obs="event_id").obs_frame())
query("filter_raw", "select vec_id, label from embeddings where embedding[2] > 0 and embedding[3] < 0")(lambda d: d.rich().filter(raw=[col("r1") > 0, col("r2") < 0]).obs_frame())
query("filter_layer", "select vec_id from embeddings where embedding[64]::float * 2 > 0.25")(lambda d: d.rich().filter(x=col("f63") > 0.25, layer="twice").select(obs="vec_id").obs_frame())
query("filter_obsm", "select vec_id from embeddings where embedding[5] > embedding[6]")(lambda d: d.rich().filter(obsm={"pca": col("p0") > col("p1")}).select(obs="vec_id").obs_frame())
query("filter_var", "select 'f' || k as name from range(64) t(k) where k % 2 = 1 and k * k > 100")(lambda d: d.rich().filter(var=[col("kind") == "odd", col("square") > 100]).var_frame().select("name"))
query("filter_varm", "select 'f' || k as name from range(64) t(k) where -k < -60")(lambda d: d.rich().filter(varm={"loadings": col("1") < -60}).var_frame().select("name"))
query("sparse_matrix", "select vec_id, round(greatest(embedding[1], 0)::double + 1.23e-7, 6) as g0, round(greatest(embedding[4], 0)::double + 1.23e-7, 6) as g3 from embeddings where greatest(embedding[2], 0) < 0.1")(lambda d: rounded(d.sparse().filter(x=col("g1") < 0.1).to_df(obs="vec_id", x=["g0", "g3"]), "g0", "g3"))
query("wide_matrix", "select vec_id, round(embedding[3]::double + 1.23e-7, 6) as w2, round(embedding[1]::double + 1.23e-7, 6) as w0 from embeddings where embedding[2] > 0")(lambda d: rounded(d.wide().filter(x=col("w1") > 0).to_df(obs="vec_id", x=["w2", "w0"]), "w2", "w0"))
query("slice_head", "select * from events order by event_id limit 7")(lambda d: d.events_table().slice_head(7).obs_frame())
query("slice_tail", "select * from events order by event_id desc limit 7")(lambda d: d.events_table().slice_tail(7).obs_frame())
query("slice_min", "select * from events order by value, event_id limit 9")(lambda d: d.events_table().slice_min("value", 9).obs_frame())
query("slice_max", "select * from events order by value desc, event_id limit 9")(lambda d: d.events_table().slice_max("value", 9).obs_frame())
query("slice_sample")(lambda d: d.by_type().slice_sample(5, random_state=1).obs_frame())
query("grouped_slice_max", "select * exclude (r) from (select *, row_number() over (partition by event_type order by value desc, event_id) r from events) where r <= 3")(lambda d: d.by_type().slice_max("value", 3).obs_frame())
query("grouped_slice_head", "select * exclude (r) from (select *, row_number() over (partition by user_id order by event_id) r from events) where r <= 2")(lambda d: d.by_user().slice_head(2).obs_frame())
query("grouped_slice", "select * exclude (r, n, p) from (select *, row_number() over (partition by user_id order by event_id) - 1 r, count(*) over (partition by user_id) n from events), (select unnest([1, -1]) p) where r = p or r = n + p")(lambda d: d.by_user().slice(1, -1).obs_frame())
query("arrange", "select event_id, row_number() over (order by event_type, value desc, event_id)::int as place from events")(lambda d: d.events_table().arrange(obs=["event_type", ax.desc("value")]).mutate(obs={"place": ax.row_number()}).select(obs=["event_id", "place"]).obs_frame())
query("arrange_grouped", "with g as (select event_type t, min(event_id) f from events group by 1) select event_id, row_number() over (order by f, value desc, event_id)::int as place from events join g on event_type = t")(lambda d: d.by_type().arrange(obs=ax.desc("value")).ungroup().mutate(obs={"place": ax.row_number()}).select(obs=["event_id", "place"]).obs_frame())

# -- joins ---------------------------------------------------------------------------------------------------------------

query("left_join", "select doc_id, lang, source, n_chars, quality, toxic from (select doc_id, lang, source, n_chars from documents) left join labels using (doc_id)")(lambda d: d.labelled().obs_frame())
query("inner_join", "select o.*, c_name, c_mktsegment from orders o join customer c on o_custkey = c_custkey")(lambda d: d.orders_table().inner_join(d.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment"), by="o_custkey").obs_frame())
query("right_join", "select n.*, r_name, row_number() over (order by r_regionkey, n_nationkey)::int as place from nation n join region r on n_regionkey = r_regionkey")(lambda d: AxisTable(d.nation, order_by="n_nationkey").right_join(AxisTable(d.region.withColumnRenamed("r_regionkey", "n_regionkey"), order_by="n_regionkey"), by="n_regionkey").mutate(obs={"place": ax.row_number()}).obs_frame())
query("full_join", "select n.*, r_name from nation n full join region r on n_regionkey = r_regionkey")(lambda d: AxisTable(d.nation, order_by="n_nationkey").full_join(d.region.withColumnRenamed("r_regionkey", "n_regionkey"), by="n_regionkey").obs_frame())
query("semi_join", "select * from customer where c_custkey in (select o_custkey from orders where o_totalprice > 300000)")(lambda d: d.customers().semi_join(d.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), by="c_custkey").obs_frame())
query("anti_join", "select * from customer where c_custkey not in (select o_custkey from orders)")(lambda d: d.customers().anti_join(d.orders.select(F.col("o_custkey").alias("c_custkey")), by="c_custkey").obs_frame())
query("join_na_never", "with l as (select event_id, nullif(event_type, 'click') k from events), r as (select distinct nullif(event_type, 'click') k, 1 as hit from events) select event_id, l.k, hit from l left join r on l.k = r.k")(
    lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "k": ax.na_if("event_type", "click")}).left_join(d.events.select(F.nullif("event_type", F.lit("click")).alias("k")).distinct().withColumn("hit", F.lit(1)), by="k", na_matches="never").obs_frame()
)
query("join_na_match", "with l as (select event_id, nullif(event_type, 'click') k from events), r as (select distinct nullif(event_type, 'click') k, 1 as hit from events) select event_id, l.k, hit from l left join r on l.k is not distinct from r.k")(
    lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "k": ax.na_if("event_type", "click")}).left_join(d.events.select(F.nullif("event_type", F.lit("click")).alias("k")).distinct().withColumn("hit", F.lit(1)), by="k").obs_frame()
)
query("join_first", "select c_custkey, c_name, min_price from customer left join (select o_custkey, arg_min(o_totalprice, o_orderkey) min_price from orders group by 1) on c_custkey = o_custkey")(
    lambda d: d.customers().select(obs=["c_custkey", "c_name"]).left_join(d.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("min_price")), by="c_custkey", multiple="first", right_order=["o_orderkey"]).select(obs=["c_custkey", "c_name", "min_price"]).obs_frame()
)

query("join_suffixes", "select o.o_orderkey, o.o_orderstatus as status_left, c.o_orderstatus as status_right from (select o_orderkey, o_custkey, o_orderstatus from orders) o left join (select c_custkey, c_mktsegment as o_orderstatus from customer) c on o_custkey = c_custkey")(
    lambda d: d.orders_table().select(obs=["o_orderkey", "o_custkey", "o_orderstatus"]).left_join(d.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("o_orderstatus")), by="o_custkey", suffixes=("_l", "_r")).transmute(obs={"o_orderkey": col("o_orderkey"), "status_left": col("o_orderstatus_l"), "status_right": col("o_orderstatus_r")}).obs_frame()
)
query("grouped_join", "select e.event_id, e.event_type, u.m, row_number() over (partition by e.event_type order by e.event_id)::int as k from events e join (select user_id, min(event_id) m from events group by 1) u using (user_id)")(
    lambda d: d.by_type().inner_join(d.events.groupBy("user_id").agg(F.min("event_id").alias("m")), by="user_id").mutate(obs={"k": ax.row_number()}).select(obs=["event_id", "m", "k"]).ungroup().select(obs=["event_id", "event_type", "m", "k"]).obs_frame()
)
query("join_relationship", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")(
    lambda d: d.customers().select(obs=["c_custkey", "c_nationkey"]).left_join(d.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), by="c_nationkey", relationship="many-to-one", multiple="all", unmatched="error").select(obs=["c_custkey", "n_name"]).obs_frame()
)
query("join_mapping_order", "select n_nationkey, part, row_number() over (order by p, n_nationkey)::int as place from nation join (values (3, 'c', 0), (1, 'a', 1), (0, 'z', 2), (2, 'b', 3), (4, 'd', 4)) t(r, part, p) on n_regionkey = r")(
    lambda d: AxisTable(d.nation, order_by="n_nationkey").right_join({"n_regionkey": [3, 1, 0, 2, 4], "part": ["c", "a", "z", "b", "d"]}, by="n_regionkey").transmute(obs={"n_nationkey": col("n_nationkey"), "part": col("part"), "place": ax.row_number()}).obs_frame()
)

# -- summaries -----------------------------------------------------------------------------------------------------------

query("summarize", "select l_returnflag, l_linestatus, count(*) n, round(sum(l_quantity), 4) qty, round(avg(l_extendedprice), 4) price, min(l_discount) lo, max(l_tax) hi from lineitem group by 1, 2")(
    lambda d: d.lineitem_table().summarize(obs={"n": ax.n(), "qty": ax.sum("l_quantity"), "price": ax.mean("l_extendedprice"), "lo": ax.min("l_discount"), "hi": ax.max("l_tax")}, by=["l_returnflag", "l_linestatus"]).withColumns({"qty": F.round("qty", 4), "price": F.round("price", 4)})
)
query("summarize_all", "select count(*) n, round(avg(value) + 1.23e-7, 6) m, count(distinct user_id) users from events")(lambda d: rounded(d.events_table().summarize(obs={"n": ax.n(), "m": ax.mean("value"), "users": ax.n_distinct("user_id")}), "m"))
query("summarize_across", "select l_returnflag, round(avg(l_quantity), 4) l_quantity_mean, max(l_quantity) l_quantity_max, round(avg(l_discount), 4) l_discount_mean, max(l_discount) l_discount_max from lineitem group by 1")(
    lambda d: d.lineitem_table().summarize(obs=ax.across(["l_quantity", "l_discount"], {"mean": ax.mean, "max": ax.max}), by="l_returnflag").withColumns({c: F.round(c, 4) for c in ("l_quantity_mean", "l_discount_mean")})
)
query("summarize_computed_key", "select n_chars // 1000 as size, count(*) n, max(n_chars) longest from documents group by 1")(lambda d: AxisTable(d.documents, order_by="doc_id").summarize(obs={"n": ax.n(), "longest": ax.max("n_chars")}, by={"size": (col("n_chars") // 1000).cast("long")}))
query("count", "select event_type, count(*) n from events group by 1")(lambda d: d.events_table().count("event_type"))
query("count_wt", "select l_returnflag, round(sum(l_quantity), 4) as qty from lineitem group by 1")(lambda d: d.lineitem_table().count("l_returnflag", wt="l_quantity", sort=True, name="qty").withColumn("qty", F.round("qty", 4)))
query("count_sorted", "with c as (select l_linenumber, count(*) // 1000 k, min((l_orderkey, l_linenumber)) f from lineitem group by 1) select l_linenumber, k, row_number() over (order by k desc, l_linenumber)::int as place from c")(
    lambda d: _placed(AxisTable(d.lineitem.groupBy("l_linenumber").agg(F.floor(F.count(F.lit(1)) / 1000).alias("k")), order_by="l_linenumber").count("l_linenumber", wt="k", sort=True, name="k"))
)
query("count_na", "select quality, count(*) n from documents left join labels using (doc_id) group by 1")(lambda d: d.labelled().count("quality"))
query("tally", "select count(*) n from events")(lambda d: d.events_table().tally())
query("add_count", "select event_id, count(*) over (partition by user_id) as n from events")(lambda d: d.events_table().add_count("user_id").select(obs=["event_id", "n"]).obs_frame())
query("add_tally", "select event_id, round(sum(value) over (), 4) as total from events")(lambda d: d.events_table().add_tally(wt="value", name="total").select(obs=["event_id", "total"]).obs_frame().withColumn("total", F.round("total", 4)))
query("group_keys", "select distinct event_type from events")(lambda d: d.by_type().group_keys())
query("group_data", "select event_type, string_agg(p::varchar, ',' order by p) as places from (select event_type, row_number() over (order by event_id) - 1 p from events) group by 1")(lambda d: d.by_type().group_data().select("event_type", F.array_join(F.col("`.rows`").cast("array<string>"), ",").alias("places")))
query("grouped_mutate", "select event_id, round(value - avg(value) over (partition by event_type) + 1.23e-7, 6) as centred, row_number() over (partition by event_type order by event_id)::int as k from events")(lambda d: rounded(d.by_type().mutate(obs={"centred": col("value") - ax.mean("value"), "k": ax.row_number()}).select(obs=["event_id", "centred", "k"]).obs_frame(), "centred").select("event_id", "centred", "k"))
query("grouped_aggregates", "select event_id, count(distinct user_id) over (partition by event_type) as users, round(median(value) over (partition by event_type) + 1.23e-7, 6) as mid, list(value order by event_id) over (partition by event_type order by event_id rows between unbounded preceding and unbounded following)[3] as third from events")(
    lambda d: rounded(d.by_type().mutate(obs={"users": ax.n_distinct("user_id"), "mid": ax.median("value"), "third": ax.nth("value", 2)}).ungroup().select(obs=["event_id", "users", "mid", "third"]).obs_frame(), "mid")
)
query("whole_nth", "select event_id, value - (select value from events order by event_id limit 1 offset 4) as a, (select value from events order by event_id desc limit 1) as z from events")(lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "a": col("value") - ax.nth("value", 4), "z": ax.nth("value", -1)}).obs_frame())
query("group_keys_stay", "select event_type, value from events")(lambda d: d.by_type().select(obs="value").ungroup().obs_frame())
query("group_by_var", "select case when k % 2 = 0 then 'even' else 'odd' end as kind, count(*) as n, max(k * k)::int as most from range(64) t(k) group by 1")(lambda d: d.rich().group_by(var="kind").summarize(var={"n": ax.n(), "most": ax.max("square")}))
query("grouped_iteration", "select event_type, count(*) as n from events group by 1")(lambda d: reduce(DataFrame.union, [t.summarize(obs={"n": ax.n()}).select(F.lit(k["event_type"]).alias("event_type"), "n") for k, t in d.by_type()]))
query("summarize_obsm", "select label, round(avg(embedding[5]::double) + 1.23e-7, 6) as p, round(max(embedding[3])::double + 1.23e-7, 6) as r from embeddings group by 1")(lambda d: rounded(d.rich().summarize(obsm={"pca": {"p": ax.mean("p0")}}, raw={"r": ax.max("r2")}, by="label"), "p", "r"))
query("summarize_layer", "select label, round(sum(embedding[1]::float * 2), 4) as s from embeddings group by 1")(lambda d: d.rich().summarize(x={"s": ax.sum("f0")}, layer="twice", by="label").withColumn("s", F.round("s", 4)))
query("summarize_varm", "select sum(k)::double as a, min(-k)::double as b from range(64) t(k)")(lambda d: d.rich().summarize(varm={"loadings": {"a": ax.sum("0"), "b": ax.min("1")}}))
query("mutate_sources", "select vec_id, round(embedding[1]::double + embedding[2] + 1.23e-7, 6) as s, round(embedding[3]::double + 1.23e-7, 6) as r, round(embedding[5]::double + 1.23e-7, 6) as p from embeddings")(lambda d: rounded(d.rich().mutate(x={"s": col("f0").cast("double") + col("f1")}, raw={"r": col("r2")}, obsm={"pca": {"p": col("p0")}}).select(obs=["vec_id", "s", "r", "p"]).obs_frame(), "s", "r", "p"))
query("mutate_var", "select 'f' || k as name, k * k + 1 as more, (-k)::double as load from range(64) t(k)")(lambda d: d.rich().mutate(var={"more": (col("square") + 1).cast("long")}, varm={"loadings": {"load": col("1")}}).var_frame().select("name", "more", "load"))
query("arrange_var", "select 'f' || k as name, row_number() over (order by k % 2, k desc)::int as place from range(64) t(k)")(lambda d: d.rich().arrange(var=["kind", ax.desc("square")]).mutate(var={"place": ax.row_number()}).var_frame().select("name", "place"))
query("join_var", "select 'f' || k as name, case when k % 2 = 0 then 'E' else 'O' end as letter from range(64) t(k)")(lambda d: d.rich().left_join({"kind": ["even", "odd"], "letter": ["E", "O"]}, by="kind", axis="var").var_frame().select("name", "letter"))
query("written_and_read", "select vec_id, label, round(embedding[1]::double + 1.23e-7, 6) as f0, round(embedding[1]::double * 2 + 1.23e-7, 6) as t0, round(embedding[2]::double + 1.23e-7, 6) as r1, round(embedding[6]::double + 1.23e-7, 6) as p1, row_number() over (order by label desc, vec_id)::int as place from embeddings")(lambda d: _written(d))
query("grouped_summarize", "select event_type, count(*) n, round(stddev_samp(value) + 1.23e-7, 6) s from events group by 1")(lambda d: rounded(d.by_type().summarize(obs={"n": ax.n(), "s": ax.sd("value")}), "s"))



def _written(d: Data) -> DataFrame:
    """A table written to the folder for intermediate tables, read back, and every kind of source read from it."""
    from .session import scratch

    path = scratch(d.spark, "written")
    d.rich().arrange(obs=ax.desc("label")).write_parquet(path)
    t = AxisTable.read_parquet(d.spark, path)
    t = t.mutate(obs={"place": ax.row_number()}, x={"f0": col("f0")}, raw={"r1": col("r1")}, obsm={"pca": {"p1": col("p1")}}).mutate(x={"t0": col("f0").cast("double")}, layer="twice")
    return rounded(t.select(obs=["vec_id", "label", "f0", "t0", "r1", "p1", "place"]).obs_frame(), "f0", "t0", "r1", "p1")


# -- expressions ---------------------------------------------------------------------------------------------------------


def _by_type(name: str, e, sql: str, digits: bool = False) -> None:
    """A query of one expression within event types, beside its SQL over events."""

    def run(d: Data) -> DataFrame:
        out = d.by_type().mutate(obs={"v": e}).select(obs=["event_id", "v"]).ungroup().select(obs=["event_id", "v"]).obs_frame()
        return rounded(out, "v") if digits else out

    query(name, f"select event_id, {f'round({sql} + 1.23e-7, 6)' if digits else sql} as v from events")(run)


_W, _V = "(partition by event_type order by event_id)", "(partition by event_type order by value)"
_by_type("row_number", ax.row_number(), f"(row_number() over {_W})::int")
_by_type("lead", ax.lead("value", 2, 0.0), f"lead(value, 2, 0.0::double) over {_W}")
_by_type("lag", ax.lag("value"), f"lag(value) over {_W}")
_by_type("shift_diff", col("value").diff() + col("value").shift(1), f"value - lag(value) over {_W} + lag(value) over {_W}", True)
_by_type("min_rank", ax.min_rank("value"), f"(rank() over {_V})::int")
_by_type("max_rank", ax.max_rank("value"), f"rank() over {_V} + count(*) over (partition by event_type, value) - 1")
_by_type("average_rank", ax.average_rank("value"), f"rank() over {_V} + (count(*) over (partition by event_type, value) - 1) / 2")
_by_type("dense_rank", ax.dense_rank("value"), f"(dense_rank() over {_V})::int")
_by_type("percent_rank", ax.percent_rank("value"), f"percent_rank() over {_V}", True)
_by_type("cume_dist", ax.cume_dist("value"), f"cume_dist() over {_V}", True)
_by_type("ntile", ax.ntile("value", 7), "floor((row_number() over (partition by event_type order by value, event_id) - 1) * 7 / count(*) over (partition by event_type))::bigint + 1")
_by_type("cum_sum", ax.cum_sum("value"), f"sum(value) over {_W}", True)
_by_type("cum_min", ax.cum_min("value"), f"min(value) over {_W}")
_by_type("cum_max", ax.cum_max("value"), f"max(value) over {_W}")
_by_type("cummean", ax.cummean("value"), f"sum(value) over {_W} / row_number() over {_W}", True)
_by_type("cumany", ax.cumany(col("value") > 90), f"sum((value > 90)::int) over {_W} > 0")
_by_type("cumall", ax.cumall(col("value") > 1), f"sum((value > 1)::int) over {_W} = row_number() over {_W}")
_by_type("cum_count", col("value").cum_count(), f"count(value) over {_W}")
_by_type("rolling_mean", col("value").rolling_mean(5), f"case when count(value) over (partition by event_type order by event_id rows 4 preceding) >= 5 then avg(value) over (partition by event_type order by event_id rows 4 preceding) end", True)
query("cum_prod", "select event_id, round(product(1 + value / 100000) over (partition by user_id order by event_id) + 1.23e-7, 6) as v from events")(lambda d: rounded(d.by_user().mutate(obs={"v": ax.cum_prod(1 + col("value") / 100000)}).ungroup().select(obs=["event_id", "v"]).obs_frame(), "v"))
query("over", "select event_id, round(value - avg(value) over (partition by user_id) + 1.23e-7, 6) as v from events")(lambda d: rounded(d.events_table().transmute(obs={"event_id": col("event_id"), "v": col("value") - ax.mean("value").over("user_id")}).obs_frame(), "v"))
query("ewm_mean", "with recursive e as (select *, row_number() over (partition by user_id order by event_id) r from events), w as (select user_id, r, event_id, value::double s, 1.0::double k from e where r = 1 union all select e.user_id, e.r, e.event_id, w.s * 0.5 + e.value, w.k * 0.5 + 1 from w join e on e.user_id = w.user_id and e.r = w.r + 1) select event_id, round(s / k + 1.23e-7, 6) as v from w")(lambda d: rounded(d.by_user().mutate(obs={"v": col("value").ewm_mean(0.5)}).ungroup().select(obs=["event_id", "v"]).obs_frame(), "v"))


query("ewm_mean_span", "with recursive e as (select *, row_number() over (partition by user_id order by event_id) r from events), w as (select user_id, r, event_id, value::double s from e where r = 1 union all select e.user_id, e.r, e.event_id, w.s * 0.75 + e.value * 0.25 from w join e on e.user_id = w.user_id and e.r = w.r + 1) select event_id, case when r >= 3 then round(s + 1.23e-7, 6) end as v from w")(lambda d: rounded(d.by_user().mutate(obs={"v": col("value").ewm_mean(span=7, adjust=False, min_samples=3)}).ungroup().select(obs=["event_id", "v"]).obs_frame(), "v"))
_R = "(partition by event_type order by event_id rows 3 preceding)"
_by_type("rolling_sum", col("value").rolling_sum(4), f"case when count(value) over {_R} >= 4 then sum(value) over {_R} end", True)
_by_type("rolling_min", col("value").rolling_min(4, min_samples=2), f"case when count(value) over {_R} >= 2 then min(value) over {_R} end")
_by_type("rolling_max", col("value").rolling_max(4), f"case when count(value) over {_R} >= 4 then max(value) over {_R} end")
_by_type("rolling_std", col("value").rolling_std(4), f"case when count(value) over {_R} >= 4 then stddev_samp(value) over {_R} end", True)
_by_type("rank_dense_descending", col("value").rank("dense", descending=True), "(dense_rank() over (partition by event_type order by value desc))::int")
_by_type("rank_ordinal", col("user_id").rank("ordinal"), "(row_number() over (partition by event_type order by user_id, event_id))::int")


def _in_ranges(name: str, e, sql: str) -> None:
    """A query of one expression over the whole table, found in 8 ranges of its values or order."""
    query(name, f"select event_id, {sql} as v from events")(lambda d: AxisTable(d.events, order_by="event_id", order_parts=8).transmute(obs={"event_id": col("event_id"), "v": e}).obs_frame())


_in_ranges("min_rank_in_ranges", ax.min_rank("user_id").cast("long"), "rank() over (order by user_id)")
_in_ranges("dense_rank_in_ranges", ax.dense_rank("user_id", descending=True).cast("long"), "dense_rank() over (order by user_id desc)")
_in_ranges("average_rank_in_ranges", ax.average_rank("value"), "rank() over (order by value) + (count(*) over (partition by value) - 1) / 2")
_in_ranges("ntile_in_ranges", ax.ntile("value", 9), "floor((row_number() over (order by value, event_id) - 1) * 9 / count(*) over ())::bigint + 1")
_in_ranges("lag_in_ranges", ax.lag("value", 3, -1.0), "lag(value, 3, -1.0::double) over (order by event_id)")
_in_ranges("rolling_max_in_ranges", col("value").rolling_max(6), "case when count(value) over (order by event_id rows 5 preceding) >= 6 then max(value) over (order by event_id rows 5 preceding) end")
_in_ranges("cum_count_in_ranges", ax.row_number().cast("long"), "row_number() over (order by event_id)")


def _per_type(name: str, e, sql: str, digits: bool = False) -> None:
    query(name, f"select event_type, {f'round({sql} + 1.23e-7, 6)' if digits else sql} as v from events group by event_type")(lambda d: rounded(o, "v") if (o := d.by_type().summarize(obs={"v": e})) is not None and digits else o)


_per_type("n_distinct", ax.n_distinct("user_id"), "count(distinct user_id)")
_per_type("median", ax.median("value"), "median(value)", True)
_per_type("sd", ax.sd("value"), "stddev_samp(value)", True)
_per_type("first", ax.first("value"), "arg_min(value, event_id)")
_per_type("last", ax.last("value"), "arg_max(value, event_id)")
_per_type("nth", ax.nth("value", 3), "list(value order by event_id)[4]")
_per_type("std_population", col("value").std(ddof=0), "stddev_pop(value)", True)
_per_type("len_count", col("user_id").len() + col("user_id").count(), "2 * count(*)")
_per_type("map_batches_scalar", col("value").map_batches(lambda v: float(v.max() - v.min()), "double", returns_scalar=True), "max(value) - min(value)", True)
_per_type("all_any", (col("value") > 0).all() & (col("value") > 99).any(), "bool_and(value > 0) and bool_or(value > 99)")
query("n_distinct_na", "select lang, count(distinct quality) + max((quality is null)::int) as v from documents left join labels using (doc_id) group by 1")(lambda d: d.labelled().summarize(obs={"v": ax.n_distinct("quality")}, by="lang"))


def _plain(name: str, e, sql: str) -> None:
    query(name, f"select event_id, {sql} as v from events")(lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "v": e}).obs_frame())


_plain("case_when", ax.case_when((col("value") > 80, "high"), (col("value") > 20, "mid"), default="low"), "case when value > 80 then 'high' when value > 20 then 'mid' else 'low' end")
_plain("case_match", ax.case_match("event_type", (["click", "view"], "look"), ("purchase", "buy"), default="other"), "case when event_type in ('click', 'view') then 'look' when event_type = 'purchase' then 'buy' else 'other' end")
_plain("recode", ax.recode("event_type", {"click": "c", "view": "v"}), "case event_type when 'click' then 'c' when 'view' then 'v' else event_type end")
_plain("if_else", ax.if_else(col("value") > 50, "up", "down"), "case when value > 50 then 'up' else 'down' end")
_plain("na_if", ax.na_if("event_type", "click"), "nullif(event_type, 'click')")
_plain("between", ax.between("value", 10, 50, closed="left"), "value >= 10 and value < 50")
_plain("near", ax.near("value", 50.0, tolerance=5.0), "abs(value - 50.0) <= 5.0")
_plain("string_methods", col("event_type").str.slice(0, 3).str.to_uppercase(), "upper(substr(event_type, 1, 3))")
_plain("clip", col("value").clip(10, 20.5), "least(greatest(value, 10.0), 20.5)")
_plain("round", col("user_id").cast("double").spark(lambda c: c / 8).round(1), "round_even(user_id::double / 8, 1)")
_plain("replace_strict", (col("user_id") % 3).cast("int").replace_strict({0: "zero", 1: "one", 2: "two"}), "['zero', 'one', 'two'][(user_id % 3) + 1]")
_plain("is_between", col("value").is_between(10, 20, closed="none") | col("value").fill_null(0).is_null(), "value > 10 and value < 20")
_plain("casts", (col("value").floor() + col("value").ceil() + col("value").cast("long").abs()).cast("long"), "(floor(value) + ceil(value) + abs(trunc(value)))::bigint")
_plain("strings_case", col("event_type").str.to_titlecase().spark(lambda a, b: F.concat(a, b), col("event_type").str.to_lowercase()), "upper(event_type[1]) || event_type[2:] || lower(event_type)")
_plain("strings_tests", col("event_type").str.starts_with("c") | col("event_type").str.ends_with("e") | col("event_type").str.contains("i.w"), "starts_with(event_type, 'c') or ends_with(event_type, 'e') or regexp_matches(event_type, 'i.w')")
_plain("strings_edit", col("event_type").str.replace_all("[aeiou]", "_").str.strip_chars("_c"), "trim(regexp_replace(event_type, '[aeiou]', '_', 'g'), '_c')")
_plain("strings_parts", col("event_type").str.head(2).spark(lambda a, b, c: F.concat(a, F.lit("|"), b, F.lit("|"), c.cast("string")), col("event_type").str.tail(2), col("event_type").str.len_chars()), "event_type[:2] || '|' || right(event_type, 2) || '|' || length(event_type)")
_plain("strings_zfill", col("user_id").cast("string").str.zfill(5), "lpad(user_id::varchar, 5, '0')")
_plain("strings_split", col("event_type").str.split("i").spark(F.size).cast("long"), "len(string_split(event_type, 'i'))")
_plain("dates_parts", col("ts").dt.year() * 10000 + col("ts").dt.month() * 100 + col("ts").dt.weekday() + col("ts").dt.minute() + col("ts").dt.second(), "(year(ts) * 10000 + month(ts) * 100 + isodow(ts) + minute(ts) + second(ts))::int")
_plain("dates_truncate", col("ts").dt.truncate("month").dt.date().cast("string"), "strftime(date_trunc('month', ts), '%Y-%m-%d')")
_plain("date_methods", col("ts").dt.hour() + col("ts").dt.day(), "(hour(ts) + day(ts))::int")
query("coalesce", "select doc_id, coalesce(quality, toxic, -1) as a, coalesce(toxic, 9) as b, quality is null as missing from documents left join labels using (doc_id)")(lambda d: d.labelled().transmute(obs={"doc_id": col("doc_id"), "a": ax.coalesce("quality", "toxic", -1), "b": ax.replace_na("toxic", 9), "missing": ax.is_na("quality")}).obs_frame())
query("if_any", "select event_id from events where value > 95 or user_id > 95")(lambda d: d.events_table().filter(obs=ax.if_any(["value", "user_id"], lambda e: e > 95)).select(obs="event_id").obs_frame())
query("if_all", "select event_id from events where value > 20 and user_id > 20")(lambda d: d.events_table().filter(obs=ax.if_all(["value", "user_id"], lambda e: e > 20)).select(obs="event_id").obs_frame())
query("selectors", "select c_custkey, c_acctbal, c_mktsegment from customer")(lambda d: d.customers().select(obs=[ax.where(ax.is_numeric) & ~ax.contains("nation"), ax.last_col()]).obs_frame())
query("selector_union", "select c_name, c_nationkey, c_acctbal, c_mktsegment from customer")(lambda d: d.customers().select(obs=(ax.matches("^c_n") | ax.ends_with("bal") | ax.all_of(["c_mktsegment"]))).obs_frame())
query("selector_all_of", "select c_acctbal, c_custkey from customer")(lambda d: d.customers().select(obs=ax.all_of(["c_acctbal", "c_custkey"])).obs_frame())
query("num_range", "select vec_id, round(embedding[2]::double + 1.23e-7, 6) as f1, round(embedding[3]::double + 1.23e-7, 6) as f2 from embeddings")(lambda d: rounded(d.vectors().to_df(obs="vec_id", x=ax.num_range("f", [1, 2])), "f1", "f2"))
query("pick", "select event_id, greatest(value, user_id) as most from events")(lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "most": col("value").spark(lambda a, b: F.greatest(a, b.cast("double")), col("user_id"))}).select(obs=ax.pick("event_id", "most")).obs_frame())
query("mutate_across", "select c_custkey, upper(c_name) as c_name_up, upper(c_mktsegment) as c_mktsegment_up from customer")(lambda d: d.customers().transmute(obs=[{"c_custkey": col("c_custkey")}, ax.across(["c_name", "c_mktsegment"], lambda e: e.str.to_uppercase(), names="{col}_up")]).obs_frame())
query("map_batches", "select event_id, round(value * 2 + 1 + 1.23e-7, 6) as v from events")(lambda d: rounded(d.events_table().transmute(obs={"event_id": col("event_id"), "v": col("value").map_batches(lambda s: s * 2 + 1)}).obs_frame(), "v"))

# -- extraction ----------------------------------------------------------------------------------------------------------

query("pull", "select round(embedding[6]::double + 1.23e-7, 6) as f5 from embeddings")(lambda d: rounded(d.vectors().pull(x="f5").select(F.col("f5").cast("double").alias("f5")), "f5"))
query("pull_raw", "select round(embedding[3]::double + 1.23e-7, 6) as r2 from embeddings")(lambda d: rounded(d.rich().pull(raw="r2"), "r2"))
query("pull_layer", "select round(embedding[3]::float * 2 + 1.23e-7, 6) as f2 from embeddings")(lambda d: rounded(d.rich().pull(x="f2", layer="twice"), "f2"))
query("pull_obsm", "select round(embedding[6]::double + 1.23e-7, 6) as p1 from embeddings")(lambda d: rounded(d.rich().pull(obsm={"pca": "p1"}), "p1"))
query("pull_var", "select (k * k)::int as square from range(64) t(k)")(lambda d: d.rich().pull(var="square"))
query("pull_varm", "select (-k)::double as \"1\" from range(64) t(k)")(lambda d: d.rich().pull(varm={"loadings": "1"}))
query("pull_obsp", "select 4 as a, label::double as \"5\" from embeddings where vec_id = 4")(lambda d: d.rich().pull(obsp={"next": 5}).withColumn("a", F.col("a").cast("int")))
query("to_df_sources", "select vec_id, round(embedding[1]::double + 1.23e-7, 6) as raw_r0, round(embedding[5]::double + 1.23e-7, 6) as pca_p0, case when vec_id = 6 then (select label::double from embeddings where vec_id = 6) else 0 end as next_7 from embeddings")(lambda d: rounded(d.rich().to_df(obs="vec_id", raw="r0", obsm={"pca": "p0"}, obsp={"next": [7]}), "raw_r0", "pca_p0"))
query("as_frame_varm", "select 'f' || k as name, k::double as \"0\", (-k)::double as \"1\" from range(64) t(k)")(lambda d: d.rich().as_frame("varm", key="loadings"))
query("budget_kept", "select vec_id, round(embedding[1]::double + 1.23e-7, 6) as f0 from embeddings")(lambda d: rounded(d.vectors().to_df(obs="vec_id", x="f0", max_matrix_values=10**9), "f0"))
query("escape_hatch", "select event_id, sqrt(abs(value)) > ln(user_id + 2) as v from events")(lambda d: d.events_table().transmute(obs={"event_id": col("event_id"), "v": col("value").spark(lambda v, u: F.sqrt(F.abs(v)) > F.log(u + 2), col("user_id"))}).obs_frame())


def _refused(d: Data) -> DataFrame:
    """What each misuse raises, before any result is made."""
    t, v = d.events_table(), d.vectors()
    twice = d.events.select("user_id", F.col("event_id").alias("w"))
    calls = {
        "truth of an expression": lambda: bool(col("value") > 1),
        "budget": lambda: v.to_df(obs="vec_id", x=["f0", "f1"], max_matrix_values=3),
        "duplicate keys of the right table": lambda: t.left_join(twice, by="user_id"),
        "unmatched rows": lambda: t.left_join(twice.where("user_id < 0"), by="user_id", unmatched="error"),
        "one-to-one": lambda: t.left_join(twice.groupBy("user_id").agg(F.max("w").alias("w")), by="user_id", relationship="one-to-one"),
        "unknown policy": lambda: t.left_join(twice, by="user_id", relationship="some"),
        "no common column": lambda: t.left_join(d.region),
        "equal suffixes": lambda: t.left_join(d.events.select("event_id", "value"), by="event_id", suffixes=("_x", "_x")),
        "order of a right join": lambda: t.right_join(twice, by="user_id"),
        "key made twice": lambda: t.summarize(obs={"event_type": ax.n()}, by="event_type"),
        "computed key over a column": lambda: t.summarize(obs={"n": ax.n()}, by={"value": col("value") + 1}),
        "name of a count": lambda: t.count("event_type", name="event_type"),
        "summary without an aggregate": lambda: t.summarize(obs={"v": col("value")}),
        "unknown column": lambda: t.select(obs="nothing"),
        "unknown feature": lambda: v.select(x="nothing"),
        "unknown layer": lambda: v.pull(x="f0", layer="nothing"),
        "rename to an equal name": lambda: t.rename(obs={"value": "user_id"}),
        "unknown name": lambda: ax.rename_obs_names(v, {"a": "nobody"}),
        "two axes": lambda: t.group_by(obs="user_id", var="name"),
        "verb on the other axis": lambda: d.rich().group_by(var="kind").mutate(obs={"a": ax.lit(1)}),
        "long table without features": lambda: v.to_tidy(obs="label"),
        "clashing long names": lambda: v.to_tidy(obs="label", x="f0", feature="label"),
        "sample larger than its rows": lambda: t.slice_sample(10**9),
        "keys of pivot_wider": lambda: ax.pivot_wider(d.events.select("user_id", "event_type", "value"), "user_id", "event_type", "value"),
    }
    rows = []
    for name, call in calls.items():
        try:
            call()
            rows.append((name, "nothing"))
        except Exception as error:
            rows.append((name, type(error).__name__))
    return d.spark.createDataFrame(rows, "misuse string, raises string")


query("refusals", """select * from (values ('truth of an expression', 'TypeError'), ('budget', 'AxisFrameError'), ('duplicate keys of the right table', 'JoinRelationshipError'), ('unmatched rows', 'JoinRelationshipError'), ('one-to-one', 'JoinRelationshipError'), ('unknown policy', 'JoinRelationshipError'), ('no common column', 'JoinRelationshipError'), ('equal suffixes', 'DuplicateNameError'), ('order of a right join', 'JoinRelationshipError'), ('key made twice', 'DuplicateNameError'), ('computed key over a column', 'DuplicateNameError'), ('name of a count', 'DuplicateNameError'), ('summary without an aggregate', 'SelectionError'), ('unknown column', 'UnknownColumnError'), ('unknown feature', 'UnknownColumnError'), ('unknown layer', 'UnknownSourceError'), ('rename to an equal name', 'DuplicateNameError'), ('unknown name', 'UnknownColumnError'), ('two axes', 'IncompatibleAxisError'), ('verb on the other axis', 'IncompatibleAxisError'), ('long table without features', 'SelectionError'), ('clashing long names', 'NameRepairError'), ('sample larger than its rows', 'SelectionError'), ('keys of pivot_wider', 'DuplicateNameError')) t(misuse, raises)""")(_refused)
query("pipe", "select event_type, count(*) as n from events where value > 50 group by 1")(lambda d: d.events_table().pipe(lambda t, least: t.filter(obs=col("value") > least), 50).pipe((lambda by, table: table.count(by), "table"), "event_type"))
query("to_df", "select vec_id, label, round(embedding[1]::double + 1.23e-7, 6) f0, round(embedding[64]::double + 1.23e-7, 6) f63 from embeddings")(lambda d: d.vectors().to_df(obs=["vec_id", "label"], x=["f0", "f63"]).select("vec_id", "label", *(six(F.col(c)).alias(c) for c in ("f0", "f63"))))
_LONG = "select vec_id as id, 'f' || k as feature, round(embedding[k + 1]::double + 1.23e-7, 6) as value, label from embeddings, unnest(range(0, 3)) t(k)"
query("to_tidy", _LONG)(lambda d: d.vectors().to_tidy(obs="label", x=["f0", "f1", "f2"], obs_name="id").withColumn("value", six(F.col("value"))))
query("pivot_longer", _LONG.replace("feature", "name"))(lambda d: d.vectors().pivot_longer(obs="label", x=["f0", "f1", "f2"], obs_name="id").withColumn("value", six(F.col("value"))))
query("as_frame", "select vec_id, round(embedding[2]::double + 1.23e-7, 6) f1, round(embedding[3]::double + 1.23e-7, 6) f2 from embeddings")(lambda d: d.vectors().as_frame("x", select=["f1", "f2"]).select("vec_id", *(six(F.col(c)).alias(c) for c in ("f1", "f2"))))
query("select_features", "select vec_id, round(embedding[5]::double + 1.23e-7, 6) as b, round(embedding[1]::double + 1.23e-7, 6) as f0 from embeddings")(lambda d: d.vectors().select(x=["f4", "f0"]).rename(x={"b": "f4"}).to_df(obs="vec_id", x=ax.everything()).select("vec_id", *(six(F.col(c)).alias(c) for c in ("b", "f0"))))
query("feature_means", "select 'f' || (k - 1) as feature, round(avg(v::double) + 1.23e-7, 6) as mean from (select unnest(embedding) v, generate_subscripts(embedding, 1) k from embeddings) group by k")(lambda d: rounded(d.vectors().feature_means().withColumn("feature", F.col("feature")), "mean"))
query("arrange_x", "select vec_id, row_number() over (order by embedding[1] desc, vec_id)::int as place from embeddings")(lambda d: d.vectors().arrange(x=ax.desc("f0")).mutate(obs={"place": ax.row_number()}).select(obs=["vec_id", "place"]).obs_frame())

# -- reshaping -----------------------------------------------------------------------------------------------------------

query("pivot_wider", "select l_returnflag, sum(case when l_linestatus = 'F' then 1 end)::bigint as F, sum(case when l_linestatus = 'O' then 1 end)::bigint as O from lineitem group by 1")(lambda d: ax.pivot_wider(d.lineitem_table().count(["l_returnflag", "l_linestatus"]), id_cols="l_returnflag", names_from="l_linestatus", values_from="n"))
query("nest", "select conv_id, count(*) as turns, string_agg(role, ',' order by turn) as roles from conversations group by 1")(lambda d: ax.nest(d.conversations, by="conv_id", columns=["turn", "role", "text"], order_by="turn").select("conv_id", F.size("data").cast("long").alias("turns"), F.array_join(F.transform("data", lambda r: r["role"]), ",").alias("roles")))
query("nest_by", "select event_type, count(*) as size, min(event_id) as first_id from events group by 1")(lambda d: d.events_table().nest_by("event_type", obs=["event_id", "value"]).select("event_type", F.size("data").cast("long").alias("size"), F.get("data", 0)["event_id"].alias("first_id")))
query("unnest", "select conv_id, turn, role from conversations")(lambda d: ax.unnest(ax.nest(d.conversations, by="conv_id", columns=["turn", "role"], order_by="turn"), "data"))
query("chop", "select conv_id, string_agg(role, ',' order by turn) as role, string_agg(turn::varchar, ',' order by turn) as turn from conversations group by 1")(lambda d: ax.chop(d.conversations.select("conv_id", "turn", "role"), ["role", "turn"], by="conv_id", order_by="turn").select("conv_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("role", "turn"))))
query("unchop", "select conv_id, turn, role from conversations")(lambda d: ax.unchop(ax.chop(d.conversations.select("conv_id", "turn", "role"), ["turn", "role"], by="conv_id", order_by="turn"), ["turn", "role"]))
query("unnest_longer", "select vec_id, unnest(embedding[1:3])::double as v, unnest([0, 1, 2]) as i from embeddings")(lambda d: ax.unnest_longer(d.embeddings.select("vec_id", F.slice("embedding", 1, 3).alias("e")), "e", values_to="v", indices_to="i").withColumn("v", F.col("v").cast("double")))
query("unnest_wider", "select vec_id, embedding[1]::double as e_0, embedding[2]::double as e_1 from embeddings")(lambda d: ax.unnest_wider(d.embeddings.select("vec_id", F.slice("embedding", 1, 2).cast("array<double>").alias("e")), "e", names_sep="_"))
query("pack", "select p_partkey, p_brand || '/' || p_size as both_ from part")(lambda d: ax.pack(d.part.select("p_partkey", "p_brand", "p_size"), "p", ["p_brand", "p_size"]).select("p_partkey", F.concat_ws("/", "p.p_brand", "p.p_size").alias("both_")))
query("unpack", "select p_partkey, p_brand as p_p_brand, p_size as p_p_size from part")(lambda d: ax.unpack(ax.pack(d.part.select("p_partkey", "p_brand", "p_size"), "p", ["p_brand", "p_size"]), "p", names_sep="_"))
query("hoist", "select event_id, (props::json->>'$.k')::int as k from events")(lambda d: ax.hoist(d.events.select("event_id", F.from_json("props", "struct<k: int>").alias("p")), "p", k="k").drop("p"))
query("drop_na", "select doc_id, quality, toxic from documents join labels using (doc_id) where quality is not null and toxic is not null")(lambda d: ax.drop_na(d.labelled().select(obs=["doc_id", "quality", "toxic"]).obs_frame()))
query("fill", "select event_id, last_value(case when event_type = 'click' then value end ignore nulls) over (partition by user_id order by event_id rows unbounded preceding) as v from events")(lambda d: ax.fill(d.events.select("event_id", "user_id", F.when(F.col("event_type") == "click", F.col("value")).alias("v")), "v", order_by="event_id", by="user_id").drop("user_id"))
query("separate", "select p_partkey, split_part(p_name, ' ', 1) as a, nullif(split_part(p_name, ' ', 2), '') as b from part")(lambda d: ax.separate(d.part.select("p_partkey", "p_name"), "p_name", ["a", "b"], sep=" "))
query("separate_rows", "select p_partkey, unnest(string_split(p_name, ' ')) as p_name from part")(lambda d: ax.separate_rows(d.part.select("p_partkey", "p_name"), "p_name", sep=" "))
query("extract", "select c_custkey, nullif(regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 1), '') as word, nullif(regexp_extract(c_name, '([A-Za-z]+)#0*([0-9]+)', 2), '') as number from customer")(lambda d: ax.extract(d.customer.select("c_custkey", "c_name"), "c_name", ["word", "number"], "([A-Za-z]+)#0*([0-9]+)"))
query("unite", "select p_partkey, p_brand || '-' || coalesce(p_type, '') as both_ from part")(lambda d: ax.unite(d.part.select("p_partkey", "p_brand", "p_type"), "both_", ["p_brand", "p_type"], sep="-"))

# -- utilities -----------------------------------------------------------------------------------------------------------

query("sample_meta", "select n_regionkey, r_name from (select distinct n_regionkey, r_name from nation join region on n_regionkey = r_regionkey)")(lambda d: ax.sample_meta(AxisTable(d.nation, order_by="n_nationkey").inner_join(d.region.withColumnRenamed("r_regionkey", "n_regionkey"), by="n_regionkey"), "n_regionkey", include=["r_name"]))
query("sample_summary", "select label, count(*) as n, round(avg(embedding[1]::double) + 1.23e-7, 6) as m from embeddings group by 1")(lambda d: rounded(ax.sample_summary(d.vectors(), "label", obs={"n": ax.n()}, x={"m": ax.mean("f0")}), "m"))
query("add_sample_meta", "select event_id, event_type, length(event_type)::int as size from events")(lambda d: ax.add_sample_meta(d.events_table(), d.events.select(F.col("event_type").alias("kind"), F.length("event_type").alias("size")).distinct(), sample="event_type", by="kind").select(obs=["event_id", "event_type", "size"]).obs_frame())
query("feature_present", "select * from (values ('f0', true, null), ('F1', false, 'f1'), ('g', false, null)) t(feature, found, wrong_case_found)")(lambda d: ax.feature_present(d.vectors(), ["f0", "F1", "g"]).to_frame())
query("name_duplicates", "with e as (select *, (row_number() over (order by event_id) - 1)::int p from events) select user_id as name, count(*) as count, string_agg(p::varchar, ',' order by p) as positions from e group by 1 having count(*) > 1")(lambda d: ax.name_duplicates(d.events_table(), name="user_id").withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ",")))
query("add_name_prefix", "select 'v_' || vec_id as vec_id, label from embeddings")(lambda d: ax.add_name_prefix(d.vectors(), "v").obs_frame())
query("rename_obs_names", "select case vec_id when 3 then 'three' when 0 then 'zero' else vec_id::varchar end as vec_id, label from embeddings")(lambda d: ax.rename_obs_names(d.vectors(), {"three": "3", "zero": "0"}).obs_frame())
query("rename_obs_names_function", "select vec_id || '!' as vec_id, label from embeddings")(lambda d: ax.rename_obs_names(d.vectors(), lambda n: n + "!").obs_frame())
query("rename_var_names", "select case k when 1 then 'one' else 'f' || k end as name, case when k % 2 = 0 then 'even' else 'odd' end as kind from range(64) t(k)")(lambda d: ax.rename_var_names(d.rich(), {"one": "f1"}).var_frame().select("name", "kind"))
query("replace_name_suffix", "select case when vec_id % 10 = 7 then left(vec_id::varchar, length(vec_id::varchar) - 1) || '_' else vec_id::varchar end as vec_id, label from embeddings")(lambda d: ax.replace_name_suffix(d.vectors(), "7", "_").obs_frame())
query("get_palette", "select event_type as level, ['#a', '#b', '#c', '#d', '#e', '#f', '#g', '#h'][row_number() over (order by f)] as color from (select event_type, min(event_id) f from events group by 1)")(
    lambda d: d.spark.createDataFrame(list(ax.get_palette(ax.store_palette(d.events_table(), "event_type", [f"#{c}" for c in "abcdefgh"]), "event_type").items()), "level string, color string")
)
query("palette", "select level, (row_number() over (order by f) - 1)::int as ordinal, ['#a', '#b', '#c', '#d', '#e', '#f', '#g', '#h'][row_number() over (order by f)] as color from (select event_type as level, min(event_id) f from events group by 1)")(lambda d: ax.store_palette(d.events_table(), "event_type", [f"#{c}" for c in "abcdefgh"]).as_frame("uns", key="event_type_colors"))
