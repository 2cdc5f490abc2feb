"""The operators of the engine as queries over the test tables, each with its SQL.

Selectors run over virtual partitions, an expression over a table, so that Catalyst sees plain filters and
joins; facts are aggregated per partition before they meet cohorts. Everything that concerns stored shards
runs a pipeline over a tree in the shared folder: `History` builds it from orders and events, changes its
sources step by step, and keeps what the engine says at each step.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.errors import ConfigError
from tidemill.functions.digests import fingerprints
from tidemill.functions.natural import natural
from tidemill.operators.relaxed import relaxed_union
from tidemill.operators.selectors import PART, Selector, after_part, all_of, as_column, before_part, between, claimed, own_last_copy, parts, same_part, select, walk_forward
from tidemill.plans.picture import columns
from tidemill.plans.pipeline import Pipeline
from tidemill.sources.store import Store, decode, encode
from tidemill.streaming.sink import append_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select("o_orderkey", "o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.year("o_orderdate").cast("string").alias("season"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


O = "o as (select o_orderkey, o_custkey, round(o_totalprice * 100)::bigint as cents, year(o_orderdate)::varchar as season from orders)"
L = "l as (select l_returnflag as flag, l_linestatus as status, round(l_extendedprice * 100)::bigint as cents from lineitem)"

def _totals() -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "cents": F.sum("cents")}


def _merged() -> dict[str, Callable[[str], Column]]:
    return {"n": lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long"), "cents": lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")}


def seasons(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).select("season").distinct()


def _walk(spark: SparkSession, d: str, selector: Selector) -> DataFrame:
    return walk_forward(seasons(spark, d), orders(spark, d), selector.bind(("season",)), _totals(), _merged())


def _walk_sql(test: str) -> str:
    return f"with {O}, p as (select distinct season from o) select p.season, count(o.season)::bigint as n, coalesce(sum(o.cents), 0)::bigint as cents from p left join o on {test} group by p.season"


@query(f"with {O} select count(*)::bigint as n, sum(cents)::bigint as cents from o")
def q_all_of(spark, d):
    return orders(spark, d).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(_walk_sql("o.season = p.season"))
def q_same_part(spark, d):
    return _walk(spark, d, same_part("orders"))


@query(_walk_sql("o.season < p.season"))
def q_before_part(spark, d):
    return _walk(spark, d, before_part("orders"))


@query(_walk_sql("o.season <= p.season"))
def q_before_part_inclusive(spark, d):
    return _walk(spark, d, before_part("orders", inclusive=True))


@query(_walk_sql("o.season > p.season"))
def q_after_part(spark, d):
    return _walk(spark, d, after_part("orders"))


@query(_walk_sql("o.season >= p.season"))
def q_after_part_inclusive(spark, d):
    return _walk(spark, d, after_part("orders", inclusive=True))


@query("with p as (select distinct p_size from part) select p.p_size::varchar as size, count(s.p_size)::bigint as n, coalesce(sum(round(s.p_retailprice * 100)::bigint), 0)::bigint as cents from p left join part s on s.p_size < p.p_size group by p.p_size")
def q_before_part_natural(spark, d):
    facts = read(spark, d, "part").select(F.col("p_size").cast("string").alias("size"), F.round(F.col("p_retailprice") * 100).cast("long").alias("cents"))
    return walk_forward(facts.select("size").distinct(), facts, before_part("part").bind(("size",)), _totals(), _merged())


@query(f"with {O}, g as (select season, count(*)::bigint as n from o group by season) select season, n, coalesce(sum(n) over (order by season rows between unbounded preceding and 1 preceding), 0)::bigint as before from g")
def q_prefix_window(spark, d):
    w = Window.orderBy(natural(F.col("season"))).rowsBetween(Window.unboundedPreceding, -1)
    return orders(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))


@query(f"with {O}, g as (select season, count(*)::bigint as n from o group by season) select season, n, coalesce(sum(n) over (order by season rows between 1 following and unbounded following), 0)::bigint as after from g")
def q_suffix_window(spark, d):
    w = Window.orderBy(natural(F.col("season"))).rowsBetween(1, Window.unboundedFollowing)
    return orders(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n")).withColumn("after", F.coalesce(F.sum("n").over(w), F.lit(0)))


def _chosen(spark, d, selector: Selector, facts: DataFrame, keys: list[str]) -> DataFrame:
    return facts.where(as_column(selector.where(), F.col)).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))


@query(f"with {O} select season, count(*)::bigint as n, sum(cents)::bigint as cents from o where season >= '1996' and season < '1999' group by season")
def q_between(spark, d):
    return _chosen(spark, d, between("orders", key="season", ge="1996", lt="1999"), orders(spark, d), ["season"])


@query(f"with {O} select season, count(*)::bigint as n, sum(cents)::bigint as cents from o where season in ('1995', '1998') group by season")
def q_parts(spark, d):
    return _chosen(spark, d, parts("orders", season=["1995", "1998"]), orders(spark, d), ["season"])


@query(f"with {L} select flag, status, count(*)::bigint as n, sum(cents)::bigint as cents from l where flag in ('A', 'R') and status = 'F' group by flag, status")
def q_parts_multi(spark, d):
    return _chosen(spark, d, parts("lineitem", flag=["A", "R"], status="F"), lines(spark, d), ["flag", "status"])


def _walk_lines(spark, d, selector: Selector) -> DataFrame:
    facts = lines(spark, d)
    return walk_forward(facts.select("flag", "status").distinct(), facts, selector.bind(("flag", "status")), _totals(), _merged())


def _lines_sql(test: str) -> str:
    return f"with {L}, p as (select distinct flag, status from l) select p.flag, p.status, count(l.flag)::bigint as n, coalesce(sum(l.cents), 0)::bigint as cents from p left join l on {test} group by p.flag, p.status"


@query(_lines_sql("l.flag = p.flag and l.status = p.status"))
def q_same_part_composite(spark, d):
    return _walk_lines(spark, d, same_part("lineitem"))


@query(_lines_sql("l.flag < p.flag and l.status = p.status"))
def q_before_preserve(spark, d):
    return _walk_lines(spark, d, before_part("lineitem", key="flag"))


@query(_lines_sql("l.flag <= p.flag"))
def q_before_no_preserve(spark, d):
    return _walk_lines(spark, d, before_part("lineitem", key="flag", inclusive=True, preserve=()))


@query("select n_nationkey::bigint as k, n_name as nm, null::double as bal from nation union all select c_custkey, c_name, c_acctbal from customer")
def q_relaxed_union(spark, d):
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nm"))
    return relaxed_union([nation, read(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("nm"), F.col("c_acctbal").alias("bal"))])



class History:
    """A pipeline over orders and events, and what the engine says as its sources change.

    feed (a source by season; 1995 comes later) -> box -> features -> cohorts -> report, with knobs; and stages
    for single operators beside it.
    """

    def __init__(self, spark: SparkSession, d: str):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not spark.sparkContext.master.startswith("local"):
                raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            shared = tempfile.mkdtemp(prefix="tidemill-")
        root = f"{shared.rstrip('/')}/tidemill-history-{uuid.uuid4().hex}"
        self.spark, self.p = spark, Pipeline(spark, f"{root}/tree", trace=f"{root}/trace", guard=False)
        p, o = self.p, orders(spark, d).persist()
        every = sorted(r[0] for r in seasons(spark, d).collect())
        feed = p.source("feed", part="season", why="orders of a year")
        p.source("unread", part="season", why="nobody reads it")
        knobs = p.source("knobs", ext=".json", why="settings")
        p.writes("knobs", {"factor": 2})

        @p.step("box", part="season", universe=lambda: [x.part for x in p.store.shards("feed").values()])
        def box(feed=same_part(feed), k=all_of(knobs)):
            return feed.withColumn("doubled", F.col("cents") * k["factor"])

        @p.step("features", part="season", universe=lambda: [x.part for x in p.store.shards("feed").values()])
        def features(box=same_part(box)):
            return box.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))

        @p.step("cohorts", part="season", universe=every)
        def cohorts(features=before_part(features, optional=True), season=None):
            if features is None:
                return spark.createDataFrame([(season, 0, 0)], "season string, n long, cents long")
            return features.agg(F.lit(season).alias("season"), F.sum("n").alias("n"), F.sum("cents").alias("cents"))

        @p.step("report")
        def report(cohorts=all_of(cohorts)):
            return cohorts.agg(F.sum("n").alias("n"), F.sum("cents").alias("cents"))

        def write(season: str, rows: DataFrame) -> None:
            p.writes("feed", rows.where(F.col("season") == season), part={"season": season})

        in_order = o.repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
        for season in every:
            if season != "1995":
                write(season, in_order)
        p.run()
        # 1995 comes late.
        write("1995", in_order)
        self.late_plan = p.staleness()
        p.run(up_to="features")
        self.late = p.staleness()["cohorts"]
        self.required = p.required({"report"})
        p.run()
        # The same rows in another order.
        write("1996", o.repartition(2, "cents").sortWithinPartitions(F.desc("cents")))
        self.same = p.staleness()
        self.again = p.run()
        write("1996", in_order)
        self.before = self.manifest()
        self.keys = {s: p.key_of(cohorts, cohorts.outputs["out"], {"season": s}) for s in every}
        newer = replace(cohorts, version="2")
        self.versions = {s: p.key_of(newer, newer.outputs["out"], {"season": s}) for s in every}
        self.ids = self.selections()
        # 1998 moves.
        write("1998", in_order.withColumn("cents", F.col("cents") + 1))
        self.stale, self.status, self.reasons = p.staleness(), p.status(), p.reasons()
        self.follow = p.downstream({"box": {"season=1998"}})
        self.tick = p.impact("box", part={"season": "2000"})
        self.built = p.run()
        self.after, self.ids_after = self.manifest(), self.selections()
        self.keys_after = {s: p.key_of(cohorts, cohorts.outputs["out"], {"season": s}) for s in every}
        p.flush()

    def manifest(self) -> set[tuple[str, str, str]]:
        return {(d, part, s.fp) for d in ("feed", "box", "features", "cohorts", "report") for part, s in self.p.store.shards(d).items()}

    def selections(self) -> dict[str, str]:
        of = lambda where: self.p.store.id_of(select(self.p.store.shards("feed").values(), where))
        return {"all": of({}), "to 1997": of({"season": {"le": "1997"}}), "from 1998": of({"season": {"ge": "1998"}})}

    def frame(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(list(rows), schema)

    def load(self, dataset: str, **how) -> DataFrame:
        return self.p.store.load(select(self.p.store.shards(dataset).values(), {}), **how)


_HISTORIES: dict[tuple[str, str], History] = {}


def history(spark: SparkSession, d: str) -> History:
    """One for each session and folder."""
    key = spark.sparkContext.applicationId, d
    if key not in _HISTORIES:
        _HISTORIES[key] = History(spark, d)
    return _HISTORIES[key]


def part_season(part: str) -> str:
    return decode(part).get("season", "")


def tree(spark: SparkSession, d: str) -> Pipeline:
    """A pipeline in an empty tree beside the history's."""
    return Pipeline(spark, history(spark, d).p.tree + "-" + uuid.uuid4().hex, guard=False)


S = "s as (select distinct season from o)"
MOVED = "c as (select * replace (cents + case when season = '1998' then 1 else 0 end as cents) from o)"


@query(f"with {O}, w as (select unnest(['1994', '1995', '2001', '2050']) as season) select season from w where season not in (select season from o)")
def q_coverage_missing(spark, d):
    where = parts("feed", season=["1994", "1995", "2001", "2050"]).where()
    found = select(history(spark, d).p.store.shards("feed").values(), {"season": {"ge": "0"}})
    return spark.createDataFrame([(v,) for _, lost in claimed(where, [s.part for s in found]) for v in lost], "season string")


@query(f"with {O} select season, count(*)::bigint as n from o where season in ('1995', '2050') and (select count(distinct season) from o where season in ('1995', '2050')) = 2 group by season")
def q_optional_empty(spark, d):
    h = history(spark, d)
    shards = h.p.chosen(parts("feed", season=["1995", "2050"], optional=True))
    return (h.p.store.load(shards) if shards else h.load("feed").limit(0)).groupBy("season").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {O} select season, o_orderkey, row_number() over (order by season, o_orderkey)::bigint as place from o")
def q_ordered_read(spark, d):
    h = history(spark, d)
    rows = h.load("feed", ordered=True).select("season", "o_orderkey").withColumn("at", F.monotonically_increasing_id())
    # Written down, as Catalyst drops a sort below the aggregate that follows.
    rows.write.parquet(path := f"{h.p.tree}-ordered-{uuid.uuid4().hex}")
    rows = spark.read.parquet(path)
    # A row's place is the rows of the partitions before its own and its number there: no task sorts everything.
    own = rows.withColumn("pid", F.shiftright("at", 33)).withColumn("k", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    before = own.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return own.join(F.broadcast(before), "pid").select("season", "o_orderkey", (F.col("before") + F.col("k") + 1).alias("place"))


@query("with v as (select distinct event_type, user_id from events) select event_type || user_id as v, dense_rank() over (order by event_type, user_id)::bigint as place from v")
def q_natural_order(spark, d):
    v = read(spark, d, "events").select(F.concat("event_type", F.col("user_id").cast("string")).alias("v")).distinct()
    return v.withColumn("place", F.dense_rank().over(Window.orderBy(natural(F.col("v")))).cast("long"))


@query(f"with {O} select max(season) as season from o")
def q_last_part(spark, d):
    p = history(spark, d).p
    found = p.determinism("box", sample=True)
    last = select(p.store.shards("box").values(), {})[-1]
    return spark.createDataFrame([(last.part["season"],)] if not found else [], "season string")


@query("select event_type, count(*)::bigint as n, count(distinct user_id)::bigint as users from events group by event_type")
def q_split(spark, d):
    p = tree(spark, d)
    by = p.dataset("by", part="event_type")

    @p.step(by, split=True, once=True)
    def split():
        return read(spark, d, "events").select("event_type", "user_id")

    split()
    rows = [(s.part["event_type"], p.store.load([s])) for s in p.store.shards("by").values()]
    out = [df.agg(F.lit(t).alias("event_type"), F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users")) for t, df in rows]
    return relaxed_union(out)


@query(f"with {O} select 'count' as output, season, count(*)::bigint as value from o group by season union all select 'cents', season, sum(cents)::bigint from o group by season")
def q_multi_output(spark, d):
    p = tree(spark, d)

    @p.step({"count": "n", "cents": "sum"}, once=True)
    def both():
        one = orders(spark, d).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
        return {"count": one.select("season", F.col("n").alias("value")), "cents": one.select("season", F.col("cents").alias("value"))}

    both()
    return relaxed_union([both.load(output=x).select(F.lit(x).alias("output"), "season", "value") for x in ("count", "cents")])


@query(f"with {O}, old as (select o_orderkey, cents from o where season <= '1997'), new as (select o_orderkey, cents + 1 as cents from o where season >= '1997') select * from new union all select * from old where o_orderkey not in (select o_orderkey from new)")
def q_own_last_copy(spark, d):
    p, o = tree(spark, d), orders(spark, d)
    incoming = p.source("incoming")

    @p.step("latest")
    def latest(new=all_of(incoming), old=own_last_copy()):
        return new if old is None else new.unionByName(old.join(new, "o_orderkey", "left_anti"))

    p.writes("incoming", o.where("season <= '1997'").select("o_orderkey", "cents"))
    latest()
    p.writes("incoming", o.where("season >= '1997'").select("o_orderkey", (F.col("cents") + 1).alias("cents")))
    return latest()


@query("select event_id % 2 as half, event_type, count(*)::bigint as n from events group by event_type, event_id % 2")
def q_append(spark, d):
    p, half = tree(spark, d), [0]

    @p.step("audit", append=True)
    def audit():
        return read(spark, d, "events").where(F.col("event_id") % 2 == half[0]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("half", F.lit(half[0]).cast("long"))

    audit()
    half[0] = 1
    audit()
    return p.store.load(select(p.store.shards("audit").values(), {}))


@query(f"with {O}, {MOVED} select o.season, bool_and(o.cents = c.cents) as same from o join c using (o_orderkey, o_custkey) group by o.season")
def q_fingerprint(spark, d):
    o = orders(spark, d)
    of = lambda df: {k[0]: fp for k, fp in fingerprints(df, ["season"], df.schema)}
    one, two = of(o), of(o.withColumn("cents", F.col("cents") + F.when(F.col("season") == "1998", 1).otherwise(0)).repartition(3, "o_custkey"))
    return spark.createDataFrame([(s, one[s] == two[s]) for s in one], "season string, same boolean")


@query(f"with {O}, {MOVED} select 'all' as selection, count(*) = 0 as same from (select * from c except all select * from o) union all select 'to 1997', count(*) = 0 from (select * from c where season <= '1997' except all select * from o) union all select 'from 1998', count(*) = 0 from (select * from c where season >= '1998' except all select * from o)")
def q_selection_id(spark, d):
    h = history(spark, d)
    return h.frame([(k, v == h.ids_after[k]) for k, v in h.ids.items()], "selection string, same boolean")


@query(f"with {O}, {S} select season, exists (select 1 from o where o.season = '1998' and o.season < s.season) as moved from s")
def q_derivation_key(spark, d):
    h = history(spark, d)
    return h.frame([(s, k != h.keys_after[s]) for s, k in h.keys.items()], "season string, moved boolean")


@query(f"with {O}, {S} select season, true as differ from s")
def q_version_key(spark, d):
    h = history(spark, d)
    return h.frame([(s, k != h.versions[s]) for s, k in h.keys.items()], "season string, differ boolean")


@query(f"with {O}, {S} select d.dataset, s.season, case when s.season = '1998' and d.dataset = 'box' then 'its inputs moved' else 'current' end as reason from s, (values ('box'), ('features'), ('cohorts')) d(dataset)")
def q_why_stale(spark, d):
    h = history(spark, d)
    return h.frame([(x, part_season(p), why or "current") for x in ("box", "features", "cohorts") for p, why in h.stale[x].items()], "dataset string, season string, reason string")


@query(f"with {O}, {S} select season, 'current' as reason, 0::bigint as built from s")
def q_early_cutoff(spark, d):
    h = history(spark, d)
    return h.frame([(part_season(p), why or "current", len(h.again)) for p, why in h.same["box"].items()], "season string, reason string, built long")


@query(f"with {O}, {S} select season, case when season > '1995' then 'its inputs moved' else 'current' end as reason from s")
def q_backfill(spark, d):
    h = history(spark, d)
    return h.frame([(part_season(p), why or "current") for p, why in h.late.items()], "season string, reason string")


@query(f"with {O}, {S}, u as (select unnest(['1994', '1995', '1996', '2050']) as season) select u.season, case when u.season = '2050' then 'absent' when s.season is null then 'missing' else 'present' end as state from u left join s using (season)")
def q_absence(spark, d):
    p = tree(spark, d)

    @p.step("maybe", part="season", universe=["1995", "1996", "2050"], allow_missing=True, once=True)
    def maybe(season):
        rows = orders(spark, d).where(F.col("season") == season)
        return None if rows.isEmpty() else rows

    p.run()
    stored = p.store.shards("maybe")
    state = lambda s: "missing" if s is None else "absent" if s.absent else "present"
    return spark.createDataFrame([(x, state(stored.get(encode({"season": x})))) for x in ("1994", "1995", "1996", "2050")], "season string, state string")


def shards_of(h: History, dataset: str) -> int:
    return len(h.p.store.shards(dataset))


@query(f"with {O}, {S}, n as (select count(*)::bigint as shards from s) select v.src, v.dst, n.shards from n, (values ('box', 'features'), ('features', 'cohorts'), ('cohorts', 'report')) v(src, dst)")
def q_edges(spark, d):
    h = history(spark, d)
    return h.frame([(a, b, shards_of(h, a)) for a, b in h.p.edges()], "src string, dst string, shards long")


@query("select 'report' as dataset, (count(*) > 0)::bigint as shards from orders")
def q_terminal(spark, d):
    h = history(spark, d)
    read_ = {a for a, _ in h.p.edges()}
    return h.frame([(x, shards_of(h, x)) for s in h.p.order() if s.name not in read_ for x in s.datasets], "dataset string, shards long")


@query("select 'SOURCE NOBODY READS: unread' as problem, count(*) filter (o_orderkey is null)::bigint as shards from orders")
def q_sources_unread(spark, d):
    h = history(spark, d)
    return h.frame([(x, shards_of(h, "unread")) for x in h.p.check()], "problem string, shards long")


@query(f"with recursive {O}, {S}, n as (select count(*)::bigint as shards from s), e(src, dst) as (values ('box', 'features'), ('features', 'cohorts'), ('cohorts', 'report')), c as (select src, dst from e union select c.src, e.dst from c join e on c.dst = e.src) select src, dst, shards from c, n")
def q_closure(spark, d):
    h = history(spark, d)
    return h.frame([(s, x, shards_of(h, s)) for s in h.p.stages for x in h.p.closure([s]) - {s}], "src string, dst string, shards long")


@query(f"with {O}, {S} select v.stage, v.depth, case when v.stage = 'report' then 1 else (select count(*) from s) end::bigint as shards from (values ('box', 0), ('features', 1), ('cohorts', 2), ('report', 3)) v(stage, depth)")
def q_topo_depth(spark, d):
    h = history(spark, d)
    depth = [(n, k) for k, col in enumerate(columns([s.name for s in h.p.order()], h.p.edges())) for n in col]
    return h.frame([(n, k, shards_of(h, n)) for n, k in depth], "stage string, depth int, shards long")


@query(f"with {O}, {S} select 'features' as dataset, season from s where season = '1998' union all select 'cohorts', season from s where season > '1998' union all select 'report', ''")
def q_may_follow(spark, d):
    h = history(spark, d)
    return h.frame([(x, part_season(p)) for x, of in h.follow.items() for p in of], "dataset string, season string")


@query(f"with {O}, {S} select 'features' as dataset, season from s where season = '2000' union all select 'cohorts', season from s where season > '2000' union all select 'report', ''")
def q_impact(spark, d):
    h = history(spark, d)
    return h.frame([(x, part_season(p)) for x, of in h.tick.items() for p in of], "dataset string, season string")


@query(f"with {O}, {S}, x as (select d.dataset, s.season, case when d.dataset = 'box' and s.season = '1998' then 'stale' when (d.dataset = 'features' and s.season = '1998') or (d.dataset = 'cohorts' and s.season > '1998') then 'maybe' else 'current' end as tier from s, (values ('box'), ('features'), ('cohorts')) d(dataset) union all select 'report', '', 'maybe') select dataset, tier, count(*)::bigint as n from x group by dataset, tier")
def q_status_tally(spark, d):
    h = history(spark, d)
    return h.frame([(x, tier, n) for x, of in h.status.items() for tier, n in of.items() if n], "dataset string, tier string, n long")


@query("select 'box' as dataset, 'its inputs moved' as reason, '1998' as first_season, (count(distinct year(o_orderdate)) filter (year(o_orderdate) = 1998))::bigint as n from orders")
def q_reasons(spark, d):
    h = history(spark, d)
    return h.frame([(x, why, part_season(min(of)), len(of)) for (x, why), of in h.reasons.items()], "dataset string, reason string, first_season string, n long")


@query(f"with {O}, {S} select 'box' as stage, '1998' as season, 'its inputs moved (feed/season=1998)' as why union all select 'features', '1998', 'its inputs moved (box/season=1998)' union all select 'cohorts', season, 'its inputs moved (features/season=1998)' from s where season > '1998' union all select 'report', '', 'its inputs moved (cohorts/season=' || (select min(season) from s where season > '1998') || ', cohorts/season=' || (select season from s where season > '1998' order by season limit 1 offset 1) || ', cohorts/season=' || (select season from s where season > '1998' order by season limit 1 offset 2) || ')'")
def q_causes(spark, d):
    h = history(spark, d)
    # Sources that were written between runs are changes too; those of earlier steps aren't read anew.
    told = {("box", "1998"): "feed/season=1998", ("features", "1998"): "box/season=1998"}
    rows = []
    for stage, part, why in h.built:
        season = part.get("season", "")
        moved = {c for c in h.p.causes(h.p.stages[stage], part) if any(c == f"{x}/{q}" for x, q, fp in h.after - h.before)}
        assert told.get((stage, season), next(iter(moved))) in moved
        rows.append((stage, season, f"{why.partition(' (')[0]} ({', '.join(sorted(moved))})"))
    return h.frame(rows, "stage string, season string, why string")


@query(f"with {O}, {S} select 'cohorts' as stage, 'cohorts' as dataset, count(*)::bigint as stale from s where season > '1995'")
def q_required(spark, d):
    h = history(spark, d)
    return h.frame([(n, x, sum(map(bool, h.late.values()))) for n, of in h.required.items() for x in of], "stage string, dataset string, stale long")


@query(f"with {O}, {S}, v as (select 'feed' as dataset, season from s where season = '1998' union all select 'box', '1998' union all select 'features', '1998' union all select 'cohorts', season from s where season > '1998' union all select 'report', '') select c.change, v.dataset, v.season from v, (values ('added'), ('removed')) c(change)")
def q_manifest_diff(spark, d):
    h = history(spark, d)
    diff = [("added", x) for x in h.after - h.before] + [("removed", x) for x in h.before - h.after]
    return h.frame([(change, x, part_season(p)) for change, (x, p, _) in diff], "change string, dataset string, season string")


@query(f"with {O}, {S} select season from s where season not in ('1996', '1997', '1998')")
def q_orphans(spark, d):
    p = history(spark, d).p
    stage = p.stages["features"]
    kept, stage.universe = stage.universe, ["1996", "1997", "1998"]
    try:
        return spark.createDataFrame([(part_season(x),) for x in p.retired("features")], "season string")
    finally:
        stage.universe = kept


@query(f"with {O}, {S}, v as (select 'feed' as dataset, season, 1 as n from s where season = '1998' union all select 'box', '1998', 1 union all select 'features', '1998', 1 union all select 'cohorts', season, (season > '1995')::int + (season > '1998')::int from s union all select 'report', '', 2) select dataset, season, n::bigint as n from v where n > 0")
def q_duplicate_shards(spark, d):
    h = history(spark, d)
    rows: dict[tuple[str, str], int] = {}
    for x in ("feed", "box", "features", "cohorts", "report"):
        for name in h.p.store.superseded(x):
            key = x, part_season(name.split(".")[0]) if name.startswith("season=") else ""
            rows[key] = rows.get(key, 0) + 1
    return h.frame([(*k, n) for k, n in rows.items()], "dataset string, season string, n long")


@query(f"with {O}, {S}, x as (select season, case when season >= '2000' then 'o_orderkey,cents' else 'o_orderkey' end as columns from s) select columns, count(*)::bigint as n, string_agg(season, ',' order by season) as seasons from x group by columns")
def q_schema_drift(spark, d):
    p, o = tree(spark, d), orders(spark, d)
    p.store.commit_split("mixed", ("season",), o.where("season < '2000'").select("season", "o_orderkey"))
    p.store.commit_split("mixed", ("season",), o.where("season >= '2000'").select("season", "o_orderkey", "cents"))
    said = p.store.verify("mixed")
    groups: dict[str, list[str]] = {}
    for s in select(p.store.shards("mixed").values(), {}):
        groups.setdefault(",".join(c for c in p.store.schema_of(s).names if c != "season"), []).append(s.part["season"])
    assert len(said) == 1 and "schemas differ" in said[0]
    return spark.createDataFrame([(c, len(x), ",".join(x)) for c, x in groups.items()], "columns string, n long, seasons string")


@query(f"with {O}, {S} select season from s where season = '1998'")
def q_determinism(spark, d):
    p = tree(spark, d)

    @p.step("noisy", part="season", universe=[r[0] for r in seasons(spark, d).collect()])
    def noisy(season):
        rows = orders(spark, d).where(F.col("season") == season)
        return rows.withColumn("x", F.rand() if season == "1998" else F.lit(0.0))

    return spark.createDataFrame([(part_season(x.partition("/")[2]),) for x in p.determinism("noisy")], "season string")


@query(f"with {O}, {S} select v.node, v.op, v.rel, case when v.node = 'report' and v.op = 'write' then 1 else (select count(*) from s) - (v.rel = 'features' and v.op = 'read')::int end::bigint as parts from (values ('box', 'read', 'feed'), ('box', 'write', 'box'), ('features', 'read', 'box'), ('features', 'write', 'features'), ('cohorts', 'read', 'features'), ('cohorts', 'write', 'cohorts'), ('report', 'read', 'cohorts'), ('report', 'write', 'report')) v(node, op, rel)")
def q_trace_json(spark, d):
    events = history(spark, d).p.events().where("node <> '' and rel <> 'knobs'")
    return events.select("node", "op", "rel", F.explode("part").alias("x")).groupBy("node", "op", "rel").agg(F.countDistinct("x").alias("parts"))


@query(f"with {O}, {S} select 'undeclared' as side, 'features' as stage, 'read' as op, 'box' as dataset, count(*)::bigint as shards from s union all select 'unseen', 'features', 'read', 'feed', count(*)::bigint from s")
def q_trace_drift(spark, d):
    h = history(spark, d)
    stage = h.p.stages["features"]
    # The declaration is changed behind the trace's back.
    kept, stage.reads = stage.reads, {"box": replace(stage.reads["box"], dataset="feed")}
    try:
        return h.frame([(side, n, op, x, shards_of(h, x)) for side, rows in h.p.drift().items() for n, op, x in rows], "side string, stage string, op string, dataset string, shards long")
    finally:
        stage.reads = kept


@query(f"with {O}, {MOVED} select season, sum(cents * 2)::bigint as doubled from c group by season")
def q_chain(spark, d):
    return history(spark, d).load("box").groupBy("season").agg(F.sum("doubled").alias("doubled"))


@query(f"with {O}, {MOVED}, {S}, x as (select s.season, count(c.season) as n, coalesce(sum(c.cents), 0) as cents from s left join c on c.season < s.season group by s.season) select sum(n)::bigint as n, sum(cents)::bigint as cents from x")
def q_report(spark, d):
    return history(spark, d).load("report")


@query(_lines_sql("l.flag >= 'N' and l.status = p.status"))
def q_between_composite(spark, d):
    return _walk_lines(spark, d, between("lineitem", key="flag", ge="N"))


@query("select event_id, (props::json ->> '$.page')::varchar as page, left(props, 1) as html from events where event_id < 20")
def q_formats(spark, d):
    p = tree(spark, d)
    for name, ext in (("json", ".json"), ("pickle", ".pkl"), ("html", ".html")):
        p.dataset(name, part="id", ext=ext)
    import json

    rows = read(spark, d, "events").where("event_id < 20").select("event_id", "props").collect()
    for r in rows[:20]:
        part = {"id": str(r.event_id)}
        p.writes("json", json.loads(r.props), part=part)
        p.writes("pickle", {"id": r.event_id}, part=part)
        p.writes("html", r.props, part=part)
    one = lambda name, x: p.store.load([p.store.shards(name)[f"id={x}"]])
    return spark.createDataFrame([(one("pickle", x)["id"], str(v) if (v := one("json", x).get("page")) is not None else None, one("html", x)[0]) for x in (r.event_id for r in rows)], "event_id long, page string, html string")


@query(f"with {O}, {S} select dataset, season, count(*) over (partition by dataset)::bigint as shards from (select 'box' as dataset, season from s union all select 'features', season from s)")
def q_publish(spark, d):
    h = history(spark, d)
    far = Store(spark, h.p.tree + "-far-" + uuid.uuid4().hex)
    for x in ("box", "features"):
        h.p.store.push(far, x)
        assert h.p.store.push(far, x) == (0, 0)
    return h.frame([(x, part_season(q), len(far.shards(x))) for x in ("box", "features") for q in far.shards(x)], "dataset string, season string, shards long")


@query("select event_type, count(*)::bigint as n from events group by event_type")
def q_stream_append(spark, d):
    store, root = tree(spark, d).store, history(spark, d).p.tree + "-stream-" + uuid.uuid4().hex
    read(spark, d, "events").select("event_type").write.parquet(root)
    stream = spark.readStream.schema("event_type string").parquet(root)
    append_batches(stream, store, "audit", root + "-checkpoint").awaitTermination()
    return store.load(list(store.shards("audit").values())).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {O} select season, count(*)::bigint as n, sum(cents)::bigint as cents from o where season in ('1996', '1997') group by season")
def q_direct_write(spark, d):
    p = tree(spark, d)
    raw = p.source("raw", part="season")
    with p.writing("raw", part={"season": "1996"}) as path:
        orders(spark, d).where("season = '1996'").write.parquet(path)
    p.writes("raw", orders(spark, d).where("season = '1997'"), part={"season": "1997"})

    @p.step("sums", schema="season string, n long, cents long")
    def sums(out, raw=all_of(raw, as_paths=True)):
        spark.read.parquet(*raw).groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents")).write.parquet(out)

    return sums()


@query("select n_regionkey::bigint as region, count(*)::bigint as n from nation group by n_regionkey")
def q_external(spark, d):
    p = tree(spark, d)
    nation = p.source("nation", external=f"{d}/nation.parquet")

    @p.step("regions")
    def regions(nation=all_of(nation)):
        return nation.groupBy(F.col("n_regionkey").cast("long").alias("region")).agg(F.count(F.lit(1)).alias("n"))

    p.run()
    assert regions.is_current() and p.run() == []
    return regions.load()


@query("select src, dst, n from (values ('orders [done=no]', 'orders [done=yes]')) v(src, dst), (select count(*) filter (o_orderstatus = 'F')::bigint as n from orders)")
def q_fixed_parts(spark, d):
    p = tree(spark, d)
    both = p.dataset("orders", part="done")

    @p.step(both, part={"done": "no"}, once=True)
    def every():
        return read(spark, d, "orders").select("o_orderkey", "o_orderstatus")

    @p.step(both, part={"done": "yes"})
    def done(rows=parts(both, done="no")):
        return rows.where("o_orderstatus = 'F'")

    p.run()
    assert p.owner("orders", {"done": "yes"}) is done and p.edges() == [("every", "done")]
    return spark.createDataFrame([(a, b, done.load().count()) for a, b in p.dataset_edges()], "src string, dst string, n long")


@query(f"with {O}, {S} select season, count(*) over ()::bigint as shards from s")
def q_two_writers(spark, d):
    one = tree(spark, d).store
    two = Store(spark, one.files.root)
    with one, two:  # both hold the manifest as it is now
        assert not one.shards("d") and not two.shards("d")
        for k, (season,) in enumerate(sorted(seasons(spark, d).collect())):
            (one, two)[k % 2].commit("d", {"season": season}, {"k": k}, ext=".json")
    found = Store(spark, one.files.root).shards("d")
    return spark.createDataFrame([(part_season(x), len(found)) for x in found], "season string, shards long")


RULES = {"listed": {"season": ["1995", "1998", "2050"]}, "from": {"season": {"ge": "1997"}}, "between": {"season": {"gt": "1995", "le": "1998"}}, "none": {}, "other key": {"league": ["a"]}}


@query(f"with {O}, {S} select r.rule, s.season from s, (values ('listed'), ('from'), ('between'), ('none')) r(rule) where r.rule = 'none' or (r.rule = 'listed' and season in ('1995', '1998', '2050')) or (r.rule = 'from' and season >= '1997') or (r.rule = 'between' and season > '1995' and season <= '1998')")
def q_covers(spark, d):
    from tidemill.operators.selectors import covers

    shards = history(spark, d).p.store.shards("feed").values()
    return spark.createDataFrame([(name, s.part["season"]) for name, where in RULES.items() for s in shards if covers(where, s.part)], "rule string, season string")


@query(f"with {O}, {S}, r as (select unnest(['first', 'again', 'part', 'forced']) as run) select r.run, v.stage, count(s.season)::bigint as built from r, (values ('root'), ('leaf')) v(stage), s where (r.run in ('first', 'forced')) or (v.stage = 'root' and r.run = 'again') or (r.run = 'part' and s.season = '1997' and v.stage = 'root') group by r.run, v.stage")
def q_run(spark, d):
    p, every = tree(spark, d), seasons(spark, d)

    @p.step("root", part="season", universe=lambda: every, ext=".json")
    def root(season):
        return {"season": season}

    @p.step("leaf", part="season", universe=lambda: every, ext=".json")
    def leaf(root=same_part(root)):
        return root

    runs = {"first": p.run(), "again": p.run(), "part": p.run(part={"season": "1997"})}
    p.force = True
    runs["forced"] = p.run()
    counts: dict[tuple[str, str], int] = {}
    for run, built in runs.items():
        for stage, _, _ in built:
            counts[run, stage] = counts.get((run, stage), 0) + 1
    return spark.createDataFrame([(*k, n) for k, n in counts.items()], "run string, stage string, built long")


@query(f"with {O}, {S} select season, season = '1998' as wrong, season <> '1997' as kept from s")
def q_verify_gc(spark, d):
    p = tree(spark, d)
    p.dataset("d", part="season")
    p.store.commit_split("d", ("season",), orders(spark, d))
    shard = p.store.shards("d")["season=1998"]
    # Tampered with: one row twice.
    df = spark.read.parquet(p.store.location(shard))
    df.limit(1).write.mode("append").parquet(p.store.location(shard))
    wrong = p.verify("d")
    p.store.collect("d", lambda s: s.part["season"] != "1997")
    now = set(p.store.shards("d"))
    every = [r[0] for r in seasons(spark, d).collect()]
    return spark.createDataFrame([(s, any(f"season={s}." in x for x in wrong), f"season={s}" in now) for s in every], "season string, wrong boolean, kept boolean")


@query(f"with {O}, {MOVED} select season, count(*)::bigint as n, sum(cents)::bigint as cents from c group by season")
def q_fetch(spark, d):
    h = history(spark, d)
    dest = f"{h.p.tree}-fetched-{uuid.uuid4().hex}"
    files, size = h.p.fetch(dest)
    assert files and size
    store = Store(spark, dest)
    return store.load(select(store.shards("features").values(), {}))


@query(f"with {O}, {S} select v.stage, case when v.stage = 'report' then 1 else (select count(*) from s) end::bigint as shards from (values ('features'), ('cohorts'), ('report'), ('box')) v(stage)")
def q_focus(spark, d):
    h = history(spark, d)
    nodes, edges = h.p.focus("features")
    assert len(edges) == 3 and h.p.find("feat").name == "features" and not h.p.preflight()
    return h.frame([(n, shards_of(h, n)) for n in nodes], "stage string, shards long")
