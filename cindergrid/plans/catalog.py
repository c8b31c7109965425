"""Registered queries over the driver's tables, each with its DuckDB twin. Expressions that both engines read alike are written once."""

from pyspark.sql import functions as F

from cindergrid.functions.exprs import albers_sql, confidence_label, draw_sql, prior_corrected, wind_from
from cindergrid.operators import geometry
from cindergrid.operators.sampling import controls
from cindergrid.operators.state import shared_dir
from cindergrid.operators.spread import burn_probability, ensemble
from cindergrid.operators.windows import antecedent, every_day, keep_latest, percentile_rank
from cindergrid.operators.zonal import zonal_mode, zonal_stats
from cindergrid.plans.register import Q, SQL, both, query, rounded
from cindergrid.sources.tables import table
from cindergrid.sources.grids import raster, write_rasters
from cindergrid.streaming.dedupe import publish
from cindergrid.streaming.publish import publish_batches, published

def pixels(s, d):
    return table(s, d, "lineitem").select(
        F.col("l_suppkey").alias("cell"), F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice")).alias("elev"), F.col("l_quantity").alias("slope"),
        (F.col("l_partkey") % 361 - 1).cast("double").alias("aspect"), (91 + F.col("l_partkey") % 114).cast("int").alias("fuel"))


PIX = "WITH p AS (SELECT l_suppkey cell, CASE WHEN l_linenumber<>7 THEN l_extendedprice END elev, l_quantity slope, CAST(l_partkey%361-1 AS DOUBLE) aspect, CAST(91+l_partkey%114 AS INT) fuel FROM lineitem) "


@query(PIX + """, a AS (SELECT cell, avg(elev) mean, stddev_pop(elev) std, min(elev) lo, max(elev) hi, 100.0*count(*) FILTER (slope>30)/count(*) ps, 100.0*count(*) FILTER (aspect=-1)/count(*) pf,
 coalesce(avg(cos(radians(aspect))) FILTER (aspect BETWEEN 0 AND 360),0) n, coalesce(avg(sin(radians(aspect))) FILTER (aspect BETWEEN 0 AND 360),0) e, count(*) k FROM p GROUP BY cell)
 SELECT cell, round(mean,6) mean, round(std,6) std, round(lo,6) lo, round(hi,6) hi, round(ps,6) pct_steep, round(pf,6) pct_flat, round(n,6) northness, round(e,6) eastness, k n_pixels, round(sqrt(n*n+e*e),6) consistency FROM a""")
def zonal_terrain(s, d):
    return rounded(zonal_stats(pixels(s, d), "cell", "elev", "slope", "aspect"))


@query(PIX + "SELECT cell, fuel majority FROM (SELECT cell, fuel, row_number() OVER (PARTITION BY cell ORDER BY count(*) DESC, fuel) r FROM p GROUP BY cell, fuel) WHERE r=1")
def zonal_mode_fuel(s, d):
    return zonal_mode(pixels(s, d), "cell", "fuel")


def wx(s, d):
    """Whole cents, so that sums are exact in both engines; a row for each pixel and day."""
    paid = table(s, d, "orders").groupBy((F.col("o_custkey") % 25).alias("pixel"), F.to_date("o_orderdate").alias("day")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("pr"))
    return every_day(paid, "pixel", "day")


def wx_frame(n, f="sum"):
    """A day's frame by comparing days, not by rows."""
    return f"(SELECT {f}(b.pr) FROM x b WHERE b.pixel = a.pixel AND b.day BETWEEN a.day - {n - 1} AND a.day)"


@query(f"""WITH w AS (SELECT o_custkey%25 pixel, CAST(o_orderdate AS DATE) AS day, CAST(sum(CAST(round(o_totalprice*100) AS BIGINT)) AS BIGINT) pr FROM orders GROUP BY 1,2),
 x AS (SELECT p.pixel, CAST(t.day AS DATE) AS day, w.pr, CAST(date_diff('day', (SELECT min(day) FROM w), CAST(t.day AS DATE)) + 1 AS INT) AS idx FROM (SELECT DISTINCT pixel FROM w) p CROSS JOIN (SELECT unnest(generate_series((SELECT min(day) FROM w), (SELECT max(day) FROM w), INTERVAL 1 DAY)) AS day) t LEFT JOIN w ON w.pixel = p.pixel AND w.day = CAST(t.day AS DATE))
 SELECT pixel, day, pr/1e7 AS pr, idx, CAST({wx_frame(7)} AS DOUBLE)/1e7 AS sum_7d, CAST({wx_frame(30)} AS DOUBLE)/1e7 AS sum_30d, CAST({wx_frame(90)} AS DOUBLE)/1e7 AS sum_90d, {wx_frame(7, 'avg')}/1e7 AS mean_7d,
 CAST(least(120, coalesce(date_diff('day', (SELECT max(b.day) FROM x b WHERE b.pixel = a.pixel AND b.day <= a.day AND b.pr > 25000000), a.day), 120)) AS INT) AS days_since_wet FROM x a""")
def antecedent_full(s, d):
    found = antecedent(wx(s, d), "pixel", "day", "pr", wet=25_000_000)
    return found.select(*[(F.col(c).cast("double") / 1e7).alias(c) if c == "pr" or c[:4] in ("sum_", "mean") else c for c in found.columns])


@query("SELECT o_orderkey, round((rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey)-1)/2.0)/count(*) OVER (),6) pct FROM orders")
def pct_rank_avg(s, d):
    return rounded(percentile_rank(table(s, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey").select("o_orderkey", "pct"))


@query("SELECT event_id, lat, hr FROM (SELECT event_id, round_even(value,0) lat, CAST(date_trunc('hour',ts) AS TIMESTAMP) AS hr, row_number() OVER (PARTITION BY round_even(value,0), date_trunc('hour',ts) ORDER BY ts DESC, event_id DESC) r FROM events) WHERE r=1")
def dedupe_latest(s, d):
    e = table(s, d, "events").select("event_id", "ts", F.rint("value").alias("lat"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hr"))
    return keep_latest(e, ["lat", "hr"], [F.desc("ts"), F.desc("event_id")]).select("event_id", "lat", "hr")


@query("SELECT event_id, CASE WHEN k<=30 THEN 'low' WHEN k<=80 THEN 'nominal' ELSE 'high' END label FROM (SELECT event_id, CAST(json_extract(props,'$.k') AS INT) k FROM events)")
def confidence(s, d):
    return table(s, d, "events").select("event_id", confidence_label(F.get_json_object("props", "$.k")).alias("label"))


@query("SELECT l_returnflag g, round(((degrees(atan2(-avg(l_quantity-25),-avg(l_tax-0.04)))%360)+360)%360,6) dir FROM lineitem GROUP BY 1")
def wind_vectors(s, d):
    return rounded(table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("g")).agg(F.avg(F.col("l_quantity") - 25).alias("u"), F.avg(F.col("l_tax") - 0.04).alias("v")).select("g", wind_from(F.col("u"), F.col("v")).alias("dir")))


SC = "WITH s AS (SELECT toxic y, CAST(1.0/(1.0+n_chars) AS DOUBLE) p, doc_id FROM labels JOIN documents USING(doc_id)) "


def scored(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("y"), (1.0 / (1.0 + F.col("n_chars"))).alias("p"), "doc_id")


@query(SC + "SELECT round(avg((1/(1+exp(-(ln(p/(1-p))+ln(0.1))))-y)**2),6) brier FROM s")
def brier_corrected(s, d):
    return rounded(scored(s, d).agg(F.avg(F.pow(prior_corrected(F.col("p"), 0.1) - F.col("y"), 2)).alias("brier")))


both("average_precision", "WITH s AS (SELECT CAST(n_chars AS DOUBLE) p, toxic y FROM labels JOIN documents USING(doc_id)), g AS (SELECT p, sum(y) t, count(*) n FROM s GROUP BY p), c AS (SELECT t, sum(t) OVER (ORDER BY p DESC) tp, sum(n) OVER (ORDER BY p DESC) k, sum(t) OVER (PARTITION BY n*0) pos FROM g) SELECT round(sum(CAST(t AS DOUBLE)/(SELECT sum(y) FROM s)*CAST(tp AS DOUBLE)/k),6) AS ap FROM c")
both("roc_auc", "WITH s AS (SELECT n_chars p, toxic y FROM labels JOIN documents USING(doc_id)), g AS (SELECT p, sum(y) a, count(*)-sum(y) b FROM s GROUP BY p), c AS (SELECT a, b, coalesce(sum(b) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) below FROM g) SELECT round(CAST(sum(a*(below+b/2.0)) AS DOUBLE)/(sum(a)*sum(b)),6) AS auc FROM c")
both("zonal_share", "SELECT l_suppkey cell, round(CAST(100 AS DOUBLE)*count(CASE WHEN l_partkey%114 BETWEEN 10 AND 18 THEN 1 END)/count(*),6) AS pct_grass, round(100-CAST(100 AS DOUBLE)*count(CASE WHEN l_partkey%114 < 9 THEN 1 END)/count(*),6) AS pct_burnable FROM lineitem GROUP BY l_suppkey")
both("cell_event_counts", "SELECT CAST(floor(value/10) AS BIGINT) AS cell, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2")
both("first_arrival", "SELECT user_id AS cell, min(ts) AS arrival, count(*) AS n FROM events GROUP BY user_id")
both("byte_ranges", "SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS range_end FROM events")


both("frequency_table", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
both("pivot_counts", "SELECT CAST(ts AS DATE) AS day, count(CASE WHEN event_type='click' THEN 1 END) AS click, count(CASE WHEN event_type='error' THEN 1 END) AS error FROM events GROUP BY 1")
both("season_terms", "SELECT o_orderkey, round(sin(2*pi()*extract(doy FROM o_orderdate)/365.25),6) AS doy_sin, round(cos(2*pi()*extract(doy FROM o_orderdate)/365.25),6) AS doy_cos FROM orders")
both("unit_conversions", "SELECT p_partkey, round(p_retailprice/4046.86,6) AS acres, round(p_size*2.23694,6) AS mph FROM part")
both("set_ops", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
both("semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
both("union_ragged", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, NULL FROM supplier")
both("describe_missing", "SELECT count(*) AS n, round(avg(l_quantity),6) AS mean, min(l_quantity) AS lo, max(l_quantity) AS hi, count(CASE WHEN l_quantity IS NULL THEN 1 END) AS missing FROM lineitem")
both("confusion_iou", "SELECT CAST(count(CASE WHEN quality=1 AND toxic=1 THEN 1 END) AS DOUBLE)/greatest(count(CASE WHEN quality=1 OR toxic=1 THEN 1 END),1) AS iou FROM labels")
both("timing_error", "SELECT user_id, CASE WHEN count(*)>=10 THEN round(avg(abs(value-25)),6) END AS mae, CASE WHEN count(*)>=10 THEN round(avg(value-25),6) END AS bias FROM events GROUP BY user_id")
both("score_objective", "SELECT l_suppkey, round(avg(l_discount)-0.3*least(avg(l_quantity)/48,1),6) AS score FROM lineitem GROUP BY l_suppkey ORDER BY 2 DESC, 1 LIMIT 50")
both("fold_metrics", "SELECT l_returnflag, round(avg(l_tax),6) AS mean, round(stddev_samp(l_tax),6) AS sd FROM lineitem GROUP BY l_returnflag")
both("cause_labels", "SELECT o_orderkey, CASE substring(o_orderpriority,1,1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' ELSE 'Not recorded' END AS cause, CASE WHEN substring(o_orderpriority,1,1)='1' THEN 1 ELSE 0 END AS is_urgent FROM orders")
both("prevalence_meta", "SELECT count(*) AS n, count(CASE WHEN event_type='error' THEN 1 END) AS positives, round(CAST(count(CASE WHEN event_type='error' THEN 1 END) AS DOUBLE)/count(*),6) AS prevalence FROM events")
both("spread_prob", "SELECT l_orderkey, round(greatest(0,least(1,0.3*exp(0.05*l_tax*l_quantity)*exp(0.4*greatest(-1.5,least(1.5,l_discount)))/sqrt(2))),6) AS p FROM lineitem")
both("nearest_day", "WITH u AS (SELECT user_id AS k, CAST(ts AS DATE) AS day, event_id AS id FROM events UNION ALL SELECT o_custkey, CAST(o_orderdate AS DATE), NULL FROM orders), w AS (SELECT id, day, max(CASE WHEN id IS NULL THEN day END) OVER (PARTITION BY k ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p, min(CASE WHEN id IS NULL THEN day END) OVER (PARTITION BY k ORDER BY day RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM u) SELECT id AS event_id, CASE WHEN p IS NULL OR (q - day) < (day - p) THEN q ELSE p END AS nearest FROM w WHERE id IS NOT NULL")
both("neighbour_stencil", "WITH g AS (SELECT c_custkey - c_custkey % 100 AS r, c_custkey % 100 AS c, c_acctbal AS v FROM customer), o AS (SELECT * FROM (VALUES (-100,-1),(-100,0),(-100,1),(0,-1),(0,1),(100,-1),(100,0),(100,1)) AS t(dr,dc)), m AS (SELECT r, c, r + dr AS nr, c + dc AS nc FROM g, o) SELECT m.r, m.c, count(*) AS n, max(b.v) AS hi FROM m JOIN g b ON b.r = m.nr AND b.c = m.nc GROUP BY m.r, m.c")
both("exact_quantiles", "SELECT l_returnflag, round(percentile_cont(0.02) WITHIN GROUP (ORDER BY l_extendedprice),6) AS lo, round(percentile_cont(0.98) WITHIN GROUP (ORDER BY l_extendedprice),6) AS hi FROM lineitem GROUP BY l_returnflag")
both("median_arrival", "SELECT user_id AS cell, round(median(value),6) AS mid FROM events GROUP BY user_id")
both("absent_cell_days", "WITH d AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), c AS (SELECT DISTINCT user_id FROM events) SELECT c.user_id, d.day FROM c CROSS JOIN d WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = c.user_id AND CAST(e.ts AS DATE) = d.day)")
both("range_classes", "SELECT p_partkey, f.name AS class FROM part LEFT JOIN (VALUES (1,9,'low'),(10,19,'mid'),(25,40,'high')) AS f(a,b,name) ON p_size BETWEEN f.a AND f.b")
both("principal_axis", "WITH m AS (SELECT l_returnflag AS g, var_pop(l_quantity) AS a, var_pop(l_discount*500) AS b, covar_pop(l_quantity, l_discount*500) AS c FROM lineitem GROUP BY l_returnflag) SELECT g, round(sqrt((a+b+sqrt((a-b)*(a-b)+4*c*c))/(a+b-sqrt((a-b)*(a-b)+4*c*c))),6) AS elongation FROM m")
both("points_in_polygon", "WITH e AS (SELECT * FROM (VALUES (5.0,5.0,40.0,8.0),(40.0,8.0,30.0,45.0),(30.0,45.0,20.0,20.0),(20.0,20.0,5.0,5.0)) AS t(x1,y1,x2,y2)), p AS (SELECT p_partkey, p_partkey % 47 + 0.25 AS x, p_size + 0.25 AS y FROM part) SELECT p_partkey FROM p JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY p_partkey HAVING count(*) % 2 = 1")
both("ring_areas", "WITH v AS (SELECT o_custkey AS k, CAST(o_orderkey % 97 AS DOUBLE) AS x, CAST(o_orderkey % 89 AS DOUBLE) AS y, o_orderkey AS i FROM orders), n AS (SELECT k, x, y, coalesce(lead(x) OVER (PARTITION BY k ORDER BY i), first_value(x) OVER (PARTITION BY k ORDER BY i)) AS x2, coalesce(lead(y) OVER (PARTITION BY k ORDER BY i), first_value(y) OVER (PARTITION BY k ORDER BY i)) AS y2 FROM v) SELECT k, round(abs(sum(x*y2-x2*y))/2,6) AS area FROM n GROUP BY k")
both("wind_components", "SELECT event_id, round(-value*sin(radians(user_id)),6) AS u, round(-value*cos(radians(user_id)),6) AS v FROM events")
both("prefix_sums", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING),6) AS total FROM events")
both("outer_merge", "WITH a AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), b AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS m FROM orders GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, n, m FROM a FULL OUTER JOIN b ON a.day = b.day")
both("total_bounds", "SELECT min(l_quantity) AS x0, min(l_tax) AS y0, max(l_quantity) AS x1, max(l_tax) AS y1 FROM lineitem")


X, Y = albers_sql("(-124 + 0.4e0 * n_nationkey)", "(33 + 0.3e0 * n_nationkey)")
both("albers_xy", f"SELECT n_nationkey, round({X},3) AS x, round({Y},3) AS y FROM nation")
both("feed_summary", "SELECT user_id, count(*) AS total, count(CASE WHEN event_type='click' THEN 1 END) AS vegetation, count(CASE WHEN event_type<>'click' THEN 1 END) AS other, coalesce(max(value),0) AS top FROM events GROUP BY user_id")
both("overlay_share", "WITH c AS (SELECT p_partkey, CAST(p_partkey % 40 AS DOUBLE) AS x, CAST(p_size AS DOUBLE) AS y FROM part) SELECT p_partkey, round(greatest(0,least(x+1,30.25)-greatest(x,4.5))*greatest(0,least(y+1,40.75)-greatest(y,7.25)),6) AS share FROM c WHERE x+1 > 4.5 AND x < 30.25 AND y+1 > 7.25 AND y < 40.75")


both("stale_cells", "SELECT user_id, max(ts) AS latest, max(ts) < TIMESTAMP '2024-01-15 00:00:00' AS stale FROM events GROUP BY user_id")


LATTICE = "SELECT c_custkey AS cell, c_custkey DIV 40 AS r, c_custkey % 40 AS c, least(1, 0.25e0 + c_acctbal / 20000) AS fuel FROM customer"
AROUND = "(VALUES (0,-1,-1),(1,-1,0),(2,-1,1),(3,0,-1),(4,0,1),(5,1,-1),(6,1,0),(7,1,1)) AS o(dir,dr,dc)"
EDGES = f"SELECT a.cell AS src, b.cell AS dst, dir, greatest(0, least(1, 0.35e0 * b.fuel * exp(0.2e0 * dc) / sqrt(dr*dr + dc*dc))) AS p FROM g a CROSS JOIN {AROUND} JOIN g b ON b.r = a.r + dr AND b.c = a.c + dc"
# Repetitions, hours and burning steps of the ensemble; it starts in the cell of most fuel, the least of equals.
RUNS, STEPS, BURN = 25, 48, 2
STATES = f"""WITH RECURSIVE g AS ({LATTICE.replace('DIV', '//')}), e AS ({EDGES}), o AS (SELECT cell FROM g WHERE fuel IS NOT NULL ORDER BY fuel DESC, cell LIMIT 1),
 s AS (SELECT range AS run, cell, 0 AS arrival, 0 AS t FROM range({RUNS}) CROSS JOIN o UNION ALL SELECT run, cell, CAST(min(arrival) AS INT), CAST(t + 1 AS INT) FROM (SELECT run, cell, arrival, t FROM s WHERE t < {STEPS}
  UNION ALL SELECT run, dst, t + 1, t FROM s JOIN e ON s.cell = e.src WHERE t < {STEPS} AND arrival > t - {BURN} AND {draw_sql('run', 'src', 'dir + 8 * (t + 1)', 11)} < p) x GROUP BY run, cell, t)"""


@query(STATES + f" SELECT cell, round(count(*) / {RUNS}.0, 6) AS prob, median(arrival) AS arrival FROM s WHERE t = {STEPS} GROUP BY cell")
def spread_ensemble(s, d):
    table(s, d, "customer").createOrReplaceTempView("customer")
    edges = s.sql(f"WITH g AS ({LATTICE}) {EDGES}")
    origin = s.sql(f"WITH g AS ({LATTICE}) SELECT cell FROM g WHERE fuel IS NOT NULL ORDER BY fuel DESC, cell LIMIT 1")
    return rounded(burn_probability(ensemble(s.range(RUNS).withColumnRenamed("id", "run").crossJoin(origin), edges, STEPS, BURN), RUNS))


@query("""WITH p AS (SELECT DISTINCT user_id AS cell, CAST(ts AS DATE) AS day FROM events WHERE event_type='error'), k AS (SELECT max(user_id)+1 AS cells FROM events),
 x AS (SELECT range AS id, CAST(floor(%s * (SELECT cells FROM k)) AS BIGINT) AS cell, DATE '2024-01-01' + CAST(floor(%s * 366) AS INT) AS day FROM range(4 * (SELECT count(*) FROM p)))
 SELECT cell, CAST(day AS DATE) AS day FROM (SELECT cell, day, min(id) AS id FROM x GROUP BY cell, day) f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.cell = f.cell AND p.day = f.day) ORDER BY id LIMIT (SELECT 2 * count(*) FROM p)"""
       % tuple(draw_sql("range % 90000", "range // 90000", str(k), 42) for k in (1, 2)))
def case_control(s, d):
    e = table(s, d, "events")
    cases = e.filter("event_type = 'error'").select(F.col("user_id").alias("cell"), F.to_date("ts").alias("day"))
    return controls(cases, (e.agg(F.max("user_id")).first()[0] or 0) + 1, "2024-01-01", 366, ratio=2, grow=False)


@query("WITH g AS (SELECT p_partkey // 50 AS r, p_partkey % 50 AS c, p_size = 1 AS dev FROM part) SELECT a.r, a.c, round(min(sqrt((a.r-b.r)**2 + (a.c-b.c)**2)) * 30 / 1000, 6) AS km FROM g a JOIN g b ON b.dev GROUP BY a.r, a.c")
def distance_transform(s, d):
    cells = table(s, d, "part").select(F.expr("p_partkey div 50").alias("row"), (F.col("p_partkey") % 50).alias("col"), (F.col("p_size") == 1).alias("hit"))
    return rounded(geometry.distance_transform(cells, "hit", 30).select(F.col("row").alias("r"), F.col("col").alias("c"), (F.col("distance") / 1000).alias("km")))


@query(SQL["dedupe_latest"])
def stream_dedupe(s, d):
    schema = table(s, d, "events").schema
    rows = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.rint("value").alias("lat"))
    return publish(rows, "ts", ["lat"], ["event_id"]).select("event_id", "lat", F.col("hour").cast("timestamp_ntz").alias("hr"))


@query(SQL["dedupe_latest"])
def published_detections(s, d):
    """The latest row of each place and hour, from a table that a stream replaces whole."""
    root = shared_dir(s)
    rows = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = rows.select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.rint("value").alias("lat"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hr"))

    def merged(before, batch):
        return keep_latest(batch if before is None else before.unionByName(batch), ["lat", "hr"], [F.desc("ts"), F.desc("event_id")])
    publish_batches(rows, f"{root}/live", f"{root}/progress", merged).awaitTermination()
    return published(s, f"{root}/live").select("event_id", "lat", "hr")


@query("SELECT p_partkey // 50 AS row, p_partkey % 50 AS col, p_retailprice AS value FROM part")
def raster_files(s, d):
    """A raster of all parts, written in files of 16 rows and read from their strips."""
    root = f"{shared_dir(s)}/raster"
    cells = table(s, d, "part").select(F.expr("p_partkey div 50").alias("row"), (F.col("p_partkey") % 50).alias("col"), F.col("p_retailprice").alias("value"))
    write_rasters(cells, root, 0.0, 0.0, 1.0, 50, band=16).agg(F.sum("rows")).collect()
    return raster(s, root).filter("value is not null and y < 0").select(F.floor(-F.col("y")).alias("row"), "col", "value")


from cindergrid.plans import shapes, slices  # noqa: E402, F401  (registers the other queries)
