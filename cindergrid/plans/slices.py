"""Queries of the operators that take column names, each with a DuckDB twin that is written by itself."""

from functools import reduce

from pyspark.sql import functions as F

from cindergrid.functions import feed, times
from cindergrid.functions.exprs import albers_sql, lonlat_sql, prior_corrected
from cindergrid.operators import boosting, geometry, joins, metrics, model, spread, windows
from cindergrid.operators.state import numbered
from cindergrid.operators.zonal import zonal_stats
from cindergrid.plans.register import SQL, query, rounded, rows_only
from cindergrid.sources import sinks, tables
from cindergrid.sources.tables import table

BOX = "[{'x': 4.5, 'y': 7.25}, {'x': 30.25, 'y': 7.25}, {'x': 30.25, 'y': 40.75}, {'x': 4.5, 'y': 40.75}]"


def rings(spark, *polygons):
    return spark.createDataFrame([(k, list(p)) for k, p in enumerate(polygons)], "poly int, ring array<struct<x:double,y:double>>")


def judged(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id")


@query(SQL["average_precision"])
def average_precision(s, d):
    return rounded(metrics.average_precision(judged(s, d), "toxic", "n_chars"))


@query(SQL["roc_auc"])
def roc_auc(s, d):
    return rounded(metrics.roc_auc(judged(s, d), "toxic", "n_chars"))


@query(SQL["exact_quantiles"])
def exact_quantiles(s, d):
    return rounded(metrics.quantiles(table(s, d, "lineitem"), "l_returnflag", "l_extendedprice", [.02, .98]).withColumnsRenamed({"q_1": "lo", "q_2": "hi"}))


@query("SELECT count(*) FILTER (quality=1 AND toxic=1) AS hits, count(*) FILTER (quality=1 AND toxic=0) AS misses, count(*) FILTER (quality=0 AND toxic=1) AS false_alarms, round(count(*) FILTER (quality=1 AND toxic=1)/greatest(count(*) FILTER (quality=1 OR toxic=1),1),6) AS iou,"
       " round(count(*) FILTER (quality=1 AND toxic=1)/greatest(count(*) FILTER (toxic=1),1),6) AS precision, round(count(*) FILTER (quality=1 AND toxic=1)/greatest(count(*) FILTER (quality=1),1),6) AS recall, round(2.0*count(*) FILTER (quality=1 AND toxic=1)/greatest(count(*) FILTER (toxic=1)+count(*) FILTER (quality=1),1),6) AS f1 FROM labels")
def confusion_scores(s, d):
    return rounded(metrics.confusion(table(s, d, "labels").select((F.col("quality") == 1).alias("t"), (F.col("toxic") == 1).alias("f")), "t", "f"))


@query("SELECT user_id, CASE WHEN count(*)>=10 THEN round(avg(abs(value-user_id%50)),6) END AS mae, CASE WHEN count(*)>=10 THEN round(avg(value-user_id%50),6) END AS bias, count(*) AS n FROM events GROUP BY user_id")
def timing_error_columns(s, d):
    e = table(s, d, "events").withColumn("seen", F.col("user_id") % 50)
    return rounded(e.groupBy("user_id").agg(*metrics.timing("seen", "value")))


@query("SELECT c_custkey, (SELECT count(DISTINCT floor(b.c_acctbal/1000)) FROM customer b WHERE floor(b.c_acctbal/1000) < floor(a.c_acctbal/1000)) AS block FROM customer a")
def block_ids(s, d):
    c = table(s, d, "customer").select("c_custkey", F.floor(F.col("c_acctbal") / 1000).alias("b"))
    return windows.dense_ranks(c, "b", "block").select("c_custkey", "block")


@query("SELECT c_custkey, min({'d': abs(c_acctbal - s_acctbal), 's': s_acctbal}).s AS near FROM customer LEFT JOIN supplier ON true GROUP BY c_custkey")
def nearest_axis(s, d):
    asks = table(s, d, "customer").select("c_custkey", "c_acctbal")
    return joins.nearest_on_axis(asks, table(s, d, "supplier"), "c_acctbal", "s_acctbal").select("c_custkey", F.col("nearest").alias("near"))


@query("SELECT event_id, (SELECT min({'d': abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(ts AS DATE))), 't': CAST(o_orderdate AS DATE)}).t FROM orders WHERE o_custkey = user_id) AS nearest FROM events")
def nearest_day_joined(s, d):
    asks = table(s, d, "events").select("event_id", F.col("user_id").alias("k"), F.to_date("ts").cast("timestamp").alias("t"))
    points = table(s, d, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").cast("timestamp").alias("o"))
    return windows.nearest_in_time(asks, points, "k", "t", "o").select("event_id", F.to_date("nearest").alias("nearest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:00') AS acq_utc, lpad(CAST(user_id AS VARCHAR),5,'0') AS code, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(ts, '%Y-%m-%d %H:%M:%S') AS from_ms,"
       " round(date_diff('microsecond', TIMESTAMP '2024-01-01 00:00:00', ts)/3.6e9,6) AS hours, props AS plain, replace(props, 'k', '***') AS hidden FROM events")
def time_parse(s, d):
    ts = F.col("ts").cast("timestamp")
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    e = table(s, d, "events").select("event_id", "props", "user_id", ts.alias("ts"), F.date_format(ts, "yyyy-MM-dd").alias("acq_date"), (F.hour(ts) * 100 + F.minute(ts)).alias("acq_time"))
    out = e.select("event_id", show(times.instant(F.col("acq_date"), F.col("acq_time"))).alias("acq_utc"), times.padded(F.col("user_id"), 5).alias("code"), times.iso_z(F.col("ts")).alias("iso"), show(times.from_millis(F.unix_millis("ts"))).alias("from_ms"),
                   times.hours_between(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.col("ts")).alias("hours"), F.col("props").alias("plain"), feed.redacted(F.col("props"), "k").alias("hidden"))
    return rounded(out)


def detections(s, d):
    """Events as raw detections: a confidence as text, a clock time without zeros, some powers missing."""
    ts = F.col("ts").cast("timestamp")
    raw = table(s, d, "events").select("event_id", (F.col("value") / 7 + 39).alias("latitude"), (F.col("user_id") / 100 - 121.5).alias("longitude"), F.date_format(ts, "yyyy-MM-dd").alias("acq_date"), (F.hour(ts) * 100 + F.minute(ts)).alias("acq_time"),
                                       F.get_json_object("props", "$.k").alias("confidence"), F.when(F.col("event_type") != "error", F.col("value")).alias("frp"), F.when(F.col("event_type") == "click", 0).otherwise(2).alias("type"), "user_id")
    return feed.normalised(raw, "test")


EVENT = "SELECT event_id, user_id, round_even((value/7+39)*100000,0)/100000 AS lat, round_even((user_id/100-121.5)*100000,0)/100000 AS lon, strftime(ts, '%Y-%m-%dT%H:%M:00Z') AS acq_utc, CASE WHEN event_type<>'error' THEN value ELSE 0 END AS frp, event_type='click' AS fire, CAST(json_extract(props,'$.k') AS INT) AS k FROM events"


@query(f"SELECT event_id, lat, lon, acq_utc, frp AS frp_mw, fire AS is_fire, CASE WHEN k<=30 THEN 'low' WHEN k<=80 THEN 'nominal' ELSE 'high' END AS label, 'Point' AS kind FROM ({EVENT}) e")
def geojson_features(s, d):
    """Read back from the documents' text."""
    own = detections(s, d)
    text = own.select("event_id", F.to_json(feed.feature(F.col("latitude"), F.col("longitude"), {"acq_utc": times.iso_z(F.col("acq_utc")), "frp_mw": F.coalesce("frp", F.lit(0.0)), "fire": F.col("is_vegetation_fire"), "label": F.col("confidence_label")})).alias("f"))
    f = F.from_json("f", "geometry struct<type:string,coordinates:array<double>>, properties struct<acq_utc:string,frp_mw:double,fire:boolean,label:string>")
    return text.select("event_id", f.alias("f")).select("event_id", F.col("f.geometry.coordinates")[1].alias("lat"), F.col("f.geometry.coordinates")[0].alias("lon"), "f.properties.acq_utc", "f.properties.frp_mw", F.col("f.properties.fire").alias("is_fire"), "f.properties.label", F.col("f.geometry.type").alias("kind"))


@query("SELECT user_id, count(*) AS total, count(*) FILTER (event_type='click') AS vegetation, count(*) FILTER (event_type<>'click') AS other, coalesce(max(CASE WHEN event_type<>'error' THEN value END),0) AS top FROM events GROUP BY user_id")
def feed_summary(s, d):
    """Of a document for each user, as text."""
    f = feed.feature(F.col("latitude"), F.col("longitude"), {"acq_utc": times.iso_z(F.col("acq_utc")), "frp_mw": F.coalesce("frp", F.lit(0.0)), "is_vegetation_fire": F.col("is_vegetation_fire"), "confidence_label": F.col("confidence_label")})
    docs = detections(s, d).groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(f).alias("features"))).alias("document"))
    n = feed.summary(docs)
    return n.select("user_id", *[F.col(c).cast("long").alias(c) for c in ("total", "vegetation", "other")], F.col("max_frp").alias("top"))


@query(f"SELECT count(*) AS total, count(*) FILTER (fire) AS fires, max(acq_utc) AS latest, count(*) FILTER (k<=30) AS low, count(*) FILTER (k BETWEEN 31 AND 80) AS nominal, count(*) FILTER (k>80) AS high, 'boom' AS error FROM ({EVENT}) e")
def feed_metadata(s, d):
    status = s.createDataFrame([("a", True, 5, None, False), ("b", False, 0, "boom", False)], "source string, ok boolean, rows long, error string, permanent boolean")
    m = feed.metadata(detections(s, d), status, "2024-02-01T00:00:00Z", 1, [-122, 39, -121, 40])
    return m.select(F.col("total_detections").alias("total"), F.col("vegetation_fire_detections").alias("fires"), F.col("latest_detection_utc").alias("latest"), *[F.col("confidence_mix")[k].alias(k) for k in ("low", "nominal", "high")], F.col("sources")["b"]["error"].alias("error"))


@query("SELECT user_id, CAST(floor(date_diff('second', max(ts), TIMESTAMP '2024-01-30 12:00:00')/60) AS BIGINT) AS age, CASE WHEN user_id%7=0 THEN 'unknown' WHEN floor(date_diff('second', max(ts), TIMESTAMP '2024-01-30 12:00:00')/60) > 75 THEN 'stale' ELSE 'fresh' END AS state FROM events GROUP BY user_id")
def freshness(s, d):
    latest = table(s, d, "events").groupBy("user_id").agg(times.iso_z(F.max(F.col("ts").cast("timestamp"))).alias("t"))
    now = F.lit("2024-01-30 12:00:00").cast("timestamp")
    said = F.when(F.col("user_id") % 7 == 0, "not a time").otherwise(F.col("t"))
    return latest.select("user_id", times.age_minutes(F.col("t"), now).alias("age"), times.freshness(times.age_minutes(said, now)).alias("state"))


# 47 x 60 places of parts, on squares of 10: half of the squares are in the grid.
PLACES = "SELECT p_partkey, CAST(p_partkey % 47 AS DOUBLE) + 0.25 AS x, CAST(p_size AS DOUBLE) + 0.25 AS y FROM part"


def places(s, d):
    return table(s, d, "part").select("p_partkey", ((F.col("p_partkey") % 47).cast("double") + .25).alias("x"), (F.col("p_size").cast("double") + .25).alias("y"))


def half_grid(s):
    return geometry.lattice(s, (0, 0, 47, 51), 10).withColumn("cell_id", F.col("row") * 5 + F.col("col")).filter("cell_id % 2 = 0")


IN_CELL = f"SELECT *, CASE WHEN (floor(y/10)*5+floor(x/10))%2=0 THEN CAST(floor(y/10)*5+floor(x/10) AS BIGINT) END AS cell_id FROM ({PLACES}) p"


@query(f"SELECT count(*) AS n, count(cell_id) AS matched, count(*) - count(cell_id) AS unmatched FROM ({IN_CELL}) c")
def unmatched_points(s, d):
    return joins.match_counts(joins.points_to_cells(places(s, d), half_grid(s), "x", "y", (0, 0), 10))


@query(f"SELECT cell_id, min(y) AS arrival, count(*) AS n FROM ({IN_CELL}) c WHERE cell_id IS NOT NULL GROUP BY cell_id")
def first_arrival_cells(s, d):
    return joins.first_arrivals(joins.points_to_cells(places(s, d), half_grid(s), "x", "y", (0, 0), 10, strict=True), "y")


@query("WITH b AS (SELECT CAST(floor(min(o_orderkey % 977 - 300.5) / 10) AS BIGINT) AS c0, CAST(ceil(max(o_orderkey % 977 - 300.5) / 10) AS BIGINT) AS c1, CAST(floor(min(o_custkey / 4.0 - 90) / 10) AS BIGINT) AS r0, CAST(ceil(max(o_custkey / 4.0 - 90) / 10) AS BIGINT) AS r1 FROM orders)"
       " SELECT r.v - r0 AS row, c.v - c0 AS col, CAST(c.v * 10 + 5 AS DOUBLE) AS x, CAST(r.v * 10 + 5 AS DOUBLE) AS y FROM b, unnest(generate_series(r0, r1 - 1)) AS r(v), unnest(generate_series(c0, c1 - 1)) AS c(v)")
def grid_build(s, d):
    """The squares over the bounds of all places of orders."""
    ends = geometry.bounds(table(s, d, "orders"), F.col("o_orderkey") % 977 - 300.5, F.col("o_custkey") / 4 - 90).first()
    return geometry.lattice(s, tuple(ends), 10).select("row", "col", "x", "y")


TRIANGLE = ((2.0, 1.0), (44.0, 9.0), (11.0, 38.0))


@query("WITH t AS (SELECT p_partkey, x, y FROM (%s) q), e(x1,y1,x2,y2) AS (VALUES %s) SELECT p_partkey, count(*) %% 2 = 1 AS inside FROM t JOIN e ON (y1 > y) <> (y2 > y) AND x < (x2-x1)*(y-y1)/(y2-y1)+x1 GROUP BY p_partkey HAVING count(*) %% 2 = 1"
       % (PLACES, ", ".join(f"({a[0]},{a[1]},{b[0]},{b[1]})" for a, b in zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1]))))
def points_in_ring(s, d):
    own = places(s, d).join(F.broadcast(rings(s, TRIANGLE)), F.lit(True))
    return own.select("p_partkey", geometry.holds(F.col("ring"), F.col("x"), F.col("y")).alias("inside")).filter("inside")


@query("WITH v AS (SELECT o_custkey AS k, [] || list({'x': CAST(o_orderkey%97 AS DOUBLE), 'y': CAST(o_orderkey%89 AS DOUBLE)} ORDER BY o_orderkey) AS r FROM orders GROUP BY 1) SELECT k, round(abs(list_sum([r[i].x*r[i%len(r)+1].y - r[i%len(r)+1].x*r[i].y for i in range(1, len(r)+1)]))/2,6) AS area, len(r) >= 3 AND abs(list_sum([r[i].x*r[i%len(r)+1].y - r[i%len(r)+1].x*r[i].y for i in range(1, len(r)+1)])) > 0 AS valid FROM v")
def ring_checks(s, d):
    v = F.struct(F.col("o_orderkey"), (F.col("o_orderkey") % 97).cast("double").alias("x"), (F.col("o_orderkey") % 89).cast("double").alias("y"))
    r = table(s, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.transform(F.sort_array(F.collect_list(v)), lambda p: F.struct(p["x"], p["y"])).alias("ring"))
    return rounded(r.select("k", geometry.area(F.col("ring")).alias("area"), geometry.valid(F.col("ring")).alias("valid")))


@query("WITH t AS (%s), e(x1,y1,x2,y2) AS (VALUES (4.5,7.25,30.25,7.25),(30.25,7.25,30.25,40.75),(30.25,40.75,4.5,40.75),(4.5,40.75,4.5,7.25)) SELECT p_partkey FROM t WHERE sqrt(greatest(4.5-x,0,x-30.25)**2 + greatest(7.25-y,0,y-40.75)**2) <= 5" % PLACES)
def points_near_ring(s, d):
    own = places(s, d).join(F.broadcast(rings(s, [(4.5, 7.25), (30.25, 7.25), (30.25, 40.75), (4.5, 40.75)])), F.lit(True))
    return own.filter(geometry.distance_to(F.col("ring"), F.col("x"), F.col("y")) <= 5).select("p_partkey")


CELLS = "SELECT c_custkey AS cell, c_custkey // 40 AS row, c_custkey % 40 AS col, c_acctbal AS elev, least(1, 0.25 + c_acctbal/20000) AS fuel FROM customer"


def cells(s, d):
    return table(s, d, "customer").select(F.col("c_custkey").alias("cell"), F.expr("c_custkey div 40").alias("row"), (F.col("c_custkey") % 40).alias("col"), F.col("c_acctbal").alias("elev"), F.least(F.lit(1.0), .25 + F.col("c_acctbal") / 20000).alias("fuel"))


@query(f"WITH g AS ({CELLS}) SELECT a.cell AS src, b.cell AS dst, round((b.elev-a.elev)/(sqrt((a.row-b.row)**2+(a.col-b.col)**2)*1000),6) AS steep FROM g a JOIN g b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND a.cell<>b.cell")
def neighbour_slope(s, d):
    n = geometry.neighbours(cells(s, d), "cell", "elev")
    return rounded(n.select(F.col("src_cell").alias("src"), F.col("dst_cell").alias("dst"), geometry.slope(F.col("dst_elev") - F.col("src_elev"), F.col("dr"), F.col("dc"), F.lit(1000.0)).alias("steep")))


EDGE = f"""WITH g AS ({CELLS}) SELECT a.cell AS src, b.cell AS dst, b.row-a.row AS dr, b.col-a.col AS dc, a.fuel AS f, (b.elev-a.elev)/(sqrt((a.row-b.row)**2+(a.col-b.col)**2)*1000) AS steep, (a.cell%7-3)/2.0 AS u, (a.cell%5-2)/2.0 AS v
 FROM g a JOIN g b ON b.row BETWEEN a.row-1 AND a.row+1 AND b.col BETWEEN a.col-1 AND a.col+1 AND a.cell<>b.cell WHERE b.fuel > 0"""


@query(f"SELECT src, dst, round(greatest(0,least(1,0.3*f*exp(0.2*(CASE WHEN u=0 AND v=0 THEN 0 ELSE sqrt(u*u+v*v)*cos(atan2(v,u)-atan2(dr,dc)) END))*exp(0.5*greatest(-1.5,least(1.5,steep)))/sqrt(dr*dr+dc*dc))),6) AS p FROM ({EDGE}) e")
def spread_edges(s, d):
    """Wind at the source, slope and distance."""
    e = spread.edges(cells(s, d), 1000)
    p = spread.probability(F.col("fuel"), (F.col("src") % 7 - 3) / 2, (F.col("src") % 5 - 2) / 2, F.col("steep"), F.col("dr"), F.col("dc"), .3, .2, .5)
    return rounded(e.select("src", "dst", p.alias("p")))


@query("SELECT p_partkey, round(CASE WHEN p_size%5+p_partkey%3+p_size%2=0 THEN 0 ELSE (p_size/50.0)*(0.9*(p_size%5)+0.6*(p_partkey%3)+0.2*(p_size%2))/(p_size%5+p_partkey%3+p_size%2) END,6) AS fuel FROM part")
def fuel_receptivity(s, d):
    return rounded(table(s, d, "part").select("p_partkey", spread.receptivity(F.col("p_size") / 50, F.col("p_size") % 5, F.col("p_partkey") % 3, F.col("p_size") % 2, (.9, .6, .2)).alias("fuel")))


@query(f"WITH g AS ({CELLS}), h AS (SELECT * FROM g WHERE elev > 9000), b AS (SELECT min(row) a, max(row) b, min(col) c, max(col) d FROM h), n AS (SELECT cell, row, col FROM g, b WHERE row BETWEEN a-2 AND b+2 AND col BETWEEN c-2 AND d+2) SELECT cell, row-(SELECT min(row) FROM n) AS r, col-(SELECT min(col) FROM n) AS c FROM n")
def spread_domain(s, d):
    own = cells(s, d)
    return spread.domain(own.select("cell", "row", "col"), own.filter("elev > 9000"), 2).select("cell", "r", "c")


@query("WITH w AS (SELECT DISTINCT l_partkey * 7 % 110 AS h FROM lineitem WHERE l_linenumber = 7) SELECT CAST(t.range AS INT) AS step, min({'d': abs(h - t.range), 'h': h}).h AS hour FROM range(1, 105) t CROSS JOIN w GROUP BY t.range")
def wind_hours(s, d):
    hours = table(s, d, "lineitem").filter("l_linenumber = 7").select((F.col("l_partkey") * 7 % 110).alias("hour"))
    return spread.hour_of_step(104, hours)


@query(f"WITH g AS ({CELLS}), f AS (SELECT cell, row, col, (cell%100)/100.0 AS prob FROM g WHERE cell%3=0), o AS (SELECT row, col FROM g WHERE cell=50) SELECT count(*) FILTER (prob>=0.5) AS likely_cells, CAST(floor(count(*) FILTER (prob>=0.5)*247.105) AS BIGINT) AS acres, count(*) FILTER (prob>0) AS any_cells, round(max(CASE WHEN prob>=0.5 THEN sqrt((f.row-o.row)**2+(f.col-o.col)**2) END),6) AS reach FROM f, o")
def scenario_summary(s, d):
    own = cells(s, d)
    found = own.filter("cell % 3 = 0").select("cell", ((F.col("cell") % 100) / 100).alias("prob"))
    return rounded(spread.scenario_summary(found, own.select("cell", "row", "col"), 50))


@query(f"WITH g AS ({CELLS}), a AS (SELECT cell FROM g WHERE (cell%100)/100.0>=0.5), b AS (SELECT cell FROM g WHERE cell%4=0) SELECT h AS hits, nb-h AS misses, na-h AS false_alarms, round(h/greatest(1,na+nb-h),6) AS iou, round(h/greatest(1,na),6) AS precision, round(h/greatest(1,nb),6) AS recall, round(2.0*h/greatest(1,na+nb),6) AS f1 FROM (SELECT (SELECT count(*) FROM a JOIN b USING(cell)) AS h, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb)")
def perimeter_overlap(s, d):
    own = cells(s, d)
    return rounded(spread.overlap(own.select("cell", ((F.col("cell") % 100) / 100).alias("prob")), own.filter("cell % 4 = 0")))


NEAREST = f"WITH p AS ({PLACES}), q AS (SELECT s_suppkey AS id, s_suppkey * 5 % 47 + 0.75 AS x, s_suppkey * 7 % 50 + 0.5 AS y FROM supplier), n AS (SELECT p_partkey AS ask, min({{'d': sqrt((q.x-p.x)**2+(q.y-p.y)**2), 'p': id}}) AS of FROM p JOIN q ON NEAR GROUP BY 1) SELECT ask, round(of.d, 6) AS distance, of.p AS point FROM n"


def nearest_supplier(s, d, **how):
    """One row for each part key, the nearest of its rows' suppliers; without a cutoff, a key that has no place or meets none has the least supplier and no distance."""
    own = table(s, d, "supplier").select(F.col("s_suppkey").alias("point"), (F.col("s_suppkey") * 5 % 47 + .75).alias("x"), (F.col("s_suppkey") * 7 % 50 + .5).alias("y"))
    asks = places(s, d).withColumnRenamed("p_partkey", "ask")
    found = joins.nearest_points(asks, own, "ask", "point", "x", "y", 4.0, **how)
    if "cutoff" not in how:
        least = own.agg(F.min("point").alias("point"), F.count("*").alias("n")).filter("n > 0")
        lone = asks.join(F.broadcast(least), F.lit(True)).filter("x is null or y is null or point is null")
        found = found.union(lone.select("ask", "point", F.lit(None).cast("double")))
    near = found.groupBy("ask").agg(F.min(F.struct(F.isnull("distance").alias("lone"), "distance", "point")).alias("of"))
    return rounded(near.select("ask", "of.point", "of.distance"))


@query(NEAREST.replace("NEAR ", "true "))
def nearest_vector(s, d):
    return nearest_supplier(s, d)


@query(NEAREST.replace("NEAR ", "sqrt((q.x-p.x)**2+(q.y-p.y)**2) <= 2.3 "))
def nearest_cutoff(s, d):
    return nearest_supplier(s, d, cutoff=2.3)


@query(f"SELECT cell FROM ({CELLS}) g ORDER BY (row-11.3)**2+(col-17.8)**2, cell LIMIT 1")
def nearest_cell(s, d):
    return joins.nearest_to(cells(s, d), "row", "col", (11.3, 17.8), "cell").select("cell")


@query(f"SELECT min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM ({CELLS}) g WHERE elev BETWEEN 1000 AND 3000 AND (CASE WHEN col*10>180 THEN col*10-360 ELSE col*10 END) BETWEEN -60 AND 20")
def curvilinear_window(s, d):
    return geometry.window_of(cells(s, d).withColumn("lon", F.col("col") * 10), "elev", "lon", (1000, -60, 3000, 20))


@query(f"SELECT p_partkey, CAST(greatest(0,least(9,trunc((50-y)/3))) AS BIGINT) AS row, CAST(greatest(0,least(11,trunc((x-2)/3))) AS BIGINT) AS col FROM ({PLACES}) p")
def pixel_lookup(s, d):
    row, col = geometry.pixel(F.col("x"), F.col("y"), 2, 50, 3, 10, 12)
    return places(s, d).select("p_partkey", row.alias("row"), col.alias("col"))


@query("WITH m AS (SELECT l_returnflag AS g, var_pop(l_quantity) AS a, var_pop(l_quantity*0.5 + l_discount*200) AS b, covar_pop(l_quantity, l_quantity*0.5 + l_discount*200) AS c FROM lineitem GROUP BY 1), t AS (SELECT *, 0.5*atan2(2*c, a-b) AS th FROM m)"
       " SELECT g, round(sqrt((a*cos(th)**2+2*c*sin(th)*cos(th)+b*sin(th)**2)/(a*sin(th)**2-2*c*sin(th)*cos(th)+b*cos(th)**2)),6) AS elongation, round((90-degrees(th)+180)%180,6) AS bearing FROM t")
def principal_bearing(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_quantity").alias("x"), (F.col("l_quantity") * .5 + F.col("l_discount") * 200).alias("y"))
    return rounded(geometry.principal_axis(rows, "g", "x", "y"))


@query("WITH p AS (SELECT l_suppkey cell, l_quantity v, CAST(l_partkey%361-1 AS DOUBLE) a FROM lineitem), z AS (SELECT cell, avg(cos(radians(a))) FILTER (a BETWEEN 0 AND 360) n, avg(sin(radians(a))) FILTER (a BETWEEN 0 AND 360) e, max(v)-min(v) r FROM p GROUP BY cell) SELECT cell, r AS range, round((degrees(atan2(e,n))+360)%360,6) AS aspect_mean_deg FROM z")
def zonal_circular(s, d):
    p = table(s, d, "lineitem").select(F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("v"), (F.col("l_partkey") % 361 - 1).cast("double").alias("a"))
    z = zonal_stats(p, "cell", "v", "v", "a")
    return rounded(z.select("cell", (F.col("hi") - F.col("lo")).alias("range"), F.when(F.hypot("northness", "eastness") > 0, F.pmod(F.degrees(F.atan2("eastness", "northness")), F.lit(360.0))).alias("aspect_mean_deg")))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.02) lo, quantile_cont(o_totalprice, 0.98) hi FROM orders), t AS (SELECT o_orderkey, greatest(0,least(1,(o_totalprice-lo)/(hi-lo))) AS s FROM orders, q) SELECT o_orderkey, round(s,6) AS share, round(CASE WHEN s<=0.5 THEN 255*s/0.5 ELSE 255+(100-255)*(s-0.5)/0.5 END,4) AS shade FROM t")
def quantile_stretch(s, d):
    o = table(s, d, "orders").select("o_orderkey", "o_totalprice", F.lit(1).alias("g"))
    own = o.join(F.broadcast(metrics.quantiles(o, "g", "o_totalprice", [.02, .98])), "g").select("o_orderkey", sinks.stretched(F.col("o_totalprice"), F.col("q_1"), F.col("q_2")).alias("share"))
    return own.select("o_orderkey", F.round("share", 6).alias("share"), F.round(sinks.ramp(F.col("share"), [(0, 0), (.5, 255), (1, 100)]), 4).alias("shade"))


@query("SELECT p_partkey, CASE WHEN p_size%10=0 THEN NULL ELSE p_size*0.1::DOUBLE END AS v FROM part")
def masked_raster(s, d):
    """No-data is masked before it is scaled."""
    raw = F.when(F.col("p_size") % 20 == 0, -9999.0).when(F.col("p_size") % 10 == 0, float("nan")).otherwise(F.col("p_size").cast("double"))
    return table(s, d, "part").select("p_partkey", tables.masked(raw, .1).alias("v"))


@query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type='click') AS a, count(*) FILTER (event_type='error') AS b FROM events WHERE event_type IN ('click','error') GROUP BY 1, 2")
def cube_merge(s, d):
    """Two variables, one in two parts, joined in full."""
    e = table(s, d, "events").select("user_id", F.to_date("ts").alias("day"), "event_type")
    n = lambda kind, name, cond="true": e.filter(f"event_type = '{kind}' and {cond}").groupBy("user_id", "day").agg(F.count("*").alias(name))
    return tables.cube({"a": [n("click", "a", "user_id < 50"), n("click", "a", "user_id >= 50")], "b": [n("error", "b")]}, ["user_id", "day"]).fillna(0)


@query("SELECT event_id // 4 AS path, 'V' || CAST(event_id % 4 AS VARCHAR) AS message, event_id * 100 AS first, CASE WHEN event_id % 4 < 3 THEN event_id * 100 + 99 END AS last FROM events WHERE event_id // 4 < (SELECT count(*) // 4 FROM events) AND event_id % 4 > 0")
def index_ranges(s, d):
    """From lines of an index, four messages to a file, three of them wanted; a last file that isn't whole is left out."""
    e = table(s, d, "events").select("event_id")
    k = F.col("event_id") % 4
    line = F.concat_ws(":", k.cast("string"), (F.col("event_id") * 100).cast("string"), F.lit("d=2024"), F.concat(F.lit("V"), k.cast("string")), F.lit("10 m"), F.lit("anl"))
    e = e.select(F.expr("event_id div 4").alias("path"), line.alias("line")).filter(F.col("path") < e.count() // 4)
    return tables.byte_ranges(e, wanted=("V1", "V2", "V3")).select("path", "message", "first", "last")


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) UNION ALL SELECT 'first', count(*) FROM (SELECT c_custkey FROM customer WHERE c_custkey%2=0 EXCEPT SELECT o_custkey FROM orders WHERE o_custkey%3=0)")
def set_counts(s, d):
    c, o = table(s, d, "customer").select("c_custkey"), table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = lambda kind, rows: rows.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"))
    return n("both", c.intersect(o)).union(n("either", c.union(o).distinct())).union(n("first", c.filter("c_custkey % 2 = 0").exceptAll(o.filter("c_custkey % 3 = 0").distinct()).distinct()))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, NULL AS balance, 'customer' AS source FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal, 'supplier' FROM supplier")
def union_sources(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    return feed.combined([c, table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source"))])


@query("WITH c AS (SELECT c_custkey%25 AS pixel, CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders JOIN customer ON c_custkey=o_custkey WHERE o_totalprice>200000 GROUP BY 1,2), t AS (SELECT pixel, day, 1 AS ignition FROM c UNION ALL SELECT (pixel+7)%25, day, 0 FROM c)"
       " SELECT t.pixel, t.day, ignition, w.v AS paid, g.size AS size, round(sin(2*pi()*extract(doy FROM t.day)/365.25),6) AS doy_sin FROM t JOIN (SELECT o_custkey%25 AS pixel, CAST(o_orderdate AS DATE) AS day, count(*) AS v FROM orders GROUP BY 1,2) w ON w.pixel=t.pixel AND w.day=t.day LEFT JOIN (SELECT p_partkey AS pixel, p_size AS size FROM part) g ON g.pixel=t.pixel")
def training_table(s, d):
    """Cases and controls with the weather of their pixel and day and the grid's columns."""
    o = table(s, d, "orders").select((F.col("o_custkey") % 25).alias("pixel"), F.to_date("o_orderdate").alias("day"), "o_totalprice")
    cases = o.filter("o_totalprice > 200000").select("pixel", "day").distinct()
    rows = model.labelled_union(cases, cases.select(((F.col("pixel") + 7) % 25).alias("pixel"), "day"))
    weather = o.groupBy("pixel", "day").agg(F.count("*").alias("paid"))
    rows = rows.join(weather, ["pixel", "day"]).withColumn("doy_sin", times.season(F.col("day"))[0])
    grid = table(s, d, "part").select(F.col("p_partkey").alias("pixel"), F.col("p_size").alias("size"))
    return rounded(joins.filled_from(rows.withColumn("key", F.col("pixel")), grid.withColumnRenamed("pixel", "key"), "key", ["pixel", "day", "ignition", "paid", "size", "doy_sin"]).drop("key"))


@query("SELECT round(avg(l_quantity),6) AS quantity, round(avg(l_tax),6) AS tax, round(sqrt(avg(l_discount-0.05)**2+avg(l_tax-0.05)**2)*2.23694,6) AS wind_mph, round((degrees(atan2(-avg(l_discount-0.05),-avg(l_tax-0.05)))+360)%360,3) AS wind_from FROM lineitem")
def conditions(s, d):
    rows = table(s, d, "lineitem").select(F.col("l_quantity").alias("quantity"), F.col("l_tax").alias("tax"), (F.col("l_discount") - .05).alias("u_wind"), (F.col("l_tax") - .05).alias("v_wind"))
    return rounded(model.conditions(rows, "quantity", "tax")).withColumn("wind_from", F.round("wind_from", 3))


@query("WITH w AS (SELECT count(DISTINCT user_id) AS cells, date_diff('day', min(CAST(ts AS DATE)), max(CAST(ts AS DATE))) + 1 AS days FROM events), c AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, CAST(ts AS DATE) FROM events WHERE event_type='error') e)"
       " SELECT n AS positives, CAST(cells * days AS INT) AS cell_days, round(n / CAST(cells * days AS DOUBLE), 6) AS prevalence, n * 20 AS controls, round(1 / 21.0, 6) AS sampled_prevalence, round(n * 20 / (CAST(cells * days AS DOUBLE) - n), 6) AS fraction FROM w, c")
def sampling_meta(s, d):
    """Of all cells and all days between the first and the last."""
    e = table(s, d, "events").select(F.col("user_id").alias("cell"), F.to_date("ts").alias("day"), "event_type")
    whole = e.agg(F.countDistinct("cell").alias("cells"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days")).first()
    return rounded(model.prevalence(e.filter("event_type = 'error'"), whole.cells, whole.days, 20))


@query("""WITH RECURSIVE o AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, g) AS i FROM (SELECT floor(c_acctbal / 250) AS g, count(*) AS n FROM customer GROUP BY 1) c),
 f AS (SELECT CAST(0 AS BIGINT) AS i, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS load, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS BIGINT) AS n, 0 AS fold UNION ALL
  SELECT o.i, list_transform(load, lambda x, j: CASE WHEN j = list_position(load, list_min(load)) THEN x + o.n ELSE x END), o.g, o.n, list_position(load, list_min(load)) - 1 FROM f JOIN o ON o.i = f.i + 1)
 SELECT CAST(g AS BIGINT) AS g, n, CAST(fold AS INT) AS fold FROM f WHERE i > 0""")
def group_folds(s, d):
    """The fold of every group, and its rows."""
    rows = table(s, d, "customer").select(F.floor(F.col("c_acctbal") / 250).alias("g"))
    return rows.groupBy("g").agg(F.count("*").alias("n")).join(model.group_folds(rows, "g"), "g")


def risk_rows(s, d):
    """A label from the line's price and tax, wrong for one row in eight; a value missing here and there; years and blocks of places."""
    li = table(s, d, "lineitem").join(table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("day")), "l_orderkey")
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    sure = (F.col("l_quantity") > 30) & (F.col("l_discount") > .04)
    return li.select(key.alias("id"), F.year("day").alias("year"), "day", F.col("l_suppkey").alias("cell"), model.block(F.col("l_suppkey") * 1500, F.col("l_suppkey") * 700).alias("block"), F.when(F.col("l_linenumber") != 5, F.col("l_quantity")).alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
                     (sure != (F.crc32(key.cast("string")) % 8 == 0)).cast("int").alias("label"))


FEATURES = ["quantity", "discount", "tax"]


@rows_only
def gbt_score(s, d):
    """Out-of-fold metrics of boosted trees (400 at most), a single year held out at a time, and of blocks in five folds; under the same blocks those of logistic models of all features and of one, and of the training share."""
    rows = model.written(risk_rows(s, d))
    # What no model reads isn't sent through them.
    needed = ["id", "fold", "label", *FEATURES]
    years = rows.join(windows.dense_ranks(rows.select("year").distinct(), "year", "fold"), "year").select(needed)
    blocks = model.written(rows.join(model.group_folds(rows, "block"), "block").select(needed))
    found = {("years", "boosted"): model.boosted_out_of_fold(years, FEATURES, "label", key="id"), ("blocks", "boosted"): model.boosted_out_of_fold(blocks, FEATURES, "label", key="id"),
             ("blocks", "logistic"): model.out_of_fold(blocks, model.logistic(FEATURES, "label"), FEATURES, "label"), ("blocks", "quantity"): model.out_of_fold(blocks, model.logistic(["quantity"], "label"), ["quantity"], "label"), ("blocks", "prior"): model.prior_out_of_fold(blocks, "label")}
    out = []
    for (scheme, name), scores in found.items():
        scores = model.written(scores.select("fold", "label", "score"))
        whole = metrics.average_precision(scores, "label", "score").crossJoin(metrics.roc_auc(scores, "label", "score")).crossJoin(metrics.brier(scores, "label", "score"))
        each = metrics.average_precisions(scores, ["fold"], "label", "score").agg(F.avg("ap").alias("fold_mean"), F.stddev_samp("ap").alias("fold_sd"))
        out.append(whole.crossJoin(each).select(F.lit(scheme).alias("scheme"), F.lit(name).alias("model"), "*"))
    return reduce(lambda a, b: a.unionByName(b), out)


def first_fold(s, d):
    """(training rows, held-out rows) of the first fold of blocks."""
    rows = risk_rows(s, d)
    rows = model.written(rows.join(model.group_folds(rows, "block"), "block"))
    return rows.filter("fold <> 0"), rows.filter("fold = 0")


@rows_only
def permutation_importance(s, d):
    """By boosted trees on blocks that they haven't seen, ten repeats."""
    train, held = first_fold(s, d)
    return model.permutation_importance(boosting.boost(train, FEATURES, "label", None, key="id"), held, FEATURES, "label", "id")


@rows_only
def risk_surface(s, d):
    """Every cell on every day that has lines of it: the mean of its lines' features, scored, and ranked within the day."""
    rows = model.written(risk_rows(s, d))
    cells = rows.groupBy("day", "cell").agg(*[F.avg(c).alias(c) for c in FEATURES])
    return model.risk_surface(boosting.boost(rows, FEATURES, "label", None, key="id"), cells, FEATURES, .01, ["day"])


@rows_only
def spread_search(s, d):
    """Candidates against the arrivals of a known run, all in one ensemble."""
    own = cells(s, d)
    e = spread.edges(own, 1000).withColumns({"u": F.lit(.5), "v": F.lit(.2)})
    p = spread.probability(F.col("fuel"), F.col("u"), F.col("v"), F.col("steep"), F.col("dr"), F.col("dc"), .4, .2, .5)
    start = own.orderBy(F.desc("fuel"), "cell").limit(1).first()["cell"]
    known = spread.ensemble(s.range(1).select(F.col("id").alias("run"), F.lit(start).alias("cell")), e.select("src", "dst", "dir", p.alias("p")), 5, seed=99)
    return spread.search(spread.candidates(s, 8), e, start, known.select("cell", "arrival"), 5, repeats=3)


@query("SELECT doc_id, round(1/(1+exp(-(ln(p/(1-p))+ln(0.1)))),6) AS risk FROM (SELECT doc_id, 1.0/(1.0+n_chars) AS p FROM documents) t")
def corrected_risk(s, d):
    return rounded(table(s, d, "documents").select("doc_id", prior_corrected(1.0 / (1.0 + F.col("n_chars")), .1).alias("risk")))


@query("SELECT n_nationkey, round(-124 + 0.4e0*n_nationkey, 7) AS lon, round(33 + 0.3e0*n_nationkey, 7) AS lat, round(-124 + 0.4e0*n_nationkey, 7) AS lon_5070, round(33 + 0.3e0*n_nationkey, 7) AS lat_5070 FROM nation")
def albers_round_trip(s, d):
    """To both projections and back."""
    out = table(s, d, "nation")
    for name, how in (("", {}), ("_5070", {"parallels": (29.5, 45.5), "origin": (23, -96), "false_northing": 0})):
        x, y = albers_sql("(-124 + 0.4e0 * n_nationkey)", "(33 + 0.3e0 * n_nationkey)", **how)
        out = out.withColumns({f"x{name}": F.expr(x), f"y{name}": F.expr(y)})
        lon, lat = lonlat_sql(f"x{name}", f"y{name}", **how)
        out = out.withColumns({f"lon{name}": F.round(F.expr(lon), 7), f"lat{name}": F.round(F.expr(lat), 7)})
    return out.select("n_nationkey", "lon", "lat", "lon_5070", "lat_5070")


@query("SELECT c_custkey, row_number() OVER (ORDER BY c_mktsegment DESC, c_custkey) - 1 AS id FROM customer")
def surrogate_keys(s, d):
    return numbered(table(s, d, "customer").select("c_mktsegment", "c_custkey"), [F.desc("c_mktsegment"), F.col("c_custkey")], "id").select("c_custkey", "id")


@query("WITH g AS (SELECT r.range AS row, c.range AS col FROM range((SELECT max(p_partkey) // 40 + 1 FROM part)) r CROSS JOIN range(40) c), v AS (SELECT p_partkey // 40 AS row, p_partkey % 40 AS col, p_size AS v FROM part) SELECT g.row, g.col, v.v FROM g LEFT JOIN v USING(row, col)")
def dense_raster(s, d):
    """All parts as a raster of 40 columns; the places before the first and after the last part are null."""
    values = table(s, d, "part").select(F.expr("p_partkey div 40").alias("row"), (F.col("p_partkey") % 40).alias("col"), F.col("p_size").alias("v"))
    return geometry.dense(geometry.lattice(s, (0, 0, 40, (values.agg(F.max("row")).first()[0] or 0) + 1), 1).select("row", "col"), values)


@rows_only
def fire_scenario(s, d):
    """The summary of a fire from a place, under two hours of wind."""
    own = cells(s, d).withColumns({"x": F.col("col") * 1.0, "y": F.col("row") * 1.0})
    winds = own.crossJoin(s.createDataFrame([(0, 2.0, 0.5), (4, -1.0, 1.0)], "hour int, u double, v double")).select("hour", "cell", "u", "v")
    return spread.scenario(own, (20.2, 10.4), winds, {"p0": .3, "k_wind": .2, "k_slope": .5}, 8, runs=5)[1]
