"""The stand-in tables in SQL, as parts of a WITH clause."""

from __future__ import annotations

from .standins import REGIONS

_VALUES = ", ".join(f"({o}, '{n}', '{r}', {a}::DOUBLE, {b}::DOUBLE)" for o, n, r, a, b in REGIONS)
VIEWS = {
    "regions": f"regions(ord, region_name, role, center_lat, center_lon) AS (VALUES {_VALUES})",
    "tiles0": "tiles0 AS (SELECT p_partkey AS tile_id, ((p_partkey*7919)%12000)/1e2-60 AS tile_lat, ((p_partkey*104729)%36000)/1e2-180 AS tile_lon, p_size/1e1 AS half, (p_partkey%5)/1e1 AS skew, p_partkey%2+9 AS zoom, p_partkey%4+2018 AS year FROM part)",
    "tiles": "tiles AS (SELECT *, tile_lat-half AS y0, tile_lon-half AS x0, tile_lat+half AS y1, tile_lon-half+skew AS x1, tile_lat+half AS y2, tile_lon+half AS x2, tile_lat-half+skew AS y3, tile_lon+half AS x3 FROM tiles0)",
    "queries0": "queries0 AS (SELECT c_custkey AS query_id, ((c_custkey*6151)%12000)/1e2-60 AS lat, ((c_custkey*92821)%36000)/1e2-180 AS lon, (c_custkey%50+1)/1e1 AS half FROM customer)",
    "queries": "queries AS (SELECT *, lat-half AS y0, lon-half AS x0, lat+half AS y1, lon-half AS x1, lat+half AS y2, lon+half AS x2, lat-half AS y3, lon+half AS x3 FROM queries0)",
    "descriptors": "descriptors AS (SELECT vec_id//4 AS tile_id, (vec_id%4)*90 AS rotation, label, embedding::DOUBLE[] AS descriptor FROM embeddings)",
    "qd": "qd AS (SELECT vec_id AS query_id, vec_id//4 AS own_tile, label, embedding::DOUBLE[] AS descriptor FROM embeddings WHERE vec_id%25=0)",
    "relevant": "relevant AS (SELECT DISTINCT q.query_id, d.tile_id FROM qd q JOIN descriptors d ON q.label=d.label WHERE d.tile_id<>q.own_tile)",
    "ranked": "ranked AS (SELECT query_id, tile_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, tile_id) AS rank FROM (SELECT q.query_id, d.tile_id, max(list_dot_product(q.descriptor, d.descriptor)) AS similarity FROM qd q JOIN descriptors d ON d.tile_id<>q.own_tile GROUP BY ALL))",
    "candidates": "candidates AS (SELECT l_orderkey AS query_id, l_partkey AS tile_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rank, l_quantity::INT AS num_inliers, l_linenumber AS line, 1-l_discount AS similarity FROM lineitem)",
    "frames": "frames AS (SELECT o_orderkey AS query_id, r_name AS region_name, strftime(o_orderdate, '%Y%m%d') AS timestamp FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey)",
    "best": "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY num_inliers DESC, rank) AS nth FROM candidates) WHERE nth=1)",
    "fixes": "fixes AS (SELECT f.*, b.tile_id, b.line, b.num_inliers, coalesce(b.num_inliers,0)::DOUBLE AS confidence, CASE WHEN coalesce(b.num_inliers,0)>=30 THEN 'fix' ELSE 'no_fix' END AS status FROM frames f LEFT JOIN best b ON f.query_id=b.query_id)",
    "matches": "matches AS (SELECT f.*, i, (num_inliers*37+i*101)%640*1e0 AS qu, (tile_id*13+i*57)%480*1e0 AS qv, t.y0,t.x0,t.y1,t.x1,t.y2,t.x2,t.y3,t.x3 FROM fixes f JOIN tiles t USING(tile_id), range(6) r(i) WHERE status='fix' AND (line+i)%3<>0)",
    "ground": "ground AS (SELECT *, (y1*(1-fx)+y2*fx)*(1-fy)+(y0*(1-fx)+y3*fx)*fy AS g_lat, (x1*(1-fx)+x2*fx)*(1-fy)+(x0*(1-fx)+x3*fx)*fy AS g_lon FROM (SELECT *, (qu*0.4+10)/383e0 AS fx, (qv*0.45+5)/319e0 AS fy FROM matches))",
    "samples": "samples AS (SELECT user_id%10 AS run_id, event_id, epoch_us(ts)/1e6 AS ts, CASE WHEN event_id%17<>0 THEN ((event_id*7919000+floor(value*100)::BIGINT)%262144000)::DOUBLE END AS counter, floor(value*100)/1e1 AS rss_mb FROM events)",
}
NEEDS = {
    "tiles": ["tiles0"], "queries": ["queries0"], "relevant": ["qd", "descriptors"], "ranked": ["qd", "descriptors"],
    "best": ["candidates"], "fixes": ["frames", "best"], "matches": ["fixes", "tiles"], "ground": ["matches"],
}


def haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(12742e0*asin(least(1e0, sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2)))))"


def sql(body: str, *views: str, more: str = "") -> str:
    """A query with the views it needs. `more`: further parts of the WITH clause."""
    found: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, []):
            add(x)
        if name not in found:
            found.append(name)

    for v in views:
        add(v)
    parts = [VIEWS[v] for v in found] + ([more] if more else [])
    return ("WITH " + ", ".join(parts) + " " if parts else "") + body
