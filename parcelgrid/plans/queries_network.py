"""Registered queries over utility networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelgrid.fixtures import Fixtures
from parcelgrid.functions import geometry as g
from parcelgrid.operators import edits as ed, network as nw
from parcelgrid.operators.generate import boundary_candidates
from parcelgrid.plans.queries_generate import rect_sites
from parcelgrid.plans.queries_rules import typed_assets
from parcelgrid.plans.registry import query, r4


def asset_points(fx: Fixtures) -> DataFrame:
    return fx.assets.select(
        "site_id", F.col("asset_id").alias("node"), (F.col("x") + F.col("w") / 2).alias("px"),
        (F.col("y") + F.col("h") / 2).alias("py"),
    )


_PTS = "pt AS (SELECT site_id, asset_id AS node, x+w/2 AS px, y+h/2 AS py FROM assets)\n"


def _edges(points: str, limit: str) -> str:
    return (
        f"(SELECT a.site_id, a.node AS u, b.node AS v, sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py)) AS weight FROM {points} a "
        f"JOIN {points} b ON a.site_id=b.site_id AND a.node<b.node WHERE sqrt((a.px-b.px)*(a.px-b.px)+(a.py-b.py)*(a.py-b.py))<{limit})"
    )


def _grow(points: str, limit: str) -> str:
    """Prim's tree per site, one node a step: state is the list of reached nodes and the last edge."""
    return f"""
    ed AS (SELECT site_id, u, v, weight FROM {_edges(points, limit)}),
    bi AS (SELECT site_id, u AS a, v AS b, u, v, weight FROM ed UNION ALL SELECT site_id, v, u, u, v, weight FROM ed),
    st AS (SELECT site_id, min(node) AS s FROM {points} GROUP BY 1),
    gr AS (SELECT site_id, [s] AS reached, NULL::BIGINT AS u, NULL::BIGINT AS v, 0.0::DOUBLE AS weight FROM st UNION ALL
      SELECT site_id, list_append(reached, e.b), e.u, e.v, e.weight FROM (SELECT gr.site_id, gr.reached,
         (SELECT min(struct_pack(weight:=bi.weight,u:=bi.u,v:=bi.v,b:=bi.b)) FROM bi WHERE bi.site_id=gr.site_id AND list_contains(gr.reached,bi.a) AND NOT list_contains(gr.reached,bi.b)) AS e FROM gr) WHERE e IS NOT NULL),
    tr AS (SELECT site_id, u, v, weight FROM gr WHERE u IS NOT NULL)
    """


@query("n1_candidate_edges", _PTS + "SELECT site_id, u, v, round(weight,4) AS weight FROM " + _edges("pt", "150"))
def candidate_edges(fx: Fixtures) -> DataFrame:
    return nw.candidate_edges(asset_points(fx), 150.0).select("site_id", "u", "v", r4(F.col("weight"), "weight"))


@query("n2_mst", _PTS + "," + _grow("pt", "1e9") + "SELECT site_id, u, v, round(weight,4) AS weight FROM tr")
def mst(fx: Fixtures) -> DataFrame:
    t = nw.euclidean_mst(asset_points(fx), 100.0)
    return t.select("site_id", "u", "v", r4(F.col("weight"), "weight"))


@query(
    "n3_components",
    _PTS + f""", ed AS (SELECT site_id, u, v FROM {_edges('pt', '60')}), bi AS (SELECT site_id, u, v FROM ed UNION ALL SELECT site_id, v, u FROM ed),
    rc AS (SELECT site_id, node, node AS comp FROM pt UNION SELECT rc.site_id, bi.v, rc.comp FROM rc JOIN bi ON bi.site_id=rc.site_id AND bi.u=rc.node)
    SELECT site_id, node, min(comp) AS comp FROM rc GROUP BY 1,2""",
)
def components(fx: Fixtures) -> DataFrame:
    p = asset_points(fx)
    return nw.components(p, nw.candidate_edges(p, 60.0))


@query(
    "n4_loop_network",
    _PTS + "," + _grow("pt", "500") + """, nt AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY weight,u,v) AS rn FROM ed ANTI JOIN tr USING (site_id,u,v)),
    k AS (SELECT site_id, greatest(1,floor(count(*)*0.15::DOUBLE)) AS k FROM pt GROUP BY 1)
    SELECT site_id, u, v, round(weight,4) AS weight, 'tree' AS kind FROM tr UNION ALL SELECT site_id, u, v, round(weight,4), 'loop' FROM nt JOIN k USING (site_id) WHERE rn<=k""",
)
def loop_network(fx: Fixtures) -> DataFrame:
    n = nw.loop_network(asset_points(fx))
    return n.select("site_id", "u", "v", r4(F.col("weight"), "weight"), "kind")


@query(
    "s3_non_tree_edges",
    _PTS + "," + _grow("pt", "1e9") + f"SELECT site_id, count(*) AS n_edges, round(sum(weight),4) AS total_m FROM {_edges('pt', '150')} e ANTI JOIN tr USING (site_id,u,v) GROUP BY 1",
)
def non_tree_edges(fx: Fixtures) -> DataFrame:
    p = asset_points(fx)
    rest = ed.non_tree_edges(nw.candidate_edges(p, 150.0), nw.euclidean_mst(p, 100.0))
    return rest.groupBy("site_id").agg(F.count("*").alias("n_edges"), r4(F.sum("weight"), "total_m"))


_STEINER = _PTS + """, bp AS (SELECT site_id, 1000000000+k AS node, CASE WHEN d<=w THEN d WHEN d<=w+h THEN w WHEN d<=2*w+h THEN w-(d-w-h) ELSE 0 END AS px,
   CASE WHEN d<=w THEN 0 WHEN d<=w+h THEN d-w WHEN d<=2*w+h THEN h ELSE h-(d-2*w-h) END AS py FROM (SELECT *, k*2*(w+h)/8 AS d FROM sites, (SELECT unnest(range(8)) AS k))),
   sp AS (SELECT * FROM pt WHERE site_id IN (SELECT site_id FROM sites) UNION ALL SELECT * FROM bp)
"""


@query("n5_steiner_approx", _STEINER + "," + _grow("sp", "1e9") + "SELECT site_id, count(*) AS n_edges, round(sum(weight),3) AS total_m FROM tr GROUP BY 1")
def steiner_approx(fx: Fixtures) -> DataFrame:
    sites = rect_sites(fx)
    extra = boundary_candidates(sites.select("site_id", "ring"), 8).select(
        "site_id", (F.col("point_no") + 1000000000).cast("long").alias("node"), "px", "py"
    )
    terminals = asset_points(fx).join(sites.select("site_id"), "site_id", "left_semi")
    t = nw.steiner_approx(terminals, extra, 100.0)
    return t.groupBy("site_id").agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 3).alias("total_m"))


_SHORT = _PTS + f""", ed AS (SELECT site_id, u, v, weight FROM {_edges('pt', '150')}), bi AS (SELECT site_id, u, v, weight FROM ed UNION ALL SELECT site_id, v, u, weight FROM ed),
  src AS (SELECT site_id, min(node) AS node FROM pt GROUP BY 1),
  rx AS (SELECT site_id, node, 0.0::DOUBLE AS d, 0 AS hops FROM src UNION ALL
     SELECT site_id, node, min(d) AS d, hops FROM (SELECT bi.site_id, bi.v AS node, rx.d+bi.weight AS d, rx.hops+1 AS hops FROM rx JOIN bi ON bi.site_id=rx.site_id AND bi.u=rx.node WHERE rx.hops<21) GROUP BY 1,2,4)
"""


@query("n6_shortest_path", _SHORT + "SELECT site_id, node, round(min(d),4) AS dist_m FROM rx GROUP BY 1,2")
def shortest_path(fx: Fixtures) -> DataFrame:
    p = asset_points(fx)
    paths = nw.shortest_paths(nw.candidate_edges(p, 150.0), p.groupBy("site_id").agg(F.min("node").alias("node")))
    return paths.select("site_id", "node", r4(F.col("dist"), "dist_m"))


@query("n6_path_nodes")
def path_nodes(fx: Fixtures) -> DataFrame:
    p = asset_points(fx)
    ends = p.groupBy("site_id").agg(F.min("node").alias("lo"), F.max("node").alias("hi"))
    paths = nw.shortest_paths(nw.candidate_edges(p, 150.0), ends.select("site_id", F.col("lo").alias("node")))
    return nw.path_to(paths, ends.select("site_id", F.col("hi").alias("node")))


def utility_points(fx: Fixtures) -> DataFrame:
    gates = fx.sites.select("site_id", F.lit(0.0).alias("px"), (F.col("h") / 4).alias("py"))
    return nw.routing_points(typed_assets(fx), gates)


_UTIL = """
pt AS (SELECT site_id, asset_id AS node, x+w/2 AS px, y+h/2 AS py FROM assets WHERE kind_no<>6 UNION ALL
  SELECT site_id, -1, 0.0, h/4 FROM sites WHERE site_id IN (SELECT site_id FROM assets WHERE kind_no<>6))
"""


@query(
    "n7_route_utilities",
    _UTIL + "," + _grow("pt", "1e9") + f""", e5 AS (SELECT * FROM ed WHERE weight<500), nn AS (SELECT site_id, count(*) AS n FROM pt GROUP BY 1),
    nt AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY weight,u,v) AS rn FROM e5 ANTI JOIN tr USING (site_id,u,v)),
    lp AS (SELECT site_id, weight FROM nt JOIN nn USING (site_id) WHERE rn<=greatest(1,floor(n*0.15::DOUBLE))),
    wt AS (SELECT site_id, sum(weight) AS m FROM tr GROUP BY 1), el AS (SELECT site_id, sum(weight) AS m, count(*) AS c FROM lp GROUP BY 1)
    SELECT site_id, n AS n_nodes, round(wt.m+el.m,3) AS electric_m, round(wt.m,3) AS water_m, el.c AS redundant FROM nn JOIN wt USING (site_id) JOIN el USING (site_id)""",
)
def route_utilities(fx: Fixtures) -> DataFrame:
    p = utility_points(fx)
    s = nw.network_summary(p, nw.loop_network(p), nw.euclidean_mst(p, 100.0))
    return s.select(
        "site_id", "n_nodes", F.round("electric_m", 3).alias("electric_m"), F.round("water_m", 3).alias("water_m"), "redundant"
    )


@query(
    "n8_route_to_boundary",
    """a AS (SELECT site_id, asset_id, x+w/2 AS px, y+h/2 AS py FROM assets), j AS (SELECT a.*, s.w-2 AS xm, s.h-2 AS ym, least(abs(px-2),1e9) AS q FROM a JOIN sites s USING (site_id) WHERE NOT concave),
    d AS (SELECT *, greatest(2-px,0,px-xm) AS ox, greatest(2-py,0,py-ym) AS oy FROM j)
    SELECT site_id, asset_id, round(CASE WHEN ox>0 OR oy>0 THEN sqrt(ox*ox+oy*oy) ELSE least(px-2,xm-px,py-2,ym-py) END,4) AS length_m FROM d""",
)
def route_to_boundary(fx: Fixtures) -> DataFrame:
    s = rect_sites(fx).filter("not concave").select("site_id", "ring")
    r = nw.route_to_boundary(s, fx.assets)
    return r.select("site_id", "asset_id", r4(F.col("length_m"), "length_m"))


_LLOYD = _PTS + """, rk AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY node)-1 AS i, count(*) OVER (PARTITION BY site_id) AS n FROM pt),
 kk AS (SELECT *, greatest(1,n//5) AS k, n//greatest(1,n//5) AS st FROM rk),
 c0 AS (SELECT site_id, i//st AS c, px AS cx, py AS cy FROM kk WHERE i%st=0 AND i//st<k)
"""
for _i in range(3):
    _LLOYD += f""", a{_i} AS (SELECT site_id, node, any_value(px) AS px, any_value(py) AS py, min(struct_pack(d:=round((px-cx)*(px-cx)+(py-cy)*(py-cy),6),c:=c)) AS m FROM pt JOIN c{_i} USING (site_id) GROUP BY 1,2),
 b{_i} AS (SELECT site_id, m.c AS c, round(avg(px),6) AS nx, round(avg(py),6) AS ny FROM a{_i} GROUP BY 1,2),
 c{_i + 1} AS (SELECT site_id, c, coalesce(nx,cx) AS cx, coalesce(ny,cy) AS cy FROM c{_i} LEFT JOIN b{_i} USING (site_id,c))
"""


@query("n9_place_transformers", _LLOYD + "SELECT site_id, c, round(cx,3) AS cx, round(cy,3) AS cy FROM c3")
def place_transformers(fx: Fixtures) -> DataFrame:
    t = nw.place_transformers(asset_points(fx), per=5, rounds=3)
    return t.select("site_id", "c", F.round("cx", 3).alias("cx"), F.round("cy", 3).alias("cy"))


@query(
    "n10_drainage_flow",
    _PTS + """, ou AS (SELECT site_id, arg_min(px, [round(50-0.02::DOUBLE*px-0.03::DOUBLE*py,6), node]) AS ox, arg_min(py, [round(50-0.02::DOUBLE*px-0.03::DOUBLE*py,6), node]) AS oy FROM pt GROUP BY 1)
    SELECT site_id, node, round((ox-px)/d*30,4) AS vx, round((oy-py)/d*30,4) AS vy FROM (SELECT *, sqrt((ox-px)*(ox-px)+(oy-py)*(oy-py)) AS d FROM pt JOIN ou USING (site_id)) WHERE d>0""",
)
def drainage_flow(fx: Fixtures) -> DataFrame:
    p = asset_points(fx)
    low = F.struct(F.round(g.elevation(F.col("px"), F.col("py")), 6), F.col("node"))
    outlet = p.groupBy("site_id").agg(F.min_by(F.struct("px", "py"), low).alias("o")).select("site_id", "o.px", "o.py")
    d = nw.drainage_flow(p, outlet)
    return d.select("site_id", "node", r4(F.col("vx"), "vx"), r4(F.col("vy"), "vy"))


@query(
    "j8_visibility_edges",
    _PTS + f""", ed AS (SELECT e.*, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM {_edges('pt', '150')} e JOIN pt a ON a.site_id=e.site_id AND a.node=e.u JOIN pt b ON b.site_id=e.site_id AND b.node=e.v),
    ob AS (SELECT *, x+w AS x2, y+h AS y2 FROM site_constraints),
    hit AS (SELECT DISTINCT e.site_id, u, v FROM ed e JOIN ob USING (site_id) WHERE least(ax,bx)<x2 AND greatest(ax,bx)>x AND least(ay,by_)<y2 AND greatest(ay,by_)>y
      AND least((bx-ax)*(y-ay)-(by_-ay)*(x-ax),(bx-ax)*(y-ay)-(by_-ay)*(x2-ax),(bx-ax)*(y2-ay)-(by_-ay)*(x2-ax),(bx-ax)*(y2-ay)-(by_-ay)*(x-ax))<-1e-9
      AND greatest((bx-ax)*(y-ay)-(by_-ay)*(x-ax),(bx-ax)*(y-ay)-(by_-ay)*(x2-ax),(bx-ax)*(y2-ay)-(by_-ay)*(x2-ax),(bx-ax)*(y2-ay)-(by_-ay)*(x-ax))>1e-9)
    SELECT site_id, u, v FROM ed ANTI JOIN hit USING (site_id,u,v)""",
)
def visibility_edges(fx: Fixtures) -> DataFrame:
    p = asset_points(fx)
    return nw.visibility_edges(nw.candidate_edges(p, 150.0), p, fx.site_constraints).select("site_id", "u", "v")


_CORNERS = ("(-20,-20)", "(20,-20)", "(20,20)", "(-20,20)")


def _to_segment(corner: str) -> str:
    x, y = corner.strip("()").split(",")
    t = f"greatest(0.0,least(1.0,(({x}-au)*(bu-au)+({y}-av)*(bv-av))/greatest((bu-au)*(bu-au)+(bv-av)*(bv-av),1e-12)))"
    return f"sqrt(pow({x}-au-{t}*(bu-au),2)+pow({y}-av-{t}*(bv-av),2))"


def _turn(corner: str) -> str:
    x, y = corner.strip("()").split(",")
    return f"((bu-au)*({y}-av)-(bv-av)*({x}-au))"


@query(
    "j8_polygon_obstacles",
    _PTS + f""", ed AS (SELECT e.*, a.px AS ax, a.py AS ay, b.px AS bx, b.py AS by_ FROM {_edges('pt', '150')} e JOIN pt a ON a.site_id=e.site_id AND a.node=e.u JOIN pt b ON b.site_id=e.site_id AND b.node=e.v),
    tu AS (SELECT e.site_id, u, v, buffer_m*sqrt(2.0) AS keep, ax-x-20+ay-y-20 AS au, ax-x-ay+y AS av, bx-x-20+by_-y-20 AS bu, bx-x-by_+y AS bv FROM ed e JOIN site_constraints USING (site_id)),
    ds AS (SELECT *, least({', '.join(_to_segment(c) for c in _CORNERS)}, sqrt(pow(greatest(0.0,abs(au)-20),2)+pow(greatest(0.0,abs(av)-20),2)), sqrt(pow(greatest(0.0,abs(bu)-20),2)+pow(greatest(0.0,abs(bv)-20),2))) AS d,
      least(au,bu)<20 AND greatest(au,bu)>-20 AND least(av,bv)<20 AND greatest(av,bv)>-20 AND least({', '.join(_turn(c) for c in _CORNERS)})<-1e-9 AND greatest({', '.join(_turn(c) for c in _CORNERS)})>1e-9 AS through FROM tu)
    SELECT site_id, u, v FROM ed ANTI JOIN (SELECT DISTINCT site_id, u, v FROM ds WHERE through OR d<keep-1e-9) USING (site_id,u,v)""",
)
def polygon_obstacles(fx: Fixtures) -> DataFrame:
    """Edges that keep the buffers of constraints shaped as diamonds."""
    p, x, y = asset_points(fx), F.col("x"), F.col("y")
    diamonds = fx.site_constraints.select("site_id", "buffer_m", g.ring_of((x + 20, y), (x + 40, y + 20), (x + 20, y + 40), (x, y + 20)).alias("ring"))
    return nw.visibility_edges(nw.candidate_edges(p, 150.0), p, diamonds, buffer="buffer_m").select("site_id", "u", "v")
