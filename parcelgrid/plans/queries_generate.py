"""Registered queries over the generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from parcelgrid.fixtures import Fixtures, sites_with_ring
from parcelgrid.functions import geometry as g
from parcelgrid.operators import arrangement as ar, generate as ge, metrics as m, rules as ru, templates as te
from parcelgrid.plans import oracle_forms as o
from parcelgrid.plans.queries_geometry import plots_with_ring, turned_plots
from parcelgrid.plans.registry import query, r4


def rect_sites(fx: Fixtures) -> DataFrame:
    return g.materialize(fx.sites, ring=g.rect_ring(F.lit(0.0), F.lit(0.0), F.col("w"), F.col("h")))


def convex_sites(fx: Fixtures) -> DataFrame:
    return sites_with_ring(fx).filter("not concave")


def keyed_plots(fx: Fixtures) -> DataFrame:
    """Plots as small sites of their own."""
    return plots_with_ring(fx).withColumn("site_id", F.col("layout_id") * 8 + F.col("plot_no"))


_CENTRE = """
ce AS (SELECT *, sqrt(w*w+h*h) AS diam, CASE WHEN concave THEN 5*w/12 ELSE (w*h*w/2-cut*cut/2*(w-cut/3))/(w*h-cut*cut/2) END AS cx0,
       CASE WHEN concave THEN 5*h/12 ELSE (w*h*h/2-cut*cut/2*(h-cut/3))/(w*h-cut*cut/2) END AS cy0 FROM sites)
"""


def _cells(spacing: str, candidates: str) -> str:
    """All grid cells of candidate table ``candidates(spacing, quarter)``; a quarter turn keeps cells axis-parallel."""
    return f"""
    gc AS (SELECT site_id, {spacing} AS s, q, i, j, w AS sw, h AS sh, cut, concave, cx0, cy0, -diam+i*{spacing}-cx0 AS dx, -diam+j*{spacing}-cy0 AS dy
       FROM ce, {candidates}, LATERAL (SELECT unnest(range(0,(ceil((greatest(w,h)+2*diam)/{spacing}))::BIGINT)) AS i) a,
            LATERAL (SELECT unnest(range(0,(ceil((greatest(w,h)+2*diam)/{spacing}))::BIGINT)) AS j) b),
    gw AS (SELECT *, CASE q WHEN 0 THEN cx0+dx WHEN 1 THEN cx0-dy ELSE cx0-dx END AS px, CASE q WHEN 0 THEN cy0+dy WHEN 1 THEN cy0+dx ELSE cy0-dy END AS py FROM gc),
    gr AS (SELECT *, px-s/2 AS x, py-s/2 AS y, s AS w, s AS h FROM gw WHERE px>-s AND py>-s AND px<sw+s AND py<sh+s),
    ga AS (SELECT gr.*, round({o.site_overlap('gr', 'st')},6) AS usable FROM gr JOIN sites st USING (site_id))
    """


@query(
    "e1_grid_candidates",
    _CENTRE + "," + _cells("60.0::DOUBLE", "(SELECT unnest([0,1]) AS q)")
    + "SELECT site_id, q AS quarter, i, j, round(px,4) AS cx, round(py,4) AS cy, round(usable,2) AS usable_sqm FROM ga WHERE usable>0",
)
def grid_candidates(fx: Fixtures) -> DataFrame:
    s = sites_with_ring(fx).select("site_id", "ring", F.explode(F.array(F.lit(0), F.lit(1))).alias("quarter"))
    c = ge.grid_candidates(
        s, 60.0, F.when(F.col("quarter") == 0, 1.0).otherwise(0.0), F.when(F.col("quarter") == 0, 0.0).otherwise(1.0)
    )
    return c.select(
        "site_id", "quarter", F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), r4(F.col("cx"), "cx"),
        r4(F.col("cy"), "cy"), F.round("usable_sqm", 2).alias("usable_sqm"),
    )


@query(
    "a11_sweep_grid",
    _CENTRE + "," + _cells("sp", "(SELECT unnest(range(50,160,20))::DOUBLE AS sp), (SELECT unnest([0,1,2]) AS q)") + """,
    sc AS (SELECT site_id, s, q, sum(CASE WHEN usable/(s*s)>0.65::DOUBLE THEN usable ELSE 0 END) AS good,
           count(CASE WHEN usable/(s*s)>0.1::DOUBLE AND usable/(s*s)<=0.65::DOUBLE THEN 1 END) AS frag FROM ga WHERE usable>0 GROUP BY 1,2,3)
    SELECT DISTINCT ON (site_id) site_id, s AS spacing, q AS quarter, round(good,2) AS good_sqm, frag AS fragments FROM sc
    ORDER BY site_id, round(good,2) DESC, frag, s, q""",
)
def sweep_grid(fx: Fixtures) -> DataFrame:
    from parcelgrid.operators.sweeps import sweep_grid as sweep

    # fixed values: cosine and sine of the three candidate turns
    turns = [(0, 1.0, 0.0), (1, 0.0, 1.0), (2, -1.0, 0.0)]
    best = sweep(sites_with_ring(fx).select("site_id", "ring"), [float(v) for v in range(50, 160, 20)], turns)
    return best.select("site_id", "spacing", "quarter", F.col("good_sqm"), "fragments")


_LINES = """
ax AS (SELECT site_id, w, h, w>=h AS wide, greatest(w,h) AS l, least(w,h) AS s FROM sites)
"""


@query(
    "e2_roads_grid_template",
    _LINES + """, a AS (SELECT *, floor(s/100)::BIGINT+1 AS n, floor(l/100)::BIGINT+1 AS m FROM ax),
    li AS (SELECT site_id, 0 AS axis, i, wide, w, h, l AS len, (i-(n-1)/2.0)*s/(n-1) AS off FROM a, LATERAL (SELECT unnest(range(n)) AS i) x
     UNION ALL SELECT site_id, 1, i, wide, w, h, s, (i-(m-1)/2.0)*l/(m-1) FROM a, LATERAL (SELECT unnest(range(m)) AS i) x)
    SELECT site_id, axis, i::INT AS road_no, round(len,4) AS length_m,
      round(CASE WHEN axis=0 AND wide THEN w/2 WHEN axis=0 THEN w/2-off WHEN wide THEN w/2+off ELSE w/2 END,4)::DOUBLE AS mx,
      round(CASE WHEN axis=0 AND wide THEN h/2+off WHEN axis=0 THEN h/2 WHEN wide THEN h/2 ELSE h/2+off END,4)::DOUBLE AS my FROM li""",
)
def roads_grid_template(fx: Fixtures) -> DataFrame:
    return _with_middle(te.roads_grid(rect_sites(fx).select("site_id", "ring")))


def _with_middle(roads: DataFrame) -> DataFrame:
    p = F.col("path")
    return roads.select(
        "site_id", "axis", "road_no", r4(F.col("length_m"), "length_m"), r4((p[0].x + p[1].x) / 2, "mx"),
        r4((p[0].y + p[1].y) / 2, "my"),
    )


def template_requests(fx: Fixtures) -> DataFrame:
    n = fx.sites.agg(F.count("*").alias("n_sites"))
    e = fx.edits.crossJoin(F.broadcast(n))
    a, k = F.col("action"), F.col("edit_no")
    return e.select(
        (F.col("design_id") % F.col("n_sites")).alias("site_id"),
        k.alias("seq"),
        F.when(a == "move", "rotate").when(a == "select", "set_cell_size").when(a == "delete", "set_road_width")
        .otherwise("other").alias("action"),
        F.when(a == "move", k % 4 * 90).when(a == "select", k % 600).otherwise(k % 15).cast("double").alias("value"),
    )


@query(
    "e2b_retune_template",
    _LINES + """, rq AS (SELECT design_id%(SELECT count(*) FROM sites) AS site_id, edit_no, CASE action WHEN 'move' THEN 'r' WHEN 'select' THEN 'c' WHEN 'delete' THEN 'w' END AS a,
      (CASE action WHEN 'move' THEN edit_no%4*90 WHEN 'select' THEN edit_no%600 ELSE edit_no%15 END)::DOUBLE AS v FROM edits),
    fp AS (SELECT site_id, coalesce(sum(v) FILTER (a='r'),0) AS rotation, coalesce(arg_max(v, edit_no) FILTER (a='c' AND v BETWEEN 30 AND 500),100) AS cell,
      coalesce(arg_max(v, edit_no) FILTER (a='w' AND v>=6),12) AS width, count(*) FILTER ((a='c' AND NOT v BETWEEN 30 AND 500) OR (a='w' AND v<6)) AS ref FROM rq GROUP BY 1),
    p AS (SELECT *, (rotation/90)::BIGINT%2=1 AS odd, floor(s/cell)::BIGINT+1 AS n, floor(l/cell)::BIGINT+1 AS m FROM fp JOIN ax USING (site_id)),
    li AS (SELECT site_id, CASE WHEN odd THEN s ELSE l END AS len, 0 AS off, s FROM p, LATERAL (SELECT unnest(range(n)) AS i) x
      UNION ALL SELECT site_id, CASE WHEN odd THEN least(1.5*s,l) ELSE s END, CASE WHEN odd THEN abs((i-(m-1)/2.0)*CASE WHEN m>1 THEN l/(m-1) ELSE l END) ELSE 0 END, s
        FROM p, LATERAL (SELECT unnest(range(m)) AS i) x)
    SELECT site_id, rotation, cell AS cell_m, width AS width_m, ref AS n_refused, count(*) AS n_roads, round(sum(len),4) AS total_m
      FROM p JOIN li USING (site_id) WHERE off<=li.s/2+1e-9 GROUP BY ALL""",
)
def retune_template(fx: Fixtures) -> DataFrame:
    par = te.fold_parameters(template_requests(fx))
    s = rect_sites(fx).select("site_id", "ring").join(par, "site_id")
    roads = te.roads_grid(s, F.col("cell_m"), F.col("rotation"))
    total = roads.groupBy("site_id").agg(F.count("*").alias("n_roads"), F.sum("length_m").alias("total_m"))
    return par.join(total, "site_id").select(
        "site_id", "rotation", "cell_m", "width_m", "n_refused", "n_roads", r4(F.col("total_m"), "total_m")
    )


@query(
    "e3_roads_spine_template",
    _LINES + """, li AS (SELECT site_id, 0 AS axis, 0 AS i, wide, w, h, l AS len, 0 AS off FROM ax
     UNION ALL SELECT site_id, 1, i+1, wide, w, h, s, 50+i*100-l/2 FROM ax, LATERAL (SELECT unnest(range(floor(l/100)::BIGINT)) AS i) x)
    SELECT site_id, axis, i::INT AS road_no, round(len,4) AS length_m, round(CASE WHEN axis=1 AND wide THEN w/2+off ELSE w/2 END,4) AS mx,
      round(CASE WHEN axis=1 AND NOT wide THEN h/2+off ELSE h/2 END,4) AS my FROM li""",
)
def roads_spine_template(fx: Fixtures) -> DataFrame:
    return _with_middle(te.roads_spine(rect_sites(fx).select("site_id", "ring")))


@query(
    "e4_roads_cross_template",
    _LINES + """SELECT site_id, a AS axis, a AS road_no, CASE a WHEN 0 THEN l ELSE s END AS length_m, w/2 AS mx, h/2 AS my FROM ax, (SELECT unnest([0,1]) AS a)""",
)
def roads_cross_template(fx: Fixtures) -> DataFrame:
    return _with_middle(te.roads_cross(rect_sites(fx).select("site_id", "ring")))


_LOOP = """
lo AS (SELECT layout_id*8+plot_no AS site_id, w, h, w>60 AND h>60 AND (w-60)*(h-60)>=100 AS fits,
       CASE WHEN w>=h THEN CASE WHEN w/4<h/2 OR w/4>=30 THEN 30 ELSE sqrt(900+pow(30-w/4,2)) END
            ELSE CASE WHEN h/4<=w/2 OR h/4>=30 THEN 30 ELSE sqrt(900+pow(30-h/4,2)) END END AS con FROM plots)
"""


@query(
    "e5_roads_loop_template",
    _LOOP + """SELECT site_id, 2 AS axis, CASE WHEN fits THEN 2*(w-60)+2*(h-60) ELSE 2*(w-30)+2*(h-30) END AS length_m FROM lo
      UNION ALL SELECT site_id, 3, round(con,4) FROM lo WHERE fits""",
)
def roads_loop_template(fx: Fixtures) -> DataFrame:
    r = te.roads_loop(keyed_plots(fx).select("site_id", "ring"))
    return r.select("site_id", "axis", r4(F.col("length_m"), "length_m"))


def templated_sites(fx: Fixtures) -> DataFrame:
    names = F.array(*[F.lit(n) for n in te.TEMPLATES])
    return rect_sites(fx).select(
        "site_id", "ring", F.element_at(names, (F.col("site_id") % 4 + 1).cast("int")).alias("template")
    )


@query(
    "e5_entry_points",
    _LINES + """, t AS (SELECT *, ['grid','spine','cross','loop'][site_id%4+1] AS template FROM ax)
    SELECT site_id, template, 0 AS road_no, e AS end_no, CASE WHEN wide=(e=0) THEN 0.0 ELSE w END AS px, CASE WHEN e=0 THEN 0.0 ELSE h END AS py FROM t, (SELECT unnest([0,1]) AS e) WHERE template='grid'
    UNION ALL SELECT site_id, template, 0, e, CASE WHEN wide THEN e*w ELSE w/2 END, CASE WHEN wide THEN h/2 ELSE e*h END FROM t, (SELECT unnest([0,1]) AS e) WHERE template IN ('spine','cross')
    UNION ALL SELECT site_id, template, 1, e, CASE WHEN wide THEN w/2 ELSE (1-e)*w END, CASE WHEN wide THEN e*h ELSE h/2 END FROM t, (SELECT unnest([0,1]) AS e) WHERE template='cross'
    UNION ALL SELECT site_id, template, 1, 0, CASE WHEN wide THEN 0 ELSE w/2 END, CASE WHEN wide THEN h/2 ELSE 0 END FROM t WHERE template='loop'""",
)
def entry_points(fx: Fixtures) -> DataFrame:
    s = templated_sites(fx)
    e = te.entry_points(s.select("site_id", "ring"), te.roads_by_template(s))
    return e.select("site_id", "template", "road_no", "end_no", r4(F.col("p.x"), "px"), r4(F.col("p.y"), "py"))


@query(
    "u3_template_dispatch",
    _LINES + """SELECT site_id, ['grid','spine','cross','loop'][site_id%4+1] AS template,
      CASE site_id%4 WHEN 0 THEN floor(s/100)::BIGINT+floor(l/100)::BIGINT+2 WHEN 1 THEN 1+floor(l/100)::BIGINT ELSE 2 END AS n_roads,
      round(CASE site_id%4 WHEN 0 THEN (floor(s/100)+1)*l+(floor(l/100)+1)*s WHEN 1 THEN l+floor(l/100)*s WHEN 2 THEN l+s ELSE 2*(w-60)+2*(h-60)+30 END,4) AS total_m FROM ax""",
)
def template_dispatch(fx: Fixtures) -> DataFrame:
    r = te.roads_by_template(templated_sites(fx))
    return r.groupBy("site_id", "template").agg(
        F.count("*").alias("n_roads"), r4(F.sum("length_m"), "total_m")
    )


@query(
    "u3_template_errors",
    """SELECT site_id, CASE site_id%5 WHEN 0 THEN 'star' WHEN 2 THEN 'grid' WHEN 3 THEN 'spine' WHEN 4 THEN 'cross' END AS template,
      CASE site_id%5 WHEN 0 THEN 'unknown template star' ELSE 'no template' END AS error FROM sites WHERE site_id%5<2""",
)
def template_errors(fx: Fixtures) -> DataFrame:
    names = F.array(F.lit("star"), F.lit(None).cast("string"), F.lit("grid"), F.lit("spine"), F.lit("cross"))
    return te.template_errors(fx.sites.withColumn("template", F.get(names, (F.col("site_id") % 5).cast("int"))))


@query(
    "e6_recommend_template",
    """SELECT layout_id, plot_no, CASE WHEN a>2.5 THEN 'spine' WHEN a<1.3 THEN 'cross' WHEN w*h*20>500000 THEN 'grid' ELSE 'loop' END AS template
       FROM (SELECT *, greatest(w,h)/least(w,h) AS a FROM plots)""",
)
def recommend_template(fx: Fixtures) -> DataFrame:
    aspect = F.greatest("w", "h") / F.least("w", "h")
    return fx.plots.select(
        "layout_id", "plot_no", te.recommend_template(F.col("w") * F.col("h") * 20, aspect).alias("template")
    )


_GRIDNET = """
cs AS (SELECT *, w+h-cut-50*sqrt(2.0) AS dd FROM sites WHERE NOT concave),
pl AS (SELECT site_id, 'h' AS axis, 150+200*k AS pos, least(w-50,dd-(150+200*k))-50 AS len, 150+200*k AS ym, (50+least(w-50,dd-(150+200*k)))/2 AS xm
        FROM cs, (SELECT unnest(range(5)) AS k) WHERE 150+200*k<h-50
       UNION ALL SELECT site_id, 'v', 150+200*k, least(h-50,dd-(150+200*k))-50, (50+least(h-50,dd-(150+200*k)))/2, 150+200*k FROM cs, (SELECT unnest(range(5)) AS k) WHERE 150+200*k<w-50),
sl AS (SELECT site_id, 'h' AS axis, 150+100*k AS pos, least(w-50,dd-(150+100*k))-50 AS len FROM cs, (SELECT unnest(range(9)) AS k)
        WHERE 150+100*k<h-50 AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.site_id=cs.site_id AND abs(150+100*k-ym)<50)
       UNION ALL SELECT site_id, 'v', 150+100*k, least(h-50,dd-(150+100*k))-50 FROM cs, (SELECT unnest(range(9)) AS k)
        WHERE 150+100*k<w-50 AND NOT EXISTS (SELECT 1 FROM pl WHERE pl.site_id=cs.site_id AND abs(150+100*k-xm)<50))
"""


@query(
    "e7_grid_network",
    _GRIDNET + """SELECT site_id, 'primary' AS road_class, axis, pos::DOUBLE AS at, round(len,4) AS length_m, round(len*24,4) AS area_sqm FROM pl
      UNION ALL SELECT site_id, 'secondary', axis, pos, round(len,4), round(len*16,4) FROM sl""",
)
def grid_network(fx: Fixtures) -> DataFrame:
    n = ge.grid_network(convex_sites(fx).select("site_id", "ring"))
    return n.select(
        "site_id", "road_class", "axis", "at", r4(F.col("length_m"), "length_m"),
        r4(F.col("length_m") * F.col("width_m"), "area_sqm"),
    )


@query(
    "e8_spine_network",
    """cs AS (SELECT *, w+h-cut-50*sqrt(2.0) AS dd, w>=h AS wide FROM sites WHERE NOT concave)
    SELECT site_id, 'primary' AS road_class, CASE WHEN wide THEN 'h' ELSE 'v' END AS axis, CASE WHEN wide THEN h/2 ELSE w/2 END AS at, greatest(w,h)-100 AS length_m FROM cs
    UNION ALL SELECT site_id, 'secondary', CASE WHEN wide THEN 'v' ELSE 'h' END, 125+150*k, round(CASE WHEN wide THEN least(h-50,dd-(125+150*k))-50 ELSE least(w-50,dd-(125+150*k))-50 END,4)
      FROM cs, (SELECT unnest(range(6)) AS k) WHERE 125+150*k<greatest(w,h)-50""",
)
def spine_network(fx: Fixtures) -> DataFrame:
    n = ge.spine_network(convex_sites(fx).select("site_id", "ring"), max_distance=100.0)
    return n.select("site_id", "road_class", "axis", "at", r4(F.col("length_m"), "length_m"))


@query(
    "e9_branches_along",
    """cs AS (SELECT *, w>=h AS wide, greatest(w,h) AS l, least(5, floor(greatest(w,h)/100))::BIGINT AS k FROM sites WHERE NOT concave)
    SELECT site_id, 0 AS road_no, l AS length_m FROM cs UNION ALL
    SELECT site_id, i::INT, round(CASE WHEN wide THEN least(h, w+h-cut-w*i/(k+1)) ELSE least(w, w+h-cut-h*i/(k+1)) END,4) FROM cs, LATERAL (SELECT unnest(range(1,k+1)) AS i) x""",
)
def branches_along(fx: Fixtures) -> DataFrame:
    b = ge.branches_along(convex_sites(fx).select("site_id", "ring"))
    return b.select("site_id", "road_no", r4(F.col("length_m"), "length_m"))


_QUADS = """
qb AS (SELECT site_id, sx||sy AS side, CASE sy WHEN 'a' THEN 0 ELSE w/4+HX END AS x, CASE sx WHEN 'a' THEN h/4+HY ELSE 0 END AS y,
       CASE sy WHEN 'a' THEN w/4-HX ELSE w*3/4-HX END AS w, CASE sx WHEN 'a' THEN h*3/4-HY ELSE h/4-HY END AS h
       FROM sites, (SELECT unnest(['a','b']) AS sx), (SELECT unnest(['a','b']) AS sy) WHERE_)
"""


def street_plan(fx: Fixtures) -> DataFrame:
    """The roads of a site, a dead end off the secondary one, and a diagonal that ends on the primary one."""
    s, lit = fx.sites, F.lit
    more = [
        (3, F.col("w") / 4, 3 * F.col("h") / 4, F.col("w") / 8, 3 * F.col("h") / 4),
        (4, F.col("w") / 2 - 30, lit(-30.0), F.col("w") / 2 + F.col("h") / 4, F.col("h") / 4),
    ]
    columns = fx.roads.columns
    roads = fx.roads
    for no, x1, y1, x2, y2 in more:
        roads = roads.unionByName(s.select(
            "site_id", lit(no).cast("long").alias("road_no"), lit("internal").alias("road_class"), x1.alias("x1"), y1.alias("y1"),
            x2.alias("x2"), y2.alias("y2"), lit(10.0).alias("width_m"),
        ).select(*columns))
    return roads


@query(
    "e10_extract_blocks",
    _QUADS.replace("HX", "8").replace("HY", "12").replace("WHERE_", "")
    + f""", q AS (SELECT b.site_id, side, {o.site_overlap('b', 's')} AS a, s.w AS sw, s.h AS sh FROM qb b JOIN sites s USING (site_id)),
    bl AS (SELECT site_id, 1 AS block_no, a FROM q WHERE side='ba' UNION ALL SELECT site_id, 2, a-(sw/8-8)*10 FROM q WHERE side='aa'
      UNION ALL SELECT site_id, 3, (sw/4-8-sqrt(50.0))*(sh/4-12)+pow(sh/4-12,2)/2 FROM q WHERE side='bb'
      UNION ALL SELECT site_id, 4, a FROM q WHERE side='ab'
      UNION ALL SELECT site_id, 5, (sw/2-sqrt(50.0))*(sh/4-12)-pow(sh/4-12,2)/2 FROM q WHERE side='bb')
    SELECT site_id, block_no::BIGINT AS block_no, 0 AS n_holes, round(a::DOUBLE,4) AS area_sqm FROM bl""",
)
def extract_blocks(fx: Fixtures) -> DataFrame:
    b = ar.extract_blocks(sites_with_ring(fx), street_plan(fx))
    return b.select("site_id", "block_no", F.size("holes").alias("n_holes"), r4(F.col("area_sqm"), "area_sqm"))


@query(
    "e11_lot_widths",
    """SELECT layout_id, plot_no, (CASE WHEN l<20 THEN 0 WHEN ok THEN n ELSE greatest(1,floor(l/40)) END)::INT AS n_lots,
       round(CASE WHEN l<20 THEN 0 WHEN ok THEN l/n ELSE l/greatest(1,floor(l/40)) END,4) AS width_m FROM
       (SELECT *, n>=1 AND l/greatest(n,1) BETWEEN 20 AND 80 AS ok FROM (SELECT *, least(ceil(l/40),floor(l/20)) AS n FROM (SELECT *, (w+h)/6 AS l FROM plots)))""",
)
def lot_widths(fx: Fixtures) -> DataFrame:
    p = fx.plots.withColumn("ws", ge.lot_widths((F.col("w") + F.col("h")) / 6, 20.0, 80.0, 40.0))
    return p.select(
        "layout_id", "plot_no", F.size("ws").alias("n_lots"), r4(F.coalesce(F.try_element_at("ws", F.lit(1)), F.lit(0.0)), "width_m")
    )


@query(
    "e12_uniform_widths",
    """SELECT layout_id, plot_no, (CASE WHEN l<20 THEN 0 ELSE c END)::INT AS n_lots, round(CASE WHEN l<20 THEN 0 ELSE l/c END,4) AS width_m FROM
       (SELECT *, greatest(1,CASE WHEN l/n<20 THEN floor(l/20) WHEN l/n>50 THEN floor(l/50)+1 ELSE n END) AS c FROM
        (SELECT *, greatest(1,round_even(l/40,0)) AS n FROM (SELECT *, (w+h)/4 AS l FROM plots)))""",
)
def uniform_widths(fx: Fixtures) -> DataFrame:
    p = fx.plots.withColumn("ws", ge.uniform_widths((F.col("w") + F.col("h")) / 4, 20.0, 50.0, 40.0))
    return p.select(
        "layout_id", "plot_no", F.size("ws").alias("n_lots"), r4(F.coalesce(F.try_element_at("ws", F.lit(1)), F.lit(0.0)), "width_m")
    )


_SLICES = """
sl AS (SELECT *, greatest(w,h) AS l, least(w,h) AS s, greatest(1,least(ceil(greatest(w,h)/60),floor(greatest(w,h)/30)))::BIGINT AS n FROM plots)
"""


@query(
    "e13_orthogonal_slice",
    _SLICES + """SELECT layout_id, plot_no, i::INT AS lot_no, round(w*h/n,4) AS lot_sqm, round(0.8::DOUBLE*lx-0.6::DOUBLE*ly,3) AS cx, round(0.6::DOUBLE*lx+0.8::DOUBLE*ly,3) AS cy FROM
      (SELECT *, CASE WHEN w>=h THEN x+(i+0.5)*w/n ELSE x+w/2 END AS lx, CASE WHEN w>=h THEN y+h/2 ELSE y+(i+0.5)*h/n END AS ly FROM sl, LATERAL (SELECT unnest(range(n)) AS i) z)""",
)
def orthogonal_slice(fx: Fixtures) -> DataFrame:
    p = turned_plots(fx).withColumn("widths", ge.lot_widths(F.greatest("w", "h"), 30.0, 120.0, 60.0))
    lots = ge.orthogonal_slice(p.select("layout_id", "plot_no", "ring", "widths")).withColumn("_c", g.centroid(F.col("lot_ring")))
    return lots.select(
        "layout_id", "plot_no", "lot_no", r4(F.col("lot_sqm"), "lot_sqm"), (F.round("_c.x", 3) + 0.0).alias("cx"),
        (F.round("_c.y", 3) + 0.0).alias("cy"),
    )


@query(
    "e14_obb_grid_lots",
    """SELECT layout_id, plot_no, count(*) AS n_lots, round(min(w*h/(c*r)),4) AS lot_sqm, round(sum(w*h/(c*r)),4) AS total_sqm FROM
      (SELECT *, greatest(1,floor(least(w,h)/40))::BIGINT AS c, greatest(1,floor(greatest(w,h)/60))::BIGINT AS r FROM plots), LATERAL (SELECT unnest(range(c*r)) AS i) z
      WHERE w*h/(c*r)>=500 GROUP BY 1,2""",
)
def obb_grid_lots(fx: Fixtures) -> DataFrame:
    lots = ge.obb_grid_lots(turned_plots(fx).select("layout_id", "plot_no", "ring"), 40.0, 60.0, 500.0)
    return lots.groupBy("layout_id", "plot_no").agg(
        F.count("*").alias("n_lots"), r4(F.min("lot_sqm"), "lot_sqm"), r4(F.sum("lot_sqm"), "total_sqm")
    )


@query(
    "e14_obb_grid_lots_by_size",
    """SELECT layout_id, plot_no, count(*) AS n_lots, count(CASE WHEN a>=1500 THEN 1 END) AS n_good, count(CASE WHEN a<1500 THEN 1 END) AS n_green FROM
      (SELECT layout_id, plot_no, w*h/(c*r) AS a, unnest(range(c*r)) AS i FROM
       (SELECT *, greatest(1,floor(least(w,h)/sqrt(3000*0.67)))::BIGINT AS c, greatest(1,floor(greatest(w,h)/(3000/sqrt(3000*0.67))))::BIGINT AS r FROM plots)) WHERE a>=900 GROUP BY 1,2""",
)
def obb_grid_lots_by_size(fx: Fixtures) -> DataFrame:
    size = 3000.0
    w = (size * 0.67) ** 0.5
    lots = ge.obb_grid_lots(turned_plots(fx).select("layout_id", "plot_no", "ring"), w, size / w, size * 0.3)
    return lots.groupBy("layout_id", "plot_no").agg(
        F.count("*").alias("n_lots"), F.count_if(F.round("lot_sqm", 6) >= 1500).alias("n_good"),
        F.count_if(F.round("lot_sqm", 6) < 1500).alias("n_green"),
    )


_SUB = _SLICES + """,
lt AS (SELECT layout_id, plot_no, lot_no, CASE WHEN w*h/14400<0.6 THEN 'park' WHEN greatest(l/n,s)/least(l/n,s)<=4 THEN 'lot' ELSE 'green' END AS kind,
  CASE WHEN w*h/14400<0.6 THEN w*h ELSE w*h/n END AS area, CASE WHEN w*h/14400<0.6 THEN 0 ELSE s END AS width,
  CASE WHEN w*h/14400<0.6 THEN 0 ELSE greatest(0,l/n-12)*greatest(0,s-12) END AS buildable
  FROM (SELECT *, unnest(range(CASE WHEN w*h/14400<0.6 THEN 1 ELSE n END)) AS lot_no FROM sl) WHERE w*h/14400<0.6 OR w*h/n>=1500)
"""


def subdivided(fx: Fixtures) -> DataFrame:
    b = turned_plots(fx).select("layout_id", "plot_no", "ring")
    return ge.subdivide_blocks(b, 120.0, 30.0, 120.0, 60.0, min_area=1500.0)


@query(
    "e15_subdivide_blocks",
    _SUB + "SELECT layout_id, plot_no, lot_no::INT AS lot_no, kind, round(area,4) AS area_sqm, round(width,4) AS width_m, round(buildable,4) AS buildable_sqm FROM lt",
)
def subdivide_blocks(fx: Fixtures) -> DataFrame:
    return subdivided(fx).select(
        "layout_id", "plot_no", "lot_no", "kind", r4(F.col("area_sqm"), "area_sqm"), r4(F.col("width_m"), "width_m"),
        r4(F.col("buildable_sqm"), "buildable_sqm"),
    )


@query(
    "a6_redistribution_stats",
    _SUB + """SELECT layout_id AS site_id, (SELECT 0)::BIGINT+count(DISTINCT CASE WHEN kind='park' THEN plot_no END) AS total_blocks, count(CASE WHEN kind='lot' THEN 1 END) AS total_lots,
      count(CASE WHEN kind='park' THEN 1 END) AS total_parks, count(CASE WHEN kind='green' THEN 1 END) AS total_greens, 0::BIGINT AS service_count,
      round(coalesce(avg(CASE WHEN kind='lot' THEN width END),0),4) AS avg_lot_width, (CASE WHEN count(CASE WHEN kind='lot' THEN 1 END)>0 THEN 1 ELSE 0 END)::DOUBLE AS mean_rectangularity,
      (CASE WHEN count(CASE WHEN kind='lot' THEN 1 END)>0 THEN 1 ELSE 0 END)::DOUBLE AS share_rectangular FROM lt GROUP BY 1""",
)
def redistribution_stats(fx: Fixtures) -> DataFrame:
    s = m.redistribution_stats(subdivided(fx).withColumnRenamed("layout_id", "site_id"))
    for c in ("avg_lot_width", "mean_rectangularity", "share_rectangular"):
        s = s.withColumn(c, F.round(c, 4))
    return s


@query(
    "e16_grid_plots",
    """cs AS (SELECT *, w+h-cut-10*sqrt(2.0) AS dd FROM sites WHERE NOT concave),
    c0 AS (SELECT site_id, r, c, 10+60*c AS x, 10+80*r AS y, w/4-13 AS va, w/4+13 AS vb, h/4-17 AS ha, h/4+17 AS hb, dd FROM cs,
       LATERAL (SELECT unnest(range(floor((w-20)/60)::BIGINT)) AS c) a, LATERAL (SELECT unnest(range(floor((h-20)/80)::BIGINT)) AS r) b),
    c1 AS (SELECT *, CASE WHEN va<=x AND vb>x THEN vb ELSE x END AS x1, CASE WHEN vb>=x+60 AND va<x+60 THEN va ELSE x+60 END AS x2,
       CASE WHEN ha<=y AND hb>y THEN hb ELSE y END AS y1, CASE WHEN hb>=y+80 AND ha<y+80 THEN ha ELSE y+80 END AS y2 FROM c0
       WHERE NOT (va>x AND vb<x+60) AND NOT (ha>y AND hb<y+80)),
    c2 AS (SELECT *, greatest(0,x2-x1) AS dx, greatest(0,y2-y1) AS dy, x2+y2-dd AS e FROM c1),
    c3 AS (SELECT *, round(dx*dy-(pow(greatest(0,e),2)-pow(greatest(0,e-dx),2)-pow(greatest(0,e-dy),2)+pow(greatest(0,e-dx-dy),2))/2,4) AS a FROM c2)
    SELECT site_id, r::INT AS row, c::INT AS col, a AS area_sqm FROM c3 WHERE a>=2000""",
)
def grid_plots(fx: Fixtures) -> DataFrame:
    p = ge.grid_plots(convex_sites(fx).select("site_id", "ring"), fx.roads, 60.0, 80.0, 2000.0, 10.0, 5.0)
    return p.select("site_id", "row", "col", r4(F.col("area_sqm"), "area_sqm"))


@query(
    "e17_partition_site",
    """cs AS (SELECT *, w+h-cut-20*sqrt(2.0) AS dd, (w-40)*(h-40)-pow(cut-40+20*sqrt(2.0),2)/2 AS a, w-52 AS uw, h-52 AS uh FROM sites WHERE NOT concave),
    n1 AS (SELECT *, greatest(2,least(floor(a/10400),20)) AS n FROM cs), n2 AS (SELECT *, greatest(1,floor(sqrt(n*uw/uh))) AS c0 FROM n1),
    n3 AS (SELECT *, greatest(1,ceil(n/c0)) AS r FROM n2), n4 AS (SELECT *, greatest(c0,ceil(n/r))::BIGINT AS c FROM n3),
    n5 AS (SELECT *, (uw-(c-1)*12)/c AS pw, (uh-(r-1)*12)/r AS ph FROM n4),
    ce AS (SELECT *, 20+(k%c)*(pw+12) AS x, 20+(k//c)*(ph+12) AS y FROM n5, LATERAL (SELECT unnest(range((r*c)::BIGINT)) AS k) z),
    ok AS (SELECT *, x+pw+y+ph-dd AS e FROM ce),
    ok2 AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY k) AS rn FROM ok
       WHERE e<=1e-9 OR pw*ph-(pow(greatest(0,e),2)-pow(greatest(0,e-pw),2)-pow(greatest(0,e-ph),2)+pow(greatest(0,e-pw-ph),2))/2 > 0.9*pw*ph)
    SELECT site_id, 'P'||rn AS plot_id, round(x,4) AS x, round(y,4) AS y, round(pw,4) AS w, round(ph,4) AS h FROM ok2 WHERE rn<=n""",
)
def partition_site(fx: Fixtures) -> DataFrame:
    p = ge.partition_site(convex_sites(fx).select("site_id", "ring"), 8000.0, 12.0, 20.0, 2, 20)
    return p.filter("status = 'success'").select("site_id", "plot_id", *[r4(F.col(c), c) for c in "xywh"])


def _packed(name: str) -> str:
    w, h, gap, k = ge.PACKINGS[name]
    return f"""(SELECT site_id, '{name}' AS strategy, (rn-1)::INT AS plot_no, x, y FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY j, i) AS rn FROM
      (SELECT p.* FROM (SELECT site_id, i, j, {gap}+i*{w + gap} AS x, {gap}+j*{h + gap} AS y, {w} AS w, {h} AS h, w AS sw, h AS sh FROM sites,
         (SELECT unnest(range(20)) AS i), (SELECT unnest(range(20)) AS j)) p JOIN sites s USING (site_id)
       WHERE x+{w}<sw AND y+{h}<sh AND {o.site_contains('p', 's')})) WHERE rn<={k})"""


@query(
    "e18_pack_layout",
    "SELECT site_id, strategy, plot_no, x::DOUBLE AS x, y::DOUBLE AS y FROM " + _packed("balanced") + " UNION ALL SELECT site_id, strategy, plot_no, x::DOUBLE, y::DOUBLE FROM " + _packed("premium"),
)
def pack_layout(fx: Fixtures) -> DataFrame:
    s = sites_with_ring(fx).select("site_id", "ring")
    both = ge.pack_layout(s, "balanced").unionByName(ge.pack_layout(s, "premium"))
    return both.select("site_id", "strategy", "plot_no", "x", "y")


@query("e19_sample_layouts")
def sample_layouts(fx: Fixtures) -> DataFrame:
    return ge.sample_layouts(sites_with_ring(fx).select("site_id", "ring"), 10, 12)


@query("e19_mutate_layouts")
def mutate_layouts(fx: Fixtures) -> DataFrame:
    s = sites_with_ring(fx).select("site_id", "ring")
    return ge.mutate_layouts(ge.sample_layouts(s, 10, 12), s)


@query(
    "e21_classify_road",
    """SELECT r.site_id, road_no, CASE WHEN (CASE road_no WHEN 1 THEN s.h/4 ELSE s.w/4 END)<100 OR (CASE road_no WHEN 1 THEN s.w ELSE s.h END)>400 THEN 'main' ELSE 'internal' END AS kind
       FROM roads r JOIN sites s USING (site_id)""",
)
def classify_road(fx: Fixtures) -> DataFrame:
    s = fx.sites.select("site_id", (F.col("w") / 2).alias("mx"), (F.col("h") / 2).alias("my"))
    j = fx.roads.join(s, "site_id")
    seg = F.struct(g.pt(F.col("x1"), F.col("y1")).alias("p"), g.pt(F.col("x2"), F.col("y2")).alias("q"))
    d = g.point_segment_distance(g.pt(F.col("mx"), F.col("my")), seg)
    return j.select("site_id", "road_no", ge.classify_road(d, g.seg_len(seg)).alias("kind"))


@query(
    "e22_boundary_candidates",
    """SELECT site_id, k::INT AS point_no, round(CASE WHEN d<=w THEN d WHEN d<=w+h THEN w WHEN d<=2*w+h THEN w-(d-w-h) ELSE 0 END,4) AS px,
       round(CASE WHEN d<=w THEN 0 WHEN d<=w+h THEN d-w WHEN d<=2*w+h THEN h ELSE h-(d-2*w-h) END,4) AS py FROM (SELECT *, k*2*(w+h)/20 AS d FROM sites, (SELECT unnest(range(20)) AS k))""",
)
def boundary_candidates(fx: Fixtures) -> DataFrame:
    b = ge.boundary_candidates(rect_sites(fx).select("site_id", "ring"))
    return b.select("site_id", "point_no", r4(F.col("px"), "px"), r4(F.col("py"), "py"))


@query(
    "e23_tile_grid",
    f"""ti AS (SELECT *, least(50,greatest(5,sqrt({o.SITE_AREA}/200))) AS t FROM sites),
    tg AS (SELECT site_id, r, c, c*t AS x, r*t AS y, t AS w, t AS h FROM ti, LATERAL (SELECT unnest(range(floor(ti.w/t)::BIGINT)) AS c) a, LATERAL (SELECT unnest(range(floor(ti.h/t)::BIGINT)) AS r) b)
    SELECT p.site_id, r::INT AS row, c::INT AS col, round(p.x,4) AS x, round(p.y,4) AS y, round({o.site_overlap('p', 's')},6)<=0 AS is_empty FROM tg p JOIN sites s USING (site_id)""",
)
def tile_grid(fx: Fixtures) -> DataFrame:
    t = ge.tile_grid(sites_with_ring(fx).select("site_id", "ring"))
    return t.select("site_id", "row", "col", r4(F.col("x"), "x"), r4(F.col("y"), "y"), "is_empty")


@query(
    "e24_sidewalks_and_green_rings",
    """SELECT site_id AS owner_id, road_no AS part_no, 'sidewalk' AS kind, (x2-x1+y2-y1)*2*2.0::DOUBLE AS area_sqm FROM roads
       UNION ALL SELECT layout_id, plot_no, 'green_ring', CASE WHEN w>50 AND h>50 THEN w*h-(w-50)*(h-50) ELSE 0 END FROM plots""",
)
def sidewalks_and_green_rings(fx: Fixtures) -> DataFrame:
    path = g.ring_of((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    outer = F.aggregate(g.road_strips(path, 2 * (6.0 + 2.0)), F.lit(0.0), lambda a, r: a + g.signed_area(r))
    inner = F.aggregate(g.road_strips(path, 2 * 6.0), F.lit(0.0), lambda a, r: a + g.signed_area(r))
    walks = fx.roads.select(
        F.col("site_id").alias("owner_id"), F.col("road_no").alias("part_no"), F.lit("sidewalk").alias("kind"),
        r4(outer - inner, "area_sqm"),
    )
    p = plots_with_ring(fx).withColumn("_in", F.round(g.area(g.inset(F.col("ring"), 25.0)), 6))
    rings = p.select(
        F.col("layout_id").alias("owner_id"), F.col("plot_no").alias("part_no"), F.lit("green_ring").alias("kind"),
        r4(F.when(F.col("_in") > 0, g.area(F.col("ring")) - F.col("_in")).otherwise(0.0), "area_sqm"),
    )
    return walks.unionByName(rings)


def subdivided_sites(fx: Fixtures) -> DataFrame:
    """Blocks between the roads, lots on their oriented boxes, then the rule table decides lot or green."""
    blocks = ar.extract_blocks(rect_sites(fx), fx.roads.withColumn("width_m", F.lit(12.0)), min_area=0.0)
    blocks = blocks.withColumnRenamed("block_no", "side")
    small = blocks.filter((F.col("area_sqm") < 750) & (F.col("area_sqm") > 50)).select(
        "site_id", "side", F.lit("green").alias("action"), "area_sqm"
    )
    lots = ge.obb_grid_lots(
        blocks.filter("area_sqm >= 750").select("site_id", "side", "ring"), 40.0, 60.0, 750.0
    ).withColumn("_b", g.obb(F.col("lot_ring")))
    lots = lots.withColumn("_q", g.shape_quality(F.col("lot_sqm"), F.col("_b.width"), F.col("_b.length"), 0.6, 1.9, 1500.0))
    shapes = lots.select(
        "site_id", "side", F.col("lot_sqm").alias("area_sqm"), F.col("_q.is_valid").alias("is_valid"),
        F.lit(1500.0).alias("min_area"),
    )
    ruled = ru.apply_rules(shapes, ru.DEFAULT_RULES).filter("action <> 'drop'")
    return small.unionByName(ruled.select("site_id", "side", "action", "area_sqm"))


_SUBSITE = _QUADS.replace("HX", "6").replace("HY", "6").replace("WHERE_", "") + """,
ql AS (SELECT *, greatest(1,floor(least(w,h)/40)) AS c, greatest(1,floor(greatest(w,h)/60)) AS r FROM qb),
qs AS (SELECT *, least(w,h)/c AS a, greatest(w,h)/r AS b, w*h/(c*r) AS la FROM ql),
qk AS (SELECT *, CASE WHEN greatest(a,b)/least(a,b)<=1.9+1e-9 AND la>=1500 THEN 'inset_front' ELSE 'green' END AS action FROM qs)
"""


@query(
    "e25_subdivide_site",
    _SUBSITE + "SELECT site_id, action, sum(c*r)::BIGINT AS n, round(sum(w*h),4) AS total_sqm FROM qk GROUP BY 1,2",
)
def subdivide_site(fx: Fixtures) -> DataFrame:
    return subdivided_sites(fx).groupBy("site_id", "action").agg(
        F.count("*").alias("n"), r4(F.sum("area_sqm"), "total_sqm")
    )


@query(
    "e25_lots_on_outlines",
    _QUADS.replace("HX", "6").replace("HY", "6").replace("WHERE_", "") + f""",
    ql AS (SELECT *, w<h AS tall, greatest(1,floor(least(w,h)/40))::BIGINT AS c, greatest(1,floor(greatest(w,h)/60))::BIGINT AS r FROM qb),
    lc AS (SELECT site_id, CASE WHEN tall THEN c ELSE r END AS nx, CASE WHEN tall THEN r ELSE c END AS ny, x, y, w, h FROM ql),
    cells AS (SELECT site_id, x+i*w/nx AS x, y+j*h/ny AS y, w/nx AS w, h/ny AS h FROM lc, LATERAL (SELECT unnest(range(nx)) AS i) a, LATERAL (SELECT unnest(range(ny)) AS j) b),
    lots AS (SELECT b.site_id, {o.site_overlap('b', 's')} AS a FROM cells b JOIN sites s USING (site_id))
    SELECT site_id, count(*)::BIGINT AS n_lots, round(sum(a)::DOUBLE,3) AS total_sqm, round(min(a)::DOUBLE,3) AS least_sqm FROM lots WHERE a>1e-6 GROUP BY 1""",
)
def lots_on_outlines(fx: Fixtures) -> DataFrame:
    """Lots of every block of the real outlines, corners cut off and notches included."""
    blocks = ar.extract_blocks(sites_with_ring(fx), fx.roads.withColumn("width_m", F.lit(12.0)), min_area=0.0)
    lots = ge.obb_grid_lots(blocks.select("site_id", "block_no", "ring"), 40.0, 60.0, 1e-6)
    return lots.groupBy("site_id").agg(
        F.count("*").alias("n_lots"), F.round(F.sum("lot_sqm"), 3).alias("total_sqm"), F.round(F.min("lot_sqm"), 3).alias("least_sqm")
    )


@query(
    "u2_rule_table",
    """SELECT layout_id, plot_no, CASE WHEN w*h>30000 THEN 'split' WHEN v THEN 'inset_front' WHEN w*h>=0.3*3000 THEN 'green' ELSE 'drop' END AS action
       FROM (SELECT *, w*h>=3000 AND greatest(w,h)/least(w,h)<=4 AS v FROM plots)""",
)
def rule_table(fx: Fixtures) -> DataFrame:
    p = fx.plots.withColumn("area_sqm", F.col("w") * F.col("h")).withColumn("min_area", F.lit(3000.0))
    q = g.shape_quality(F.col("area_sqm"), F.least("w", "h"), F.greatest("w", "h"), 0.75, 4.0, 3000.0)
    rules = ru.add_rule(
        ru.DEFAULT_RULES, {"name": "large", "condition": "area_sqm > 30000", "action": "split", "priority": 20}
    )
    return ru.apply_rules(p.withColumn("is_valid", q.is_valid), rules).select("layout_id", "plot_no", "action")


@query(
    "e26_lot_envelope",
    "SELECT layout_id, plot_no, (w-6)*(h-6) AS buildable_sqm, w*h-(w-6)*(h-6) AS setback_sqm FROM plots",
)
def lot_envelope(fx: Fixtures) -> DataFrame:
    e = ge.lot_envelope(plots_with_ring(fx), 3.0)
    return e.select("layout_id", "plot_no", r4(F.col("buildable_sqm"), "buildable_sqm"), r4(F.col("setback_sqm"), "setback_sqm"))
