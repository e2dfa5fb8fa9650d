"""Views of planning tables over the given parquet tables.

The SQL is plain enough for Spark and DuckDB alike, so the same text feeds the queries and their oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelgrid.functions import geometry as g

VIEWS: dict[str, str] = {
    "sites": """
        SELECT CAST(s_suppkey AS BIGINT) AS site_id,
               CAST(400+(s_suppkey*37%10)*20 AS DOUBLE) AS w,
               CAST(360+(s_suppkey*53%8)*20 AS DOUBLE) AS h,
               CAST(40+(s_suppkey*11%6)*10 AS DOUBLE) AS cut,
               s_suppkey%5=4 AS concave
        FROM {supplier}""",
    "layouts": """
        SELECT CAST(o_orderkey AS BIGINT) AS layout_id,
               CAST(o_custkey%(SELECT count(*) FROM {supplier}) AS BIGINT) AS site_id
        FROM {orders}""",
    "plots": """
        SELECT CAST(l_orderkey AS BIGINT) AS layout_id,
               CAST(l_linenumber AS BIGINT) AS plot_no,
               CAST((min(l_partkey)*7+l_linenumber*131)%320 AS DOUBLE) AS x,
               CAST((min(l_suppkey)*31+l_linenumber*97)%280 AS DOUBLE) AS y,
               CAST(40+(min(l_partkey)%9)*20 AS DOUBLE) AS w,
               CAST(40+(CAST(min(l_quantity) AS BIGINT)%9)*20 AS DOUBLE) AS h,
               CASE WHEN l_linenumber=7 THEN 'utility' WHEN min(l_returnflag)='A' THEN 'industrial'
                    ELSE 'green_space' END AS type
        FROM {lineitem} GROUP BY l_orderkey,l_linenumber""",
    "roads": """
        SELECT site_id, CAST(1 AS BIGINT) AS road_no, 'primary' AS road_class, CAST(0 AS DOUBLE) AS x1, h/4 AS y1,
               w AS x2, h/4 AS y2, CAST(24 AS DOUBLE) AS width_m FROM {sites}
        UNION ALL
        SELECT site_id, CAST(2 AS BIGINT), 'secondary', w/4, CAST(0 AS DOUBLE), w/4, h, CAST(16 AS DOUBLE)
        FROM {sites}""",
    "site_constraints": """
        SELECT CAST(n_nationkey AS BIGINT) AS constraint_id,
               CAST(n_nationkey%(SELECT count(*) FROM {supplier}) AS BIGINT) AS site_id,
               CAST(100+(n_nationkey*70)%200 AS DOUBLE) AS x, CAST(80+(n_nationkey*50)%150 AS DOUBLE) AS y,
               CAST(40 AS DOUBLE) AS w, CAST(40 AS DOUBLE) AS h, CAST(10*(n_nationkey%4) AS DOUBLE) AS buffer_m,
               n_nationkey%3<>0 AS is_hard
        FROM {nation}""",
    "assets": """
        SELECT CAST(p_partkey AS BIGINT) AS asset_id,
               CAST(p_partkey%(SELECT count(*) FROM {supplier}) AS BIGINT) AS site_id,
               CAST((p_partkey*13)%420 AS DOUBLE) AS x, CAST((p_partkey*17)%380 AS DOUBLE) AS y,
               CAST(10+p_size AS DOUBLE) AS w, CAST(10+(p_size*3)%40 AS DOUBLE) AS h,
               CAST(p_size%7 AS BIGINT) AS kind_no, p_partkey%3=0 AS is_existing
        FROM {part}""",
    "edits": """
        SELECT CAST(user_id AS BIGINT) AS design_id, CAST(event_id AS BIGINT) AS edit_no, ts,
               CASE event_type WHEN 'click' THEN 'move' WHEN 'view' THEN 'select' WHEN 'signup' THEN 'add_road'
                               WHEN 'purchase' THEN 'convert_to_green' ELSE 'delete' END AS action,
               concat('L', CAST(1+event_id%20 AS VARCHAR(9))) AS target,
               CAST(CAST(floor(value) AS BIGINT)%30 AS DOUBLE) AS dx, CAST(event_id%30 AS DOUBLE) AS dy
        FROM {events}""",
    "messages": """
        SELECT CAST(conv_id AS BIGINT) AS session_id, CAST(turn AS BIGINT) AS seq, role, text,
               TIMESTAMP '2024-01-01 00:00:00' + conv_id * INTERVAL '1' HOUR + turn * INTERVAL '1' MINUTE AS created_at
        FROM {conversations}""",
}

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


class Fixtures:
    """Lazy access to tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in VIEWS and name not in TABLES):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                text = VIEWS[name]
                needed = [t for t in [*TABLES, *VIEWS] if "{" + t + "}" in text]
                self._made[name] = self.spark.sql(text, **{t: getattr(self, t) for t in needed})
        return self._made[name]


def with_views(body: str) -> str:
    """Oracle text: the views as common table expressions in front of ``body``."""
    names = {t: t for t in [*TABLES, *VIEWS]}
    ctes = ",\n".join(f"{name} AS ({sql.format(**names)})" for name, sql in VIEWS.items())
    joint = " " if body.lstrip()[:6].upper() == "SELECT" else ",\n"
    return f"WITH RECURSIVE {ctes}{joint}{body}"


def site_ring(w: str = "w", h: str = "h", cut: str = "cut", concave: str = "concave") -> Column:
    """Outline of a site: an L shape when concave, otherwise a rectangle with its far corner cut off."""
    w, h, cut = F.col(w), F.col(h), F.col(cut)
    ell = g.ring_of((0, 0), (w, 0), (w, h / 2), (w / 2, h / 2), (w / 2, h), (0, h))
    cut_corner = g.ring_of((0, 0), (w, 0), (w, h - cut), (w - cut, h), (0, h))
    return F.when(F.col(concave), ell).otherwise(cut_corner)


def sites_with_ring(fx: Fixtures) -> DataFrame:
    return g.materialize(fx.sites, ring=site_ring())
