"""Closed forms used by the oracles: what the general polygon code must give on rectangles and site outlines."""


def overlap(a: str, b: str) -> str:
    """Overlap area of two rectangles given as table aliases."""
    return (
        f"(greatest(0.0, least({a}.x+{a}.w,{b}.x+{b}.w)-greatest({a}.x,{b}.x))"
        f"*greatest(0.0, least({a}.y+{a}.h,{b}.y+{b}.h)-greatest({a}.y,{b}.y)))"
    )


def gap(a: str, b: str) -> str:
    dx = f"greatest(0.0,{a}.x-{b}.x-{b}.w,{b}.x-{a}.x-{a}.w)"
    dy = f"greatest(0.0,{a}.y-{b}.y-{b}.h,{b}.y-{a}.y-{a}.h)"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def road_gap(p: str, r: str) -> str:
    """Rectangle to axis-parallel road line."""
    dx = f"greatest(0.0,{p}.x-{r}.x2,{r}.x1-{p}.x-{p}.w)"
    dy = f"greatest(0.0,{p}.y-{r}.y2,{r}.y1-{p}.y-{p}.h)"
    return f"sqrt({dx}*{dx}+{dy}*{dy})"


def site_overlap(p: str, s: str) -> str:
    """Area of a rectangle inside a site outline (cut corner or L shape)."""
    x1, y1 = f"greatest({p}.x,0.0)", f"greatest({p}.y,0.0)"
    x2, y2 = f"least({p}.x+{p}.w,{s}.w)", f"least({p}.y+{p}.h,{s}.h)"
    dx, dy = f"greatest(0.0,{x2}-{x1})", f"greatest(0.0,{y2}-{y1})"
    e = f"({x2}+{y2}-({s}.w+{s}.h-{s}.cut))"
    tri = (
        f"(pow(greatest(0.0,{e}),2)-pow(greatest(0.0,{e}-{dx}),2)-pow(greatest(0.0,{e}-{dy}),2)"
        f"+pow(greatest(0.0,{e}-{dx}-{dy}),2))/2"
    )
    notch = (
        f"greatest(0.0,{x2}-greatest({x1},{s}.w/2))*greatest(0.0,{y2}-greatest({y1},{s}.h/2))"
    )
    return (
        f"(CASE WHEN {dx}<=0 OR {dy}<=0 THEN 0.0 WHEN {s}.concave THEN {dx}*{dy}-{notch} "
        f"ELSE {dx}*{dy}-{tri} END)"
    )


def site_contains(p: str, s: str, d: str = "0.0") -> str:
    """Rectangle inside a site with clearance ``d`` to its outline."""
    box = f"({p}.x>={d} AND {p}.y>={d} AND {p}.x+{p}.w<={s}.w-{d} AND {p}.y+{p}.h<={s}.h-{d})"
    cut = f"({p}.x+{p}.w+{p}.y+{p}.h<={s}.w+{s}.h-{s}.cut-{d}*sqrt(2.0)+1e-9)"
    nx = f"greatest(0.0,{s}.w/2-{p}.x-{p}.w)"
    ny = f"greatest(0.0,{s}.h/2-{p}.y-{p}.h)"
    # clearance to the notch corner (w/2, h/2): left of it, below it, or diagonally away from it
    ell = (
        f"(({p}.x+{p}.w<={s}.w/2 OR {p}.y+{p}.h<={s}.h/2) AND sqrt({nx}*{nx}+{ny}*{ny})>={d}-1e-9)"
    )
    return f"({box} AND CASE WHEN {s}.concave THEN {ell} ELSE {cut} END)"


SITE_AREA = "(CASE WHEN concave THEN 0.75*w*h ELSE w*h-cut*cut/2 END)"
