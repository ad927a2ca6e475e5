"""SQL twins of the pixel-table queries."""

from oracle.common import q

PIX = """
e AS (SELECT vec_id AS frame_id, label::BIGINT AS kind, unnest(embedding)::DOUBLE AS v, unnest(generate_series(0,63)) AS pos FROM embeddings),
pix AS (SELECT frame_id, kind, pos//8 AS y, pos%8 AS x, 100.0::DOUBLE + 50.0::DOUBLE*v AS value FROM e)
"""

SRC = """
src AS (SELECT vec_id AS frame_id, 'a' AS source_id, 3.1::DOUBLE + vec_id%5/10.0::DOUBLE AS sx, 3.4::DOUBLE + vec_id%3/10.0::DOUBLE AS sy FROM embeddings
  UNION ALL SELECT vec_id, 'b', 4.3::DOUBLE + vec_id%7/10.0::DOUBLE, 4.6::DOUBLE FROM embeddings)
"""


def near(name: str, pixels: str, sources: str, keys: str, inner: float, outer: float) -> str:
    """Pixels of each source with two rounds of 3-sigma clipping of the annulus: bg, sd, na."""
    on = " AND ".join(f"p.{k} = s.{k}" for k in keys.split(", "))
    sk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""
{name}_r AS (SELECT {sk}, s.source_id, s.sx, s.sy, p.x, p.y, p.value, sqrt((p.x-s.sx)*(p.x-s.sx)+(p.y-s.sy)*(p.y-s.sy)) AS r FROM {pixels} p JOIN {sources} s ON {on}
  WHERE sqrt((p.x-s.sx)*(p.x-s.sx)+(p.y-s.sy)*(p.y-s.sy)) <= {outer}),
{name}_0 AS (SELECT {keys}, source_id, value AS v FROM {name}_r WHERE r >= {inner}),
{name}_s0 AS (SELECT {keys}, source_id, median(v) AS m, stddev_pop(v) AS s FROM {name}_0 GROUP BY ALL),
{name}_1 AS (SELECT {keys}, source_id, v FROM {name}_0 JOIN {name}_s0 USING ({keys}, source_id) WHERE abs(v-m) <= 3*s),
{name}_s1 AS (SELECT {keys}, source_id, median(v) AS m, stddev_pop(v) AS s FROM {name}_1 GROUP BY ALL),
{name}_2 AS (SELECT {keys}, source_id, v FROM {name}_1 JOIN {name}_s1 USING ({keys}, source_id) WHERE abs(v-m) <= 3*s),
{name}_b AS (SELECT {keys}, source_id, median(v) AS bg, stddev_pop(v) AS sd, count(*) AS na FROM {name}_2 GROUP BY ALL),
{name} AS (SELECT * FROM {name}_r JOIN {name}_b USING ({keys}, source_id))"""


def shifted(name: str, source: str, keys: str, dx: str, dy: str) -> str:
    return f"""
{name}_g AS (SELECT {keys}, value, x - floor({dx}) - ox AS tx, y - floor({dy}) - oy AS ty,
  (CASE WHEN ox=1 THEN {dx}-floor({dx}) ELSE 1-({dx}-floor({dx})) END)*(CASE WHEN oy=1 THEN {dy}-floor({dy}) ELSE 1-({dy}-floor({dy})) END) AS w
  FROM {source} CROSS JOIN (SELECT unnest([0,0,1,1]) AS ox, unnest([0,1,0,1]) AS oy)),
{name} AS (SELECT {keys}, CAST(ty AS BIGINT) AS y, CAST(tx AS BIGINT) AS x, sum(w*value) AS value FROM {name}_g WHERE w > 0 GROUP BY ALL HAVING sum(w) > 1-1e-9)"""


RES = """
bk AS (SELECT kind, y, x, median(value) AS m FROM pix GROUP BY ALL),
res AS (SELECT frame_id, kind, y, x, value - m AS value FROM pix JOIN bk USING (kind, y, x))
"""

MAD_STD = 1.482602218505602


def rejected(name: str, rows: str, averaged: bool) -> str:
    """Five rounds of 3-spread clipping of ``rows`` (kind, y, x, frame_id, value, snr) around the median or mean."""
    out = [f"{name}_0 AS (SELECT * FROM {rows})"]
    for i in range(5):
        out.append(f"{name}_m{i} AS (SELECT kind, y, x, median(value) AS m, avg(value) AS a FROM {name}_{i} GROUP BY ALL)")
        out.append(f"{name}_d{i} AS (SELECT kind, y, x, m, a, median(abs(value-m)) AS d FROM {name}_{i} JOIN {name}_m{i} USING (kind, y, x) GROUP BY ALL)")
        out.append(
            f"{name}_{i + 1} AS MATERIALIZED (SELECT r.* FROM {name}_{i} r JOIN {name}_d{i} USING (kind, y, x) WHERE abs(value-{'a' if averaged else 'm'}) <= 3*{MAD_STD}::DOUBLE*d)"
        )
    return ",\n".join([*out, f"{name} AS (SELECT * FROM {name}_5)"])


def integrated(rejection: str, rows: str) -> str:
    return f"""SELECT kind, y, x, '{rejection}' AS rejection, count(*) AS used_count, round(avg(value),4) AS average_value, round(sum(snr*value)/sum(snr),4) AS mean_value,
        round(min(value),4) AS min_value, round(max(value),4) AS max_value FROM {rows} GROUP BY kind, y, x"""


WEIGHTS = """
fb AS (SELECT frame_id, median(value) AS bg, max(value) AS mx FROM pix GROUP BY ALL),
fd AS (SELECT frame_id, greatest(1e-6, 1.4826*median(abs(value-bg))) AS sg, avg(greatest(value-bg, 0)) AS av, any_value(mx-bg) AS tp FROM pix JOIN fb USING (frame_id) GROUP BY frame_id),
fw AS MATERIALIZED (SELECT frame_id, greatest(1e-6, av) AS av, greatest(1e-6, tp/sg) AS snr FROM fd)
"""


def squares(name: str, asks: str, pixels: str, keys: str, radius: int) -> str:
    """Local peak around (px, py) of each row of ``asks``: x, y, pk, bg, sg, fl, off."""
    on = " AND ".join(f"p.{k} = a.{k}" for k in keys.split(", ") if k in ("frame_id", "kind"))
    return f"""
{name}_r AS (SELECT a.*, p.y, p.x, p.value FROM {asks} a JOIN {pixels} p ON {on} AND p.y BETWEEN round_even(py,0)-{radius} AND round_even(py,0)+{radius} AND p.x BETWEEN round_even(px,0)-{radius} AND round_even(px,0)+{radius}),
{name}_m AS (SELECT {keys}, median(value) AS bg, max(value) AS pk, arg_max(x, (value, -y, -x)) AS mx, arg_max(y, (value, -y, -x)) AS my, any_value(px) AS px, any_value(py) AS py FROM {name}_r GROUP BY {keys}),
{name} AS (SELECT {keys}, any_value(m.bg) AS bg, any_value(m.pk) AS pk, any_value(mx) AS x, any_value(my) AS y, greatest(1e-6, 1.4826*median(abs(value-m.bg))) AS sg,
  sum(value-m.bg) FILTER ((r.y-my)*(r.y-my)+(r.x-mx)*(r.x-mx) <= 12.25) AS fl, any_value(sqrt(pow(mx-m.px,2)+pow(my-m.py,2))) AS off FROM {name}_r r JOIN {name}_m m USING ({keys}) GROUP BY {keys})"""


SQL = {
    "frame_weights": q(
        PIX, WEIGHTS, "ak AS (SELECT vec_id AS frame_id, 3.2::DOUBLE + vec_id%3 AS px, 3.6::DOUBLE AS py FROM embeddings)", squares("lp", "ak", "pix", "frame_id", 3),
        """SELECT frame_id, round(greatest(1e-6, fl),5) AS psf_signal_weight, round(greatest(1e-6, (pk-bg)/sg),5) AS psf_snr, round(snr,5) AS snr, round(av,5) AS average_signal_strength
        FROM fw JOIN lp USING (frame_id)""",
    ),
    "stack_modes": q(
        PIX, WEIGHTS, shifted("mv0", "pix", "kind, frame_id", "(frame_id%8*0.35::DOUBLE)", "(frame_id%8*(-0.2)::DOUBLE)"),
        "mv AS MATERIALIZED (SELECT mv0.*, snr FROM mv0 JOIN fw USING (frame_id))", rejected("sc", "mv", False), rejected("ac", "mv", True),
        """xt AS (SELECT kind, y, x, count(*) AS n, arg_min(frame_id, (value, frame_id)) AS lo, arg_max(frame_id, (value, -frame_id)) AS hi FROM mv GROUP BY ALL),
        nx AS (SELECT mv.* FROM mv JOIN xt USING (kind, y, x) WHERE NOT (n > 2 AND (frame_id = lo OR frame_id = hi))),
        wl AS (SELECT kind, y, x, min(value) AS lo, max(value) AS hi FROM sc GROUP BY ALL),
        wi AS (SELECT kind, y, x, frame_id, snr, greatest(lo, least(hi, value)) AS value FROM mv JOIN wl USING (kind, y, x))""",
        " UNION ALL ".join(
            integrated(r, t) for r, t in (("no_rejection", "mv"), ("min_max", "nx"), ("sigma_clipping", "sc"), ("averaged_sigma_clipping", "ac"), ("winsorized_sigma_clipping", "wi"))
        ),
    ),
    "sweep_confirmation": q(
        PIX, RES,
        """vec AS (SELECT i AS vector_id, (i//12+1)*1.0*cos(radians((i%12)*30.0)) AS vx, (i//12+1)*1.0*sin(radians((i%12)*30.0)) AS vy FROM (SELECT unnest(generate_series(0,35)) AS i)),
        tr AS (SELECT kind, vector_id, frame_id, y, x, greatest(0,value) AS value, ((frame_id//10)%8)/8.0::DOUBLE*vx AS ddx, ((frame_id//10)%8)/8.0::DOUBLE*vy AS ddy FROM res CROSS JOIN vec)""",
        shifted("mv", "tr", "kind, vector_id, frame_id", "ddx", "ddy"),
        """st AS (SELECT kind, vector_id, y, x, avg(value) AS sv FROM mv GROUP BY ALL),
        m AS (SELECT kind, vector_id, median(sv) AS md FROM st GROUP BY ALL),
        s AS (SELECT kind, vector_id, 1.4826*median(abs(sv-md)) AS sc FROM st JOIN m USING (kind, vector_id) GROUP BY ALL),
        pks AS (SELECT kind, vector_id, y AS sy, x AS sx FROM st JOIN m USING (kind, vector_id) JOIN s USING (kind, vector_id) WHERE (sv-md)/sc >= 2.5),
        pos AS MATERIALIZED (SELECT frame_id, kind, y, x, greatest(0,value) AS value FROM res),
        fr AS (SELECT DISTINCT kind, frame_id, (frame_id//10)%8/8.0::DOUBLE AS h FROM res), fb AS (SELECT kind, min(h) AS h0 FROM fr GROUP BY kind),
        ak AS (SELECT k.kind, vector_id, sy, sx, frame_id, h, sx + vx*(h-h0) AS px, sy + vy*(h-h0) AS py FROM pks k JOIN vec USING (vector_id) JOIN fr ON fr.kind = k.kind JOIN fb ON fb.kind = k.kind)""",
        squares("lp", "ak", "pos", "kind, frame_id, vector_id, sy, sx, h", 2),
        """ok AS (SELECT kind, vector_id, sy, sx, count(*) AS n, avg((pk-bg)/sg) AS a, max(pk) AS p, avg(off) AS mo, regr_slope(x, h) AS vx, regr_slope(y, h) AS vy,
          sqrt(pow(arg_max(x, (h, frame_id)) - arg_min(x, (h, frame_id)), 2) + pow(arg_max(y, (h, frame_id)) - arg_min(y, (h, frame_id)), 2)) AS dp FROM lp WHERE off <= 2.8 GROUP BY ALL)""",
        """SELECT kind, vector_id, sy AS stack_y, sx AS stack_x, n AS frame_count, round(a,4) AS average_snr, round(p,4) AS peak_value, round(mo,4) AS mean_offset_px, round(vx,4) AS vx, round(vy,4) AS vy,
        round(dp,4) AS displacement_px, round(sqrt(vx*vx+vy*vy),4) AS motion_px_per_hour FROM ok WHERE n >= 3 AND dp >= 0.5""",
    ),
    "master_frames": q(PIX, "SELECT kind, y, x, count(*) AS frame_count, round(median(value),6) AS master FROM pix GROUP BY ALL"),
    "calibrate": q(
        PIX,
        """pe AS (SELECT *, frame_id%2 AS camera, CASE kind WHEN 1 THEN 60.0::DOUBLE + frame_id%3*60 WHEN 2 THEN 20.0::DOUBLE ELSE 30.0::DOUBLE + frame_id%7*40 END AS ex FROM pix),
        bi AS (SELECT camera, y, x, median(value*0.1) AS b FROM pe WHERE kind=0 GROUP BY ALL),
        da AS (SELECT camera, ex AS dx, y, x, median(value*0.2) AS d FROM pe WHERE kind=1 GROUP BY ALL),
        fl AS (SELECT camera, ex, y, x, median(value*10.0) AS f FROM pe WHERE kind=2 GROUP BY ALL),
        de AS (SELECT DISTINCT camera, dx FROM da), ee AS (SELECT DISTINCT camera, ex FROM pe WHERE kind >= 2),
        ch AS (SELECT camera, ex, dx, CASE WHEN camera=0 THEN ex/dx ELSE 1.0 END AS sc FROM ee JOIN de USING (camera)
          QUALIFY row_number() OVER (PARTITION BY camera, ex ORDER BY abs(dx-ex), dx) = 1),
        fv AS (SELECT camera, y, x, f - b - d*sc AS v FROM fl JOIN bi USING (camera, y, x) JOIN ch USING (camera, ex) JOIN da USING (camera, dx, y, x)),
        md AS (SELECT camera, median(v) FILTER (v > 0) AS m FROM fv GROUP BY camera)""",
        """SELECT frame_id, y, x, round((value - b - d*sc)/CASE WHEN v/m > 1e-6 THEN v/m ELSE 1 END,6) AS value FROM pe JOIN ch USING (camera, ex) JOIN da USING (camera, dx, y, x)
        JOIN bi USING (camera, y, x) JOIN fv USING (camera, y, x) JOIN md USING (camera) WHERE kind > 2""",
    ),
    "pixel_bin": q(PIX, "SELECT frame_id, y//3 AS y, x//3 AS x, round(avg(value),6) AS value, count(*) AS pixel_count FROM pix GROUP BY frame_id, y//3, x//3 HAVING count(*)=9"),
    "tile_stats": q(
        PIX,
        """t AS (SELECT frame_id, y//4 AS tile_y, x//4 AS tile_x, CASE WHEN value<92 THEN 0.0 WHEN value>108 THEN NULL ELSE value END AS v FROM pix),
        c AS (SELECT frame_id, tile_y, tile_x, count(*) AS pc, count(v) AS ok, count(*) FILTER (v<>0) AS nz FROM t GROUP BY ALL)""",
        """SELECT frame_id, tile_y, tile_x, any_value(pc) AS pixel_count, round(quantile_cont(v,0.01) FILTER (nz<8 OR v<>0),6) AS low_value,
        round(quantile_cont(v,0.99) FILTER (nz<8 OR v<>0),6) AS high_value, round(any_value(ok)/any_value(pc),6) AS valid_fraction
        FROM t JOIN c USING (frame_id, tile_y, tile_x) GROUP BY frame_id, tile_y, tile_x""",
    ),
    "region_snr": q(
        PIX,
        """m AS (SELECT frame_id, median(value) FILTER (y<2 OR y>5) AS b, avg(value) FILTER (y BETWEEN 3 AND 4 AND x BETWEEN 3 AND 4) AS s FROM pix GROUP BY ALL),
        d AS (SELECT frame_id, 1.4826*median(abs(value-b)) AS n FROM pix JOIN m USING (frame_id) WHERE y<2 OR y>5 GROUP BY ALL)""",
        "SELECT frame_id, round(s-b,6) AS signal, round(n,6) AS noise, round((s-b)/n,6) AS snr FROM m JOIN d USING (frame_id)",
    ),
    "aperture_photometry": q(
        PIX, SRC, near("n1", "pix", "src", "frame_id", 2.2, 3.6),
        """c AS (SELECT frame_id, source_id, any_value(sx) AS px, any_value(sy) AS py, sum(greatest(0,value-bg)) AS w, sum(greatest(0,value-bg)*x) AS wx, sum(greatest(0,value-bg)*y) AS wy
          FROM n1 WHERE r <= 1.6 GROUP BY ALL),
        c2 AS (SELECT *, CASE WHEN w>0 THEN sqrt(pow(wx/w-px,2)+pow(wy/w-py,2)) END AS off FROM c),
        s2 AS (SELECT frame_id, source_id, coalesce(off<=1.6,false) AS good, off, CASE WHEN coalesce(off<=1.6,false) THEN wx/w ELSE px END AS sx, CASE WHEN coalesce(off<=1.6,false) THEN wy/w ELSE py END AS sy FROM c2)""",
        near("n2", "pix", "s2", "frame_id", 2.2, 3.6),
        """a AS (SELECT frame_id, source_id, any_value(sx) AS x, any_value(sy) AS y, any_value(bg) AS bg, any_value(sd) AS sd, any_value(na) AS na, count(*) FILTER (r<=1.6) AS ap,
          sum(value) FILTER (r<=1.6) AS s, max(value) FILTER (r<=1.6) AS pk, count(*) FILTER (r<=1.6 AND value>=112) AS sat FROM n2 GROUP BY frame_id, source_id),
        f AS (SELECT *, s-ap*bg AS fl, sqrt(abs(s-ap*bg)+ap*sd*sd*(1+ap/na)) AS fe FROM a)""",
        """SELECT frame_id, source_id, round(x,5) AS x, round(y,5) AS y, round(bg,5) AS background_level, round(sd,5) AS background_scatter, na AS annulus_pixels,
        ap AS aperture_pixels, round(pk,5) AS peak_pixel_value, sat AS saturated_pixel_count, round(fl,5) AS flux, round(fe,5) AS flux_error, round(fl/fe,5) AS snr,
        CASE WHEN fl>0 THEN round(-2.5*log10(fl),5) END AS instrumental_magnitude, CASE WHEN good THEN round(off,5) END AS centroid_shift_pixels, NOT good AS used_predicted_position
        FROM f JOIN s2 USING (frame_id, source_id)""",
    ),
    "hr_planes": q(
        """e AS (SELECT vec_id AS frame_id, unnest(embedding)::DOUBLE AS v, unnest(generate_series(0,63)) AS pos FROM embeddings),
        p0 AS (SELECT frame_id, ['red','green','blue'][pos%3+1] AS plane, pos//21 AS y, pos//3%7 AS x, 100.0::DOUBLE+50.0::DOUBLE*v AS value FROM e),
        pl AS (SELECT frame_id, plane, y, x, value FROM p0 UNION ALL SELECT frame_id, 'lum', y, x, avg(value) FROM p0 GROUP BY frame_id, y, x),
        ss AS (SELECT DISTINCT frame_id, plane, 'c' AS source_id, 3.0::DOUBLE AS sx, 1.0::DOUBLE AS sy FROM pl)""",
        near("n1", "pl", "ss", "frame_id, plane", 1.5, 3.2),
        """a AS (SELECT frame_id, plane, source_id, any_value(bg) AS bg, any_value(sd) AS sd, any_value(na) AS na, count(*) FILTER (r<=1.1) AS ap, sum(value) FILTER (r<=1.1) AS s FROM n1 GROUP BY ALL),
        f AS (SELECT *, s-ap*bg AS fl, sqrt(abs(s-ap*bg)+ap*sd*sd*(1+ap/na)) AS fe, CASE WHEN s-ap*bg>0 THEN -2.5*log10(s-ap*bg) END AS mg FROM a)""",
        "SELECT frame_id, source_id, "
        + ", ".join(f"round(max(fl) FILTER (plane='{p}'),5) AS {p}_flux, round(max(mg) FILTER (plane='{p}'),5) AS {p}_mag, round(max(fl/fe) FILTER (plane='{p}'),5) AS {p}_snr, round(max(fe) FILTER (plane='{p}'),5) AS {p}_flux_error" for p in ("lum", "red", "green", "blue"))
        + ", round(max(mg) FILTER (plane='blue') - max(mg) FILTER (plane='red'),5) AS blue_minus_red, round(coalesce(CASE WHEN frame_id%3=0 THEN frame_id%20/10.0::DOUBLE END, max(mg) FILTER (plane='blue') - max(mg) FILTER (plane='red')),5) AS colour,"
        + " CASE WHEN frame_id%3=0 THEN 'catalog' WHEN max(mg) FILTER (plane='blue') - max(mg) FILTER (plane='red') IS NOT NULL THEN 'instrumental' ELSE 'none' END AS colour_source FROM f GROUP BY frame_id, source_id",
    ),
    "frame_fwhm": q(
        PIX, SRC,
        """nr AS (SELECT p.frame_id, s.source_id, p.value, sqrt((p.x-s.sx)*(p.x-s.sx)+(p.y-s.sy)*(p.y-s.sy)) AS r FROM pix p JOIN src s USING (frame_id)
          WHERE sqrt((p.x-s.sx)*(p.x-s.sx)+(p.y-s.sy)*(p.y-s.sy)) <= 3),
        b AS (SELECT frame_id, source_id, median(value) AS bg FROM nr WHERE r >= 1.8 GROUP BY ALL),
        pr AS (SELECT frame_id, source_id, CAST(floor(r/0.5) AS BIGINT) AS ring, median(value) AS v0 FROM nr GROUP BY ALL),
        p2 AS (SELECT frame_id, source_id, ring, v0-bg AS v, max(v0-bg) OVER (PARTITION BY frame_id, source_id)/2 AS h, lag(v0-bg) OVER w AS pv, lag(ring) OVER w AS rr FROM pr JOIN b USING (frame_id, source_id)
          WINDOW w AS (PARTITION BY frame_id, source_id ORDER BY ring)),
        cr AS (SELECT frame_id, source_id, 2*((rr+0.5)*0.5 + (pv-h)/(pv-v)*((ring+0.5)*0.5-(rr+0.5)*0.5)) AS fw FROM p2 WHERE pv>=h AND v<h AND h>0
          QUALIFY row_number() OVER (PARTITION BY frame_id, source_id ORDER BY ring)=1)""",
        "SELECT frame_id, count(*) AS source_count, round(median(fw),5) AS frame_fwhm FROM cr GROUP BY frame_id",
    ),
    "tracked_stack": q(
        PIX, "ix AS (SELECT *, (frame_id//10)%8 AS fi FROM pix)", shifted("mv", "ix", "kind, frame_id", "(fi*0.35::DOUBLE)", "(fi*(-0.2)::DOUBLE)"),
        """m AS (SELECT kind, y, x, median(value) AS md, count(*) AS n FROM mv GROUP BY ALL),
        s AS (SELECT kind, y, x, 1.4826*median(abs(value-md)) AS sc FROM mv JOIN m USING (kind, y, x) GROUP BY ALL),
        k AS (SELECT mv.*, n < 3 OR sc <= 0 OR abs(value-md) <= 3*sc AS keep FROM mv JOIN m USING (kind, y, x) JOIN s USING (kind, y, x))""",
        """SELECT kind, y, x, count(*) AS frame_count, round(avg(value),5) AS mean_value, round(avg(value) FILTER (keep),5) AS clipped_value, round(min(value),5) AS min_value,
        round(max(value),5) AS max_value, count(*) FILTER (NOT keep) AS rejected_count FROM k GROUP BY kind, y, x""",
    ),
    "shift_stack_sweep": q(
        PIX, RES,
        """vec AS (SELECT i AS vector_id, (i//12+1)*1.0*cos(radians((i%12)*30.0)) AS vx, (i//12+1)*1.0*sin(radians((i%12)*30.0)) AS vy FROM (SELECT unnest(generate_series(0,35)) AS i)),
        tr AS (SELECT kind, vector_id, frame_id, y, x, greatest(0,value) AS value, ((frame_id//10)%8)/8.0::DOUBLE*vx AS ddx, ((frame_id//10)%8)/8.0::DOUBLE*vy AS ddy FROM res CROSS JOIN vec)""",
        shifted("mv", "tr", "kind, vector_id, frame_id", "ddx", "ddy"),
        """st AS (SELECT kind, vector_id, y, x, avg(value) AS sv, count(*) AS n FROM mv GROUP BY ALL),
        m AS (SELECT kind, vector_id, median(sv) AS md FROM st GROUP BY ALL),
        s AS (SELECT kind, vector_id, 1.4826*median(abs(sv-md)) AS sc FROM st JOIN m USING (kind, vector_id) GROUP BY ALL)""",
        """SELECT kind, vector_id, y, x, round(sv,5) AS stack_value, n AS frame_count, round((sv-md)/sc,5) AS snr,
        row_number() OVER (PARTITION BY kind, vector_id ORDER BY (sv-md)/sc DESC, y, x) AS rank FROM st JOIN m USING (kind, vector_id) JOIN s USING (kind, vector_id)
        WHERE (sv-md)/sc >= 2.5""",
    ),
    "cumulative_stack": q(
        PIX,
        """SELECT frame_id, kind, y, x, count(*) OVER w AS stack_count, round(avg(value) OVER w, 5) AS stack_value FROM pix
        WINDOW w AS (PARTITION BY kind, y, x ORDER BY frame_id ROWS UNBOUNDED PRECEDING)""",
    ),
    "stack_peak": q(
        PIX,
        """s AS (SELECT kind, y, x, avg(value) AS v FROM pix GROUP BY ALL),
        n AS (SELECT * FROM s WHERE abs(x-3.5) <= 2.5 AND abs(y-3.5) <= 2.5),
        m AS (SELECT kind, median(v) AS md FROM n GROUP BY kind),
        d AS (SELECT kind, 1.4826*median(abs(v-md)) AS sd FROM n JOIN m USING (kind) GROUP BY kind),
        p AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY kind ORDER BY v DESC, y, x) = 1)""",
        "SELECT kind, x, y, round(v,4) AS peak_value, round((v-md)/sd,4) AS snr FROM p JOIN m USING (kind) JOIN d USING (kind)",
    ),
    "residual_detections": q(
        PIX, RES,
        """m AS (SELECT frame_id, median(value) AS md FROM res GROUP BY ALL),
        s AS (SELECT frame_id, 1.4826*median(abs(value-md)) AS sc, any_value(md) AS md FROM res JOIN m USING (frame_id) GROUP BY ALL)""",
        """SELECT frame_id, y, x, round(value,5) AS value, round((value-md)/sc,5) AS local_snr FROM res r JOIN s USING (frame_id) WHERE value > md+1.5*sc AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6
        AND NOT EXISTS (SELECT 1 FROM res b WHERE b.frame_id=r.frame_id AND abs(b.y-r.y)<=1 AND abs(b.x-r.x)<=1 AND b.value > r.value)""",
    ),
    "frame_signal": q(
        PIX, "m AS (SELECT frame_id, median(value) AS b, quantile_cont(value, 0.995) AS t FROM pix GROUP BY ALL), d AS (SELECT frame_id, 1.4826*median(abs(value-b)) AS n, any_value(b) AS b, any_value(t) AS t FROM pix JOIN m USING (frame_id) GROUP BY frame_id)",
        "SELECT frame_id, round(b,6) AS background, round(t-b,6) AS signal, round(n,6) AS noise, round((t-b)/n,6) AS snr FROM d",
    ),
    "unknown_residuals": q(
        PIX, RES,
        """m AS (SELECT frame_id, median(value) AS md FROM res GROUP BY ALL),
        s AS (SELECT frame_id, 1.4826*median(abs(value-md)) AS sc, any_value(md) AS md FROM res JOIN m USING (frame_id) GROUP BY ALL)""",
        """SELECT frame_id, y, x, round(value,5) AS value, round((value-md)/sc,5) AS local_snr FROM res r JOIN s USING (frame_id) WHERE value > md+1.5*sc AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6
        AND NOT EXISTS (SELECT 1 FROM res b WHERE b.frame_id=r.frame_id AND abs(b.y-r.y)<=1 AND abs(b.x-r.x)<=1 AND b.value > r.value)
        AND (value-md)/sc BETWEEN 1.6 AND 4.0 AND pow(x-(2+frame_id%4),2)+pow(y-(3+frame_id%3),2) > 2.25""",
    ),
    "streaks": "WITH RECURSIVE " + q(
        PIX, RES,
        """r2 AS (SELECT frame_id, y, x, value + 20.0 AS value FROM res),
        m AS (SELECT frame_id, median(value) AS md FROM r2 GROUP BY ALL),
        s AS (SELECT frame_id, 1.4826*median(abs(value-md)) AS sc, any_value(md) AS md FROM r2 JOIN m USING (frame_id) GROUP BY ALL),
        h AS (SELECT frame_id, y, x, y*8+x AS c, value FROM r2 JOIN s USING (frame_id) WHERE value > md+0.4*sc),
        ed AS (SELECT a.frame_id, a.c AS a, b.c AS b FROM h a JOIN h b ON a.frame_id=b.frame_id AND abs(a.y-b.y)<=1 AND abs(a.x-b.x)<=1),
        reach AS (SELECT frame_id, c AS a, c AS b FROM h UNION SELECT r.frame_id, r.a, ed.b FROM reach r JOIN ed ON ed.frame_id=r.frame_id AND ed.a=r.b),
        cm AS (SELECT frame_id, a AS c, min(b) AS comp FROM reach GROUP BY frame_id, a),
        g AS (SELECT frame_id, comp, count(*) AS area, sum(value) AS w, sum(value*x)/sum(value) AS cx, sum(value*y)/sum(value) AS cy, max(value) AS pk FROM h JOIN cm USING (frame_id, c) GROUP BY frame_id, comp
          HAVING count(*) >= 4 AND sum(value) > 0),
        t AS (SELECT frame_id, comp, any_value(area) AS area, any_value(pk) AS pk, any_value(cx) AS cx, any_value(cy) AS cy, sum(value*pow(x-cx,2))/any_value(w) AS xx,
          sum(value*pow(y-cy,2))/any_value(w) AS yy, sum(value*(x-cx)*(y-cy))/any_value(w) AS xy FROM h JOIN cm USING (frame_id, c) JOIN g USING (frame_id, comp) GROUP BY frame_id, comp),
        u AS (SELECT *, 2.3548*sqrt(greatest(0,(xx+yy)/2+sqrt(pow((xx-yy)/2,2)+xy*xy))) AS mj, 2.3548*sqrt(greatest(0,(xx+yy)/2-sqrt(pow((xx-yy)/2,2)+xy*xy))) AS mn FROM t)""",
        """SELECT frame_id, area, round(pk,4) AS peak_value, round(cx,4) AS x, round(cy,4) AS y, round(mj,4) AS major_fwhm, round(mn,4) AS minor_fwhm FROM u
        WHERE mj >= 2.0 AND mj/greatest(mn,1e-6) >= 1.3""",
    ).removeprefix("WITH "),
}
