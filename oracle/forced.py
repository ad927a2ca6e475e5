"""SQL twins of the forced-photometry queries."""

from oracle.common import q
from oracle.pixels import PIX, SRC
from skyloom.plans.forced import BLANKS, STARS

FRAMES = """
ids AS (SELECT DISTINCT vec_id // 20 AS frame_id FROM embeddings),
frames AS (SELECT frame_id, frame_id % 3 AS field, 40 AS width, 32 AS height, 10.0::DOUBLE + frame_id % 3 AS crval1, 20.0::DOUBLE AS crval2,
  20.0::DOUBLE + frame_id % 4 * 0.7::DOUBLE AS crpix1, 16.0::DOUBLE - frame_id % 5 * 0.5::DOUBLE AS crpix2,
  -cos(frame_id % 7 * 0.02::DOUBLE) / 3600 AS cd11, sin(frame_id % 7 * 0.02::DOUBLE) / 3600 AS cd12,
  sin(frame_id % 7 * 0.02::DOUBLE) / 3600 AS cd21, cos(frame_id % 7 * 0.02::DOUBLE) / 3600 AS cd22 FROM ids)
"""


def placed(name: str, rows: str) -> str:
    """``rows`` with ra_deg, dec_deg and a solution: adds sx, sy (tangent plane)."""
    return f"""
{name}_a AS (SELECT *, radians(ra_deg) AS a, radians(dec_deg) AS de, radians(crval1) AS a0, radians(crval2) AS d0 FROM {rows}),
{name}_b AS (SELECT *, sin(de)*sin(d0) + cos(de)*cos(d0)*cos(a-a0) AS dp FROM {name}_a),
{name}_c AS (SELECT *, degrees(cos(de)*sin(a-a0)/dp) AS xi, degrees((sin(de)*cos(d0) - cos(de)*sin(d0)*cos(a-a0))/dp) AS eta, cd11*cd22 - cd12*cd21 AS det FROM {name}_b),
{name} AS (SELECT * EXCLUDE (a, de, a0, d0, dp, xi, eta, det), crpix1 + (cd22*xi - cd12*eta)/det AS sx, crpix2 + (cd11*eta - cd21*xi)/det AS sy FROM {name}_c)"""


STAR_ROWS = ", ".join(f"({i}, {e}::DOUBLE, {n}::DOUBLE, {h}::DOUBLE, {k})" for i, (e, n, h, k) in enumerate(STARS))
TARGET_ROWS = ", ".join(
    f"('{name}', {e}::DOUBLE, {n}::DOUBLE)"
    for name, e, n in [(f"star{i}", s[0], s[1]) for i, s in enumerate(STARS)] + [(f"blank{i}", *b) for i, b in enumerate(BLANKS)]
)

MOSAIC = (
    FRAMES
    + f""",
starlist AS (SELECT * FROM (VALUES {STAR_ROWS}) AS t(k, east, north, height, every)),
shown AS (SELECT f.*, k, CASE WHEN f.frame_id // 3 % every = 0 THEN s.height ELSE 0 END AS h, crval1 + east/3600 AS ra_deg, crval2 + north/3600 AS dec_deg FROM frames f, starlist s),"""
    + placed("inj", "shown")
    + """,
ex AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(generate_series(0,63)) AS pos FROM embeddings),
mo AS (SELECT vec_id // 20 AS frame_id, vec_id % 20 // 5 * 8 + pos // 8 AS y, vec_id % 20 % 5 * 8 + pos % 8 AS x, 100.0::DOUBLE + 50.0::DOUBLE*v AS base FROM ex),
pix AS MATERIALIZED (SELECT frame_id, y, x, any_value(base) + sum(h*exp(-((x-sx)*(x-sx) + (y-sy)*(y-sy))/2.88)) AS value FROM mo JOIN inj USING (frame_id) GROUP BY frame_id, y, x)"""
)


def clipped(name: str, rows: str, keys: str, rounds: int = 5) -> str:
    """Median and population spread of ``v`` after rounds of 3-sigma clipping: m, s, c."""
    out = [f"{name}_v0 AS (SELECT {keys}, v FROM {rows})"]
    for i in range(rounds):
        out.append(f"{name}_s{i} AS (SELECT {keys}, median(v) AS m, stddev_pop(v) AS s FROM {name}_v{i} GROUP BY ALL)")
        out.append(f"{name}_v{i + 1} AS MATERIALIZED (SELECT {keys}, v FROM {name}_v{i} JOIN {name}_s{i} USING ({keys}) WHERE abs(v-m) <= 3*s)")
    out.append(f"{name} AS MATERIALIZED (SELECT {keys}, median(v) AS m, stddev_pop(v) AS s, count(*) AS c FROM {name}_v{rounds} GROUP BY ALL)")
    return ",\n".join(out)


NOISE = "fv AS (SELECT frame_id, value AS v FROM pix),\n" + clipped("noise", "fv", "frame_id")


def forced(targets: str, fwhm: float) -> str:
    """Signals of ``targets`` (group_id, field, ra_deg, dec_deg) in the frames: table ``signals``."""
    radius = max(3.0, fwhm * 1.75)
    inner = radius + max(3.0, fwhm * 1.25)
    outer = inner + max(4.0, fwhm * 1.75)
    pad = -int(-outer // 1) + 2
    return (
        f"tf AS (SELECT t.group_id, t.ra_deg, t.dec_deg, f.* FROM {targets} t JOIN frames f USING (field)),"
        + placed("tp", "tf")
        + f""",
tq AS (SELECT * FROM tp WHERE round_even(sx,0) >= {pad} AND round_even(sy,0) >= {pad} AND round_even(sx,0) < width-{pad} AND round_even(sy,0) < height-{pad}),
nr AS MATERIALIZED (SELECT tq.frame_id, group_id, sx, sy, value, sqrt((x-sx)*(x-sx) + (y-sy)*(y-sy)) AS r FROM tq JOIN pix USING (frame_id)
  WHERE (x-sx)*(x-sx) + (y-sy)*(y-sy) <= {outer * outer}),
an AS (SELECT frame_id, group_id, value AS v FROM nr WHERE r >= {inner}),
a0 AS (SELECT frame_id, group_id, count(*) AS n0, stddev_pop(v) AS s0 FROM an GROUP BY ALL),"""
        + clipped("bg", "an", "frame_id, group_id")
        + f""",
ap AS (SELECT frame_id, group_id, any_value(sx) AS x, any_value(sy) AS y, count(*) AS k, sum(value) AS su, max(value) AS mx FROM nr WHERE r <= {radius} GROUP BY frame_id, group_id),
sg AS (SELECT ap.*, bg.m, greatest(CASE WHEN bg.s > 0 THEN bg.s WHEN s0 > 0 THEN s0 ELSE noise.s END, noise.s*0.25, 1e-6) AS nz FROM ap JOIN bg USING (frame_id, group_id)
  JOIN a0 USING (frame_id, group_id) JOIN noise USING (frame_id) WHERE n0 >= 10 AND k >= 4 AND noise.s > 0),
signals AS MATERIALIZED (SELECT *, su - k*m AS flux, nz*sqrt(k) AS fu, (su - k*m)/greatest(nz*sqrt(k), 1e-6) AS snr, (mx - m)/nz AS ps FROM sg)"""
    )


TARGETS = f"""
fields AS (SELECT DISTINCT field, crval1, crval2 FROM frames),
targets AS (SELECT name || '-' || field AS group_id, field, crval1 + east/3600 AS ra_deg, crval2 + north/3600 AS dec_deg FROM fields, (VALUES {TARGET_ROWS}) AS t(name, east, north))"""

SEARCH = """
hot AS (SELECT p.frame_id, p.y, p.x, value - m AS pk, s FROM pix p JOIN noise USING (frame_id) WHERE s > 0 AND value - m > 6*s),
met AS (SELECT h.*, p.y AS qy, p.x AS qx, p.value - n.m AS ex FROM hot h JOIN pix p ON p.frame_id = h.frame_id AND abs(p.y - h.y) <= 2 AND abs(p.x - h.x) <= 2 JOIN noise n ON n.frame_id = h.frame_id),
pk AS (SELECT frame_id, y, x, any_value(pk) AS pk, any_value(s) AS s, sum(greatest(ex, 0)*qx)/sum(greatest(ex, 0)) AS cx, sum(greatest(ex, 0)*qy)/sum(greatest(ex, 0)) AS cy FROM met GROUP BY frame_id, y, x
  HAVING NOT bool_or(abs(qy - y) <= 1 AND abs(qx - x) <= 1 AND (ex > pk OR (ex = pk AND (qy < y OR (qy = y AND qx < x)))))),
de AS (SELECT pk.*, f.*, radians(cd11*(cx-crpix1) + cd12*(cy-crpix2)) AS xi, radians(cd21*(cx-crpix1) + cd22*(cy-crpix2)) AS eta, radians(crval2) AS d0 FROM pk JOIN frames f USING (frame_id)
  WHERE cx BETWEEN 2 AND width-3 AND cy BETWEEN 2 AND height-3),
det AS MATERIALIZED (SELECT row_number() OVER (ORDER BY frame_id, y, x) AS id, frame_id, field, pk/s AS snr, (crval1 + degrees(atan2(xi, cos(d0) - eta*sin(d0)))) % 360 AS ra_deg,
  degrees(atan2(sin(d0) + eta*cos(d0), sqrt(xi*xi + pow(cos(d0) - eta*sin(d0), 2)))) AS dec_deg FROM de),
lk AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM det a JOIN det b ON a.field = b.field AND a.id <> b.id AND {sep} <= 2.5),
cc AS (SELECT id, id AS root FROM det UNION SELECT lk.b, cc.root FROM cc JOIN lk ON lk.a = cc.id),
gr AS (SELECT id, min(root) AS g FROM cc GROUP BY id),
tv AS (SELECT g AS group_id, any_value(field) AS field, count(*) AS dc, avg(cos(radians(dec_deg))*cos(radians(ra_deg))) AS ux, avg(cos(radians(dec_deg))*sin(radians(ra_deg))) AS uy, avg(sin(radians(dec_deg))) AS uz
  FROM det JOIN gr USING (id) GROUP BY g),
groups AS MATERIALIZED (SELECT group_id, field, dc, (degrees(atan2(uy, ux)) + 360) % 360 AS ra_deg, degrees(asin(uz/sqrt(ux*ux + uy*uy + uz*uz))) AS dec_deg FROM tv)"""


def _search() -> str:
    from oracle.common import sep

    return q(
        MOSAIC, NOISE, TARGETS, SEARCH.replace("{sep}", sep("a", "b")), forced("groups", 1.5),
        f"""nn AS (SELECT g.group_id, k.group_id AS cat, {sep("g", "k")} AS sp FROM groups g JOIN targets k ON k.group_id LIKE 'star0%' WHERE {sep("g", "k")} <= 30
          QUALIFY row_number() OVER (PARTITION BY g.group_id ORDER BY sp, cat) = 1),
        ag AS (SELECT group_id, count(*) AS n, count(*) FILTER (flux > 0 AND snr >= 6) AS fc, arg_max(flux, (flux, frame_id)) AS bf, arg_max(fu, (flux, frame_id)) AS bu, arg_max(snr, (flux, frame_id)) AS bs,
          arg_min(flux, (flux, frame_id)) AS ff, arg_min(fu, (flux, frame_id)) AS fu, arg_min(snr, (flux, frame_id)) AS fs, max(ps) AS pb, min(ps) AS pf, max(snr) AS ms,
          median(snr) FILTER (flux > 0 AND snr >= 6) AS md FROM signals GROUP BY group_id),
        bb AS (SELECT *, (bf-ff)/sqrt(bu*bu+fu*fu) AS vs, (bf+greatest(bu,fu,1.0))/greatest(ff,greatest(bu,fu,1.0)) AS fr FROM ag),
        ok AS (SELECT bb.*, g.*, cat, sp FROM bb JOIN groups g USING (group_id) LEFT JOIN nn USING (group_id) WHERE n >= 2 AND bf > 0 AND bs >= 6 AND bf > ff AND vs >= 7.5
          AND (fr >= 2 OR ff <= 0 OR fs <= 3.3 OR (vs >= 30 AND fr >= 1.35 AND (pb+1)/greatest(pf+1,1) >= 1.45)) AND fc >= 1 AND NOT coalesce(sp <= 5 AND fr < 2, false))""",
        """SELECT field, row_number() OVER (PARTITION BY field ORDER BY vs DESC, fr DESC, ms DESC, group_id) AS candidate_no, round(ra_deg,7) AS ra_deg, round(dec_deg,7) AS dec_deg, dc AS detection_count,
        fc AS frame_count, n AS signal_count, round(vs,4) AS variability_snr, round(fr,4) AS flux_ratio, round(md,4) AS median_snr, round(ms,4) AS max_snr, 'Known ' || cat AS nearest_catalog_name,
        round(sp,4) AS nearest_catalog_separation_arcsec FROM ok""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def _flagged() -> str:
    from oracle.pixels import near

    return q(
        PIX, SRC,
        """geo AS (SELECT vec_id AS frame_id, CASE WHEN vec_id % 5 <> 0 THEN vec_id % 3 * 18.5::DOUBLE END AS pc, CASE WHEN vec_id % 7 <> 0 THEN 109.0::DOUBLE + vec_id % 4 END AS lim FROM embeddings)""",
        near("n1", "pix", "src", "frame_id", 1.9, 2.9),
        """c AS (SELECT frame_id, source_id, any_value(sx) AS px, any_value(sy) AS py, sum(greatest(0,value-bg)) AS w, sum(greatest(0,value-bg)*x) AS wx, sum(greatest(0,value-bg)*y) AS wy
          FROM n1 WHERE r <= 1.3 GROUP BY ALL),
        c2 AS (SELECT *, CASE WHEN w>0 THEN sqrt(pow(wx/w-px,2)+pow(wy/w-py,2)) END AS off FROM c),
        s2 AS (SELECT frame_id, source_id, coalesce(off<=1.3,false) AS good, off, CASE WHEN coalesce(off<=1.3,false) THEN wx/w ELSE px END AS sx, CASE WHEN coalesce(off<=1.3,false) THEN wy/w ELSE py END AS sy FROM c2)""",
        near("n2", "pix", "s2", "frame_id", 1.9, 2.9),
        """a AS (SELECT frame_id, source_id, any_value(sx) AS x, any_value(sy) AS y, any_value(bg) AS bg, any_value(sd) AS sd, any_value(na) AS na, count(*) FILTER (r<=1.3) AS ap,
          sum(value) FILTER (r<=1.3) AS s, max(value) FILTER (r<=1.3) AS pk, count(*) FILTER (r<=1.3 AND value>=lim) AS sat FROM n2 JOIN geo USING (frame_id) GROUP BY frame_id, source_id),
        f AS (SELECT *, s-ap*bg AS fl, sqrt(abs(s-ap*bg)+ap*sd*sd*(1+ap/na)) AS fe, greatest(2.9, 8*least(0.49, greatest(0, coalesce(pc,0)/100))) AS mg FROM a JOIN geo USING (frame_id)),
        u AS (SELECT *, x >= mg AND x < 8-mg AND y >= mg AND y < 8-mg AS ok FROM f),
        v AS (SELECT *, ok AND sat > 0 AS full_, coalesce(ok AND sat = 0 AND pk >= lim*0.95, false) AS nearly FROM u)""",
        """SELECT frame_id, source_id, round(x,5) AS x, round(y,5) AS y, CASE WHEN ok THEN round(bg,5) END AS background_level, CASE WHEN ok THEN round(sd,5) END AS background_scatter,
        CASE WHEN ok THEN na END AS annulus_pixels, CASE WHEN ok THEN ap END AS aperture_pixels, CASE WHEN ok THEN round(pk,5) END AS peak_pixel_value, CASE WHEN ok THEN sat END AS saturated_pixel_count,
        CASE WHEN ok THEN round(fl,5) END AS flux, CASE WHEN ok THEN round(fe,5) END AS flux_error, CASE WHEN ok THEN round(fl/fe,5) END AS snr, CASE WHEN ok AND fl>0 THEN round(-2.5*log10(fl),5) END AS instrumental_magnitude,
        CASE WHEN good THEN round(off,5) END AS centroid_shift_pixels, NOT good AS used_predicted_position, ok AS in_usable_area, full_ AS is_saturated, nearly AS is_near_saturated,
        list_filter([CASE WHEN NOT ok THEN CASE WHEN coalesce(pc,0) <= 0 THEN 'Target lies outside the usable image area.' ELSE printf('Target lies outside the usable image area (configured %.1f%% edge margin).', pc) END END,
          CASE WHEN nearly THEN printf('Source core is near saturation (peak %.0f is %.1f%% of %.0f).', pk, pk/lim*100, lim) END,
          CASE WHEN full_ THEN printf('Saturated source core detected (peak %.0f >= %.0f; %d saturated pixel(s)).', pk, lim, sat) END], lambda t: t IS NOT NULL) AS flags
        FROM v JOIN s2 USING (frame_id, source_id)""",
    )


SQL = {
    "forced_signals": q(
        MOSAIC, NOISE, TARGETS, forced("targets", 1.5),
        """SELECT group_id, frame_id, round(x,5) AS x, round(y,5) AS y, k AS aperture_pixels, round(m,5) AS background, round(nz,5) AS noise, round(flux,5) AS flux, round(fu,5) AS flux_uncertainty,
        round(snr,5) AS snr, round(ps,5) AS peak_snr FROM signals""",
    ),
    "transient_search": _search(),
    "flagged_photometry": _flagged(),
}
