"""SQL twins of the time-series queries."""

from oracle.common import DIFF, MEAS_RAW, PAIRS, QUALITY, q

POINTS = """
pts AS (SELECT source_id, filter_name, observation_time/86400.0 AS t, instrumental_magnitude AS y, 1.085736*flux_error/flux AS e FROM meas WHERE NOT is_reference),
tt AS (SELECT source_id, filter_name, t, t - lag(t) OVER (PARTITION BY source_id, filter_name ORDER BY t) AS dt FROM (SELECT DISTINCT source_id, filter_name, t FROM pts)),
b0 AS (SELECT source_id, filter_name, count(*) AS time_count, min(t) AS t0, max(t)-min(t) AS span, median(dt) AS cad FROM tt GROUP BY ALL),
bounds AS (SELECT *, greatest(0.1::DOUBLE/24, cad*2) AS p0, span*0.95 AS p1 FROM b0 WHERE time_count >= 6 AND span*0.95 > greatest(0.1::DOUBLE/24, cad*2)),
ge AS (SELECT source_id, filter_name, count(*) FILTER (e > 0) AS g FROM pts GROUP BY ALL),
wp AS (SELECT pts.source_id, pts.filter_name, t - t0 AS x, y, CASE WHEN g >= 3 THEN 1/(e*e) ELSE 1.0 END AS w, p0, p1, span, cad FROM pts
  JOIN bounds USING (source_id, filter_name) JOIN ge USING (source_id, filter_name))
"""

S = "source_id, filter_name"

SQL = {
    "period_bounds": q(
        MEAS_RAW, POINTS,
        f"""SELECT {S}, time_count, round(span,7) AS span_days, round(cad,7) AS cadence_days, round(p0,7) AS min_period_days,
        round(p1,7) AS max_period_days FROM bounds""",
    ),
    "lomb_scargle": q(
        MEAS_RAW, POINTS,
        f"""base AS (SELECT {S}, sum(w) AS W0, sum(w*y)/sum(w) AS ym, max(x)-min(x) AS bl, any_value(p0) AS p0, any_value(p1) AS p1 FROM wp GROUP BY ALL),
        ks AS (SELECT *, unnest(generate_series(0, greatest(0, CAST(round((1/p0-1/p1)*(bl*10)) AS BIGINT)))) AS k FROM base),
        g AS (SELECT wp.source_id, wp.filter_name, k, 1/ks.p1 + k/(bl*10) AS f, w/W0 AS w, y-ym AS d, x FROM wp JOIN ks USING ({S})),
        h AS (SELECT {S}, k, f, w, d, cos(2*pi()*f*x) AS c, sin(2*pi()*f*x) AS s FROM g),
        m AS (SELECT {S}, k, any_value(f) AS f, sum(w*c) AS C, sum(w*s) AS S0, sum(w*d) AS D, sum(w*d*d) AS DD, sum(w*d*c) AS DC, sum(w*d*s) AS DS,
          sum(w*c*c) AS CC, sum(w*c*s) AS CS FROM h GROUP BY source_id, filter_name, k),
        n AS (SELECT {S}, k, f, DD-D*D AS YY, DC-D*C AS YC, DS-D*S0 AS YS, CC-C*C AS C2, 1-CC-S0*S0 AS S2, CS-C*S0 AS X2 FROM m),
        pw AS (SELECT {S}, k, f, CASE WHEN YY*(C2*S2-X2*X2) <> 0 THEN (S2*YC*YC + C2*YS*YS - 2*X2*YC*YS)/(YY*(C2*S2-X2*X2)) END AS p FROM n),
        b AS (SELECT * FROM pw WHERE p IS NOT NULL AND isfinite(p) QUALIFY row_number() OVER (PARTITION BY {S} ORDER BY p DESC, k) = 1),
        near AS (SELECT pw.source_id, pw.filter_name, hh, pw.f, pw.p FROM pw JOIN b USING ({S}) CROSS JOIN (SELECT unnest([2,3,4]) AS hh) WHERE pw.p IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY {S}, hh ORDER BY abs(pw.f - b.f/hh), pw.k) = 1),
        g2 AS (SELECT b.source_id, b.filter_name, b.f AS f0, b.p AS q0, max(near.f) FILTER (hh=2 AND abs(near.f-b.f/2) <= b.f/2*0.08) AS f2, max(near.p) FILTER (hh=2 AND abs(near.f-b.f/2) <= b.f/2*0.08) AS q2,
          max(near.f) FILTER (hh=3 AND abs(near.f-b.f/3) <= b.f/3*0.08) AS f3, max(near.p) FILTER (hh=3 AND abs(near.f-b.f/3) <= b.f/3*0.08) AS q3,
          max(near.f) FILTER (hh=4 AND abs(near.f-b.f/4) <= b.f/4*0.08) AS f4, max(near.p) FILTER (hh=4 AND abs(near.f-b.f/4) <= b.f/4*0.08) AS q4
          FROM b LEFT JOIN near USING ({S}) GROUP BY b.source_id, b.filter_name, b.f, b.p),
        u2 AS (SELECT *, coalesce(q0>0 AND q2>=q0*0.95,false) AS up FROM g2),
        v2 AS (SELECT *, CASE WHEN up THEN f2 ELSE f0 END AS fa, CASE WHEN up THEN q2 ELSE q0 END AS qa FROM u2),
        v3 AS (SELECT *, coalesce(q0>0 AND q3>=qa*0.95,false) AS up3 FROM v2),
        w3 AS (SELECT *, CASE WHEN up3 THEN f3 ELSE fa END AS fb, CASE WHEN up3 THEN q3 ELSE qa END AS qb FROM v3),
        v4 AS (SELECT *, coalesce(q0>0 AND q4>=qb*0.95,false) AS up4 FROM w3)""",
        f"""SELECT {S}, round(24.0/CASE WHEN up4 THEN f4 ELSE fb END,5) AS period_hours, round(CASE WHEN up4 THEN q4 ELSE qb END,5) AS power,
        round(q0,5) AS peak_power FROM v4""",
    ),
    "snr_bins": "WITH RECURSIVE " + q(
        MEAS_RAW, PAIRS, DIFF, QUALITY,
        """rows0 AS (SELECT *, row_number() OVER (PARTITION BY source_id, filter_name ORDER BY observation_time, file_path) AS i FROM qual),
        gaps AS (SELECT source_id, filter_name, observation_time - lag(observation_time) OVER (PARTITION BY source_id, filter_name ORDER BY observation_time, file_path) AS gap FROM rows0),
        cad AS (SELECT source_id, filter_name, median(gap) FILTER (gap > 0) AS cad FROM gaps GROUP BY ALL),
        pl0 AS (SELECT r.source_id, r.filter_name, count(*) AS mc, median(snr) AS ms, any_value(cad) AS cad, any_value(source_no) AS u FROM rows0 r JOIN cad USING (source_id, filter_name) GROUP BY ALL),
        pl1 AS (SELECT *, CASE WHEN u%5<>0 THEN 4.0 + u%17 END AS per, CASE u%3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 0.3 END::DOUBLE AS fr FROM pl0),
        pl2 AS (SELECT *, least(345600.0, coalesce(per*86400.0*fr, 345600.0)) AS md, coalesce(cad, CASE WHEN per IS NOT NULL THEN 345600.0 END) AS c FROM pl1),
        pl3 AS (SELECT *, least(15, greatest(1, CAST(floor(md/greatest(c,1.0)) AS BIGINT))) AS safe,
          CASE WHEN ms >= 30 THEN 1 ELSE greatest(1, CAST(ceil((30.0/ms)*(30.0/ms)) AS BIGINT)) END AS tg FROM pl2),
        pl4 AS (SELECT *, greatest(1, least(15, safe, tg)) AS nf FROM pl3 WHERE mc >= 2 AND c IS NOT NULL AND safe >= 2),
        act AS (SELECT r.*, nf, md FROM rows0 r JOIN pl4 USING (source_id, filter_name) WHERE nf >= 2),
        walk AS (SELECT source_id, filter_name, i, observation_time AS t0, 1 AS c, 1 AS bin FROM act WHERE i = 1
          UNION ALL SELECT a.source_id, a.filter_name, a.i, CASE WHEN w.c + 1 > a.nf OR a.observation_time - w.t0 > a.md THEN a.observation_time ELSE w.t0 END,
            CASE WHEN w.c + 1 > a.nf OR a.observation_time - w.t0 > a.md THEN 1 ELSE w.c + 1 END,
            CASE WHEN w.c + 1 > a.nf OR a.observation_time - w.t0 > a.md THEN w.bin + 1 ELSE w.bin END
          FROM walk w JOIN act a ON a.source_id = w.source_id AND a.filter_name = w.filter_name AND a.i = w.i + 1),
        mem AS (SELECT a.*, bin FROM act a JOIN walk USING (source_id, filter_name, i)),
        st AS (SELECT source_id, filter_name, bin, median(flux) AS fm, count(*) AS fn FROM mem GROUP BY ALL),
        fmd AS (SELECT source_id, filter_name, bin, median(abs(flux-fm)) AS fmad FROM mem JOIN st USING (source_id, filter_name, bin) GROUP BY ALL),
        inn AS (SELECT mem.*, CASE WHEN fn >= 3 AND fmad > 0 THEN abs(flux-fm) <= 3.5*1.4826*fmad ELSE true END AS keep FROM mem
          JOIN st USING (source_id, filter_name, bin) JOIN fmd USING (source_id, filter_name, bin)),
        kk AS (SELECT * FROM inn QUALIFY keep OR count(*) FILTER (keep) OVER (PARTITION BY source_id, filter_name, bin) < 2),
        kw AS (SELECT *, CASE WHEN qw > 0 THEN qw ELSE 1.0 END AS q2, CASE WHEN scatter > 0 THEN rflux*scatter END AS rse FROM kk),
        ag AS (SELECT source_id, filter_name, bin, count(*) AS member_count, avg(observation_time) AS ot, bool_and(excluded) AS ex,
          sum(q2/(flux_error*flux_error)*flux)/sum(q2/(flux_error*flux_error)) AS fl, sqrt(1/sum(q2/(flux_error*flux_error))) AS fe,
          sum(q2/(rse*rse)) AS rw, sum(q2/(rse*rse)*rflux) FILTER (rse IS NOT NULL) AS rwv, sum(q2) FILTER (rflux IS NOT NULL) AS rq,
          sum(q2*rflux) AS rqv, sum(q2*rflux*rflux) AS rqvv, count(rflux) AS rn,
          sum(q2/(zpe*zpe)*zpz)/sum(q2/(zpe*zpe)) AS z, sqrt(1/sum(q2/(zpe*zpe))) AS ze, sum(q2*qs)/sum(q2) AS sc FROM kw GROUP BY ALL HAVING count(*) >= 2),
        ah AS (SELECT *, CASE WHEN rw > 0 THEN rwv/rw ELSE rqv/rq END AS rf,
          CASE WHEN rw > 0 THEN sqrt(1/rw) WHEN rn = 1 THEN 0 WHEN rn >= 2 THEN sqrt(greatest(0.0, rqvv/rq - pow(rqv/rq,2))/rn) END AS rfe FROM ag)""",
        """SELECT source_id, filter_name, member_count, round(ot,3) AS observation_time, ex AS excluded_from_analysis, round(fl,5) AS flux, round(fe,5) AS flux_error,
        round(fl/fe,5) AS snr, round(-2.5*log10(fl),5) AS instrumental_magnitude, round(-2.5*log10(fl/rf),5) AS differential_magnitude,
        round(2.5/ln(10)*sqrt(pow(fe/fl,2)+pow(rfe/rf,2)),5) AS differential_magnitude_error, round(-2.5*log10(fl)+z,5) AS calibrated_magnitude,
        round(sqrt(pow(1.085736*fe/fl,2)+ze*ze),5) AS calibrated_magnitude_error, round(sc,5) AS quality_score FROM ah""",
    )[5:],
    "overview_layers": q(
        MEAS_RAW, PAIRS, DIFF,
        """tg AS (SELECT DISTINCT source_id AS target_id, object_name FROM diff WHERE is_variable),
        us AS (SELECT p.source_id AS target_id, p.ref_source_id AS source_id, count(*) AS n FROM pairs p WHERE p.source_id IN (SELECT target_id FROM tg) GROUP BY ALL),
        nm AS (SELECT source_id, min(source_name) AS nm FROM meas GROUP BY source_id),
        cp AS (SELECT target_id, source_id, 'comparison' AS role FROM us JOIN nm USING (source_id)
          QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY n DESC, lower(nm), source_id) <= 8),
        ck AS (SELECT DISTINCT tg.target_id, m.source_id, 'check' AS role FROM tg JOIN meas m ON m.object_name = tg.object_name AND m.is_check),
        o AS (SELECT * FROM cp UNION ALL SELECT * FROM ck),
        allm AS (SELECT file_path, filter_name, source_id, flux, instrumental_magnitude AS ins, dm, cal, std, flux_error AS fe, dme, cale, stde FROM diff
          UNION ALL SELECT file_path, filter_name, source_id, flux, instrumental_magnitude, NULL, NULL, NULL, flux_error, NULL, NULL, NULL FROM meas WHERE is_reference),
        x AS (SELECT o.target_id, o.role, a.source_id, a.filter_name, coalesce(a.dm, -2.5*log10(a.flux/c.rflux)) AS dm, coalesce(a.cal, a.ins + c.zpz) AS cal,
          coalesce(a.std, a.ins + c.sz) AS std, CASE WHEN a.dm IS NOT NULL THEN a.dme WHEN c.rflux IS NOT NULL THEN 2.5/ln(10)*sqrt(pow(a.fe/a.flux,2)+pow(a.fe/c.rflux,2)) END AS dme,
          CASE WHEN a.cal IS NOT NULL THEN a.cale WHEN c.zpz IS NOT NULL THEN sqrt(pow(2.5/ln(10)*a.fe/a.flux,2)+pow(coalesce(c.zpe,0),2)) END AS cale,
          CASE WHEN a.std IS NOT NULL THEN a.stde WHEN c.sz IS NOT NULL THEN sqrt(pow(2.5/ln(10)*a.fe/a.flux,2)+pow(coalesce(c.sze,0),2)) END AS stde FROM o JOIN allm a USING (source_id)
          LEFT JOIN diff c ON c.source_id = o.target_id AND c.file_path = a.file_path AND c.filter_name = a.filter_name
          UNION ALL SELECT source_id, 'target', source_id, filter_name, dm, cal, std, dme, cale, stde FROM diff WHERE is_variable)""",
        """SELECT target_id, role, source_id, filter_name, count(*) AS point_count, round(avg(dm),5) AS mean_differential, round(avg(cal),5) AS mean_calibrated,
        round(avg(std),5) AS mean_standard, round(avg(dme),5) AS mean_differential_error, round(avg(cale),5) AS mean_calibrated_error, round(avg(stde),5) AS mean_standard_error FROM x GROUP BY ALL""",
    ),
    "event_forecast": q(
        """s AS (SELECT p_partkey AS k, p_type IN ('ECONOMY','STANDARD') AS ecl, 0.2::DOUBLE + p_size/10.0::DOUBLE AS per, 2460310.0::DOUBLE + p_partkey%100/10.0::DOUBLE AS ep,
          CASE WHEN p_partkey%2=0 THEN 3.0::DOUBLE END AS eh FROM part),
        ev AS (SELECT *, unnest(CASE WHEN ecl THEN [0.0::DOUBLE, 0.5::DOUBLE] ELSE [0.0::DOUBLE] END) AS ph FROM s),
        e2 AS (SELECT *, ep + ph*per AS base FROM ev),
        e3 AS (SELECT *, unnest(generate_series(CAST(ceil((2460398.25::DOUBLE-base)/per) AS BIGINT), CAST(floor((2460404.25::DOUBLE-base)/per) AS BIGINT))) AS cycle FROM e2),
        e4 AS (SELECT *, base + cycle*per AS jd, CASE WHEN NOT ecl THEN 'Max' WHEN ph=0 THEN 'Min I' ELSE 'Min II' END AS event FROM e3)""",
        """SELECT k AS star_id, event, cycle, round(jd,5) AS event_jd, CASE WHEN ecl THEN round(jd-eh/48,5) END AS window_start_jd,
        CASE WHEN ecl THEN round(jd+eh/48,5) END AS window_end_jd, row_number() OVER (PARTITION BY k ORDER BY jd, e4.event) AS rank FROM e4 QUALIFY rank <= 12""",
    ),
    "crossings": q(
        """e AS (SELECT user_id, epoch_us(ts)/1e6 AS t1, value-35.0 AS b, lag(epoch_us(ts)/1e6) OVER w AS t0, lag(value-35.0) OVER w AS a FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts)/1e6, event_id)),
        x AS (SELECT *, t0 + (t1-t0)*CASE WHEN b<>a THEN -a/(b-a) ELSE 0 END AS x, a<0 AND b>=0 AS up, a>0 AND b<=0 AS dn FROM e)""",
        """SELECT user_id, round(min(x) FILTER (up),3) AS first_rise, round(min(x) FILTER (dn),3) AS first_set, count(*) FILTER (up OR dn) AS crossing_count
        FROM x GROUP BY user_id""",
    ),
}
SQL["snr_bins"] = "WITH RECURSIVE " + SQL["snr_bins"].split("WITH RECURSIVE ")[-1].removeprefix("WITH ").lstrip()

SQL["predicted_positions"] = """WITH e AS (SELECT event_id, 10.0::DOUBLE + (user_id*37%1000)/1000.0::DOUBLE AS ra, 20.0::DOUBLE + (user_id*91%1000)/1000.0::DOUBLE AS de,
      coalesce(CASE WHEN user_id%5<>0 THEN (user_id%41-20)*1.5::DOUBLE END, 0) AS a, coalesce(CASE WHEN user_id%7<>0 THEN (user_id%23-11)*0.8::DOUBLE END, 0) AS b,
      ((floor(epoch_us(ts)/1e6/86400)+1)*86400 - epoch_us(ts)/1e6)/3600.0 AS h FROM events)
    SELECT event_id, round(ra + a*h/3600.0, 7) AS ra_deg, round(de + b*h/3600.0, 7) AS dec_deg, round(sqrt(a*a+b*b), 7) AS arcsec_per_hour FROM e"""
