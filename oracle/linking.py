"""SQL twins of the detection-linking and frame-check queries."""

from oracle.common import MEAS_RAW, q, sep

SKY = """
skyd AS (SELECT event_id AS detection_id, CAST(floor(epoch_us(ts)/1e6/86400) AS BIGINT) AS frame_id, user_id, 10.0::DOUBLE + (user_id*37%1000)/1000.0::DOUBLE + event_id%5*0.0001::DOUBLE AS ra_deg,
  20.0::DOUBLE + (user_id*91%1000)/1000.0::DOUBLE AS dec_deg, value/5.0 AS snr, value AS flux FROM events)
"""

DET = """
d0 AS (SELECT user_id AS u, CAST(floor(epoch_us(ts)/1e6/86400) AS BIGINT) AS night, CAST(floor(epoch_us(ts)/1e6/10800) AS BIGINT)%8 AS fi, avg(value) AS v, max(value) AS pk, count(*) AS k FROM events GROUP BY ALL),
det AS (SELECT night, fi, u, fi*3.0::DOUBLE AS h, v/5.0 AS snr, pk, (u*37%1000) + CASE WHEN u%3<>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END*(u%7-3)*0.8::DOUBLE*(fi*3.0::DOUBLE) + k%3*0.1::DOUBLE AS x,
  (u*91%1000) + CASE WHEN u%3<>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END*(u%5-2)*0.7::DOUBLE*(fi*3.0::DOUBLE) AS y FROM d0),
known AS (SELECT night, 'K' || u AS object_id, fi, x + CASE WHEN u%3=1 AND u%2=0 THEN 0.5::DOUBLE ELSE 2000.0::DOUBLE + u*10 END AS x, y, u FROM det),
cand AS (SELECT night, 'C' || u AS candidate_id, fi, x - CASE WHEN u%3<>0 THEN 0.0::DOUBLE ELSE 3000.0::DOUBLE END AS x, y, snr FROM det),
ov AS (SELECT c.night, candidate_id, object_id, count(*) AS mf, sqrt(avg(pow(c.x-k.x,2)+pow(c.y-k.y,2))) AS rms, sqrt(max(pow(c.x-k.x,2)+pow(c.y-k.y,2))) AS mx, avg(snr) AS asnr
  FROM cand c JOIN known k ON c.night=k.night AND c.fi=k.fi AND pow(c.x-k.x,2)+pow(c.y-k.y,2) <= 20.25 GROUP BY ALL HAVING count(*) >= 3)
"""

FRAME = "fs AS (SELECT *, frame_no || '/' || filter_name AS frame_id FROM meas)"

SQL = {
    "transient_groups": "WITH RECURSIVE " + q(
        SKY,
        f"""pl AS (SELECT ra_deg, dec_deg, min(detection_id) AS p FROM skyd GROUP BY ALL),
        ed AS (SELECT a.p AS a, b.p AS b FROM pl a JOIN pl b ON abs(a.dec_deg-b.dec_deg) < 0.001 AND {sep('a', 'b')} <= 2.5),
        reach AS (SELECT p AS a, p AS b FROM pl UNION SELECT r.a, ed.b FROM reach r JOIN ed ON r.b=ed.a),
        cm AS (SELECT a AS p, min(b) AS g FROM reach GROUP BY a),
        m AS (SELECT g, s.* FROM skyd s JOIN pl USING (ra_deg, dec_deg) JOIN cm USING (p)),
        v AS (SELECT g, count(*) AS n, count(DISTINCT frame_id) AS nf, max(snr) AS ms, avg(cos(radians(dec_deg))*cos(radians(ra_deg))) AS vx, avg(cos(radians(dec_deg))*sin(radians(ra_deg))) AS vy, avg(sin(radians(dec_deg))) AS vz FROM m GROUP BY g)""",
        """SELECT g AS group_id, n AS detection_count, nf AS frame_count, round(ms,11) AS max_snr, round(degrees(atan2(vy,vx)),11) AS ra_deg,
        round(degrees(asin(vz/sqrt(vx*vx+vy*vy+vz*vz))),11) AS dec_deg FROM v""",
    ).removeprefix("WITH "),
    "transient_candidates": q(
        SKY,
        """g AS (SELECT user_id AS gid, frame_id, avg(flux) AS f, 2.0::DOUBLE+count(*)/10.0::DOUBLE AS fu, max(flux)/4.0 AS ps FROM skyd GROUP BY ALL),
        a AS (SELECT gid, count(*) AS n, count(*) FILTER (f>0 AND f/fu>=5) AS fc, arg_max(f,(f,frame_id)) AS bf, arg_max(fu,(f,frame_id)) AS bu, arg_min(f,(f,frame_id)) AS ff, arg_min(fu,(f,frame_id)) AS fu,
          max(ps) AS pb, min(ps) AS pf, max(f/fu) AS ms, CASE WHEN gid%4=0 THEN gid%9*1.0::DOUBLE END AS ns FROM g GROUP BY gid),
        b AS (SELECT *, (bf-ff)/sqrt(bu*bu+fu*fu) AS vs, (bf+greatest(bu,fu,1.0))/greatest(ff,greatest(bu,fu,1.0)) AS fr FROM a)""",
        """SELECT gid AS group_id, n AS signal_count, fc AS frame_count, round(vs,5) AS variability_snr, round(fr,5) AS flux_ratio, round(ms,5) AS max_snr, ns AS nearest_catalog_separation_arcsec
        FROM b WHERE n>=2 AND bf>0 AND bf/bu>=5 AND bf>ff AND vs>=7 AND (fr>=2 OR ff<=0 OR ff/fu<=2.75 OR (vs>=28 AND fr>=1.35 AND (pb+1)/greatest(pf+1,1)>=1.45)) AND fc>=1
        AND NOT coalesce(ns<=5 AND fr<2,false)""",
    ),
    "tracklet_seeds": q(
        DET,
        """s AS (SELECT a.night, a.u AS start_id, b.u AS end_id, a.fi AS sf, b.fi AS ef, sqrt(pow(b.x-a.x,2)+pow(b.y-a.y,2)) AS dp, b.h-a.h AS dt FROM det a JOIN det b ON a.night=b.night AND b.fi-a.fi BETWEEN 1 AND 2)""",
        """SELECT night, start_id, end_id, CAST(sf AS INT) AS start_frame, CAST(ef AS INT) AS end_frame, round(dp,5) AS displacement_px, round(dp/dt,5) AS motion_px_per_hour FROM s WHERE dp>=1.5 AND dp/dt <= 4.000001""",
    ),
    "known_object_match": q(
        DET,
        """hit AS (SELECT * FROM ov QUALIFY row_number() OVER (PARTITION BY night, candidate_id ORDER BY mf DESC, rms, mx, asnr DESC, candidate_id, object_id)=1
          AND row_number() OVER (PARTITION BY night, object_id ORDER BY mf DESC, rms, mx, asnr DESC, candidate_id, object_id)=1),
        ob AS (SELECT DISTINCT night, object_id FROM known), cd AS (SELECT DISTINCT night, candidate_id FROM cand)""",
        """SELECT night, object_id, candidate_id, mf AS matched_frames, round(rms,5) AS rms_px, round(mx,5) AS max_offset_px, round(asnr,5) AS average_snr,
        CASE WHEN candidate_id IS NULL THEN 'missed' ELSE 'recovered' END AS outcome FROM ob LEFT JOIN hit USING (night, object_id)
        UNION ALL SELECT night, NULL, candidate_id, NULL, NULL, NULL, NULL, 'unmatched' FROM cd WHERE NOT EXISTS (SELECT 1 FROM hit WHERE hit.night=cd.night AND hit.candidate_id=cd.candidate_id)""",
    ),
    "known_objects_in_field": q(
        DET,
        """p AS (SELECT night, fi, object_id, x AS px, y AS py, 10.0::DOUBLE+u%9 AS pm, u%40-5 AS alt, (u%4)::DOUBLE AS tr FROM known WHERE x BETWEEN 0 AND 900 AND y BETWEEN 0 AND 950 AND u%40-5 > 0),
        d4 AS (SELECT * REPLACE (x + CASE WHEN u%4<>0 THEN 0.0::DOUBLE ELSE 30.0::DOUBLE END AS x) FROM det), fr AS (SELECT DISTINCT night, fi FROM d4),
        j AS (SELECT p.*, d.u AS did, d.snr, sqrt(pow(d.x-px,2)+pow(d.y-py,2)) AS o FROM p JOIN fr USING (night, fi) LEFT JOIN d4 d ON d.night=p.night AND d.fi=p.fi AND pow(d.x-px,2)+pow(d.y-py,2) <= 36
          QUALIFY row_number() OVER (PARTITION BY p.night, p.fi, object_id ORDER BY o, did)=1),
        c AS (SELECT *, greatest(0, least(0.99, 0.1 + greatest(0,least(0.25,(15.0-pm)/15.0)) + CASE WHEN snr IS NOT NULL THEN greatest(0,least(0.4,snr/20.0)) ELSE 0 END
          + CASE WHEN o IS NOT NULL THEN greatest(0,0.25*(1-least(o,10.0)/10.0)) ELSE 0 END + CASE WHEN tr>1.5 THEN 0.05 ELSE 0 END - CASE WHEN least(px,py,900-px,950-py)<12 THEN 0.15 ELSE 0 END))::DOUBLE AS cf FROM j)""",
        """SELECT night, CAST(fi AS INT) AS frame_index, object_id, round(px,5) AS px, round(py,5) AS py, did AS detection_id, round(o,5) AS offset_px, round(cf,5) AS confidence,
        CASE WHEN coalesce(snr>=3,false) AND cf>=0.75 THEN 'High-confidence match' WHEN coalesce(snr>=3,false) AND cf>=0.5 THEN 'Plausible visible match' WHEN pm<=15 THEN 'Predicted in field; visual confirmation weak'
        ELSE 'Predicted in field' END AS status FROM c""",
    ),
    "best_variant": q(
        DET,
        """v AS (SELECT u AS object_id, fi AS variant, count(*) FILTER (snr >= 10) AS vc, count(*) FILTER (abs(x-floor(x))*4.0 <= 2.0) AS cm, round(sum(snr),6) AS ss,
          round(median(abs(x-floor(x))*4.0),6) AS mo, round(avg(snr)/50.0,6) AS cf FROM det GROUP BY ALL)""",
        "SELECT object_id, CAST(variant AS BIGINT) AS variant FROM v QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY vc DESC, cm DESC, ss DESC, mo, cf DESC, variant DESC) = 1",
    ),
    "recovery_report": q(
        DET,
        """b AS (SELECT night, object_id, count(*) AS pf FROM known GROUP BY ALL),
        s AS (SELECT k.night, object_id, count(DISTINCT k.fi) AS rf FROM known k JOIN det d ON d.night=k.night AND d.fi=k.fi AND d.pk>15 AND pow(d.x-k.x,2)+pow(d.y-k.y,2)<=20.25 GROUP BY ALL),
        m AS (SELECT night, object_id, count(*) AS oc, max(rms<0.55) AS rec FROM ov GROUP BY ALL)""",
        """SELECT night, object_id, pf AS predicted_frames, coalesce(rf,0) AS residual_frames, coalesce(oc,0) AS overlap_count, CASE WHEN coalesce(rec,false) THEN 'recovered' WHEN coalesce(rf,0)=0 THEN 'no residuals'
        WHEN rf<3 THEN 'too few residual frames' WHEN coalesce(oc,0)=0 THEN 'not linked' ELSE 'conflict' END AS stage FROM b LEFT JOIN s USING (night, object_id) LEFT JOIN m USING (night, object_id)""",
    ),
    "visible_limit": "WITH RECURSIVE " + q(
        MEAS_RAW, FRAME,
        # Walk the bins of a frame in order, as the search is described: count failures in a row, stop at two.
        """t AS (SELECT frame_id, CAST(floor(catalog_magnitude/0.5) AS BIGINT) AS bin, catalog_magnitude AS mag, snr>=5 AND centroid_shift_pixels*2<=5 AS ok,
          count(*) OVER (PARTITION BY frame_id, CAST(floor(catalog_magnitude/0.5) AS BIGINT)) AS stars,
          row_number() OVER (PARTITION BY frame_id, CAST(floor(catalog_magnitude/0.5) AS BIGINT) ORDER BY abs(catalog_magnitude-(CAST(floor(catalog_magnitude/0.5) AS BIGINT)+0.5)*0.5), source_id) AS place FROM fs),
        b AS (SELECT frame_id, bin, any_value(stars) AS stars, CASE WHEN any_value(stars)>=2 THEN count(*) FILTER (ok AND place<=5) ELSE 0 END AS seen, max(mag) FILTER (ok AND place<=5) AS dim FROM t GROUP BY ALL),
        o AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY bin) AS i FROM b),
        walk AS (SELECT frame_id, 0::BIGINT AS i, 0 AS fails, false AS shown, false AS used, NULL::DOUBLE AS good, NULL::DOUBLE AS last_any, 0 AS bins, 0 AS good_bins FROM (SELECT DISTINCT frame_id FROM o)
          UNION ALL SELECT w.frame_id, o.i,
            CASE WHEN o.seen>=2 THEN 0 WHEN o.stars>=2 OR w.shown THEN w.fails+1 ELSE w.fails END, w.shown OR o.seen>0, true,
            CASE WHEN o.seen>=2 THEN o.dim ELSE w.good END, CASE WHEN o.seen>0 THEN o.dim ELSE w.last_any END,
            w.bins + CASE WHEN o.stars>=2 OR w.shown THEN 1 ELSE 0 END, w.good_bins + CASE WHEN o.seen>=2 THEN 1 ELSE 0 END
          FROM walk w JOIN o ON o.frame_id=w.frame_id AND o.i=w.i+1 WHERE w.fails<2),
        z AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY i DESC)=1)""",
        "SELECT frame_id, round(coalesce(good, last_any),5) AS magnitude_limit, CAST(bins AS BIGINT) AS bin_count, CAST(good_bins AS BIGINT) AS seen_bins FROM z WHERE bins > 0",
    ).removeprefix("WITH "),
    "astrometry_check": q(
        MEAS_RAW, FRAME,
        """p AS (SELECT frame_id, source_no AS a, ra_deg*1000 AS x, dec_deg*1000 AS y FROM fs),
        d AS (SELECT frame_id, source_no AS b, ra_deg*1000+1.5+source_no%3*0.4::DOUBLE + CASE WHEN source_no%5<>0 THEN 0.0::DOUBLE ELSE 20000.0::DOUBLE END AS x, dec_deg*1000-0.7 AS y FROM fs),
        j AS (SELECT frame_id, a, b, d.x-p.x AS dx, d.y-p.y AS dy, pow(p.x-d.x,2)+pow(p.y-d.y,2) AS d2 FROM p JOIN d USING (frame_id) WHERE pow(p.x-d.x,2)+pow(p.y-d.y,2)<=36
          QUALIFY row_number() OVER (PARTITION BY frame_id, a ORDER BY d2, b)=1),
        m AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY frame_id, b ORDER BY d2, a)=1),
        s AS (SELECT frame_id, median(dx) AS sx, median(dy) AS sy, count(*) AS mc FROM m GROUP BY ALL),
        r AS (SELECT frame_id, median(sqrt(pow(dx-sx,2)+pow(dy-sy,2))) AS mr FROM m JOIN s USING (frame_id) GROUP BY ALL),
        n AS (SELECT frame_id, count(*) AS sc FROM p GROUP BY ALL)""",
        """SELECT frame_id, sc AS star_count, coalesce(mc,0) AS match_count, round(sx,4) AS shift_x, round(sy,4) AS shift_y, round(mr,4) AS median_residual_px, round(coalesce(mc,0)/sc,4) AS matched_fraction,
        round(sqrt(sx*sx+sy*sy),4) AS coherent_shift_px, CASE WHEN mr<=0.5 AND mc/sc>=0.6 THEN 'approved' WHEN mr<=2.0 AND mc/sc>=0.3 THEN 'approved with warning' ELSE 'rejected' END AS verdict
        FROM n LEFT JOIN s USING (frame_id) LEFT JOIN r USING (frame_id)""",
    ),
    "quality_sample": q(
        MEAS_RAW,
        """s AS (SELECT filter_name, source_id || '/' || frame_no AS sid, ra_deg*1000-10000 AS x, dec_deg*1000-20000 AS y, peak_pixel_value AS peak, 2.0+source_no%7 AS fwhm FROM meas WHERE snr>=4),
        f AS (SELECT *, median(fwhm) OVER (PARTITION BY filter_name) AS fw FROM s),
        g AS (SELECT * FROM f WHERE fwhm BETWEEN fw*0.5 AND fw*2),
        c AS (SELECT filter_name, quantile_cont(peak,0.15) AS p15, quantile_cont(peak,0.65) AS p65, quantile_cont(peak,0.9) AS p90 FROM g GROUP BY ALL),
        h AS (SELECT g.*, abs(ln(peak/p65)) AS o, least(3,CAST(floor(y/250) AS BIGINT))*4+least(3,CAST(floor(x/250) AS BIGINT)) AS cell FROM g JOIN c USING (filter_name) WHERE peak BETWEEN p15 AND p90),
        t AS (SELECT *, row_number() OVER (PARTITION BY filter_name, cell ORDER BY o, sid) AS turn FROM h)""",
        "SELECT filter_name, sid AS source_id, cell, turn, row_number() OVER (PARTITION BY filter_name ORDER BY t.turn, t.cell, sid) AS pick FROM t QUALIFY pick <= 32",
    ),
    "alignment_shift": q(
        MEAS_RAW,
        """r AS (SELECT DISTINCT object_name, ra_deg*1000 AS x, dec_deg*1000 AS y FROM meas),
        a AS (SELECT object_name, frame_no || '/' || object_name AS frame_id, ra_deg*1000+frame_no%4+source_no%3*0.2::DOUBLE AS x, dec_deg*1000-frame_no%3 AS y FROM meas),
        o AS (SELECT frame_id, a.x-r.x AS dx, a.y-r.y AS dy FROM a JOIN r ON a.object_name=r.object_name AND abs(a.x-r.x)<=8 AND abs(a.y-r.y)<=8),
        b AS (SELECT *, CAST(floor(dx+0.5) AS BIGINT) AS bx, CAST(floor(dy+0.5) AS BIGINT) AS bb FROM o),
        f0 AS (SELECT frame_id, bx, bb, count(*) AS c FROM b GROUP BY ALL), f AS (SELECT * FROM f0 QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY c DESC, bx, bb)=1),
        m AS (SELECT frame_id, median(dx) AS mx, median(dy) AS my FROM b JOIN f USING (frame_id, bx, bb) GROUP BY ALL)""",
        """SELECT frame_id, count(*) AS inlier_count, round(median(dx),4) AS shift_x, round(median(dy),4) AS shift_y FROM o JOIN m USING (frame_id)
        WHERE sqrt(pow(dx-mx,2)+pow(dy-my,2))<=1.5 GROUP BY frame_id HAVING count(*)>=3""",
    ),
}
