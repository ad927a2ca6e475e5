"""SQL twins of the catalog queries."""

from oracle.common import CATALOG, MEAS_RAW, VARIABLES, q, sep

REFSTARS = f"""
near AS (SELECT DISTINCT c.source_id FROM catalog c JOIN variables v ON {sep('c', 'v')} < 30),
refstars AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY CASE WHEN magnitude BETWEEN 10 AND 13.5 THEN 0 ELSE 1 END,
  abs(magnitude-12.0), magnitude, source_id) AS rank FROM catalog
  WHERE magnitude BETWEEN 8 AND 16 AND source_id NOT IN (SELECT source_id FROM near) QUALIFY rank <= 25)
"""

PICK = "[{}][CAST(({}) % {} + 1 AS INT)]"


def pick(values, index):
    return PICK.format(", ".join("'" + v + "'" for v in values), index, len(values))


TYPES = {
    "Galaxy": "galaxy", "GlC": "globular_cluster", "PN": "planetary_nebula", "Sy1": "seyfert_galaxy", "HII Region": "hii_region",
    "cluster of galaxies": "galaxy_cluster", "V*": "variable_star", "weird": "", "  dark   nebula": "dark_nebula",
    "Pair of Galaxies": "galaxy_pair", "x": "xray_source", "": "",
}

SQL = {
    "stamp_bands": q(
        MEAS_RAW,
        """SELECT file_path, filter_name, source_id, CASE WHEN source_no%7<>0 THEN round(catalog_magnitude+0.05,5) END AS v_mag,
        CASE WHEN source_no%3<>0 THEN round(catalog_magnitude+0.6,5) END AS b_mag, CASE WHEN source_no%3<>0 THEN 'vsp' END AS b_source FROM meas""",
    ),
    "folder_match": """WITH c AS (SELECT c_custkey AS source_no, regexp_replace(c_name, '#0*', '-') AS name, lower(regexp_replace(c_name, '#0*', ' ')) AS t FROM customer),
        f AS (SELECT source_no, name, CASE source_no%5 WHEN 0 THEN t WHEN 1 THEN t || ' V band' WHEN 2 THEN 'Customer' WHEN 3 THEN 'other field' ELSE '' END AS folder FROM c)
        SELECT *, source_no%5 IN (0, 1, 2) AS kept FROM f""",
    "reference_stars": q(CATALOG, VARIABLES, REFSTARS, "SELECT field, source_id, rank, round(magnitude,6) AS magnitude FROM refstars"),
    "crossmatch_bands": q(
        CATALOG, VARIABLES,
        f"""m0 AS (SELECT c.source_id, v.catalog, v.source_id AS vid, {sep('c', 'v')} AS s FROM catalog c JOIN variables v ON {sep('c', 'v')} <= 2),
        m1 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY source_id, catalog ORDER BY s, vid) = 1),
        b AS (SELECT source_id, 'G' AS band, magnitude AS mag, NULL::DOUBLE AS error, 'gaia-g' AS src, 0 AS g, NULL::DOUBLE AS s FROM catalog
          UNION ALL SELECT source_id, 'V', magnitude, NULL, 'apass', 0, NULL FROM catalog WHERE right(source_id,1) IN ('1','3','5')
          UNION ALL SELECT m1.source_id, 'V', magnitude+0.1, magnitude_error, m1.catalog, 1, s FROM m1 JOIN variables v ON v.source_id=vid
          UNION ALL SELECT m1.source_id, 'B', magnitude+0.6, magnitude_error, m1.catalog, 1, s FROM m1 JOIN variables v ON v.source_id=vid)""",
        """SELECT source_id, band, round(mag,4) AS mag, round(error,4) AS error, src AS band_source, round(s,4) AS separation_arcsec FROM b
        QUALIFY row_number() OVER (PARTITION BY source_id, band ORDER BY CASE src WHEN 'vsp' THEN 3 WHEN 'apass' THEN 2 ELSE 1 END DESC, g DESC, src DESC) = 1""",
    ),
    "nearest_catalog": q(
        CATALOG, VARIABLES,
        f"""d AS (SELECT source_id AS detection_id, ra_deg+0.3 AS ra_deg, dec_deg FROM variables),
        j AS (SELECT detection_id, name, {sep('d', 'c')} AS s FROM d CROSS JOIN catalog c)""",
        """SELECT detection_id, name AS nearest_name, round(s,3) AS separation_arcsec FROM j
        QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY s, name) = 1""",
    ),
    "hr_match": q(
        CATALOG, VARIABLES,
        f"""d AS (SELECT source_id AS detection_id, ra_deg, dec_deg FROM variables UNION ALL
          SELECT source_id || 'b', ra_deg, dec_deg + 0.0001::DOUBLE FROM variables),
        j AS (SELECT detection_id, c.source_id, {sep('d', 'c')} AS s FROM d JOIN catalog c ON {sep('d', 'c')} <= 10.5),
        f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY detection_id ORDER BY s, source_id) = 1)""",
        """SELECT source_id, arg_min(detection_id, (s, detection_id)) AS detection_id, round(min(s),4) AS separation_arcsec,
        count(*) AS detection_count FROM f GROUP BY source_id""",
    ),
    "unique_match": q(
        MEAS_RAW,
        """a AS (SELECT frame_no, filter_name, source_no AS a_id, ra_deg*1000 AS x, dec_deg*1000 AS y FROM meas WHERE is_variable),
        b AS (SELECT frame_no, filter_name, source_no AS b_id, ra_deg*1000 AS x, dec_deg*1000 AS y FROM meas WHERE is_reference),
        j AS (SELECT frame_no, filter_name, a_id, b_id, (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) AS d2 FROM a JOIN b USING (frame_no, filter_name)
          WHERE (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) <= 22500
          QUALIFY row_number() OVER (PARTITION BY frame_no, filter_name, a_id ORDER BY d2, b_id) = 1)""",
        """SELECT frame_no, filter_name, b_id, a_id, round(d2,3) AS d2 FROM j
        QUALIFY row_number() OVER (PARTITION BY frame_no, filter_name, b_id ORDER BY d2, a_id) = 1""",
    ),
    "isolated_sources": q(
        CATALOG, VARIABLES,
        "u AS (SELECT source_id, ra_deg, dec_deg FROM catalog UNION ALL SELECT source_id, ra_deg, dec_deg FROM variables)",
        f"SELECT source_id FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE a.source_id <> b.source_id AND {sep('a', 'b')} < 5)",
    ),
    "cone_search": q(
        CATALOG, VARIABLES,
        f"""c2 AS (SELECT *, 'Obj ' || object_type || (source_no % 3) AS nm FROM catalog),
        j AS (SELECT v.source_id AS query_id, c.source_id, c.nm AS name, c.magnitude, {sep('v', 'c')} AS s FROM variables v JOIN c2 c ON {sep('v', 'c')} <= 28800),
        f AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY query_id, lower(name) ORDER BY s, source_id) = 1)""",
        """SELECT query_id, source_id, name, round(magnitude,6) AS magnitude, round(s,3) AS separation_arcsec,
        row_number() OVER (PARTITION BY query_id ORDER BY s, source_id) AS rank FROM f""",
    ),
    "nearest_snapshot": q(
        """o AS (SELECT o_orderkey AS k, o_custkey % 10 AS site, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))*86400.0::DOUBLE AS t0 FROM orders),
        s AS (SELECT site, k AS snapshot_id, t0 + (k%24)*3600.0 AS sat, 8.0 + k%7 AS lim, k%100 AS rc FROM o WHERE k%2=0),
        w AS (SELECT site, k AS query_id, t0 + 43200.0 AS qa, 8.0 + k%5 AS wl, k%60 AS wr FROM o WHERE k%2=1),
        j AS (SELECT query_id, snapshot_id, abs(qa-sat) AS gap, lim, rc FROM w JOIN s ON w.site=s.site AND lim>=wl AND rc>=wr AND abs(qa-sat)<=64800)""",
        """SELECT query_id, arg_min(snapshot_id, (gap, lim, rc, snapshot_id)) AS snapshot_id, min(gap) AS gap_seconds, count(*) AS candidate_count
        FROM j GROUP BY query_id""",
    ),
    "catalog_union": q(
        CATALOG,
        """t AS (SELECT source_id, field, magnitude, source_no, source_no%4 AS tile FROM catalog UNION ALL
          SELECT source_id, field, magnitude+1.0, source_no, (source_no+2)%4 FROM catalog WHERE source_no%3=0),
        one AS (SELECT *, 'g' || (source_no%4) AS group_id FROM t QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY tile, magnitude) = 1),
        f AS (SELECT group_id, field, count(*) FILTER (source_no%15=0)*100000 + count(*) FILTER (source_no%15<>0) AS score FROM one GROUP BY ALL),
        b AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY score DESC, field DESC) = 1)""",
        "SELECT group_id, field, score, source_id, tile, round(magnitude,6) AS magnitude FROM one JOIN b USING (group_id, field)",
    ),
    "magnitude_filter": q(
        CATALOG,
        f"c AS (SELECT source_no, {pick(['deep_sky', 'gaia_stars', 'variable_stars'], 'source_no')} AS layer, CASE WHEN source_no%5<>0 THEN magnitude END AS m FROM catalog)",
        """SELECT layer, count(*) AS kept_count, count(m) AS known_count, CAST(sum(source_no) AS BIGINT) AS source_no_sum FROM c
        WHERE layer='deep_sky' OR m IS NULL OR m <= 13 GROUP BY layer""",
    ),
    "object_type": q(
        f"""p AS (SELECT p_partkey AS k, {pick(list(TYPES), 'p_partkey')} AS t,
        {pick(['deep_sky', 'general_objects', 'deep_sky', 'exoplanets', 'deep_sky'], 'p_partkey')} AS layer FROM part)""",
        "SELECT k AS source_no, CASE WHEN layer='exoplanets' THEN 'exoplanet_host' "
        + " ".join(f"WHEN t='{a}' THEN '{b}'" for a, b in TYPES.items() if b)
        + " WHEN layer='general_objects' THEN 'general_object' ELSE 'other_deep_sky' END AS type_key FROM p",
    ),
    "designation_keys": """SELECT p_partkey AS source_no, CASE p_partkey%7 WHEN 0 THEN 'NGC' || p_partkey || 'A;B' || p_partkey
        WHEN 1 THEN 'M' || p_partkey WHEN 2 THEN '' WHEN 3 THEN 'IC' || p_partkey || ';LDN' || p_partkey WHEN 4 THEN 'SH2' || p_partkey
        WHEN 5 THEN 'VDB' || p_partkey || ';HASH' || p_partkey ELSE '' END AS keys FROM part""",
    "preferred_identifier": q(
        """c AS (SELECT c_custkey AS k, CAST(c_custkey AS VARCHAR) AS s FROM customer),
        ids AS (SELECT k, 'Gaia DR3 ' || s AS id, 20 AS r, true AS g FROM c WHERE k%5=0 UNION ALL SELECT k, 'Star ' || s, 5, false FROM c WHERE k%5=1
          UNION ALL SELECT k, 'HD ' || s, 0, false FROM c WHERE k%3=0 UNION ALL SELECT k, 'hip ' || s, 0, false FROM c WHERE k%4=0
          UNION ALL SELECT k, 'TIC ' || s, 20, true FROM c WHERE k%2=0 UNION ALL SELECT k, 'ABC ' || s, 5, false FROM c)""",
        "SELECT k AS source_no, arg_min(id, (g, r, length(id), lower(id))) AS preferred FROM ids GROUP BY k",
    ),
    "variable_candidates": q(
        CATALOG, VARIABLES, REFSTARS,
        """SELECT field, source_id, round(magnitude,6) AS magnitude FROM catalog WHERE source_id NOT IN (SELECT source_id FROM refstars)
        AND source_no NOT IN (SELECT source_no*15 FROM variables) AND magnitude BETWEEN 9 AND 17 QUALIFY row_number() OVER (PARTITION BY field ORDER BY catalog.magnitude, lower(name), source_id) <= 60""",
    ),
    "brightest": q(
        CATALOG,
        """c AS (SELECT *, CASE WHEN source_no%9<>0 THEN magnitude END AS m FROM catalog),
        r AS (SELECT object_type, source_id, m, row_number() OVER (PARTITION BY object_type ORDER BY coalesce(m,1e9), lower(name), source_id) AS rank,
          count(*) OVER (PARTITION BY object_type) AS n FROM c)""",
        "SELECT object_type, source_id, round(m,6) AS magnitude, rank FROM r WHERE rank <= greatest(1, floor(n*12.5/100.0))",
    ),
    "comparison_candidates": q(
        CATALOG, VARIABLES,
        """t AS (SELECT source_id AS target_id, ra_deg, dec_deg + 0.02::DOUBLE AS dec_deg, magnitude, CASE WHEN source_no%2=0 THEN 0.2::DOUBLE + source_no%25/10.0::DOUBLE END AS c FROM variables),
        j AS (SELECT t.target_id, r.source_id, r.name, degrees(acos(least(1.0, greatest(-1.0, sin(radians(t.dec_deg))*sin(radians(r.dec_deg))
          + cos(radians(t.dec_deg))*cos(radians(r.dec_deg))*cos(radians(t.ra_deg)-radians(r.ra_deg))))))*60 AS s, abs(r.magnitude-t.magnitude) AS dm,
          abs(r.bp_rp-t.c) AS dc FROM t, catalog r),
        k AS (SELECT *, dm/2.0 + coalesce(dc/0.6,0) + s/600.0 AS score FROM j WHERE s<=600 AND dm<=2.0 AND coalesce(dc<=0.6,true))""",
        """SELECT target_id, source_id, round(s,6) AS separation_arcmin, round(dm,6) AS delta_mag, round(dc,6) AS delta_color, round(score,6) AS score,
        row_number() OVER (PARTITION BY target_id ORDER BY k.score, s, lower(name), source_id) AS rank FROM k QUALIFY rank <= 10""",
    ),
    "comparison_sets": q(
        CATALOG, VARIABLES, REFSTARS, "f AS (SELECT * FROM refstars WHERE rank <= 7)",
        """SELECT a.field, a.source_id || '|' || b.source_id || '|' || c.source_id AS set_id FROM f a JOIN f b ON a.field=b.field AND a.rank<b.rank
        JOIN f c ON c.field=b.field AND b.rank<c.rank""",
    ),
    "catalog_search": q(
        """p AS (SELECT p_partkey AS source_no, p_name AS name, p_size::DOUBLE AS m, p_partkey%2=0 AS star,
          [lower(p_name), lower(p_brand), lower(p_type), replace(lower(p_name),' ',''), replace(lower(p_brand),' ',''), replace(lower(p_type),' ','')] AS e FROM part),
        r AS (SELECT *, CASE WHEN list_contains(e,'red') THEN 0 WHEN len(list_filter(e, lambda x: starts_with(x,'red')))>0 THEN 1
          WHEN len(list_filter(e, lambda x: contains(x,'red')))>0 THEN 2 END AS match_rank FROM p WHERE m <= 25)""",
        """SELECT source_no, name, m AS magnitude, CAST(match_rank AS BIGINT) AS match_rank FROM r WHERE match_rank IS NOT NULL
        ORDER BY r.match_rank, m, lower(name), source_no LIMIT 80""",
    ),
    "distance_map": q(
        CATALOG,
        """m AS (SELECT *, 1000.0/parallax_mas AS d, parallax_mas/parallax_error_mas AS snr FROM catalog WHERE parallax_mas/parallax_error_mas >= 5
          AND 1000.0/parallax_mas <= 500)""",
        """SELECT source_id, round(magnitude,4) AS magnitude, round(d,4) AS distance_pc, round(snr,4) AS parallax_snr,
        round(1000.0/(parallax_mas+parallax_error_mas),4) AS near_pc, round(1000.0/greatest(parallax_mas-parallax_error_mas,1e-6),4) AS far_pc,
        round(d*cos(radians(dec_deg))*cos(radians(ra_deg)),4) AS x_pc, round(d*cos(radians(dec_deg))*sin(radians(ra_deg)),4) AS y_pc,
        round(d*sin(radians(dec_deg)),4) AS z_pc FROM m""",
    ),
    "distance_rejections": q(
        CATALOG,
        """m AS (SELECT field, CASE WHEN source_no%11<>0 THEN CASE WHEN source_no%13=0 THEN -parallax_mas ELSE parallax_mas END END AS p, CASE WHEN source_no%17<>0 THEN parallax_error_mas END AS e FROM catalog)""",
        """SELECT field, CASE WHEN e IS NULL OR p IS NULL OR p <= 0 OR p/e < 5 THEN 'low_snr' WHEN 1000.0/p > 500 THEN 'distance' ELSE 'kept' END AS outcome, count(*) AS star_count FROM m GROUP BY ALL""",
    ),
    "cluster_distance": q(
        CATALOG,
        """SELECT object_type, count(*) AS member_count,
        round(1000.0/(sum(parallax_mas/(parallax_error_mas*parallax_error_mas))/sum(1/(parallax_error_mas*parallax_error_mas))),4) AS mean_distance_pc,
        round(median(1000.0/parallax_mas),4) AS median_distance_pc FROM catalog GROUP BY object_type""",
    ),
    "catalog_dedupe": q(
        CATALOG, VARIABLES,
        f"""p AS (SELECT *, 'al' || (source_no%700) AS al FROM catalog),
        s AS (SELECT *, 'al' || (source_no*11) AS al FROM variables),
        st AS (SELECT source_id FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE round(p.ra_deg,4)=round(s.ra_deg,4) AND round(p.dec_deg,4)=round(s.dec_deg,4))
          AND NOT EXISTS (SELECT 1 FROM p WHERE p.source_no%3=0 AND {sep('p', 's')} <= 432.0)),
        ds AS (SELECT source_id FROM s WHERE al NOT IN (SELECT al FROM p) AND NOT EXISTS (SELECT 1 FROM p WHERE round(p.ra_deg,3)=round(s.ra_deg,3)
          AND round(p.dec_deg,3)=round(s.dec_deg,3))),
        u AS (SELECT 'primary' AS origin, source_id FROM p UNION ALL SELECT 'secondary', source_id FROM st UNION ALL
          SELECT 'deep_sky', source_id FROM p UNION ALL SELECT 'deep_sky', source_id FROM ds)""",
        "SELECT origin, count(*) AS row_count, min(source_id) AS first_id, max(source_id) AS last_id FROM u GROUP BY origin",
    ),
    "entity_resolution": "WITH RECURSIVE " + """
        o AS (SELECT p_partkey AS k, CASE p_partkey%3 WHEN 0 THEN 'NGC ' || (p_partkey%400) WHEN 1 THEN 'M ' || (p_partkey%300) ELSE 'Obj' || p_partkey END AS name,
          CASE p_partkey%3 WHEN 0 THEN 'NGC' || (p_partkey%400) WHEN 1 THEN 'M' || (p_partkey%300) END AS dk,
          (p_retailprice/5.0) % 360.0 AS ra, (p_partkey%50)*1.5::DOUBLE AS dec, CASE WHEN p_partkey%4<>0 THEN p_size::DOUBLE END AS m,
          (p_partkey%17)::DOUBLE AS sz FROM part),
        keys AS (SELECT k, 'p' || CAST(round(ra*360) AS BIGINT) || '|' || CAST(round(dec*360) AS BIGINT) AS key FROM o
          UNION ALL SELECT k, dk FROM o WHERE dk IS NOT NULL),
        e AS (SELECT DISTINCT a.k AS a, b.k AS b FROM keys a JOIN keys b USING (key)),
        reach AS (SELECT k AS a, k AS b FROM o UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
        comp AS (SELECT a AS k, min(b) AS c FROM reach GROUP BY a)
        SELECT c AS seen_order, arg_min(name, k) AS name, arg_min(m, k) FILTER (m IS NOT NULL) AS magnitude, max(sz) AS size_arcmin, count(*) AS merged_count
        FROM o JOIN comp USING (k) GROUP BY c""",
    "layer_summary": q(
        CATALOG,
        """o AS (SELECT source_id, field, object_type AS layer, magnitude, source_no%4<>0 AS in_frame, (source_no%31)::DOUBLE AS dist FROM catalog),
        s AS (SELECT * FROM o WHERE in_frame QUALIFY row_number() OVER (PARTITION BY field, layer ORDER BY magnitude, source_id) <= 12),
        l AS (SELECT field, layer, count(*) AS returned_count, count(*) FILTER (in_frame) AS in_frame_count FROM o GROUP BY ALL),
        r AS (SELECT field, layer, count(*) AS n, max(magnitude) AS mx, avg(dist) AS ad FROM s GROUP BY ALL)""",
        """SELECT field, layer, returned_count, in_frame_count, coalesce(n,0) AS displayed_count, round(mx,6) AS faintest_magnitude,
        round(ad,6) AS mean_distance_arcmin FROM l LEFT JOIN r USING (field, layer)""",
    ),
    "prediction_merge": q(
        """o AS (SELECT 'obj' || (c_custkey%1200) AS identity, c_custkey AS prediction_id, c_acctbal AS magnitude, (c_custkey%50)::DOUBLE AS ra_rate, 1.0::DOUBLE AS uncertainty
          FROM customer QUALIFY row_number() OVER (PARTITION BY identity ORDER BY c_custkey) = 1),
        a AS (SELECT 'obj' || (s_suppkey*20) AS identity, s_suppkey AS prediction_id, CASE WHEN s_suppkey%2=0 THEN s_acctbal END AS magnitude,
          CASE WHEN s_suppkey%3=0 THEN s_suppkey::DOUBLE END AS ra_rate FROM supplier)""",
        """SELECT coalesce(a.identity, o.identity) AS identity, coalesce(a.prediction_id, o.prediction_id) AS prediction_id,
        coalesce(a.magnitude, o.magnitude) AS magnitude, coalesce(a.ra_rate, o.ra_rate) AS ra_rate, o.uncertainty,
        CASE WHEN a.identity IS NULL THEN 'existing' WHEN o.identity IS NULL THEN 'authoritative' ELSE 'merged' END AS origin
        FROM o FULL OUTER JOIN a ON o.identity = a.identity""",
    ),
    "cluster_match": q(
        CATALOG, VARIABLES,
        f"""f AS (SELECT field, ra_deg, dec_deg, 5.0::DOUBLE + source_no AS r FROM catalog WHERE source_no < 10),
        e AS (SELECT source_id AS entry_id, ra_deg, dec_deg, 4.0::DOUBLE + source_no%5 AS vr FROM variables),
        n AS (SELECT c.field, e.entry_id, count(*) AS star_count FROM catalog c JOIN e ON {sep('c', 'e')} <= vr*1.15*3600 GROUP BY ALL),
        p AS (SELECT f.field, e.entry_id, coalesce(n.star_count,0) AS star_count, {sep('f', 'e')}/3600 AS s, {sep('f', 'e')} <= (greatest(0.1,r)+vr+0.35)*3600 AS in_footprint
          FROM f CROSS JOIN e LEFT JOIN n ON n.field=f.field AND n.entry_id=e.entry_id),
        g AS (SELECT *, star_count*10.0 + CASE WHEN in_footprint THEN 100.0 ELSE 0 END - s AS score FROM p WHERE in_footprint OR star_count>=5)""",
        """SELECT field, entry_id, star_count, in_footprint, round(score,6) AS score FROM g
        QUALIFY row_number() OVER (PARTITION BY field ORDER BY g.score DESC, entry_id DESC) = 1""",
    ),
    "cluster_members": q(
        CATALOG, VARIABLES,
        f"""f AS (SELECT field, ra_deg, dec_deg, 5.0::DOUBLE + source_no AS r FROM catalog WHERE source_no < 10),
        e AS (SELECT source_id AS entry_id, ra_deg, dec_deg, 4.0::DOUBLE + source_no%5 AS vr FROM variables),
        n AS (SELECT c.field, e.entry_id, count(*) AS star_count FROM catalog c JOIN e ON {sep('c', 'e')} <= vr*1.15*3600 GROUP BY ALL),
        p AS (SELECT f.field, e.entry_id, coalesce(n.star_count,0) AS star_count, {sep('f', 'e')}/3600 AS s, {sep('f', 'e')} <= (greatest(0.1,r)+vr+0.35)*3600 AS in_footprint
          FROM f CROSS JOIN e LEFT JOIN n ON n.field=f.field AND n.entry_id=e.entry_id),
        b AS (SELECT field, entry_id FROM p WHERE in_footprint OR star_count>=5 QUALIFY row_number() OVER (PARTITION BY field ORDER BY star_count*10.0 + CASE WHEN in_footprint THEN 100.0 ELSE 0 END - s DESC, entry_id DESC) = 1)""",
        f"""SELECT c.field, e.entry_id, c.source_id, round({sep('c', 'e')}/3600,5) AS separation_deg FROM catalog c JOIN b USING (field) JOIN e ON e.entry_id = b.entry_id WHERE {sep('c', 'e')}/3600 <= vr*1.15""",
    ),
    "adu_screen": q(
        MEAS_RAW,
        """SELECT filter_name, count(*) AS row_count, count(DISTINCT source_id) AS source_count, max(peak_pixel_value*10) AS top_peak FROM meas
        WHERE peak_pixel_value*10 - flux*0.2 >= 1000 AND peak_pixel_value*10 <= 4500*0.8 AND NOT is_saturated GROUP BY filter_name""",
    ),
    "mag_error": q(MEAS_RAW, "SELECT file_path, filter_name, source_id, round(1.085736*flux_error/flux,6) AS mag_error FROM meas"),
    "ccd_flux_error": q(
        """e AS (SELECT event_id, value*100-500 AS f, value AS sky, 1.0::DOUBLE + user_id%60 AS a, (user_id%7)*100.0::DOUBLE AS n FROM events),
        p AS (SELECT *, greatest(sky,0)*2.0 + 0.02::DOUBLE*60.0 + 25.0 AS pp FROM e)""",
        """SELECT event_id, CASE WHEN f < 40000 THEN round(sqrt(greatest(f,0)*2.0 + a*pp + CASE WHEN n>0 THEN a*a/n*pp ELSE 0 END)/2.0,5) END AS flux_error FROM p""",
    ),
    "error_budget": q(
        MEAS_RAW,
        """g AS (SELECT file_path, filter_name, count(*) AS n, avg(flux) AS f, sqrt(sum(flux_error*flux_error))/count(*) AS e FROM meas WHERE is_reference GROUP BY ALL),
        h AS (SELECT *, 1.085736*e/f AS t, 1.085736*0.09*pow(28.0,-2.0/3.0)*pow(1.0+n%3*0.25,1.75)*exp(-500.0/8000)/sqrt(120.0)*sqrt(1+1.0/n) AS s FROM g)""",
        """SELECT file_path, filter_name, n AS comparison_count, round(t,7) AS ensemble_mag_error, round(s,7) AS scintillation_error,
        round(sqrt(t*t+0.0001+s*s),7) AS total_mag_error FROM h""",
    ),
    "phase_fold": q(
        MEAS_RAW,
        """a AS (SELECT source_id, filter_name, arg_max(observation_time, (instrumental_magnitude, -observation_time)) AS t0, min(source_no) AS u
          FROM meas WHERE NOT is_reference GROUP BY ALL),
        p AS (SELECT file_path, filter_name, source_id, ((observation_time/86400.0+2440587.5) - (t0/86400.0+2440587.5))/(0.3::DOUBLE+u%10/20.0::DOUBLE) AS c
          FROM meas JOIN a USING (source_id, filter_name) WHERE NOT is_reference)""",
        "SELECT file_path, filter_name, source_id, round(c - floor(c),4) AS phase FROM p",
    ),
    "hr_diagram": q(
        CATALOG,
        """c AS (SELECT *, magnitude - 25.0 + source_no%11/100.0::DOUBLE AS ins FROM catalog),
        z AS (SELECT field, median(magnitude-ins) AS zp FROM c WHERE source_no%6<>0 GROUP BY field)""",
        """SELECT source_id, field, round(bp_rp,5) AS bp_rp, round(magnitude+5*log10(parallax_mas)-10,5) AS absolute_magnitude,
        round(ins+zp,5) AS calibrated_magnitude FROM c JOIN z USING (field)""",
    ),
    "moonlight_score": q(
        """e AS (SELECT event_id, (user_id%180)::DOUBLE AS al, value%90-10 AS ma, (user_id%91)::DOUBLE AS ta, greatest(0.05, value%170) AS rho, 360000.0::DOUBLE+user_id*300 AS dk FROM events),
        f AS (SELECT *, pow(10,-0.4*(3.84+0.026*al+4.0e-9*pow(al,4)))*pow(384400.0/dk,2) AS lunar,
          CASE WHEN rho<10 THEN 6.2e7/(rho*rho) ELSE pow(10,5.36)*(1.06+pow(cos(radians(rho)),2))+pow(10,6.15-rho/40) END AS sc,
          pow(greatest(1e-6,1-0.96*pow(sin(radians(least(90,greatest(0,90-ma)))),2)),-0.5) AS xm,
          pow(greatest(1e-6,1-0.96*pow(sin(radians(90-ta)),2)),-0.5) AS xt FROM e),
        g AS (SELECT event_id, CASE WHEN ma<=0 THEN 0 ELSE greatest(0,sc*lunar*pow(10,-0.4*0.172*xm)*(1-pow(10,-0.4*0.172*xt))) END AS b FROM f),
        h AS (SELECT *, CASE WHEN b<=0 THEN 0 ELSE least(100.0,100.0*abs(-2.5*log10((b+79.0)/79.0))/4.5) END AS s FROM g)""",
        """SELECT event_id, round(b::DOUBLE,4) AS moonlight_nl, round(s::DOUBLE,4) AS moonlight_score,
        CASE WHEN s<20 THEN 'Low' WHEN s<40 THEN 'Moderate' WHEN s<65 THEN 'High' ELSE 'Severe' END AS moonlight_category FROM h""",
    ),
    "reference_ranking": q(
        MEAS_RAW,
        """u AS (SELECT * FROM meas WHERE flux>0 AND NOT is_saturated AND NOT (peak_pixel_value/450.0>=0.95)),
        s AS (SELECT object_name, filter_name, source_id, is_reference, min(source_name) AS nm, min(ra_deg) AS ra, min(dec_deg) AS dec, min(catalog_magnitude) AS m FROM u GROUP BY ALL),
        j AS (SELECT t.object_name, t.filter_name, t.source_id, r.source_id AS reference_id, r.nm, abs(r.m-t.m) AS dm, (r.ra-t.ra)*(r.ra-t.ra)+(r.dec-t.dec)*(r.dec-t.dec) AS d2
          FROM s t JOIN s r ON t.object_name=r.object_name AND t.filter_name=r.filter_name AND NOT t.is_reference AND r.is_reference AND abs(r.m-t.m)<=0.75)""",
        """SELECT object_name, filter_name, source_id, reference_id, row_number() OVER (PARTITION BY object_name, filter_name, source_id ORDER BY dm, j.d2, lower(nm), reference_id) AS rank,
        round(dm,6) AS delta_mag, round(d2,6) AS d2 FROM j QUALIFY rank <= 8""",
    ),
    "fallback_ranking": q(
        MEAS_RAW,
        """mc AS (SELECT *, CASE WHEN source_no%3=0 THEN instrumental_magnitude + 22.0 END AS cal, CASE WHEN source_no%5<>1 THEN catalog_magnitude END AS cat FROM meas),
        kn AS (SELECT DISTINCT source_id, CASE WHEN source_no%4=0 THEN 8.0::DOUBLE + (source_no%80)/10.0::DOUBLE WHEN source_no%16=1 THEN 9.0::DOUBLE END AS km FROM meas WHERE source_no%8<>4),
        tg AS (SELECT object_name, filter_name, source_id, arg_min(ra_deg, (observation_time, file_path)) AS ra, arg_min(dec_deg, (observation_time, file_path)) AS de, median(cal) AS mcal, median(cat) AS mcat
          FROM mc WHERE NOT is_reference GROUP BY ALL),
        tm AS (SELECT tg.*, coalesce(km, mcal, mcat) AS tmag FROM tg LEFT JOIN kn USING (source_id)),
        rf AS (SELECT object_name, filter_name, source_id AS reference_id, arg_min(ra_deg, (observation_time, file_path)) AS rra, arg_min(dec_deg, (observation_time, file_path)) AS rde,
          lower(arg_min(source_name, (observation_time, file_path))) AS nm FROM mc WHERE is_reference AND flux>0 AND NOT is_saturated AND NOT (peak_pixel_value/450.0>=0.95) GROUP BY ALL),
        rm AS (SELECT rf.*, km AS rmag FROM rf LEFT JOIN kn ON kn.source_id = rf.reference_id),
        j AS (SELECT tm.object_name, tm.filter_name, tm.source_id, reference_id, nm, tmag, rmag, (rra-ra)*(rra-ra)+(rde-de)*(rde-de) AS d2, CASE WHEN tmag IS NOT NULL AND rmag IS NULL THEN 1 ELSE 0 END AS uk,
          CASE WHEN tmag IS NOT NULL THEN coalesce(abs(rmag-tmag), 0) ELSE 0 END AS ofs FROM tm JOIN rm USING (object_name, filter_name))""",
        """SELECT object_name, filter_name, source_id, reference_id, row_number() OVER (PARTITION BY object_name, filter_name, source_id ORDER BY uk, ofs, j.d2, nm, reference_id) AS rank,
        round(tmag,6) AS target_magnitude, CASE WHEN tmag IS NOT NULL AND rmag IS NOT NULL THEN round(ofs,6) END AS delta_mag, round(d2,6) AS d2 FROM j QUALIFY rank <= 8""",
    ),
    "sampled_sets": q(
        CATALOG, VARIABLES, REFSTARS,
        """f AS (SELECT field, source_id, rank AS p, count(*) OVER (PARTITION BY field) AS n FROM refstars WHERE rank <= 20),
        al AS (SELECT a.field, a.source_id || '|' || b.source_id || '|' || c.source_id || '|' || d.source_id AS set_id, row_number() OVER (PARTITION BY a.field ORDER BY a.p, b.p, c.p, d.p) - 1 AS no, count(*) OVER (PARTITION BY a.field) AS total
          FROM f a JOIN f b ON a.field=b.field AND a.p<b.p JOIN f c ON c.field=b.field AND b.p<c.p JOIN f d ON d.field=c.field AND c.p<d.p),
        pk AS (SELECT al.field, set_id, 2 AS kind, i FROM al JOIN (SELECT DISTINCT field, total FROM al WHERE total > 200) t USING (field), (SELECT unnest(range(200)) AS i) g WHERE no = (i*2147483647) % al.total
          UNION ALL SELECT field, set_id, 0, no FROM al WHERE total <= 200
          UNION ALL SELECT field, set_id, 1, 0 FROM al WHERE total > 200 AND no = 0
          UNION ALL SELECT a.field, string_agg(a.source_id, '|' ORDER BY a.p), 0, 0 FROM (SELECT *, row_number() OVER (PARTITION BY field ORDER BY p) AS k FROM f WHERE p%3=0) a JOIN (SELECT DISTINCT field FROM al WHERE total > 200) t USING (field)
            WHERE k <= 4 GROUP BY a.field HAVING count(*) = 4),
        oc AS (SELECT field, set_id, min((kind, i)) AS o FROM pk GROUP BY ALL)""",
        "SELECT field, set_id FROM oc QUALIFY row_number() OVER (PARTITION BY field ORDER BY o, set_id) <= 200",
    ),
    "prediction_identity": q(
        """ex AS (SELECT c_custkey AS id, CASE WHEN c_custkey%3<>0 THEN 'Obj ' || (c_custkey%900) END AS name, CASE WHEN c_custkey%2=0 THEN '2020 AB' || (c_custkey%1300) END AS designation,
          c_acctbal::DOUBLE AS magnitude, (c_custkey%50)::DOUBLE AS ra_rate, 'b' AS side FROM customer),
        au AS (SELECT s_suppkey, CASE WHEN s_suppkey%2=0 THEN 'OBJ-' || (s_suppkey*7) END, CASE WHEN s_suppkey%3<>0 THEN '2020ab' || (s_suppkey*6) END, CASE WHEN s_suppkey%4<>0 THEN s_acctbal::DOUBLE END, NULL, 'a' FROM supplier),
        al AS (SELECT side || '/' || lpad(CAST(id AS VARCHAR), 19, '0') AS row, * FROM (SELECT * FROM ex UNION ALL SELECT * FROM au)),
        ky AS (SELECT DISTINCT row, k FROM (SELECT row, unnest([regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), regexp_replace(lower(designation), '[^a-z0-9]', '', 'g')]) AS k FROM al) WHERE k <> ''),
        fi AS (SELECT k, min(row) AS b FROM ky GROUP BY k),
        lk AS MATERIALIZED (SELECT DISTINCT row AS a, b FROM ky JOIN fi USING (k) UNION SELECT b, row FROM ky JOIN fi USING (k)),
        cc AS (SELECT row, row AS root FROM al UNION SELECT lk.b, cc.root FROM cc JOIN lk ON lk.a = cc.row),
        co AS (SELECT row, min(root) AS c FROM cc GROUP BY row),
        g AS (SELECT c, count(*) AS matched_rows, arg_min(id, row) FILTER (side='a') AS aid, arg_min(id, row) FILTER (side='b') AS bid FROM al JOIN co USING (row) GROUP BY c)""",
        """SELECT coalesce(aid, bid) AS prediction_id, coalesce(a.name, b.name) AS name, coalesce(a.designation, b.designation) AS designation, coalesce(a.magnitude, b.magnitude) AS magnitude,
        coalesce(a.ra_rate, b.ra_rate) AS ra_rate, CASE WHEN aid IS NULL THEN 'existing' WHEN bid IS NULL THEN 'authoritative' ELSE 'merged' END AS origin, matched_rows
        FROM g LEFT JOIN al a ON a.side='a' AND a.id=aid LEFT JOIN al b ON b.side='b' AND b.id=bid""",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
}
SQL["snapshot_entries"] = f"""SELECT query_id, snapshot_id, l_linenumber::BIGINT AS rank, l_partkey AS object_no, round(l_extendedprice::DOUBLE, 6) AS brightness
  FROM ({SQL['nearest_snapshot']}) s JOIN lineitem ON l_orderkey = snapshot_id"""
SQL["folder_references"] = q(
    CATALOG, VARIABLES, REFSTARS, f"kp AS ({SQL['folder_match']})",
    "bo AS (SELECT source_id, field, magnitude, true AS is_extra FROM kp JOIN catalog USING (source_no) WHERE kept UNION ALL SELECT source_id, field, magnitude, false FROM refstars)",
    "SELECT source_id, field, round(magnitude,6) AS magnitude, is_extra FROM bo QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY NOT is_extra, field) = 1",
)
