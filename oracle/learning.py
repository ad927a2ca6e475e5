"""SQL twins of the clustering and classifier queries."""

from oracle.common import CATALOG, DIFF, MEAS_RAW, PAIRS, QUALITY, q
from oracle.linking import DET, SKY
from oracle.linking import SQL as LINKING
from oracle.photometry import METRICS


def groups(rows: str, strict: float, refine: bool) -> str:
    """Brute-force density clusters of ``rows`` (field, star, a, b, p[, u, v])."""
    z = ", ".join(
        f"(x.{c}-m.m{c})/CASE WHEN CASE WHEN d{c}>1e-9 THEN d{c}*1.4826 ELSE s{c} END > 1e-9 THEN CASE WHEN d{c}>1e-9 THEN d{c}*1.4826 ELSE s{c} END ELSE 1 END AS z{c}" for c in "abp"
    )
    dist = "sqrt((a.za-b.za)*(a.za-b.za)+(a.zb-b.zb)*(a.zb-b.zb)+(a.zp-b.zp)*(a.zp-b.zp))"
    tail = "SELECT field, star, round(eps,6) AS eps, ms AS min_samples, used AS used_parallax, cc AS cluster_count, mc AS member_count FROM mem"
    refined = f"""
      , rm AS (SELECT field, median(u) AS mu, median(v) AS mv, stddev_pop(u) AS su, stddev_pop(v) AS sv FROM mem GROUP BY field),
      rd AS (SELECT field, median(abs(u-mu)) AS du, median(abs(v-mv)) AS dv FROM mem JOIN rm USING (field) GROUP BY field),
      rz AS (SELECT mem.*, (u-mu)/(CASE WHEN du>1e-9 THEN du*1.4826 ELSE su END) AS zu, (v-mv)/(CASE WHEN dv>1e-9 THEN dv*1.4826 ELSE sv END) AS zv FROM mem JOIN rm USING (field) JOIN rd USING (field)),
      rk AS (SELECT a.field, a.star, sqrt((a.zu-b.zu)*(a.zu-b.zu)+(a.zv-b.zv)*(a.zv-b.zv)) AS kth FROM rz a JOIN rz b ON a.field=b.field AND a.star<>b.star
        QUALIFY row_number() OVER (PARTITION BY a.field, a.star ORDER BY kth, b.star)=3),
      rq AS (SELECT field, median(kth) AS km FROM rk GROUP BY field), rw AS (SELECT field, median(abs(kth-km)) AS kd FROM rk JOIN rq USING (field) GROUP BY field),
      rf AS (SELECT rk.field, star, kth <= km + greatest(km*{0.4 + 0.2 * strict}, {max(1.2, 2.4 * strict)}*greatest(0.05,kd)) AS fine FROM rk JOIN rq USING (field) JOIN rw USING (field)),
      rt AS (SELECT field, count(*) AS h, count(*) FILTER (fine) AS k FROM rf GROUP BY field)
    SELECT mem.field, mem.star, round(eps,6) AS eps, ms AS min_samples, used AS used_parallax, cc AS cluster_count, mc AS member_count FROM mem JOIN rf USING (field, star) JOIN rt USING (field)
    WHERE fine OR NOT (h>=5 AND k>=greatest(4,ceil(h*0.6)) AND mc-(h-k) >= greatest(4,ceil(mc*0.6)))"""
    return f"""
st AS (SELECT field, count(*) FILTER (p>0) >= greatest(6, ceil(count(*)*0.35)) AS used FROM ({rows}) GROUP BY field),
x AS (SELECT r.* REPLACE (CASE WHEN used THEN p ELSE 0 END AS p), used FROM ({rows}) r JOIN st USING (field) WHERE NOT used OR p > 0),
m AS (SELECT field, count(*) AS n, median(a) AS ma, median(b) AS mb, median(p) AS mp, stddev_pop(a) AS sa, stddev_pop(b) AS sb, stddev_pop(p) AS sp FROM x GROUP BY field),
dd AS (SELECT field, median(abs(a-ma)) AS da, median(abs(b-mb)) AS db, median(abs(p-mp)) AS dp FROM x JOIN m USING (field) GROUP BY field),
z AS (SELECT x.*, CAST(greatest(5, least(12, round_even(sqrt(n),0))) AS BIGINT) AS ms, {z} FROM x JOIN m USING (field) JOIN dd USING (field) WHERE n >= 5),
kd AS (SELECT a.field, a.star, {dist} AS kth, a.ms FROM z a JOIN z b ON a.field=b.field AND a.star<>b.star QUALIFY row_number() OVER (PARTITION BY a.field, a.star ORDER BY kth, b.star) = a.ms),
ep AS (SELECT field, least(2.4, greatest(0.25, quantile_cont(kth,0.3)*1.25*{strict})) AS eps FROM kd GROUP BY field),
nb AS (SELECT a.field, a.star AS s, b.star AS o, a.ms FROM z a JOIN z b ON a.field=b.field JOIN ep ON ep.field=a.field WHERE {dist} <= eps),
co AS (SELECT field, s FROM nb GROUP BY field, s, ms HAVING count(*) >= ms),
ce AS (SELECT nb.field, nb.s AS c1, nb.o AS c2 FROM nb JOIN co ON co.field=nb.field AND co.s=nb.s JOIN co c2 ON c2.field=nb.field AND c2.s=nb.o),
reach AS (SELECT field, s AS r1, s AS r2 FROM co UNION SELECT r.field, r.r1, ce.c2 FROM reach r JOIN ce ON ce.field=r.field AND ce.c1=r.r2),
cm AS (SELECT field, r1 AS s, min(r2) AS c FROM reach GROUP BY field, r1),
lb AS (SELECT nb.field, nb.o AS star, min(c) AS c FROM nb JOIN cm ON cm.field=nb.field AND cm.s=nb.s GROUP BY nb.field, nb.o),
cs AS (SELECT field, c, count(*) AS mc, count(*) OVER (PARTITION BY field) AS cc FROM lb GROUP BY field, c),
bs AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY field ORDER BY mc DESC, c)=1),
mem AS (SELECT z.*, eps, mc, cc FROM lb JOIN bs USING (field, c) JOIN z USING (field, star) JOIN ep USING (field) WHERE mc >= ms)
{refined if refine else tail}"""


MOTION = """SELECT 'f' || (label%3) AS field, vec_id AS star, embedding[1]::DOUBLE*10.0 AS a, embedding[2]::DOUBLE*10.0 AS b, embedding[3]::DOUBLE+0.15 AS p,
 embedding[4]::DOUBLE AS u, embedding[5]::DOUBLE AS v FROM embeddings"""
DISTANCE = """SELECT object_type AS field, source_no AS star, source_no%37+bp_rp AS a, source_no%23+magnitude/10.0 AS b, parallax_mas::DOUBLE AS p FROM catalog"""

LABELS = """
l0 AS (SELECT doc_id, CASE WHEN quality=1 THEN 'real' ELSE 'artefact' END AS label, doc_id AS updated FROM labels
  UNION ALL SELECT doc_id, CASE WHEN toxic=1 THEN 'artefact' ELSE 'real' END, doc_id+100000 FROM labels WHERE doc_id%5=0),
l1 AS (SELECT * FROM l0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY updated DESC)=1)
"""

SQL = {
    "motion_groups": "WITH RECURSIVE " + groups(MOTION, 1.0, True).strip(),
    "distance_clusters": "WITH RECURSIVE " + CATALOG.strip() + ", " + groups(DISTANCE, 1.2, False).strip(),
    "candidate_features": q(
        SKY,
        f"vc AS ({LINKING['transient_candidates']})",
        """t AS (SELECT s.*, epoch_us(ts)/1e6 AS ot, s.flux*1.5 AS pk, CASE WHEN detection_id%3=0 THEN detection_id%40*0.1::DOUBLE END AS ns FROM skyd s JOIN events e ON e.event_id=s.detection_id)""",
        """SELECT user_id, count(DISTINCT frame_id) AS frame_count, count(*) AS detection_count, round(max(snr),5) AS max_snr, round(stddev_pop(snr),5) AS snr_stddev, round(min(snr),5) AS snr_min,
        round(max(flux),5) AS flux_max, round(min(flux),5) AS flux_min, round(max(pk),5) AS peak_max, round(max(ot)-min(ot),5) AS observation_span_seconds, round(median(snr),5) AS median_snr,
        round(median(flux),5) AS flux_median, round(median(pk),5) AS peak_median, round(median(abs(flux)),5) AS flux_abs_median, round(count(*)/count(DISTINCT frame_id),5) AS detection_fraction,
        CASE WHEN count(ns)>0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_catalog_neighbor, round(coalesce(min(ns),9999.0::DOUBLE),5) AS nearest_catalog_separation_arcsec,
        round(count(ns)/count(*),5) AS detection_catalog_match_fraction, round(coalesce(median(ns),9999.0::DOUBLE),5) AS median_detection_catalog_separation_arcsec,
        coalesce(any_value(vc.variability_snr), 0.0::DOUBLE) AS variability_snr, coalesce(any_value(vc.flux_ratio), 0.0::DOUBLE) AS flux_ratio FROM t LEFT JOIN vc ON vc.group_id=user_id GROUP BY user_id""",
    ),
    "moving_features": q(
        DET,
        """l AS (SELECT night, u, regr_slope(x,h) AS vx, regr_intercept(x,h) AS ix, regr_slope(y,h) AS vy, regr_intercept(y,h) AS iy, min(h) AS t0, max(h) AS t1 FROM det GROUP BY night, u HAVING count(*)>=3),
        r AS (SELECT det.*, l.* EXCLUDE (night, u), pow(x-ix-vx*h,2)+pow(y-iy-vy*h,2) AS o2 FROM det JOIN l USING (night, u)),
        a AS (SELECT night, u, count(*) AS n, (max(fi)-min(fi)+1)::DOUBLE AS sp, avg(snr) AS s1, min(snr) AS s2, max(snr) AS s3, stddev_pop(snr) AS s4, median(snr) AS s5, min(pk) AS p1, max(pk) AS p2, median(pk) AS p3,
          sqrt(avg(o2)) AS rms, sqrt(max(o2)) AS mx, stddev_pop(x) AS xs, stddev_pop(y) AS ys, (max(h)-min(h))*3600.0 AS span, any_value(ix+vx*t0) AS x0, any_value(iy+vy*t0) AS y0, any_value(ix+vx*t1) AS x1,
          any_value(iy+vy*t1) AS y1, any_value(sqrt(vx*vx+vy*vy)) AS mo FROM r GROUP BY night, u)""",
        """SELECT night, u AS detection_id, n AS detection_count, sp AS frame_index_span, round(s1,9) AS average_snr, round(s2,9) AS local_snr_min, round(s3,9) AS local_snr_max, round(s4,9) AS local_snr_stddev,
        round(s5,9) AS local_snr_median, round(p1,9) AS peak_min, round(p2,9) AS peak_max, round(p3,9) AS peak_median, round(rms,9)+0.0 AS fit_rms_px, round(mx,9) AS max_deflection_px, round(xs,9) AS x_stddev, round(ys,9) AS y_stddev,
        span AS observation_span_seconds, round(x0,9) AS start_x, round(y0,9) AS start_y, round(x1,9) AS end_x, round(y1,9) AS end_y, round(mo,9) AS motion_px_per_hour, round(p2,9) AS peak_value, 0.0::DOUBLE AS method_is_synthetic_sweep, CASE WHEN night%2=0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_arcsec_motion, CASE WHEN night%2=0 THEN round(mo*1.5,9) ELSE 0.0::DOUBLE END AS motion_arcsec_per_hour, round(x1-x0,9)+0.0 AS delta_x, round(y1-y0,9)+0.0 AS delta_y,
        round(abs(x1-x0),9) AS abs_delta_x, round(abs(y1-y0),9) AS abs_delta_y, round(sqrt(pow(x1-x0,2)+pow(y1-y0,2)),9) AS displacement_px, round(n/greatest(1.0,sp),9) AS linked_frame_fraction FROM a""",
    ),
    "source_features": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY,
        """SELECT source_id, filter_name, count(*) AS measurement_count, count(DISTINCT file_path) AS frame_count, round(count(*) FILTER (excluded)/count(*),4) AS excluded_fraction,
        round(count(*) FILTER (is_saturated)/count(*),4) AS saturated_fraction, round(count(dm)/count(*),4) AS differential_fraction, round(min(snr),4) AS snr_min, round(max(snr),4) AS snr_max, round(stddev_pop(snr),4) AS snr_stddev,
        round(stddev_pop(flux),4) AS flux_stddev, round(avg(qs),4) AS quality_mean, round(avg(scatter),4) AS comparison_scatter_mean, round(stddev_pop(dm),4) AS differential_stddev,
        round(avg(centroid_shift_pixels),4) AS centroid_shift_mean, round(max(centroid_shift_pixels),4) AS centroid_shift_max, round(median(snr),4) AS snr_median, round(median(flux),4) AS flux_median,
        round(median(dm),4) AS differential_median FROM qual GROUP BY source_id, filter_name""",
    ),
    "training_features": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY, METRICS,
        """ms AS (SELECT source_id, count(*) AS n, count(dm) AS v, count(*) FILTER (excluded) AS x, count(*) FILTER (len(fl)>0) AS g, count(*) FILTER (is_saturated) AS sa, count(DISTINCT file_path) AS uf, count(DISTINCT filter_name) AS ul,
          max(observation_time)-min(observation_time) AS sp, max(snr) AS s1, min(snr) AS s2, stddev_pop(snr) AS s3, max(flux) AS f1, min(flux) AS f2, stddev_pop(flux) AS f3, stddev_pop(dm) AS d1, max(dm)-min(dm) AS d2,
          max(centroid_shift_pixels) AS c1, max(peak_pixel_value/450.0) AS pf, median(snr) AS m1, median(flux) AS m2, median(flux_error) AS m3, median(dme) AS m4, median(scatter) AS m5, median(qs) AS m6, median(flux*0.2) AS m7,
          median(centroid_shift_pixels) AS m8, median(CASE WHEN ids IS NULL THEN 0 ELSE len(string_split(ids, ';')) END) AS m9, min(object_name) AS object_name, any_value(source_no) AS no, any_value(catalog_magnitude) AS cm FROM qual GROUP BY source_id),
        se AS (SELECT source_id, count(*) AS n, max(candidate_score) AS b, median(candidate_score) AS m, max(mad) AS mad, max(rms) AS rms, max(amplitude) AS amp, max(reduced_chi2) AS chi, max(von_neumann) AS vn, max(stetson_j) AS sj FROM score GROUP BY source_id),
        fr AS (SELECT object_name, min(e) AS e1, max(e) AS e2, median(e) AS e3, median(h) AS h, median(b) AS b FROM (SELECT DISTINCT object_name, file_path, 30.0::DOUBLE+frame_no%5*15 AS e, 2048.0::DOUBLE+frame_no%3 AS h, 1.0::DOUBLE+frame_no%2 AS b FROM meas) GROUP BY object_name)""",
        "SELECT source_id, "
        + ", ".join(
            f"round(coalesce(({v})::DOUBLE, 0.0), 4) AS {k}"
            for k, v in {
                "source_magnitude": "CASE WHEN no%5<4 THEN cm ELSE 99.0 END", "measurement_count": "ms.n", "valid_point_count": "v", "excluded_point_count": "x", "flagged_count": "g", "valid_point_fraction": "v/ms.n",
                "excluded_point_fraction": "x/ms.n", "flagged_fraction": "g/ms.n", "saturated_fraction": "sa/ms.n", "near_saturated_fraction": "0", "unique_file_count": "uf", "unique_filter_count": "ul", "observation_span_seconds": "sp",
                "median_snr": "m1", "max_snr": "s1", "min_snr": "s2", "snr_stddev": "s3", "median_flux": "m2", "max_flux": "f1", "min_flux": "f2", "flux_stddev": "f3", "median_flux_error": "m3", "median_mag_error": "m4",
                "light_curve_rms": "d1", "light_curve_range": "d2", "median_comparison_scatter": "m5", "median_quality_score": "m6", "median_background_level": "m7", "median_background_scatter": "0", "median_centroid_shift_px": "m8",
                "max_centroid_shift_px": "c1", "median_aperture_radius": "0", "median_annulus_inner_radius": "0", "median_annulus_outer_radius": "0", "median_comparison_star_count": "m9", "max_saturation_fraction": "pf",
                "series_count": "se.n", "best_candidate_score": "se.b", "median_candidate_score": "se.m", "best_metric_mad": "mad", "best_metric_rms": "rms", "best_metric_amplitude": "amp", "best_metric_reduced_chi2": "chi",
                "best_metric_von_neumann": "vn", "best_metric_stetson_j": "sj", "median_exposure_seconds": "e3", "min_exposure_seconds": "e1", "max_exposure_seconds": "e2", "median_frame_width": "4096", "median_frame_height": "fr.h",
                "median_binning": "fr.b", "site_latitude_deg": "48.5", "site_longitude_deg": "0", "site_elevation_m": "0", "telescope_focal_length_mm": "0", "telescope_aperture_mm": "0", "telescope_focal_ratio": "0",
                "camera_pixel_size_um": "0", "bortle_scale": "5", "aperture_mode_fixed": "0", "aperture_mode_fwhm_scaled": "1", "settings_aperture_radius_pixels": "0", "settings_annulus_inner_radius_pixels": "0",
                "settings_annulus_outer_radius_pixels": "0", "settings_aperture_radius_fwhm_scale": "1.75", "settings_annulus_inner_radius_fwhm_scale": "0", "settings_annulus_outer_radius_fwhm_scale": "0",
            }.items()
        )
        + " FROM ms LEFT JOIN se USING (source_id) LEFT JOIN fr USING (object_name)",
    ),
    "label_summary": q(LABELS, "SELECT 'transient' AS mode, label, count(*) AS label_count, max(updated) AS last_updated FROM l1 GROUP BY label"),
}
