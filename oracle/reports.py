"""SQL twins of the export and comparison-set queries."""

from oracle.common import DIFF, MEAS_RAW, PAIRS, QUALITY, q
from oracle.photometry import METRICS

SCIENCE = """
chk AS (SELECT file_path, filter_name, source_id, source_name, instrumental_magnitude AS ins, catalog_magnitude AS cm, cal FROM qual WHERE is_check),
sci0 AS (SELECT qual.*, c.source_id AS cid, c.source_name AS cname, c.ins AS cins, c.cm AS ccm, coalesce(c.cal, c.ins + qual.zpz) - c.cm AS res
  FROM qual LEFT JOIN chk c ON qual.is_variable AND c.file_path = qual.file_path AND c.filter_name = qual.filter_name AND c.source_id <> qual.source_id
  QUALIFY row_number() OVER (PARTITION BY qual.file_path, qual.filter_name, qual.source_id ORDER BY c.source_name, c.source_id) = 1),
rms AS (SELECT source_id, filter_name, sqrt(avg(res*res)) AS rms, count(*) AS n FROM sci0 WHERE res IS NOT NULL GROUP BY ALL)
"""

FILT = "CASE filter_name WHEN 'click' THEN 'Johnson V' WHEN 'view' THEN 'R' WHEN 'purchase' THEN 'Lum' WHEN 'error' THEN 'b' ELSE 'weird, one' END"


def num(expr: str, places: int) -> str:
    t = f"regexp_replace(printf('%.{places}f', {expr}), '0+$', '')"
    return f"CASE WHEN {expr} IS NULL THEN 'na' WHEN {t} LIKE '%.' THEN {t} || '0' ELSE {t} END"


SUBMIT = f"""
sub0 AS (SELECT *, {FILT} AS fn, coalesce(cal, dm) AS mag, CASE WHEN cal IS NOT NULL THEN coalesce(cale, dme) ELSE dme END AS err,
  CASE filter_name WHEN 'click' THEN 'V' WHEN 'view' THEN 'R' WHEN 'error' THEN 'B' ELSE 'O' END AS code,
  CASE WHEN source_no%3<>0 THEN 1.0 + source_no%10/10.0::DOUBLE END AS air, array_to_string(fl, '; ') AS ft FROM sci0 WHERE is_variable),
sub1 AS (SELECT *, CASE WHEN excluded OR is_saturated THEN 'measurement_excluded_or_saturated' WHEN mag IS NULL THEN 'submit_ready_magnitude_missing' END AS skip,
  concat_ws(' ', CASE WHEN ft<>'' THEN 'Flags: ' || replace(replace(ft,',',';'),'|','/') END, CASE WHEN code='O' THEN 'Original filter: ' || replace(fn,',',';') END,
    CASE WHEN zn>0 THEN 'Zero-point sources: ' || zn END, CASE WHEN air IS NULL THEN 'Airmass unavailable' END)
  || concat('|VMAGINS=' || {num('instrumental_magnitude', 3)}, CASE WHEN cins IS NOT NULL THEN '|KMAGINS=' || {num('cins', 3)} || '|KREFMAG=' || {num('ccm', 3)} END) AS notes FROM sub0),
sub AS (SELECT file_path, fn AS filter_name, source_id, skip AS skip_reason, CASE WHEN skip IS NULL THEN CASE WHEN cal IS NOT NULL THEN 'STD' ELSE 'DIF' END END AS mtype,
  CASE WHEN skip IS NULL THEN code END AS filter_code, CASE WHEN skip IS NULL THEN concat_ws(',', source_name, printf('%.5f', observation_time/86400.0+2440587.5),
    {num('mag', 4)}, {num('err', 3)}, code, 'NO', CASE WHEN cal IS NOT NULL THEN 'STD' ELSE 'DIF' END,
    CASE WHEN comparison_count>1 THEN 'ENSEMBLE' WHEN comparison_count=1 THEN ids ELSE 'na' END, 'na', coalesce(cname,'na'), {num('cins', 3)}, {num('air', 3)}, 'na', 'X1', notes) END AS export_line FROM sub1)
"""

TRIALS = """
u AS (SELECT * FROM meas WHERE flux>0 AND NOT is_saturated AND NOT (peak_pixel_value/450.0>=0.95)),
s AS (SELECT object_name, filter_name, source_id, is_reference, min(source_name) AS nm, min(ra_deg) AS ra, min(dec_deg) AS dec, min(catalog_magnitude) AS m FROM u GROUP BY ALL),
rk AS (SELECT t.filter_name, t.source_id, r.source_id AS rid, row_number() OVER (PARTITION BY t.filter_name, t.source_id
    ORDER BY abs(r.m-t.m), (r.ra-t.ra)*(r.ra-t.ra)+(r.dec-t.dec)*(r.dec-t.dec), lower(r.nm), r.source_id) AS p
  FROM s t JOIN s r ON t.object_name=r.object_name AND t.filter_name=r.filter_name AND NOT t.is_reference AND r.is_reference AND abs(r.m-t.m)<=0.75 QUALIFY p <= 4),
sets AS (SELECT a.filter_name, a.source_id, a.rid || '|' || b.rid || '|' || c.rid AS set_id, [a.rid, b.rid, c.rid] AS members FROM rk a JOIN rk b USING (filter_name, source_id)
  JOIN rk c USING (filter_name, source_id) WHERE a.p < b.p AND b.p < c.p),
refs AS (SELECT * FROM meas WHERE is_reference AND flux > 0 AND NOT is_saturated AND NOT (peak_pixel_value/450.0 >= 0.95)),
targets AS (SELECT meas.* REPLACE (meas.source_id || '#' || set_id AS source_id), members FROM meas JOIN sets USING (filter_name, source_id) WHERE NOT is_reference),
pairs AS (SELECT t.file_path, t.filter_name, t.source_id, r.source_id AS ref_source_id, r.flux AS rf, r.flux_error AS re, r.instrumental_magnitude AS ri, r.catalog_magnitude AS rc,
  r.band_mag AS rb, r.band_error AS rbe, r.band_source AS rs, list_position(t.members, r.source_id) AS rank FROM targets t JOIN refs r ON r.file_path=t.file_path
  AND r.filter_name=t.filter_name AND list_contains(t.members, r.source_id))
"""

BEST = """
per AS (SELECT source_id, filter_name, count(dm) AS valid_count, count(*) FILTER (excluded) AS excluded_count, count(*) AS row_count, median(qs) AS mq, median(scatter) AS ms
  FROM qual GROUP BY ALL),
best AS (SELECT split_part(per.source_id,'#',1) AS sid, per.filter_name, split_part(per.source_id,'#',2) AS set_id, valid_count, excluded_count, row_count, ms, mq, candidate_score,
  count(*) OVER (PARTITION BY sid, per.filter_name) AS trial_count
  FROM per JOIN score USING (source_id, filter_name) WHERE valid_count > 0
  QUALIFY row_number() OVER (PARTITION BY sid, per.filter_name ORDER BY valid_count DESC, excluded_count, coalesce(ms, 'inf'::DOUBLE), mq DESC, candidate_score DESC, set_id) = 1)
"""

SQL = {
    "check_rms": q(MEAS_RAW, PAIRS, DIFF, QUALITY, SCIENCE, "SELECT source_id, filter_name, round(rms,6) AS check_residual_rms, n AS check_count FROM rms"),
    "science_rows": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY, SCIENCE,
        """SELECT file_path, filter_name, source_id, object_name, CASE WHEN is_check THEN 'check' WHEN is_variable THEN 'variable' ELSE 'target' END AS role,
        round(observation_time/86400.0+2440587.5,5) AS julian_date, CASE WHEN cal IS NOT NULL THEN 'calibrated_magnitude' WHEN dm IS NOT NULL THEN 'differential_magnitude' ELSE 'instrumental_magnitude' END AS measurement_kind,
        round(coalesce(cal, dm, instrumental_magnitude),5) AS reported_value, round(CASE WHEN cal IS NOT NULL THEN coalesce(cale, dme) WHEN dm IS NOT NULL THEN dme ELSE flux_error END,5) AS reported_uncertainty,
        CASE WHEN cal IS NOT NULL THEN 'zero_point_calibrated_untransformed' WHEN dm IS NOT NULL THEN 'differential_only' ELSE 'instrumental_only' END AS calibration_state,
        CASE WHEN cal IS NOT NULL THEN 'STD' WHEN dm IS NOT NULL THEN 'DIF' ELSE 'na' END AS type_candidate,
        CASE WHEN comparison_count=0 THEN 'none' WHEN comparison_count=1 THEN 'single' ELSE 'ensemble' END AS comparison_method, cid AS check_source_id,
        round(res,5) AS check_residual_magnitude, CASE WHEN is_variable AND cid IS NOT NULL THEN round(rms,5) END AS check_residual_rms,
        NOT excluded AND NOT is_saturated AS accepted FROM sci0 LEFT JOIN rms USING (source_id, filter_name)""",
    ),
    "submission_rows": q(MEAS_RAW, PAIRS, DIFF, QUALITY, SCIENCE, SUBMIT, "SELECT * FROM sub"),
    "submission_preflight": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY, SCIENCE, SUBMIT,
        """SELECT coalesce(skip_reason,'exported') AS outcome, coalesce(mtype,'-') AS mtype, coalesce(filter_code,'-') AS filter_code, count(*) AS row_count,
        count(DISTINCT source_id) AS source_count FROM sub GROUP BY ALL""",
    ),
    "reference_manifest": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY,
        """us AS (SELECT p.ref_source_id AS source_id, count(*) AS n, count(*) FILTER (NOT excluded AND NOT is_saturated) AS a FROM pairs p
          JOIN qual USING (file_path, filter_name, source_id) GROUP BY 1),
        b AS (SELECT source_id, min(source_name) AS source_name, min(catalog_magnitude) AS cm, string_agg(DISTINCT filter_name, '; ' ORDER BY filter_name) AS fnn,
          count(DISTINCT file_path) AS fc, bool_or(is_saturated) AS es, bool_or(NOT is_saturated AND peak_pixel_value/450.0>=0.95) AS en, max(peak_pixel_value/450.0) AS mf,
          median(flux) AS mfl, median(snr) AS msn FROM meas WHERE is_reference GROUP BY source_id)""",
        """SELECT source_id, source_name, round(cm,6) AS catalog_magnitude, fnn AS filter_names, fc AS file_count, es AS ever_saturated, en AS ever_near_saturated,
        round(mf,6) AS max_saturation_fraction, coalesce(n,0) AS usage_count, coalesce(a,0) AS accepted_usage_count, round(mfl,6) AS median_flux, round(msn,6) AS median_snr
        FROM b LEFT JOIN us USING (source_id)""",
    ),
    "report_summary": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY,
        """SELECT object_name, '{"measurement_count":' || count(*) || ',"accepted_count":' || count(*) FILTER (NOT excluded AND NOT is_saturated)
        || ',"rejected_count":' || count(*) FILTER (excluded OR is_saturated) || ',"source_count":' || count(DISTINCT source_id) || ',"file_count":' || count(DISTINCT file_path)
        || ',"light_curve_count":' || count(DISTINCT source_id || filter_name) || '}' AS summary_json FROM qual GROUP BY object_name""",
    ),
    "best_comparison_set": q(
        MEAS_RAW, TRIALS, DIFF, QUALITY, METRICS, BEST,
        """SELECT sid AS source_id, filter_name, set_id, valid_count, excluded_count, row_count, round(ms,5) AS median_scatter, round(mq,5) AS median_quality,
        candidate_score, trial_count FROM best""",
    ),
    "variable_discovery": q(
        MEAS_RAW, TRIALS, DIFF, QUALITY, METRICS, BEST, "tg AS (SELECT DISTINCT source_id, filter_name FROM meas WHERE NOT is_reference)",
        """SELECT tg.source_id, tg.filter_name, CASE WHEN set_id IS NULL THEN 'no usable comparison set' WHEN valid_count-excluded_count<3 THEN 'too few clean points'
        WHEN candidate_score>=25 THEN 'discovered' ELSE 'below minimum score' END AS outcome, set_id, candidate_score FROM tg LEFT JOIN best ON sid=tg.source_id AND best.filter_name=tg.filter_name""",
    ),
}

_WARNINGS = {
    "unmatched_filter_code": "skip IS NULL AND code='O'", "check_star_missing": "skip IS NULL AND cid IS NULL", "airmass_missing": "skip IS NULL AND air IS NULL",
    "differential_only": "skip IS NULL AND cal IS NULL", "rows_skipped": "skip IS NOT NULL",
}
SQL["submission_warnings"] = q(
    MEAS_RAW, PAIRS, DIFF, QUALITY, SCIENCE, SUBMIT,
    "w AS ("
    + " UNION ALL ".join(f"SELECT object_name, '{k}' AS warning, count(*) FILTER ({c}) AS row_count FROM sub1 GROUP BY object_name" for k, c in _WARNINGS.items())
    + " UNION ALL SELECT object_name, 'nothing_to_submit', CASE WHEN count(*) FILTER (skip IS NULL) = 0 THEN 1 ELSE 0 END FROM sub1 GROUP BY object_name)",
    "SELECT object_name, warning, row_count::BIGINT AS row_count FROM w WHERE row_count > 0",
)


def _counted(column: str) -> str:
    return f"(SELECT string_agg(v || '=' || c, ';' ORDER BY v) FROM (SELECT coalesce({column}, '') AS v, count(*) AS c FROM sc WHERE sc.object_name = b.object_name GROUP BY 1))"


SQL["provenance_manifest"] = q(
    MEAS_RAW, f"sc AS ({SQL['science_rows']})",
    """b AS (SELECT object_name, count(DISTINCT file_path) AS file_count, min(observation_time) AS t0, max(observation_time) AS t1, string_agg(DISTINCT filter_name, ';' ORDER BY filter_name) AS filters,
      count(DISTINCT source_id) FILTER (is_variable) AS vc, count(DISTINCT source_id) FILTER (is_reference) AS rc, median(3.0 + source_no%4*0.5) AS ar FROM meas GROUP BY object_name),
    a AS (SELECT object_name, count(*) FILTER (accepted) AS ac, count(*) FILTER (NOT accepted) AS rj FROM sc GROUP BY object_name)""",
    f"""SELECT object_name, file_count, round(t0,3) AS observation_start, round(t1,3) AS observation_end, filters, vc AS variable_star_count, ac AS accepted_count, rj AS rejected_count, rc AS reference_star_count,
    {_counted('calibration_state')} AS calibration_states, {_counted('comparison_method')} AS comparison_methods, {_counted('filter_name')} AS filter_counts, round(ar,3) AS median_aperture_radius
    FROM b JOIN a USING (object_name)""",
)
