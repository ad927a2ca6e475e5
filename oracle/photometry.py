"""SQL twins of the photometry and quality queries."""

from oracle.common import DIFF, MEAS_RAW, PAIRS, QUALITY, q

KEY = "file_path, filter_name, source_id"

METRICS = """
pts AS (SELECT source_id, filter_name, observation_time, file_path, v, coalesce(CASE WHEN dme>0 THEN dme END, flux_error) AS e, excluded FROM qual),
cnt AS (SELECT source_id, filter_name, count(*) AS n0, count(*) FILTER (NOT excluded) AS nc FROM pts GROUP BY ALL),
used AS (SELECT pts.* FROM pts JOIN cnt USING (source_id, filter_name) WHERE nc < 3 OR NOT excluded),
st AS (SELECT source_id, filter_name, count(*) AS n, avg(v) AS mean, stddev_samp(v) AS rms, median(v) AS med, median(e) AS te,
  quantile_cont(v, 0.95) - quantile_cont(v, 0.05) AS amp, max(v)-min(v) AS rng, sum(v/(e*e))/sum(1/(e*e)) AS wm, count(e) AS ne
  FROM used GROUP BY ALL),
r AS (SELECT u.*, st.med, st.wm, st.n, sqrt(n::DOUBLE/greatest(n::DOUBLE-1,1))*(v-mean)/e AS r FROM used u JOIN st USING (source_id, filter_name)),
rl AS (SELECT *, lag(r) OVER w AS pr, lag(v) OVER w AS pv FROM r WINDOW w AS (PARTITION BY source_id, filter_name ORDER BY observation_time, file_path)),
ag AS (SELECT source_id, filter_name, median(abs(v-med)) AS mad, sum(pow((v-wm)/e,2)) AS chi2, avg(pow(v-pv,2)) AS d2,
  avg(sign(r*pr)*sqrt(abs(r*pr))) AS j, avg(abs(r)) AS ar, avg(r*r) AS r2 FROM rl GROUP BY ALL),
met AS (SELECT source_id, filter_name, n0 AS point_count, n AS cleaned_point_count, CASE WHEN n>=2 THEN rms END AS rms,
  CASE WHEN n>=2 THEN mad END AS mad, CASE WHEN n>=5 THEN amp WHEN n>=2 THEN rng END AS amplitude,
  CASE WHEN n>=2 THEN te END AS typical_error, CASE WHEN ne>=2 THEN chi2/(ne-1) END AS reduced_chi2,
  CASE WHEN n>=3 AND rms>0 THEN d2/(rms*rms) END AS von_neumann, CASE WHEN n>=3 THEN j END AS stetson_j,
  CASE WHEN n>=3 AND r2>0 THEN ar/sqrt(r2) END AS stetson_k
  FROM st JOIN ag USING (source_id, filter_name) JOIN cnt USING (source_id, filter_name)),
score AS (SELECT *, round(least(100.0, greatest(0.0,
   coalesce(CASE WHEN reduced_chi2>1 THEN least(log10(reduced_chi2)/1.4,1)*30 END,0)
 + coalesce(CASE WHEN mad IS NOT NULL THEN least(mad/greatest(coalesce(typical_error,0.02),1e-6)/6,1)*20 END,0)
 + coalesce(CASE WHEN amplitude IS NOT NULL THEN least(amplitude/greatest(coalesce(typical_error,0.02),1e-6)/10,1)*20 END,0)
 + coalesce(CASE WHEN stetson_j>0 THEN least(stetson_j/4,1)*20 END,0)
 + coalesce(CASE WHEN von_neumann IS NOT NULL THEN least(greatest(0.0,2-von_neumann)/1.5,1)*10 END,0))),2) AS candidate_score FROM met)
"""

SQL = {
    "nearest_comparisons": q(
        MEAS_RAW, PAIRS, f"SELECT {KEY}, ref_source_id, CAST(rank AS BIGINT) AS rank, round(d2, 9) AS d2 FROM pairs"
    ),
    "ensemble_flux": q(
        MEAS_RAW, PAIRS, DIFF,
        f"""SELECT {KEY}, k AS comparison_count, ids AS comparison_ids, round(rflux,6) AS comparison_reference_flux,
        round(rerr,6) AS comparison_reference_flux_error, round(scatter,6) AS comparison_scatter FROM ens""",
    ),
    "zero_point": q(
        MEAS_RAW, PAIRS, DIFF,
        f"""SELECT {KEY}, round(z,6) AS zero_point_magnitude, round(ze,6) AS zero_point_magnitude_error,
        n AS zero_point_source_count FROM zp""",
    ),
    "standard_magnitude": q(
        MEAS_RAW, PAIRS, DIFF,
        f"""SELECT {KEY}, round(z,6) AS standard_zero_point_magnitude, round(ze,6) AS standard_zero_point_magnitude_error,
        n AS standard_zero_point_source_count, src AS standard_catalog_source FROM szp""",
    ),
    "differential_photometry": q(
        MEAS_RAW, PAIRS, DIFF,
        f"""SELECT {KEY}, round(flux,6) AS flux, round(dm,6) AS differential_magnitude, round(dme,6) AS differential_magnitude_error,
        round(cal,6) AS calibrated_magnitude, round(cale,6) AS calibrated_magnitude_error, zn AS zero_point_source_count,
        round(std,6) AS standard_magnitude, round(stde,6) AS standard_magnitude_error, sn AS standard_zero_point_source_count,
        ssrc AS standard_catalog_source, round(scatter,6) AS comparison_scatter, coalesce(ids,'') AS comparison_ids,
        list_aggregate(list_concat(flags, CASE WHEN comparison_count=0 THEN ['No nearby reference stars with positive flux.'] ELSE [] END),
        'string_agg', '; ') AS flag_text FROM diff""",
    ).replace("AS flag_text", "AS flag_text0").replace("SELECT file_path, filter_name, source_id, round(flux,6)", "SELECT * EXCLUDE flag_text0, coalesce(flag_text0,'') AS flag_text FROM (SELECT file_path, filter_name, source_id, round(flux,6)") + ")",
    "robust_outliers": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY, f"SELECT {KEY}, round(z,6) AS robust_z, coalesce(z>4.5,false) AS is_outlier FROM d1"
    ),
    "hampel": q(MEAS_RAW, PAIRS, DIFF, QUALITY, f"SELECT {KEY}, round(hz,6) AS hampel_z FROM d2"),
    "quality_score": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY,
        f"""SELECT {KEY}, round(qs,6) AS quality_score, round(qw,4) AS quality_weight, excluded AS excluded_from_analysis,
        array_to_string(fl, '; ') AS flag_text, array_to_string(reasons, '; ') AS reason_text FROM qual""",
    ),
    "light_curve_points": q(
        MEAS_RAW, PAIRS, DIFF,
        f"""SELECT {KEY}, row_number() OVER (PARTITION BY source_id, filter_name ORDER BY observation_time, file_path) AS point_index,
        round(observation_time,3) AS observation_time, round(dm,6) AS differential_magnitude, round(flux,6) AS flux FROM diff""",
    ),
    "variability_metrics": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY, METRICS,
        """SELECT source_id, filter_name, point_count, cleaned_point_count, round(rms,6) AS rms, round(mad,6) AS mad,
        round(amplitude,6) AS amplitude, round(typical_error,6) AS typical_error, round(reduced_chi2,4) AS reduced_chi2,
        round(von_neumann,6) AS von_neumann, round(stetson_j,5) AS stetson_j, round(stetson_k,6) AS stetson_k FROM score""",
    ),
    "candidate_score": q(
        MEAS_RAW, PAIRS, DIFF, QUALITY, METRICS, "SELECT source_id, filter_name, candidate_score FROM score"
    ),
    "cadence": q(
        MEAS_RAW,
        """g AS (SELECT source_id, filter_name, observation_time - lag(observation_time) OVER (
          PARTITION BY source_id, filter_name ORDER BY observation_time, file_path) AS gap FROM meas WHERE NOT is_reference)""",
        """SELECT source_id, filter_name, count(*) AS point_count, round(median(gap) FILTER (gap>0),4) AS median_cadence_seconds
        FROM g GROUP BY ALL""",
    ),
    "empirical_scatter": q(
        MEAS_RAW,
        "x0 AS (SELECT filter_name, object_name, instrumental_magnitude AS v FROM meas)",
        *[
            f"""m{i} AS (SELECT filter_name, object_name, median(v) AS m FROM x{i} GROUP BY ALL),
            s{i} AS (SELECT filter_name, object_name, any_value(m) AS m, 1.4826*median(abs(v-m)) AS s, count(*) AS n
              FROM x{i} JOIN m{i} USING (filter_name, object_name) GROUP BY ALL),
            x{i + 1} AS (SELECT filter_name, object_name, v FROM x{i} JOIN s{i} USING (filter_name, object_name)
              WHERE n < 2 OR s <= 0 OR abs(v-m) <= 4*s)"""
            for i in range(3)
        ],
        """m3 AS (SELECT filter_name, object_name, median(v) AS m FROM x3 GROUP BY ALL),
        t AS (SELECT filter_name, object_name, count(*) AS residual_count FROM x0 GROUP BY ALL)""",
        """SELECT filter_name, object_name, any_value(residual_count) AS residual_count, count(*) AS kept_count,
        CASE WHEN count(*) >= 2 THEN round(1.4826*median(abs(v-m)),6) END AS empirical_scatter
        FROM x3 JOIN m3 USING (filter_name, object_name) JOIN t USING (filter_name, object_name) GROUP BY ALL""",
    ),
}
