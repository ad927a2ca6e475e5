"""SQL twins of the archive and text-rule queries."""

from oracle.common import q

FILES = """
f0 AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS d, o_totalprice, o_orderstatus AS st,
  CASE o_custkey % 7 WHEN 0 THEN '/data/archive/nested' WHEN 1 THEN '/data/mirror' ELSE '/data/archive' END AS root_path,
  ['Lum','red','H-alpha','o3','Clear'][CAST(o_orderkey % 5 + 1 AS INT)] AS flt,
  CAST(CAST(floor(o_totalprice/1000.0) AS BIGINT) AS VARCHAR) || '.5' AS expo FROM orders),
f1 AS (SELECT *, CASE WHEN k%11=0 THEN 'flats' WHEN k%13=0 THEN 'masters' WHEN k%17=0 THEN 'Integration' WHEN k%19=0 THEN 'processed'
   WHEN st='F' THEN 'Lights' WHEN st='O' THEN 'calibrated' ELSE 'registered' END AS folder,
  (CASE WHEN k%23=0 THEN 'snap-' ELSE 'Light_' END) || 'Target ' || (c%50) || '_' || expo || 's_Bin' || (k%3+1) || '_' || flt || '_'
   || strftime(d,'%Y%m%d') || '-213000_' || k AS stem,
  CASE WHEN k%29=0 THEN '.png' WHEN k%31=0 THEN '.cr2' ELSE '.fits' END AS ext,
  CASE WHEN k%2=0 THEN flt END AS h_filter,
  CASE WHEN k%4=0 OR k%4=1 THEN CAST(expo AS DOUBLE) WHEN k%4=2 THEN floor(o_totalprice)*1000*0.001::DOUBLE ELSE CAST(expo AS DOUBLE) END AS exposure0,
  CASE WHEN k%37=0 THEN 'dark' WHEN k%3=0 THEN 'light' END AS ityp,
  CASE WHEN k%41=0 THEN 'light' WHEN k%43=0 THEN 'dark' END AS mtyp, k%5<>0 AS has_wcs,
  date_diff('second', DATE '1970-01-01', d)::DOUBLE + k%86400 AS observation_time FROM f0),
files AS (SELECT *, root_path || '/Target ' || (c%50) || '/' || folder || '/' || stem || ext AS path, 'Target ' || (c%50) AS object_name,
  -- the snap- names do not parse, so their exposure comes from the header alone
  CASE WHEN k%4=3 AND k%23=0 THEN NULL ELSE exposure0 END AS exposure_seconds,
  CASE WHEN k%4=3 AND k%23=0 THEN NULL ELSE 1 END AS dummy,
  CASE WHEN k%23=0 AND k%2=0 THEN NULL ELSE d END AS observation_date,
  CASE flt WHEN 'Lum' THEN 'L' WHEN 'red' THEN 'R' WHEN 'H-alpha' THEN 'Ha' WHEN 'o3' THEN 'OIII' ELSE 'L' END AS alias0,
  CASE ext WHEN '.png' THEN 'PNG' WHEN '.cr2' THEN 'RAW' ELSE 'accepted' END AS file_status,
  CASE WHEN mtyp='light' THEN 'integration' WHEN mtyp='dark' THEN 'master_calibration'
   WHEN folder='Integration' THEN 'integration' WHEN folder='registered' THEN 'registered_light' WHEN folder='calibrated' THEN 'calibrated_light'
   WHEN folder='masters' THEN CASE WHEN contains(lower(stem),'light') OR ityp='light' THEN 'integration' ELSE 'master_calibration' END
   WHEN folder='flats' OR ityp='dark' THEN 'calibration_frame' WHEN folder='processed' THEN 'other' ELSE 'light_subframe' END AS kind
  FROM f1),
inv AS (SELECT *, CASE WHEN k%2=1 AND k%23=0 THEN NULL ELSE alias0 END AS filter_name FROM files)
"""

COUNTING = """
deck AS (SELECT *, CASE kind WHEN 'light_subframe' THEN 1 WHEN 'calibrated_light' THEN 2 WHEN 'registered_light' THEN 3
  WHEN 'normalized_light' THEN 4 END AS stage FROM inv WHERE file_status='accepted'),
firsts AS (SELECT root_path, object_name, min(stage) AS fs FROM deck WHERE exposure_seconds > 0 GROUP BY ALL),
cf AS (SELECT deck.* FROM deck JOIN firsts USING (root_path, object_name)
  WHERE exposure_seconds > 0 AND stage = fs AND observation_date IS NOT NULL)
"""

ROOT_OF = "CASE WHEN root_path = '/data/archive/nested' THEN '/data/archive' ELSE root_path END"

SQL = {
    "frame_inventory": q(
        FILES,
        """SELECT object_name, count(*) AS file_count, count(*) FILTER (file_status='accepted') AS accepted_count,
        count(*) FILTER (file_status='accepted' AND has_wcs) AS solved_count, count(*) FILTER (file_status='PNG') AS png_count,
        count(*) FILTER (file_status='JPG') AS jpg_count, count(*) FILTER (file_status='RAW') AS raw_count,
        round(sum(exposure_seconds) FILTER (file_status='accepted'),3) AS exposure_seconds,
        count(DISTINCT filter_name) FILTER (file_status='accepted') AS filter_count FROM inv GROUP BY ALL""",
    ),
    "deck_scan": q(
        FILES, f"SELECT {ROOT_OF} AS root_path, count(*) AS file_count, count(DISTINCT path) AS path_count FROM files GROUP BY 1"
    ),
    "deck_merge": q(
        FILES,
        f"""SELECT {ROOT_OF} AS root_path, CASE WHEN root_path='/data/archive/nested' THEN 'nested' ELSE object_name END AS target_name,
        version, count(*) AS file_count, CAST(sum(k) AS BIGINT) AS file_no_sum
        FROM files, (VALUES (1), (2)) AS v(version) WHERE version=2 OR k%2<>0 GROUP BY ALL""",
    ),
    "frame_groups": q(
        FILES,
        """SELECT coalesce(filter_name,'Unknown') AS filter_name, exposure_seconds, count(*) AS frame_count,
        arg_min(path, (coalesce(observation_date, DATE '0001-01-01'), path)) AS first_path, arg_max(path, (coalesce(observation_date, DATE '0001-01-01'), path)) AS last_path
        FROM inv WHERE has_wcs GROUP BY ALL""",
    ),
    "frame_group_members": q(
        FILES,
        """SELECT coalesce(filter_name,'Unknown') AS filter_name, exposure_seconds, row_number() OVER (PARTITION BY coalesce(filter_name,'Unknown'), exposure_seconds ORDER BY observation_date NULLS FIRST, path) AS position, path
        FROM inv WHERE has_wcs""",
    ),
    "deck_instruments": q(
        FILES, COUNTING,
        """i AS (SELECT DISTINCT root_path || '/' || object_name AS target, 'cam' || (c%4) AS instrument FROM cf), e AS (SELECT * FROM i UNION ALL SELECT DISTINCT 'all', instrument FROM i)""",
        "SELECT target, count(*) AS instrument_count, string_agg(instrument, ';' ORDER BY instrument) AS instruments FROM e GROUP BY target",
    ),
    "frame_batches": q(
        FILES,
        """fr AS (SELECT 'c' || (c%50) AS target_name, path, observation_time,
          row_number() OVER (PARTITION BY c%50 ORDER BY observation_time, path) AS i, count(*) OVER (PARTITION BY c%50) AS n FROM files),
        g AS (SELECT DISTINCT target_name, n FROM fr),
        b AS (SELECT target_name, n, unnest(generate_series(0, CASE WHEN n<=24 THEN 0 ELSE CAST(ceil(greatest(n-1-23,0)/21.0) AS BIGINT) END)) AS batch_id,
          CASE WHEN n<=24 THEN 0 ELSE CAST(ceil(greatest(n-1-23,0)/21.0) AS BIGINT) END AS lastb FROM g),
        bb AS (SELECT target_name, n, batch_id, CASE WHEN batch_id=lastb AND lastb>0 AND n-1-batch_id*21 < 3 THEN greatest(0,n-1-23) ELSE batch_id*21 END AS s FROM b)""",
        """SELECT target_name, batch_id, count(*) AS frame_count, count(*) FILTER (i=1) AS reference_count,
        min(observation_time) FILTER (i>1) AS first_time, max(observation_time) AS last_time
        FROM bb JOIN fr USING (target_name, n) WHERE n<=24 OR i=1 OR (i-2 >= s AND i-2 < s+23) GROUP BY ALL""",
    ),
    "incremental_reuse": q(
        FILES,
        """c AS (SELECT k AS frame_id, sha256(path || CAST(CAST(observation_time AS BIGINT) AS VARCHAR) || CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)
          || path || '.wcs' || CAST(k*7 AS VARCHAR) || least(k%9, k%4) || '|' || greatest(k%9, k%4) || 'r1' || 'ap4') AS reuse_key FROM files)""",
        """SELECT frame_id, reuse_key, CASE WHEN frame_id%5=0 THEN 'new' WHEN frame_id%3=1 OR frame_id%7=0 THEN 'changed' ELSE 'reuse' END AS status,
        CASE WHEN frame_id%5=0 THEN '' ELSE concat_ws(';', CASE WHEN frame_id%3=1 THEN 'source_size' END, CASE WHEN frame_id%7=0 THEN 'settings' END) END
        AS changed_inputs FROM c""",
    ),
    "designation_filter": q(
        """p AS (SELECT p_partkey AS source_no, ['Gaia  DR3_','ASASSN-V ','ATO ','atlas','ZTF J','[KK98] ','TIC ','V* ',' NSVS ','pan-starrs '][CAST(p_partkey%10+1 AS INT)]
          || p_name AS name, p_partkey%10 AS m FROM part)""",
        """SELECT source_no, name, CASE m WHEN 0 THEN 'gaia' WHEN 1 THEN 'asassn' WHEN 5 THEN 'other' WHEN 6 THEN 'other' WHEN 8 THEN 'other'
        WHEN 9 THEN 'other' ELSE 'named' END AS family FROM p WHERE m NOT IN (3,4)""",
    ),
    "band_normalize": q(
        """o AS (SELECT ['Johnson V','sloan-g','R_C','g''','Lum','H-alpha','Cousins  I','Z Prime','clear','sdss'][CAST(o_orderkey%10+1 AS INT)] AS filter_name FROM orders)""",
        """SELECT filter_name, CASE filter_name WHEN 'Johnson V' THEN 'V' WHEN 'sloan-g' THEN 'SG' WHEN 'R_C' THEN 'R' WHEN 'g''' THEN 'SG'
        WHEN 'Lum' THEN 'V' WHEN 'Cousins  I' THEN 'I' WHEN 'clear' THEN 'V' END AS band, count(*) AS frame_count FROM o GROUP BY ALL""",
    ),
    "filter_alias": q(
        FILES, "SELECT filter_name, h_filter AS header_filter, count(*) AS frame_count FROM inv GROUP BY ALL"
    ),
    "filename_parse": q(
        FILES,
        """SELECT k AS file_no, CASE WHEN k%23<>0 THEN 'Light' END AS frame_type, CASE WHEN k%23<>0 THEN object_name END AS object_name,
        CASE WHEN k%23<>0 THEN expo END AS exposure_text, CASE WHEN k%23<>0 THEN 'Bin' || (k%3+1) END AS binning,
        CASE WHEN k%23<>0 THEN flt END AS filter_name, CASE WHEN k%23<>0 THEN strftime(d,'%Y%m%d') END AS date_text,
        CASE WHEN k%23<>0 THEN '213000' END AS time_text, CASE WHEN k%23<>0 THEN CAST(k AS VARCHAR) END AS sequence FROM files""",
    ),
    "timestamp_parse": """SELECT event_id, CASE event_id%6 WHEN 0 THEN epoch_us(date_trunc('day', ts)) WHEN 1 THEN epoch_us(date_trunc('second', ts))
        WHEN 2 THEN epoch_us(date_trunc('second', ts)) + 123456 WHEN 3 THEN epoch_us(date_trunc('second', ts))
        WHEN 4 THEN epoch_us(date_trunc('second', ts)) - 7200000000 END AS observed_micros, event_id%6 IN (3,4) AS has_zone FROM events""",
    "image_kind": q(FILES, "SELECT kind, object_name, count(*) AS frame_count FROM inv GROUP BY ALL"),
    "deck_stats": q(
        FILES, COUNTING,
        """r AS (SELECT coalesce(filter_name,'Unknown') AS f, CAST(observation_date AS VARCHAR) AS day, root_path || '/' || object_name AS t,
          'Bin' || (k%3+1) AS b, k%23=0 AS nobin, exposure_seconds, has_wcs, observation_date FROM cf),
        g AS (SELECT 'filter' AS grain, f AS label, * FROM r UNION ALL SELECT 'day', day, * FROM r UNION ALL SELECT 'target', t, * FROM r
          UNION ALL SELECT 'binning', CASE WHEN nobin THEN '?' ELSE b END, * FROM r UNION ALL SELECT 'total', 'all', * FROM r)""",
        """SELECT grain, label, round(sum(exposure_seconds),3) AS exposure_seconds, count(*) AS frame_count, count(*) FILTER (has_wcs) AS solved_count,
        count(DISTINCT observation_date) AS night_count, CAST(min(observation_date) AS VARCHAR) AS first_date,
        CAST(max(observation_date) AS VARCHAR) AS last_date FROM g GROUP BY ALL""",
    ),
    "observation_map": q(
        FILES, COUNTING,
        """days AS (SELECT observation_date AS d, sum(exposure_seconds) AS s, count(*) AS n FROM cf GROUP BY ALL),
        cal AS (SELECT CAST(unnest(generate_series(min(d)::TIMESTAMP, max(d)::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM days),
        top AS (SELECT max(s) AS m FROM days)""",
        """SELECT CAST(cal.d AS VARCHAR) AS observation_date, round(coalesce(s,0),3) AS exposure_seconds, coalesce(n,0) AS frame_count,
        CAST(CASE WHEN coalesce(s,0)<=0 THEN 0 WHEN s/m<0.15 THEN 1 WHEN s/m<0.35 THEN 2 WHEN s/m<0.65 THEN 3 ELSE 4 END AS BIGINT) AS level
        FROM cal LEFT JOIN days USING (d) CROSS JOIN top""",
    ),
    "observation_orbit": q(
        FILES, COUNTING,
        """days AS (SELECT observation_date AS d, sum(exposure_seconds) AS s, count(*) AS n FROM cf GROUP BY ALL),
        b AS (SELECT min(d) AS a, max(d) AS z FROM days),
        zf AS (SELECT *, year(z) + ((month(z)-1) + (day(z)-1)/day(last_day(z))::DOUBLE)/12 - 3.0::DOUBLE AS aty FROM b),
        zg AS (SELECT *, CAST(floor(aty) AS INT) AS y, (aty - floor(aty))*12 AS m FROM zf),
        sp AS (SELECT a, make_date(y, CAST(floor(m) AS INT)+1, CAST(floor((m-floor(m))*day(last_day(make_date(y, CAST(floor(m) AS INT)+1, 1)))) AS INT)+1) AS split FROM zg),
        bk AS (SELECT d, s, n, d < split AS old, CASE WHEN d < split THEN CAST(date_trunc('week', d) AS DATE) ELSE d END AS bucket, a FROM days CROSS JOIN sp),
        o0 AS (SELECT bucket, old, list(d ORDER BY d) AS ds, sum(s) AS s, count(*) AS nd, any_value(a) AS a FROM bk GROUP BY bucket, old),
        o1 AS (SELECT ds[CAST(floor(len(ds)/2) AS INT)+1] AS d, s, nd, a FROM o0),
        o2 AS (SELECT *, ((month(d)-1) + (day(d)-1)/day(last_day(d))::DOUBLE)/12 AS yf, ((month(a)-1) + (day(a)-1)/day(last_day(a))::DOUBLE)/12 AS af FROM o1),
        o3 AS (SELECT *, CAST(least(71, floor(yf*72)) AS BIGINT) AS season, year(d)-year(a) + (yf-af) AS el FROM o2),
        g AS (SELECT 'season' AS grain, season AS label, * FROM o3 UNION ALL SELECT 'year', year(d), * FROM o3 UNION ALL SELECT 'month', month(d), * FROM o3)""",
        """SELECT grain, label, round(sum(s),3) AS exposure_seconds, CAST(sum(nd) AS BIGINT) AS night_count, count(*) AS entry_count,
        round(min(el),6) AS elapsed_years FROM g GROUP BY ALL""",
    ),
    "longest_night": q(
        FILES, COUNTING,
        """days AS (SELECT observation_date AS d, sum(exposure_seconds) AS s FROM cf GROUP BY ALL)""",
        "SELECT CAST(d AS VARCHAR) AS longest_night_date, round(s,3) AS longest_night_seconds FROM days ORDER BY s DESC, d LIMIT 1",
    ),
    "library_without_root": q(FILES, "SELECT path, root_path, kind FROM inv WHERE root_path <> '/data/mirror'"),
    "timing_summary": """SELECT event_type, user_id, count(*) AS event_count, round(avg(value),6) AS mean_seconds, min(value) AS min_seconds,
        max(value) AS max_seconds, round(sum(value),6) AS total_seconds, round(median(value),6) AS median_seconds,
        round(quantile_cont(value,0.95),6) AS p95_seconds FROM events GROUP BY ALL""",
}
