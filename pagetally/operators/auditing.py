"""Planned moves, suspects, history, evaluation and text matching."""

from ..plans.anchors import MOST_SHOWN, PAGE_ANCHORS, folded
from ..plans.relations import places

_BAD = "op_type NOT IN ('move_file', 'extract_pages', 'split_in_place', 'rotate')"
_OVER = "a.page_from <= b.page_to AND b.page_from <= a.page_to"

REORG = {
    "p11_range_overlap": f"SELECT a.hospital, a.sigla, a.file, a.suspect_id AS a, b.suspect_id AS b FROM {{suspects}} AS a JOIN {{suspects}} AS b ON a.hospital = b.hospital AND a.sigla = b.sigla AND a.file = b.file AND a.suspect_id < b.suspect_id AND {_OVER}",
    "p12_op_errors": f"""
        SELECT id, 'op_type' AS error FROM {{ops}} WHERE {_BAD}
        UNION ALL SELECT o.id, e.error FROM (SELECT o.*, f.file IS NOT NULL AS there, COALESCE(f.pages, 0) AS pages, CASE WHEN f.file IS NOT NULL THEN COALESCE(f.override, f.per_file, 1) END AS contribution
            FROM {{ops}} AS o LEFT JOIN {{file_counts}} AS f ON f.hospital = o.src_hospital AND f.sigla = o.src_sigla AND f.file = o.file WHERE NOT ({_BAD})) AS o
          JOIN (VALUES ('same_cell'), ('missing_file'), ('move_with_range'), ('no_range'), ('out_of_bounds'), ('rotation'), ('no_rotation'), ('negative_count'), ('count_over_range'), ('count_over_file')) AS e(error)
          ON CASE e.error WHEN 'same_cell' THEN op_type IN ('move_file', 'extract_pages') AND src_hospital = dst_hospital AND src_sigla = dst_sigla WHEN 'missing_file' THEN NOT there
            WHEN 'move_with_range' THEN op_type = 'move_file' AND page_from IS NOT NULL WHEN 'no_range' THEN op_type = 'extract_pages' AND page_from IS NULL
            WHEN 'out_of_bounds' THEN op_type = 'extract_pages' AND NOT (1 <= page_from AND page_from <= page_to AND page_to <= pages) WHEN 'rotation' THEN rotation NOT IN (0, 90, 180, 270) WHEN 'no_rotation' THEN op_type = 'rotate' AND rotation = 0
            WHEN 'negative_count' THEN doc_count < 0 WHEN 'count_over_range' THEN op_type = 'extract_pages' AND doc_count >= 0 AND doc_count > page_to - page_from + 1 ELSE op_type = 'move_file' AND doc_count >= 0 AND doc_count > contribution END
        UNION ALL SELECT o.id, 'overlap' FROM {{ops}} AS o WHERE o.op_type = 'extract_pages' AND EXISTS (SELECT 1 FROM {{ops}} AS x WHERE x.file = o.file AND x.id < o.id AND x.op_type = 'extract_pages' AND x.status = 'pending' AND x.page_from <= o.page_to AND o.page_from <= x.page_to)""",
    "f22_op_defaults": "SELECT id, documents, workers FROM {resolved_ops}",
    "a15_net_deltas": "SELECT h.hospital, s.sigla, CAST(COALESCE(sum(d.documents), 0) AS BIGINT) AS delta, CAST(COALESCE(sum(d.workers), 0) AS BIGINT) AS worker_delta FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s LEFT JOIN {op_sides} AS d ON d.hospital = h.hospital AND d.sigla = s.sigla GROUP BY h.hospital, s.sigla",
    "a37_panel": "SELECT hospital, sigla, count_if(side = 'in') AS incoming, count_if(side = 'out') AS outgoing, CAST(sum(documents) AS BIGINT) AS net, min(id) AS first_id FROM {op_sides} GROUP BY hospital, sigla",
    "j04_open_suspects": "SELECT suspect_id, kind, hospital, sigla, file FROM {open_suspects}",
    "j05_refreshed_suspects": "SELECT suspect_id, kind, hospital, sigla, file, page_from, page_to FROM {suspects}",
    "j09_overlapping_extracts": "SELECT a.id AS a, b.id AS b FROM {ops} AS a JOIN {ops} AS b ON a.file = b.file AND a.src_hospital = b.src_hospital AND a.src_sigla = b.src_sigla AND a.id < b.id AND a.page_from <= b.page_to AND b.page_from <= a.page_to WHERE a.op_type = 'extract_pages' AND b.op_type = 'extract_pages' AND a.status = 'pending' AND b.status = 'pending'",
    "f07_suspect_id": "SELECT kind, hospital, sigla, file, page_from, page_to, suggested, suspect_id FROM {stored_suspects}",
    "r07_counted": "SELECT suspect_id, hospital, sigla, file, counted FROM {suspects}",
    "r08_blocked_cells": "SELECT hospital, sigla, bool_or(counted) AS blocked FROM {open_suspects} GROUP BY hospital, sigla",
    "p09_all_reliable": "SELECT hospital, sigla, all_reliable FROM {reliable_cells}",
    "x11_applied_ops": "SELECT id, now AS status FROM {current_ops}",
    "x15_single_file_rescan": "SELECT f.id, f.hospital, f.sigla, f.file, CASE WHEN r.id IS NOT NULL AND l.sigla IS NULL AND f.pages > 0 THEN r.count ELSE f.per_file END AS per_file, CASE WHEN r.id IS NOT NULL AND l.sigla IS NULL AND f.pages > 0 THEN 'pagination' ELSE f.method END AS method, CASE WHEN r.id IS NULL THEN 'untouched' WHEN f.pages = 0 THEN 'error' WHEN l.sigla IS NOT NULL THEN 'locked' ELSE 'done' END AS outcome FROM {file_counts} AS f LEFT JOIN {rescans} AS r ON r.id = f.id LEFT JOIN {locked_cells} AS l ON l.hospital = f.hospital AND l.sigla = f.sigla",
    "x10_suspect_lifecycle": """
        SELECT c.hospital, c.sigla, COALESCE(b.n, 0) AS before, COALESCE(a.n, 0) AS after, COALESCE(o.n, 0) AS open, CASE WHEN COALESCE(o.counted, 0) > 0 THEN false WHEN w.has_work THEN r.all_reliable ELSE COALESCE(g.high, false) END AS all_reliable
        FROM {cells} AS c JOIN {worked_cells} AS w ON w.hospital = c.hospital AND w.sigla = c.sigla JOIN {reliable_cells} AS r ON r.hospital = c.hospital AND r.sigla = c.sigla
        LEFT JOIN (SELECT hospital, sigla, count(*) AS n FROM {stored_suspects} GROUP BY hospital, sigla) AS b ON b.hospital = c.hospital AND b.sigla = c.sigla
        LEFT JOIN (SELECT hospital, sigla, count(*) AS n FROM {suspects} GROUP BY hospital, sigla) AS a ON a.hospital = c.hospital AND a.sigla = c.sigla
        LEFT JOIN (SELECT hospital, sigla, count(*) AS n, count_if(counted) AS counted FROM {open_suspects} GROUP BY hospital, sigla) AS o ON o.hospital = c.hospital AND o.sigla = c.sigla
        LEFT JOIN (SELECT hospital, host AS sigla, max(pages) <= 1 AS high FROM {file_sigla} WHERE sigla = host GROUP BY hospital, host) AS g ON g.hospital = c.hospital AND g.sigla = c.sigla""",
    "x02_event_order": "SELECT hospital, sigla, kind, file, row_number() OVER (PARTITION BY hospital, sigla ORDER BY last, file) AS seq FROM (SELECT hospital, sigla, 'file_result' AS kind, file, 0 AS last FROM {file_counts} UNION ALL SELECT DISTINCT hospital, sigla, 'cell_done', '', 1 FROM {file_counts}) AS e",
    "s16_pending_manifest": "SELECT id, op_type, file, page_from, page_to FROM {ops} WHERE status = 'pending'",
    "w26_op_ids": f"SELECT id, 'op_' || CASE WHEN place < 1000 THEN lpad(CAST(place AS STRING), 3, '0') ELSE CAST(place AS STRING) END AS op_id FROM ({places('ops', 'id')}) AS o",
    "f18_range_label": "SELECT id, CASE WHEN page_to <= page_from THEN 'p. ' || CAST(page_from AS STRING) ELSE 'pp. ' || CAST(page_from AS STRING) || '-' || CAST(page_to AS STRING) END AS label FROM {ops}",
}

_SERIES = "SELECT *, row_number() OVER (PARTITION BY hospital, sigla ORDER BY year DESC, month DESC) AS back FROM {history}"
HISTORY = {
    "s19_upsert": "SELECT year, month, hospital, sigla, count FROM (SELECT *, row_number() OVER (PARTITION BY year, month, hospital, sigla ORDER BY seq DESC) AS n FROM (SELECT *, 1 AS seq FROM {history} UNION ALL SELECT year, month, hospital, sigla, count + 1, 2 FROM {history} WHERE month = 3) AS u) AS r WHERE n = 1",
    "s24_sessions": "SELECT DISTINCT lpad(CAST(year AS STRING), 4, '0') || '-' || lpad(CAST(month AS STRING), 2, '0') AS session_id FROM {history} ORDER BY 1",
    "a18_series_stats": f"SELECT hospital, sigla, max(CASE WHEN back = 1 THEN count END) AS last, CAST(floor(avg(count) + 0.5) AS BIGINT) AS mean, min(count) AS least, max(count) AS most FROM ({_SERIES}) AS s GROUP BY hospital, sigla",
    "a19_series": "SELECT concat(hospital, '|', sigla) AS cell, array_join(transform(sort_array(collect_list(struct(year, month, count))), x -> concat(CAST(x.year AS STRING), '-', CAST(x.month AS STRING), ':', CAST(x.count AS STRING))), ' ') AS series FROM {history} GROUP BY hospital, sigla",
    "a38_scaled": "SELECT year, month, hospital, sigla, (count - min(count) OVER (PARTITION BY hospital, sigla)) / CAST(greatest(max(count) OVER (PARTITION BY hospital, sigla) - min(count) OVER (PARTITION BY hospital, sigla), 1) AS DOUBLE) AS y FROM {history}",
    "w23_drop_detector": f"SELECT hospital, sigla, CASE WHEN count(*) >= 7 AND count_if(back BETWEEN 2 AND 7 AND count > 0) = 6 AND max(CASE WHEN back = 1 THEN count END) / avg(CASE WHEN back BETWEEN 2 AND 7 THEN count END) < 0.7 THEN 'warn' ELSE 'neutral' END AS tone FROM ({_SERIES}) AS s GROUP BY hospital, sigla",
    "w24_last_months": "SELECT * FROM {history} WHERE year * 12 + month > (SELECT max(year * 12 + month) FROM {history}) - 12",
    "w25_eta": "SELECT event_id, done, CASE WHEN done = 0 OR done = total THEN NULL ELSE CAST(floor(elapsed / done * (total - done)) AS BIGINT) END AS eta FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS done, count(*) OVER (PARTITION BY user_id) AS total, (unix_micros(ts) - min(unix_micros(ts)) OVER (PARTITION BY user_id)) / 1000000.0D AS elapsed FROM (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts FROM {events}) AS e) AS p",
    "f12_session_id": "SELECT DISTINCT year, month, lpad(CAST(year AS STRING), 4, '0') || '-' || lpad(CAST(month AS STRING), 2, '0') AS session_id FROM {history}",
    "f13_month_title": "SELECT DISTINCT month, CASE month WHEN 1 THEN 'Enero' WHEN 2 THEN 'Febrero' WHEN 3 THEN 'Marzo' WHEN 4 THEN 'Abril' WHEN 5 THEN 'Mayo' WHEN 6 THEN 'Junio' WHEN 7 THEN 'Julio' WHEN 8 THEN 'Agosto' WHEN 9 THEN 'Septiembre' WHEN 10 THEN 'Octubre' WHEN 11 THEN 'Noviembre' ELSE 'Diciembre' END AS title FROM {history}",
    "f17_eta_label": "SELECT id, '~' || CAST(CAST(greatest(1, floor(pages * 350 / 60000 + 0.5)) AS INT) AS STRING) || ' min' AS label FROM {files}",
    "x03_dedup_events": "SELECT user_id, event_type, min(event_id) AS event_id FROM {events} GROUP BY user_id, event_type",
    "x06_lease_sessions": "SELECT user_id, session, count(*) AS beats, min(ts) AS joined, max(ts) AS last_seen FROM (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts >= prev + INTERVAL '6' HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM {events}) AS a) AS b GROUP BY user_id, session",
}

EVALUATION = {
    "j11_predictions_truth": "SELECT pdf, page, curr AS predicted, true_curr AS truth, COALESCE(curr = true_curr, false) AS exact FROM {recovered}",
    "j12_truth_priority": "SELECT pdf, page, curr, 'index' AS origin FROM {variant_reads} WHERE variant = 'raw' AND curr IS NOT NULL UNION ALL SELECT r.pdf, r.page, r.curr, 'fixture' FROM {page_reads} AS r WHERE r.curr IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {variant_reads} AS v WHERE v.variant = 'raw' AND v.curr IS NOT NULL AND v.pdf = r.pdf AND v.page = r.page)",
    "j13_code_collisions": "SELECT a.hospital, a.token AS code, a.host AS a, b.host AS b FROM (SELECT DISTINCT hospital, host, token FROM {name_tokens} WHERE length(token) > 3 AND NOT contains(token, '_') AND NOT contains(token, '-')) AS a JOIN (SELECT DISTINCT hospital, host, token FROM {name_tokens} WHERE length(token) > 3 AND NOT contains(token, '_') AND NOT contains(token, '-')) AS b ON a.hospital = b.hospital AND a.token = b.token AND a.host < b.host",
    # quantiles from counts of values, which merge: a window has a row a value, not a row a file
    "a20_nearest_rank": "SELECT host, min(CASE WHEN upto >= 1 + CAST(bround(0.25 * (c - 1), 0) AS BIGINT) THEN pages END) AS p25, min(CASE WHEN upto >= 1 + CAST(bround(0.5 * (c - 1), 0) AS BIGINT) THEN pages END) AS median, min(CASE WHEN upto >= 1 + CAST(bround(0.75 * (c - 1), 0) AS BIGINT) THEN pages END) AS p75, min(pages) AS least, max(pages) AS most, CAST(max(c) AS BIGINT) AS n FROM (SELECT host, pages, sum(k) OVER (PARTITION BY host ORDER BY pages) AS upto, sum(k) OVER (PARTITION BY host) AS c FROM (SELECT host, pages, count(*) AS k FROM {files} WHERE pages > 0 GROUP BY host, pages) AS h) AS r GROUP BY host",
    "a21_code_survey": "SELECT cell, code, count(*) AS n FROM (SELECT pdf % 5 AS cell, code, row_number() OVER (PARTITION BY pdf ORDER BY page) AS k FROM {page_reads} WHERE code IS NOT NULL) AS r WHERE k <= 6 GROUP BY cell, code HAVING count(*) >= 2",
    "a22_pattern_metrics": """
        SELECT variant, count(*) AS n, count(total) AS matches, count_if(total = period) AS correct, count_if(total <> period) AS false_positives, round(count(total) / CAST(count(*) AS DOUBLE), 4) AS match_rate, round(count_if(total <> period) / CAST(NULLIF(count(total), 0) AS DOUBLE), 4) AS fp_rate, count(DISTINCT total) AS totals
        FROM {pattern_reads} GROUP BY variant""",
    "a23_reader_metrics": """
        SELECT host, CAST(sum(exact) AS BIGINT) / CAST(NULLIF(sum(truths), 0) AS DOUBLE) AS exact, CAST(sum(reads) AS BIGINT) / CAST(sum(k) AS DOUBLE) AS parse_rate, CAST(sum(CASE WHEN ms > 0 THEN ms * k END) AS DOUBLE) / CAST(sum(CASE WHEN ms > 0 THEN k END) AS DOUBLE) AS mean_ms, min(CASE WHEN upto >= 1 + CAST(floor(c * 0.95) AS BIGINT) THEN ms END) AS p95_ms
        FROM (SELECT *, sum(k) OVER (PARTITION BY host ORDER BY ms) AS upto, sum(k) OVER (PARTITION BY host) AS c
          FROM (SELECT host, ms, count(*) AS k, count_if(curr = true_curr) AS exact, count(true_curr) AS truths, count(curr) AS reads
            FROM (SELECT pdf % 5 AS host, curr, CASE WHEN partkey % 4 > 0 THEN true_curr END AS true_curr, CAST(partkey % 1000 AS INT) AS ms FROM {page_reads}) AS q GROUP BY host, ms) AS h) AS r GROUP BY host""",
    "a24_rescue_counts": "SELECT rescued, regressed, maintained, still_failed, rescued - 3 * regressed AS net, round(rescued / CAST(n AS DOUBLE), 4) AS rescue_rate FROM (SELECT count(*) AS n, count_if(method = 'failed' AND curr = true_curr) AS rescued, count_if(method = 'direct' AND curr <> true_curr) AS regressed, count_if(method = 'direct' AND curr = true_curr) AS maintained, count_if(curr IS NULL) AS still_failed FROM {recovered}) AS s",
    "a25_composite_score": """
        SELECT config, doc_exact + complete_exact - 3 * real_delta - real_complete_delta - synthetic_delta - inferred_delta - 5 * regressions AS composite, doc_exact, complete_exact, real_delta, real_complete_delta, synthetic_delta, inferred_delta, regressions
        FROM (SELECT config, sum(CASE WHEN d = 0 THEN CASE WHEN real THEN 5 ELSE 3 END ELSE 0 END) AS doc_exact, sum(CASE WHEN (real AND complete >= true_complete) OR (NOT real AND d = 0 AND complete = true_complete) THEN 2 ELSE 0 END) AS complete_exact,
            sum(CASE WHEN real THEN d ELSE 0 END) AS real_delta, sum(CASE WHEN real AND complete < true_complete THEN true_complete - complete ELSE 0 END) AS real_complete_delta, sum(CASE WHEN NOT real THEN d ELSE 0 END) AS synthetic_delta,
            sum(CASE WHEN NOT real THEN abs(n_inferred - true_inferred) ELSE 0 END) AS inferred_delta, count_if(passed_before AND NOT passed) AS regressions
          FROM (SELECT *, CASE WHEN real THEN d = 0 ELSE d = 0 AND complete = true_complete END AS passed, max(CASE WHEN config = 'direct' AND CASE WHEN real THEN d = 0 ELSE d = 0 AND complete = true_complete END THEN 1 ELSE 0 END) OVER (PARTITION BY pdf) = 1 AS passed_before
            FROM (SELECT c.*, t.documents AS true_documents, t.complete AS true_complete, t.failed AS true_inferred, abs(c.documents - t.documents) AS d, c.pdf % 3 = 0 AS real FROM {config_counts} AS c JOIN {true_counts} AS t ON t.pdf = c.pdf) AS x) AS y GROUP BY config) AS z""",
    "a26_engine_verdict": "SELECT sigla, CAST(sum(abs(COALESCE(per_file, 0) - pages)) AS BIGINT) AS pagination, CAST(sum(abs(COALESCE(override, 0) - pages)) AS BIGINT) AS current_engine, CASE WHEN sum(abs(COALESCE(per_file, 0) - pages)) <= sum(abs(COALESCE(override, 0) - pages)) THEN 'MIGRATE' ELSE 'KEEP' END AS verdict FROM {file_counts} GROUP BY sigla",
    "a33_variant_scores": """
        SELECT variant, failed, correct, wrong, correct - max(CASE WHEN variant = 'raw' THEN correct END) OVER (PARTITION BY 1) AS delta, row_number() OVER (ORDER BY correct DESC, wrong, variant) AS place
        FROM (SELECT variant, count_if(curr IS NULL) AS failed, count_if(curr = true_curr) AS correct, count_if(curr <> true_curr) AS wrong FROM {variant_reads} GROUP BY variant) AS s""",
    "a40_phase_winners": """
        SELECT phase, label, net_gain, winner FROM (SELECT phase, label, net_gain, row_number() OVER (PARTITION BY phase ORDER BY net_gain DESC, label) = 1 AS winner FROM {technique_gains}) AS w
        UNION ALL SELECT 'combo', label, net_gain, row_number() OVER (ORDER BY net_gain DESC, label) = 1 FROM {combo_gains}""",
    # the three best on a sample of the failed pages, by rescued pages and then by those still failed, are tried on all pages
    "t13_prescreened": """
        SELECT v.variant, s.rescued AS screened, s.still_failed, count_if(p.method = 'failed' AND v.curr = v.true_curr) AS rescued, count_if(p.method = 'direct' AND COALESCE(v.curr <> v.true_curr, true)) AS regressed
        FROM {variant_reads} AS v JOIN {page_reads} AS p ON p.pdf = v.pdf AND p.page = v.page
        JOIN (SELECT variant, rescued, still_failed FROM (SELECT variant, rescued, still_failed, row_number() OVER (ORDER BY rescued DESC, still_failed, variant) AS place
            FROM (SELECT v.variant, count_if(v.curr = v.true_curr) AS rescued, count_if(v.curr IS NULL) AS still_failed FROM {variant_reads} AS v JOIN {screen_pages} AS c ON c.pdf = v.pdf AND c.page = v.page WHERE v.variant <> 'raw' GROUP BY v.variant) AS w) AS r WHERE place <= 3) AS s ON s.variant = v.variant
        GROUP BY v.variant, s.rescued, s.still_failed""",
    "a34_signed_deltas": "SELECT c.pdf, max(CASE WHEN c.config = 'recovered' THEN c.documents END) - max(t.documents) AS delta_recovered, max(CASE WHEN c.config = 'direct' THEN c.documents END) - max(t.documents) AS delta_direct FROM {config_counts} AS c JOIN {true_counts} AS t ON t.pdf = c.pdf GROUP BY c.pdf",
    "t05_ranked": "SELECT sigla, rescued, failed FROM (SELECT sigla, count_if(per_file > 0) AS rescued, count_if(per_file IS NULL) AS failed FROM {file_counts} GROUP BY sigla) AS s ORDER BY rescued DESC, failed, sigla LIMIT 10",
    "t10_param_grid": "SELECT DISTINCT dpi, CASE WHEN deskew = 0 THEN 0 ELSE angle END AS angle, deskew FROM (SELECT DISTINCT 150 + 33 * (p_size % 5) AS dpi FROM {part}) AS d CROSS JOIN (SELECT DISTINCT 5 + p_size % 7 AS angle FROM {part}) AS a CROSS JOIN (SELECT DISTINCT p_partkey % 2 AS deskew FROM {part}) AS s",
    "u01_union_keys": "SELECT file FROM {file_counts} WHERE per_file IS NOT NULL UNION SELECT file FROM {file_counts} WHERE override IS NOT NULL",
    "u02_difference": "SELECT file FROM {file_counts} EXCEPT SELECT file FROM {marks}",
    "u06_intersection": "SELECT code FROM {page_reads} WHERE suppkey % 2 = 0 AND code IS NOT NULL INTERSECT SELECT code FROM {page_reads} WHERE suppkey % 2 = 1",
}

TEXT = {
    "j08_anchor_hits": "SELECT pdf, page, sigla, flavor, explode(matched) AS anchor FROM {raw_flavors}",
    "m01_match_flavor": "SELECT pdf, page, sigla, flavor, size(matched) AS matched, size(missing) AS missing, anti_hits, size(matched) >= min_match AND anti_hits = 0 AS passes, anti_hits = 0 AND min_match > 1 AND size(matched) = min_match - 1 AS near FROM {raw_flavors}",
    "m02_match_page": "SELECT pdf, page, raw_owner AS flavor, raw_near AS near_flavor FROM {cover_pages}",
    "m03_count_covers": "SELECT pdf, sigla, count(owner) AS covers, count(*) AS pages, count(near) AS near_matches FROM {cover_pages} GROUP BY pdf, sigla",
    "m04_two_pass": "SELECT pdf, page, owner, near, CASE WHEN raw_owner IS NOT NULL THEN 1 WHEN owner IS NOT NULL THEN 2 END AS found_in FROM {cover_pages}",
    # every anchor, and how many of its category's pages have it
    "m05_anchors": "SELECT a.sigla, a.flavor, a.ord, a.min_match, a.place, a.anchor, a.is_anti, count(t.text) AS pages FROM {dim_anchor} AS a LEFT JOIN (SELECT sigla, raw AS text FROM {folded_covers}) AS t ON t.sigla = a.sigla AND contains(t.text, a.anchor) GROUP BY a.sigla, a.flavor, a.ord, a.min_match, a.place, a.anchor, a.is_anti",
    "a14_flavor_counts": "SELECT f.sigla, f.flavor, COALESCE(c.covers, 0) AS covers FROM (SELECT DISTINCT sigla, flavor FROM {dim_anchor}) AS f LEFT JOIN (SELECT sigla, owner, count(*) AS covers FROM {cover_pages} WHERE owner IS NOT NULL GROUP BY sigla, owner) AS c ON c.sigla = f.sigla AND c.owner = f.flavor",
    "t02_near_matches": "SELECT pdf, page, near AS near_flavor FROM {cover_pages} WHERE near IS NOT NULL",
    # categories that are scanned by anchors show three different ones, but none that says a page's number
    "t06_first_anchors": f"""
        SELECT c.hospital, c.sigla, r.anchor, r.n AS place FROM {{cells}} AS c JOIN (SELECT sigla, anchor, row_number() OVER (PARTITION BY sigla ORDER BY ord, place) AS n
          FROM (SELECT a.sigla, a.anchor, a.ord, a.place, row_number() OVER (PARTITION BY a.sigla, a.anchor ORDER BY a.ord, a.place) AS again FROM {{dim_anchor}} AS a JOIN {{dim_sigla}} AS s ON s.sigla = a.sigla AND s.strategy = 'anchors'
            WHERE a.is_anti = 0 AND {" AND ".join(f"a.anchor NOT LIKE '{p}%'" for p in PAGE_ANCHORS)}) AS d WHERE again = 1) AS r ON r.sigla = c.sigla WHERE r.n <= {MOST_SHOWN}""",
    # a page that nearly matches, as a flavor to be added
    "f19_flavor_stub": """
        SELECT pdf, page, flavor, concat('# from file ', CAST(pdf AS STRING), ' p.', CAST(page AS STRING), ' (', flavor, ')\\nanchors: ', array_join(matched, ', '), '\\nmissing: ', array_join(missing, ', '), '\\nmin_match: ', CAST(greatest(3, size(matched)) AS STRING)) AS stub
        FROM {raw_flavors} WHERE anti_hits = 0 AND min_match > 1 AND size(matched) = min_match - 1""",
    # what a reader's result and its near matches look like in an event
    "p23_event_payload": """
        SELECT hospital, sigla, CAST(sum(COALESCE(per_file, 0)) AS BIGINT) AS ocr_count, CASE WHEN bool_or(pages = 0) THEN 'low' ELSE 'high' END AS confidence, count_if(pages = 0) AS errors, max(CASE WHEN method IS NULL THEN '' ELSE method END) AS method
        FROM {file_counts} WHERE COALESCE(method, '') <> 'filename_glob' GROUP BY hospital, sigla""",
    "f04_digit_confusion": "SELECT pdf, page, translate(text, 'OolI|ZSB', '00111258') AS for_pages, translate(text, 'OoIilLzZ|tT''‘’`´', '0011112201111111') AS for_numbers FROM {page_text} WHERE text <> ''",
    "f06_token_hits": "SELECT id, token, sigla FROM (SELECT n.id, n.token, d.sigla FROM {name_tokens} AS n JOIN {dim_token} AS d ON d.token = n.token) AS t",
    "f11_slash_parse": "SELECT id, CAST(regexp_extract(t, '^([0-9]+)/([0-9]+)$', 1) AS INT) AS curr, CAST(regexp_extract(t, '^([0-9]+)/([0-9]+)$', 2) AS INT) AS total FROM (SELECT id, CAST(pages AS STRING) || '/' || CAST(pages + 2 AS STRING) AS t FROM {files}) AS f",
}

_PARTS = "SELECT DISTINCT hospital, host, unnest(string_split(translate(substr(lower(name), 1, length(name) - 4), '.-', '__'), '_')) AS token FROM {files} WHERE lower(name) LIKE '%.pdf'"
#: Texts for the oracle where they are not those of the operators.
ORACLE = {
    "a20_nearest_rank": "SELECT host, max(CASE WHEN n = 1 + CAST(bround(0.25 * (c - 1), 0) AS BIGINT) THEN pages END) AS p25, max(CASE WHEN n = 1 + CAST(bround(0.5 * (c - 1), 0) AS BIGINT) THEN pages END) AS median, max(CASE WHEN n = 1 + CAST(bround(0.75 * (c - 1), 0) AS BIGINT) THEN pages END) AS p75, min(pages) AS least, max(pages) AS most, count(*) AS n FROM (SELECT host, pages, row_number() OVER (PARTITION BY host ORDER BY pages) AS n, count(*) OVER (PARTITION BY host) AS c FROM {files} WHERE pages > 0) AS r GROUP BY host",
    "a23_reader_metrics": """
        SELECT host, count_if(curr = true_curr) / CAST(NULLIF(count(true_curr), 0) AS DOUBLE) AS exact, count(curr) / CAST(count(*) AS DOUBLE) AS parse_rate, avg(CASE WHEN ms > 0 THEN ms END) AS mean_ms, max(CASE WHEN n = 1 + CAST(floor(c * 0.95) AS BIGINT) THEN ms END) AS p95_ms
        FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY ms, pdf, page) AS n, count(*) OVER (PARTITION BY host) AS c FROM (SELECT pdf % 5 AS host, pdf, page, curr, CASE WHEN partkey % 4 > 0 THEN true_curr END AS true_curr, CAST(partkey % 1000 AS INT) AS ms FROM {page_reads}) AS q) AS r GROUP BY host""",
    "m05_anchors": f"SELECT a.sigla, a.flavor, a.ord, a.min_match, a.place, a.anchor, a.is_anti, count(t.text) AS pages FROM {{dim_anchor}} AS a LEFT JOIN (SELECT sigla, {folded('', 'strip_accents(raw)')} AS text FROM {{cover_text}}) AS t ON t.sigla = a.sigla AND contains(t.text, a.anchor) GROUP BY ALL",
    "j13_code_collisions": f"SELECT a.hospital, a.token AS code, a.host AS a, b.host AS b FROM ({_PARTS}) AS a JOIN ({_PARTS}) AS b ON a.hospital = b.hospital AND a.token = b.token AND a.host < b.host WHERE length(a.token) > 3",
    "a19_series": "SELECT hospital || '|' || sigla AS cell, string_agg(year || '-' || month || ':' || count, ' ' ORDER BY year, month, count) AS series FROM {history} GROUP BY hospital, sigla",
    "w25_eta": "SELECT event_id, done, CASE WHEN done = 0 OR done = total THEN NULL ELSE CAST(floor(elapsed / done * (total - done)) AS BIGINT) END AS eta FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS done, count(*) OVER (PARTITION BY user_id) AS total, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1000000.0::DOUBLE AS elapsed FROM {events}) AS p",
    "j08_anchor_hits": "SELECT pdf, page, sigla, flavor, unnest(matched) AS anchor FROM {raw_flavors}",
    "m01_match_flavor": "SELECT pdf, page, sigla, flavor, COALESCE(len(matched), 0) AS matched, COALESCE(len(missing), 0) AS missing, anti_hits, COALESCE(len(matched), 0) >= min_match AND anti_hits = 0 AS passes, anti_hits = 0 AND min_match > 1 AND COALESCE(len(matched), 0) = min_match - 1 AS near FROM {raw_flavors}",
    "f19_flavor_stub": "SELECT pdf, page, flavor, '# from file ' || pdf || ' p.' || page || ' (' || flavor || ')' || chr(10) || 'anchors: ' || array_to_string(matched, ', ') || chr(10) || 'missing: ' || array_to_string(missing, ', ') || chr(10) || 'min_match: ' || greatest(3, len(matched)) AS stub FROM {raw_flavors} WHERE anti_hits = 0 AND min_match > 1 AND len(matched) = min_match - 1",
    "f06_token_hits": "SELECT f.id, d.token, d.sigla FROM {files} AS f JOIN {dim_token} AS d ON lower(f.name) LIKE '%.pdf' AND regexp_matches(substr(lower(f.name), 1, length(f.name) - 4), '(^|[_.-])(' || d.token || ')($|[_.-])')",
}

OPERATORS = REORG | HISTORY | EVALUATION | TEXT
