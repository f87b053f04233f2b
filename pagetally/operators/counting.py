"""File names, page reads and cells: what is counted, and how far to trust it."""

FILES = {
    "s02_month_grid": "SELECT h.hospital, s.sigla, count(f.id) AS pdfs, count(f.id) > 0 AS present FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s LEFT JOIN {files} AS f ON f.hospital = h.hospital AND f.host = s.sigla GROUP BY h.hospital, s.sigla",
    "s03_folder_resolution": "SELECT d.n_name AS dir, min_by(s.sigla, s.ord) AS sigla FROM (SELECT n_name, CASE n_nationkey % 4 WHEN 0 THEN '7.-ART' WHEN 1 THEN ' 12 . Senaleticas 0' WHEN 2 THEN '3.-ODI Visitas TOTAL' ELSE n_name END AS raw FROM {nation}) AS d LEFT JOIN {dim_sigla} AS s ON trim(regexp_replace(d.raw, '^[ ]*[0-9]+[ ]*[.][ ]*-?[ ]*', '')) = s.folder_text OR trim(regexp_replace(d.raw, '^[ ]*[0-9]+[ ]*[.][ ]*-?[ ]*', '')) LIKE s.folder_text || ' %' GROUP BY d.n_name",
    "s20_month_point": "SELECT * FROM {history} WHERE year = 1997 AND month = 5",
    "s21_month_range": "SELECT * FROM {history} WHERE year BETWEEN 1996 AND 1997 AND year * 12 + month BETWEEN 1996 * 12 + 11 AND 1997 * 12 + 3 ORDER BY year, month, hospital, sigla",
    "s10_two_tier_read": "SELECT pdf, page, COALESCE(CASE WHEN low_curr IS NOT NULL THEN low_curr END, high_curr) AS curr, CASE WHEN low_curr IS NOT NULL THEN 'direct' WHEN high_curr IS NOT NULL THEN 'super_resolution' ELSE 'failed' END AS method FROM (SELECT a.pdf, a.page, a.curr AS low_curr, b.curr AS high_curr FROM (SELECT * FROM {variant_reads} WHERE variant = 'raw') AS a JOIN (SELECT * FROM {variant_reads} WHERE variant = 'digits') AS b ON b.pdf = a.pdf AND b.page = a.page) AS t",
    "s26_page_slice": "SELECT pdf, page, curr, total FROM {page_reads} WHERE page - 1 >= 3 AND page - 1 < 9",
    "p01_folder_text": "SELECT id, hospital, trim(regexp_replace(name, '^[ ]*[0-9]+[ ]*[.][ ]*-?[ ]*', '')) AS text FROM {folder_names}",
    "p02_folder_sigla": "SELECT d.id, d.text, min_by(s.sigla, s.ord) AS sigla FROM (SELECT id, trim(regexp_replace(name, '^[ ]*[0-9]+[ ]*[.][ ]*-?[ ]*', '')) AS text FROM {folder_names}) AS d LEFT JOIN {dim_sigla} AS s ON d.text = s.folder_text OR d.text LIKE s.folder_text || ' %' GROUP BY d.id, d.text",
    "p03_belongs_to_cell": "SELECT id, CASE WHEN host = 'chps' THEN lower(name) LIKE '%.pdf' ELSE COALESCE(sigla = host, false) END AS belongs FROM {file_sigla}",
    "p04_only_skip": "SELECT f.id, f.file FROM {file_counts} AS f WHERE f.hospital = 'HPV' AND NOT EXISTS (SELECT 1 FROM {file_counts} AS r WHERE r.id = f.id AND (r.method NOT IN ('', 'filename_glob') OR r.override IS NOT NULL))",
    "p05_skip_set": "SELECT DISTINCT hospital, sigla, file FROM (SELECT hospital, sigla, file FROM {file_counts} WHERE method IS NOT NULL AND method NOT IN ('', 'filename_glob') UNION ALL SELECT hospital, sigla, file FROM {file_counts} WHERE override IS NOT NULL) AS s",
    "p07_file_origin": "SELECT id, origin FROM {file_origin}",
    "p08_settled": "SELECT hospital, sigla, settled FROM {settled_cells}",
    "p14_file_search": "SELECT id, name FROM {files} WHERE instr(lower(name), 'irl') > 0 AND host IN ('irl', 'odi')",
    "p15_differs_from_pages": "SELECT id, COALESCE(override, per_file, 1) AS shown, pages FROM {file_counts} WHERE sigla <> 'maquinaria' AND pages > 0 AND COALESCE(override, per_file, 1) <> pages",
    "p17_pending_cells": "SELECT hospital, sigla FROM {ready_cells} WHERE NOT ready",
    "p18_grid_fill": "SELECT h.hospital, s.sigla, COALESCE(v.count, 0) AS value FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s LEFT JOIN (SELECT n.*, c.excluded FROM {cell_count} AS n JOIN {cells} AS c ON c.hospital = n.hospital AND c.sigla = n.sigla) AS v ON v.hospital = h.hospital AND v.sigla = s.sigla WHERE s.sigla <> 'chps' AND NOT COALESCE(v.excluded, false)",
    "p20_history_method": "SELECT hospital, sigla, CASE WHEN user_override IS NOT NULL THEN 'override' WHEN ocr_count IS NOT NULL THEN COALESCE(method, 'filename_glob') ELSE 'filename_glob' END AS method FROM {cells}",
    "p22_excluded_value": "SELECT c.hospital, c.sigla, CASE WHEN NOT c.excluded THEN n.count END AS value FROM {cells} AS c JOIN {cell_count} AS n ON n.hospital = c.hospital AND n.sigla = c.sigla",
    "p13_count_cap": "SELECT c.hospital, c.sigla, c.user_override > 10000 OR (s.count_type <> 'checks' AND COALESCE(f.pages, 0) > 0 AND c.user_override > f.pages) AS rejected FROM {cells} AS c JOIN {dim_sigla} AS s ON c.sigla = s.sigla LEFT JOIN {cell_files} AS f ON f.hospital = c.hospital AND f.sigla = c.sigla WHERE c.user_override IS NOT NULL",
    "p13_file_count_cap": "SELECT f.id, f.override > 10000 OR (s.count_type <> 'checks' AND f.pages > 0 AND f.override > f.pages) AS rejected FROM {file_counts} AS f JOIN {dim_sigla} AS s ON f.sigla = s.sigla WHERE f.override IS NOT NULL",
    "j07_name_patterns": "SELECT id, sigla, CAST(pos AS INT) AS pos, CAST(len AS INT) AS len FROM {name_hits}",
    "t01_extract_sigla": "SELECT id, name, sigla FROM {file_sigla}",
    "u04_foreign_names": "SELECT host, hospital, name, suggested FROM {foreign_names}",
    "u03_suggested_siglas": "SELECT DISTINCT name, sigla FROM {name_hits}",
    "a01_count_matching": "SELECT host, count(*) AS files_scanned, count_if(COALESCE(sigla = host, false)) AS matched, count_if(COALESCE(sigla = host, false)) = 0 AS no_matching, count_if(sigla IS NULL) > 0 AS some_unrecognized FROM {file_sigla} GROUP BY host",
    "a02_subfolders": "SELECT host, folder, count(*) AS n, count_if(lower(name) LIKE '%.pdf') AS pdfs FROM {files_dup} GROUP BY host, folder",
    "a03_duplicate_names": "SELECT host, name, count(*) AS n FROM {files_dup} GROUP BY host, name HAVING count(*) >= 2",
    "a04_compilation_suspect": "SELECT f.hospital, f.host, COALESCE(max(CASE WHEN pages > 0 THEN pages END) > 3 * max(COALESCE(expected, 5)) OR (count_if(pages > 0) >= 3 AND avg(CASE WHEN pages > 0 THEN pages END) > 2 * max(COALESCE(expected, 5))), false) AS suspect FROM {files} AS f LEFT JOIN {dim_sigla} AS s ON f.host = s.sigla GROUP BY f.hospital, f.host",
    "a05_fixed_pages": "SELECT f.hospital, f.host, CAST(sum(f.pages) AS BIGINT) AS documents, f.host IN ('caliente', 'herramientas_elec', 'exc') AS inferred FROM {files} AS f JOIN {dim_sigla} AS s ON f.host = s.sigla WHERE s.fixed_pages IS NOT NULL GROUP BY f.hospital, f.host",
    "a06_variable_count": "SELECT h.hospital, s.sigla, count(f.id) AS documents, CASE WHEN COALESCE(bool_and(f.pages = 1), true) THEN 'high' ELSE 'low' END AS confidence FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s LEFT JOIN (SELECT * FROM {file_sigla} WHERE sigla = host) AS f ON f.hospital = h.hospital AND f.host = s.sigla GROUP BY h.hospital, s.sigla",
    "a39_page_total": "SELECT hospital, host, CAST(sum(pages) AS BIGINT) AS pages FROM {files} GROUP BY hospital, host",
    "a30_progress_total": "SELECT f.hospital, count(*) AS n FROM {file_counts} AS f WHERE NOT (f.method IS NOT NULL AND f.method NOT IN ('', 'filename_glob')) AND f.override IS NULL GROUP BY f.hospital",
    "f09_ratio_count": "SELECT id, CAST(greatest(1, bround(pages / 2, 0)) AS INT) AS documents FROM {files}",
    "f20_effective_count": "SELECT id, COALESCE(override, per_file, 1) AS effective, pages >= 10 AS suspect FROM {file_counts}",
    "f21_contribution": "SELECT hospital, sigla, CAST(sum(COALESCE(override, per_file, 1)) AS BIGINT) AS documents FROM {file_counts} GROUP BY hospital, sigla",
    "t11_largest_file": "SELECT hospital, host, max_by(name, struct(pages, -id)) AS name, max(pages) AS pages FROM {files} GROUP BY hospital, host",
    "t12_list_window": "SELECT id, name FROM {files} ORDER BY id LIMIT 40 OFFSET 20",
}

CELLS = {
    "j01_inventory_results": "SELECT c.hospital, c.sigla, count(*) AS files FROM {cells} AS c JOIN {file_counts} AS f ON c.hospital = f.hospital AND c.sigla = f.sigla GROUP BY c.hospital, c.sigla",
    "j02_override_merge": "SELECT COALESCE(p.file, o.file) AS file, COALESCE(o.override, p.per_file, 0) AS count FROM (SELECT file, per_file FROM {file_counts} WHERE per_file IS NOT NULL) AS p FULL OUTER JOIN (SELECT file, override FROM {file_counts} WHERE override IS NOT NULL) AS o ON p.file = o.file",
    "j03_marks_present": "SELECT m.id, m.count FROM {marks} AS m WHERE EXISTS (SELECT 1 FROM {file_counts} AS f WHERE f.file = m.file AND f.hospital = m.hospital AND f.sigla = m.sigla)",
    "j06_orphan_marks": "SELECT m.hospital, m.sigla, m.file, count(*) AS n FROM {marks} AS m WHERE NOT EXISTS (SELECT 1 FROM {file_counts} AS f WHERE f.file = m.file AND f.hospital = m.hospital AND f.sigla = m.sigla) GROUP BY m.hospital, m.sigla, m.file",
    "j14_discrepancy": "SELECT f.host, f.n AS counted, r.n AS listed, f.n <> r.n AS differs FROM (SELECT host, count(*) AS n FROM {file_sigla} WHERE sigla = host GROUP BY host) AS f LEFT JOIN (SELECT host, count(*) AS n FROM {files} GROUP BY host) AS r ON f.host = r.host",
    "j16_seed_missing": "SELECT h.hospital, s.sigla FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s WHERE NOT EXISTS (SELECT 1 FROM {files} AS f WHERE f.hospital = h.hospital AND f.host = s.sigla)",
    "j15_unknown_ranges": "SELECT c.hospital || '_' || c.sigla || '_count' AS range_name FROM {cells} AS c WHERE NOT EXISTS (SELECT 1 FROM {dim_sigla} AS s WHERE s.sigla = c.sigla AND s.sigla <> 'chps')",
    "a07_cell_count": "SELECT hospital, sigla, count FROM {cell_count}",
    "a08_marks_tally": "SELECT n.hospital, n.sigla, n.workers FROM {cell_count} AS n JOIN {marked_cells} AS m ON m.hospital = n.hospital AND m.sigla = n.sigla",
    "a09_cell_rollup": "SELECT hospital, sigla, CAST(sum(COALESCE(per_file, 0)) AS BIGINT) AS documents, count(*) AS files_scanned, count_if(pages = 0) AS errors, bool_or(pages = 1) AS a7_one_page_locked, bool_or(pages > 1 AND COALESCE(per_file, 0) = 0) AS some_low_trust, CASE WHEN bool_or(pages = 0 OR (pages > 1 AND COALESCE(per_file, 0) = 0)) THEN 'low' ELSE 'high' END AS confidence FROM {file_counts} GROUP BY hospital, sigla",
    "a16_hospital_totals": "SELECT COALESCE(hospital, 'all') AS hospital, CAST(sum(count) AS BIGINT) AS total FROM {cell_count} GROUP BY ROLLUP (hospital)",
    "a17_worker_status": """
        SELECT h.hospital, CASE WHEN count(w.sigla) = 0 THEN NULL WHEN count_if(w.worker_status = 'terminado') = count(w.sigla) THEN 'listo' WHEN count_if(w.started) = 0 THEN 'pendiente' ELSE 'en_proceso' END AS status
        FROM {dim_hospital} AS h LEFT JOIN (SELECT c.hospital, c.sigla, c.worker_status, c.worker_status IS NOT NULL OR m.sigla IS NOT NULL AS started
          FROM {cells} AS c JOIN {dim_sigla} AS s ON s.sigla = c.sigla AND s.count_type IN ('documents_workers', 'checks')
          LEFT JOIN {cell_files} AS f ON f.hospital = c.hospital AND f.sigla = c.sigla LEFT JOIN {marked_cells} AS m ON m.hospital = c.hospital AND m.sigla = c.sigla
          WHERE COALESCE(f.scanned, 0) > 0 OR COALESCE(c.user_override, c.ocr_count, c.filename_count, 0) > 0) AS w ON w.hospital = h.hospital GROUP BY h.hospital""",
    "a31_session_dump": "SELECT session_id, hospital, sigla, CAST(effective AS BIGINT) AS effective, CAST(workers AS BIGINT) AS workers FROM (SELECT '2026-04' AS session_id, hospital, sigla, count AS effective, workers FROM {cell_count} UNION ALL SELECT lpad(CAST(year AS STRING), 4, '0') || '-' || lpad(CAST(month AS STRING), 2, '0'), hospital, sigla, count, NULL FROM {history}) AS s",
    "p21_enriched_cells": """
        SELECT n.hospital, n.sigla, CASE WHEN n.count_type IN ('documents_workers', 'checks') THEN n.workers END AS worker_count, CASE WHEN n.count_type = 'checks' THEN n.count END AS checks_count, COALESCE(o.n, 0) AS open_suspects, COALESCE(o.counted, 0) AS counted_suspects, o.first_id
        FROM {cell_count} AS n LEFT JOIN (SELECT hospital, sigla, count(*) AS n, count_if(counted) AS counted, min(suspect_id) AS first_id FROM {open_suspects} GROUP BY hospital, sigla) AS o ON o.hospital = n.hospital AND o.sigla = n.sigla""",
    "p06_has_work": "SELECT hospital, sigla, has_work FROM {worked_cells}",
    "p16_cell_tone": "SELECT h.hospital, s.sigla, CASE WHEN r.errors > 0 THEN 'state-error' WHEN r.sigla IS NULL THEN 'neutral' WHEN r.ready THEN 'confidence-high' ELSE 'confidence-low' END AS tone FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s LEFT JOIN {ready_cells} AS r ON r.hospital = h.hospital AND r.sigla = s.sigla",
    "p10_valid_cells": "SELECT f.id FROM {file_counts} AS f WHERE EXISTS (SELECT 1 FROM {dim_hospital} AS h WHERE h.hospital = f.hospital) AND EXISTS (SELECT 1 FROM {dim_sigla} AS s WHERE s.sigla = f.sigla)",
    "p19_worker_warnings": "SELECT c.hospital, c.sigla FROM {cells} AS c JOIN {cell_files} AS f ON f.hospital = c.hospital AND f.sigla = c.sigla WHERE f.scanned > 0 AND (c.sigla IN ('charla', 'chintegral') OR (c.sigla = 'dif_pts' AND c.hospital = 'HPV')) AND COALESCE(c.worker_status, '') <> 'terminado'",
    "p19_worker_values": """
        SELECT c.hospital || '_workers_' || CASE c.sigla WHEN 'charla' THEN 'chgen' ELSE c.sigla END AS range_name, n.workers AS value FROM {cells} AS c JOIN {cell_count} AS n ON n.hospital = c.hospital AND n.sigla = c.sigla LEFT JOIN {marked_cells} AS m ON m.hospital = c.hospital AND m.sigla = c.sigla
        WHERE c.sigla IN ('charla', 'chintegral') AND (m.sigla IS NOT NULL OR c.worker_status IS NOT NULL)
        UNION ALL SELECT hospital || '_workers_difpts', workers FROM {cell_count} WHERE hospital = 'HPV' AND sigla = 'dif_pts'""",
    "f16_range_key": "SELECT hospital || '_' || sigla || '_count' AS range_name, COALESCE(user_override, 0) AS value FROM {cells}",
    "g01_rename_count": "SELECT hospital, sigla, COALESCE(filename_count, 0) AS filename_count, COALESCE(confirmed, false) AS confirmed FROM {cells}",
    "g02_note_status": "SELECT hospital, sigla, note, CASE WHEN note IS NOT NULL THEN 'por_resolver' END AS note_status FROM {cells}",
    "g04_clobber_guard": """
        SELECT c.hospital, c.sigla, COALESCE(n.n, 0) AS filename_count, CASE WHEN w.has_work THEN c.confidence ELSE CASE WHEN COALESCE(n.most, 0) <= 1 THEN 'high' ELSE 'low' END END AS confidence,
          CASE WHEN w.has_work THEN r.all_reliable AND NOT COALESCE(b.blocked, false) ELSE COALESCE(n.most <= 1, false) AND NOT COALESCE(b.blocked, false) END AS all_reliable
        FROM {cells} AS c JOIN {worked_cells} AS w ON w.hospital = c.hospital AND w.sigla = c.sigla JOIN {reliable_cells} AS r ON r.hospital = c.hospital AND r.sigla = c.sigla
        LEFT JOIN (SELECT hospital, host, count(*) AS n, max(pages) AS most FROM {file_sigla} WHERE sigla = host GROUP BY hospital, host) AS n ON n.hospital = c.hospital AND n.host = c.sigla
        LEFT JOIN (SELECT hospital, sigla, bool_or(counted) AS blocked FROM {open_suspects} GROUP BY hospital, sigla) AS b ON b.hospital = c.hospital AND b.sigla = c.sigla""",
    "g09_history_export": "SELECT n.hospital, n.sigla, n.count, COALESCE(c.confidence, 'low') AS confidence, CASE WHEN c.user_override IS NOT NULL THEN 'override' WHEN c.ocr_count IS NOT NULL THEN COALESCE(c.method, 'filename_glob') ELSE 'filename_glob' END AS method FROM {cell_count} AS n JOIN {cells} AS c ON c.hospital = n.hospital AND c.sigla = n.sigla JOIN {dim_hospital} AS h ON h.hospital = n.hospital WHERE NOT c.excluded",
    "g10_replace_mark": """
        SELECT hospital, sigla, file, page, count FROM {marks} AS m WHERE NOT EXISTS (SELECT 1 FROM {mark_patches} AS p WHERE p.hospital = m.hospital AND p.sigla = m.sigla AND p.file = m.file AND p.page = m.page)
        UNION ALL SELECT hospital, sigla, file, page, count FROM {mark_patches} WHERE count > 0""",
}

PAGES = {
    "w02_count_documents": """
        SELECT s.pdf, s.documents, s.direct, s.recovered, s.failed, CASE WHEN s.failed > 0 OR s.recovered / s.pages > 0.30 OR s.recovered_starts > 0 THEN 'low' ELSE 'high' END AS confidence
        FROM (SELECT pdf, count(*) AS pages, greatest(1, count_if(curr = 1)) AS documents, count_if(status = 'direct') AS direct, count_if(status = 'recovered') AS recovered,
          count_if(status = 'failed') AS failed, count_if(curr = 1 AND status = 'recovered') AS recovered_starts FROM {recovered} GROUP BY pdf) AS s""",
    "a10_dominant_total": "SELECT pdf, dom FROM {dominant}",
    "a11_first_seen_mode": "SELECT pdf, min_by(total, struct(-n, first_page)) AS total FROM (SELECT pdf, total, count(*) AS n, min(page) AS first_page FROM {page_reads} WHERE total IS NOT NULL GROUP BY pdf, total) AS t GROUP BY pdf",
    "a12_code_histogram": "SELECT pdf, code, count(*) AS n FROM {page_reads} WHERE code IS NOT NULL GROUP BY pdf, code",
    "a13_status_counters": "SELECT pdf, count_if(status = 'direct') AS direct, count_if(status = 'recovered') AS recovered, count_if(status = 'failed') AS failed, count_if(curr = 1 AND status = 'recovered') AS recovered_starts, count_if(curr = 1) AS starts, count_if(curr = 1 AND COALESCE(instr(upper(code), 'F-CRS-IRL-01') > 0, false)) AS cover_starts FROM {recovered} GROUP BY pdf",
    "a29_priors": "SELECT total, n / CAST(sum(n) OVER () AS DOUBLE) AS p FROM (SELECT total, count(*) AS n FROM {page_reads} WHERE total IS NOT NULL GROUP BY total) AS t",
    "a35_document_properties": "SELECT pdf, doc, pages + inferred AS found_total, pages + inferred = declared_total AND sequence_ok AS is_complete FROM {segments}",
    "a36_inference_rollup": "SELECT pdf, count_if(curr = 1) AS documents, count_if(status = 'direct') AS direct, count_if(status = 'recovered') AS inferred, count_if(status = 'failed') AS failed FROM {recovered} GROUP BY pdf",
    "a32_region_diagnostics": """
        SELECT COALESCE(region, 'total') AS region, count(*) AS reads, count_if(method = 'failed') AS failed, round(100.0 * count_if(method = 'failed') / count(*), 2) AS failed_pct, count_if(curr = 1) AS documents, count_if(curr = 1 AND complete) AS complete, count_if(curr = 1) - count_if(true_curr = 1) AS delta
        FROM (SELECT r.*, CASE WHEN r.page <= 10 THEN 'r1' WHEN r.page <= 20 THEN 'r2' ELSE 'r3' END AS region, COALESCE(g.pages + g.inferred = g.declared_total AND g.sequence_ok, false) AS complete FROM {recovered} AS r LEFT JOIN {segments} AS g ON g.pdf = r.pdf AND g.start_page = r.page AND r.curr = 1) AS x GROUP BY ROLLUP (region)""",
    "a32_top_totals": "SELECT total, n FROM (SELECT total, count(*) AS n FROM {page_reads} WHERE total IS NOT NULL GROUP BY total) AS t ORDER BY n DESC, total LIMIT 5",
    "a32_incomplete_documents": "SELECT pdf, doc, start_page, declared_total, pages + inferred AS found FROM {segments} WHERE NOT (pages + inferred = declared_total AND sequence_ok)",
    "w01_gap_recovery": "SELECT pdf, page, curr, total, status FROM {recovered}",
    "w03_segmentation": "SELECT pdf, doc, start_page, declared_total, pages, inferred, sequence_ok FROM {segments}",
    "w03_orphans": "SELECT pdf, count(*) AS orphans FROM {segmented} WHERE doc = 0 GROUP BY pdf",
    "w04_issues": "SELECT pdf, page, CASE WHEN doc = 0 THEN 'huerfana' WHEN status = 'direct' AND pos > 1 AND total <> declared THEN 'boundary' WHEN status = 'direct' AND pos > 1 AND curr <> pos THEN 'sequence' END AS issue FROM {segmented} WHERE doc = 0 OR (status = 'direct' AND pos > 1 AND (total <> declared OR curr <> pos))",
    "w05_broken_groups": "SELECT pdf, curr, pos AS expected, count(*) AS n, CAST(min(page) AS INT) AS first_page FROM {segmented} WHERE doc > 0 AND status = 'direct' AND curr <> pos GROUP BY pdf, curr, pos",
    "w06_start_gap_period": "SELECT pdf, min_by(gap, struct(-n, first_page)) AS period FROM (SELECT pdf, gap, count(*) AS n, min(page) AS first_page FROM (SELECT pdf, page, page - lag(page) OVER (PARTITION BY pdf ORDER BY page) AS gap FROM {page_reads} WHERE curr = 1) AS g WHERE gap IS NOT NULL GROUP BY pdf, gap) AS t GROUP BY pdf",
    "w10_failed_runs": "SELECT pdf, CAST(min(page) AS INT) AS start_page, CAST(max(page) + 1 AS INT) AS end_page FROM (SELECT pdf, page, page - row_number() OVER (PARTITION BY pdf ORDER BY page) AS island FROM {page_reads} WHERE method = 'failed') AS f GROUP BY pdf, island",
    "j10_cycle_pairs": "SELECT a.pdf, a.page, b.curr, b.total, round(sum(CAST(1 AS DOUBLE) / k.k) / sum(sum(CAST(1 AS DOUBLE) / k.k)) OVER (PARTITION BY a.pdf, a.page), 9) AS weight FROM (SELECT pdf, page, dom FROM {page_modes} WHERE curr IS NULL AND dom IS NOT NULL) AS a CROSS JOIN (VALUES (-7), (-6), (-5), (-4), (-3), (-2), (-1), (1), (2), (3), (4), (5), (6), (7)) AS s(step) JOIN (SELECT pdf, page, curr, total FROM {page_reads} WHERE curr IS NOT NULL) AS b ON b.pdf = a.pdf AND b.page = a.page + s.step * a.dom JOIN (VALUES (1), (2), (3), (4), (5), (6), (7)) AS k(k) ON k.k = abs(s.step) GROUP BY a.pdf, a.page, b.curr, b.total",
    "r01_one_page_lock": "SELECT id, CASE WHEN pages = 1 THEN 1 END AS documents, pages = 1 AS a7_one_page_locked FROM {files} WHERE lower(name) LIKE '%.pdf'",
    "r03_low_trust": "SELECT pdf, failed > 0 OR recovered / n > 0.30 OR recovered_starts > 0 AS low_trust, recovered > 0 OR failed > 0 AS low_trust_cover FROM (SELECT pdf, CAST(count(*) AS DOUBLE) AS n, count_if(status = 'recovered') AS recovered, count_if(status = 'failed') AS failed, count_if(curr = 1 AND status = 'recovered') AS recovered_starts FROM {recovered} GROUP BY pdf) AS r",
    "r06_cell_high": "SELECT hospital, sigla, NOT bool_or(pages = 0 OR COALESCE(per_file, 0) = 0) AS high FROM {file_counts} GROUP BY hospital, sigla",
    "f01_parse_pagination": """
        SELECT pdf, page, CASE WHEN full_c <> '' THEN CASE WHEN CAST(NULLIF(full_c, '') AS INT) > 0 AND CAST(NULLIF(full_c, '') AS INT) <= CAST(NULLIF(full_t, '') AS INT) THEN CAST(NULLIF(full_c, '') AS INT) END WHEN one <> '' AND CAST(NULLIF(one, '') AS INT) > 0 THEN CAST(NULLIF(one, '') AS INT) END AS curr,
          CASE WHEN full_c <> '' AND CAST(NULLIF(full_c, '') AS INT) > 0 AND CAST(NULLIF(full_c, '') AS INT) <= CAST(NULLIF(full_t, '') AS INT) THEN CAST(NULLIF(full_t, '') AS INT) END AS total
        FROM (SELECT pdf, page, CASE WHEN c1 <> '' THEN c1 ELSE c2 END AS full_c, CASE WHEN c1 <> '' THEN t1 ELSE t2 END AS full_t, CASE WHEN o1 <> '' THEN o1 ELSE o2 END AS one FROM (
          SELECT pdf, page, regexp_extract(t, pre || '[ ]*([0-9]{{1,3}})[ ]*[Dd][Ee][ ]*([0-9]{{1,3}})', 1) AS c1, regexp_extract(t, pre || '[ ]*([0-9]{{1,3}})[ ]*[Dd][Ee][ ]*([0-9]{{1,3}})', 2) AS t1,
            regexp_extract(u, pre || '[ ]*([0-9]{{1,3}})[ ]*[Dd][Ee][ ]*([0-9]{{1,3}})', 1) AS c2, regexp_extract(u, pre || '[ ]*([0-9]{{1,3}})[ ]*[Dd][Ee][ ]*([0-9]{{1,3}})', 2) AS t2,
            regexp_extract(t, pre || '[.]?[ ]*([0-9]{{1,3}})([^0-9A-Za-z_]|$)', 1) AS o1, regexp_extract(u, pre || '[.]?[ ]*([0-9]{{1,3}})([^0-9A-Za-z_]|$)', 1) AS o2
          FROM (SELECT pdf, page, text AS t, translate(text, 'OolI|ZSB', '00111258') AS u, '(?:[Pp][AaÁá4@]?[Gg][Ii][Nn][Aa]|[Pp][Aa][Gg])' AS pre FROM {page_text}) AS x) AS y) AS z""",
    "f02_extract_code": "SELECT pdf, page, CASE WHEN code <> '' THEN upper(replace(code, ' ', '-')) END AS code FROM (SELECT pdf, page, regexp_extract(text, '(?:^|[^A-Za-z0-9_])([Ff][- ]?[A-Za-z]{{2,4}}[- ][A-Za-z0-9-]{{2,12}})', 1) AS code FROM {page_text}) AS c",
    "f08_normalise_code": "SELECT DISTINCT code, regexp_replace(translate(upper(code), 'OIZSB', '01258'), '[^A-Z0-9]', '' /*all*/) AS folded FROM {page_reads} WHERE code IS NOT NULL",
    "m06_strategy": "SELECT f.id, COALESCE(s.strategy, 'none') AS strategy FROM {files} AS f LEFT JOIN {dim_sigla} AS s ON f.host = s.sigla",
}
