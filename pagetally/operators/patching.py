"""Patches of a month's state as projections and merges of rows, and months, trust rules, samples and windows."""

_NOTES = "SELECT hospital, sigla, CASE n % 4 WHEN 0 THEN '  revisar ' WHEN 1 THEN '   ' WHEN 2 THEN 'falta hoja' END AS note, CASE WHEN n % 3 = 0 THEN 'por_resolver' ELSE 'resuelto' END AS status FROM (SELECT hospital, sigla, CAST(hospital_ord * 20 + ord AS INT) AS n FROM {dim_hospital} CROSS JOIN {dim_sigla}) AS g"
_MONTHS = "(VALUES ('ENERO', 1), ('FEBRERO', 2), ('MARZO', 3), ('ABRIL', 4), ('MAYO', 5), ('JUNIO', 6), ('JULIO', 7), ('AGOSTO', 8), ('SEPTIEMBRE', 9), ('OCTUBRE', 10), ('NOVIEMBRE', 11), ('DICIEMBRE', 12)) AS m(title, number)"
_PRESENT = "EXISTS (SELECT 1 FROM {file_counts} AS f WHERE f.hospital = m.hospital AND f.sigla = m.sigla AND f.file = m.file)"

STATE = {
    # a patch's count replaces the file's, and null takes an override away
    "g05_override_patch": "SELECT id, CASE WHEN patched THEN count ELSE override END AS override FROM (SELECT f.id, f.override, p.id IS NOT NULL AS patched, p.count FROM {file_counts} AS f LEFT JOIN (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS INT) END AS count FROM {part} WHERE p_size > 25) AS p ON p.id = f.id) AS s",
    "g05_note_patch": f"SELECT hospital, sigla, NULLIF(trim(note), '') AS note, CASE WHEN trim(note) <> '' THEN status END AS note_status FROM ({_NOTES}) AS p",
    "g05_confirm_patch": "SELECT c.hospital, c.sigla, COALESCE(p.confirmed, c.confirmed) AS confirmed FROM {cells} AS c LEFT JOIN (SELECT src_hospital AS hospital, src_sigla AS sigla, max_by(status = 'applied', id) AS confirmed FROM {ops} GROUP BY src_hospital, src_sigla) AS p ON p.hospital = c.hospital AND p.sigla = c.sigla",
    "g03_seed_cells": "SELECT h.hospital, s.sigla, COALESCE(c.filename_count, 0) AS filename_count, c.hospital IS NULL AS seeded FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS s LEFT JOIN (SELECT * FROM {cells} WHERE NOT excluded) AS c ON c.hospital = h.hospital AND c.sigla = s.sigla",
    # an orphan's marks join those of the file it was renamed to, kept as they are; or go
    "g06_marks_migrate": f"SELECT id, hospital, sigla, CASE WHEN {_PRESENT} THEN file ELSE replace(file, 'gone_', '') END AS file, page, count FROM {{marks}} AS m",
    "g06_marks_discard": f"SELECT id, hospital, sigla, file, page, count FROM {{marks}} AS m WHERE {_PRESENT}",
    "g07_dismiss_suspects": "SELECT s.suspect_id, s.hospital, s.sigla, s.file FROM {suspects} AS s WHERE NOT EXISTS (SELECT 1 FROM {dismissals} AS d WHERE d.hospital = s.hospital AND d.sigla = s.sigla AND d.suspect_id = s.suspect_id)",
    "g07_near_matches_cleared": "SELECT n.pdf, n.page, n.near_flavor FROM (SELECT pdf, page, near AS near_flavor FROM {cover_pages} WHERE near IS NOT NULL) AS n WHERE NOT EXISTS (SELECT 1 FROM {near_clearings} AS c WHERE c.pdf = n.pdf AND (c.page IS NULL OR c.page = n.page))",
    # deltas after applied operations are deleted and every other one's status is set
    "g08_recomputed_deltas": "SELECT hospital, sigla, CAST(sum(documents) AS BIGINT) AS delta, CAST(sum(workers) AS BIGINT) AS worker_delta FROM {op_sides} GROUP BY hospital, sigla",
    "g08_edited_ops": "SELECT id, op_type, documents, workers, status FROM (SELECT o.id, o.op_type, o.documents, o.workers, CASE WHEN e.action = 'apply' THEN 'applied' ELSE o.status END AS status, e.action = 'delete' AND o.status = 'pending' AS gone FROM {resolved_ops} AS o LEFT JOIN {op_edits} AS e ON e.id = o.id) AS x WHERE NOT COALESCE(gone, false)",
    "s04_month_folders": f"SELECT f.name, f.year, m.number AS month FROM (SELECT DISTINCT title || ' ' || CAST(year AS STRING) AS name, title, year FROM (SELECT year, CASE WHEN month = 5 THEN 'Otros' ELSE title END AS title FROM {{history}} JOIN {_MONTHS} ON number = month) AS t) AS f JOIN {_MONTHS} ON m.title = upper(f.title)",
    "s05_month_inventory": "SELECT hospital, count(*) AS categories, CAST(sum(n) AS BIGINT) AS pdfs, array_join(transform(sort_array(collect_list(struct(host, n))), x -> concat(x.host, ':', CAST(x.n AS STRING))), ' ') AS inventory FROM (SELECT hospital, host, count(*) AS n FROM {files} WHERE lower(name) LIKE '%.pdf' GROUP BY hospital, host) AS f GROUP BY hospital",
    "s22_create_if_absent": "SELECT year, month, 'stored' AS origin FROM {history} WHERE count > 3 GROUP BY year, month UNION ALL SELECT r.year, r.month, 'created' FROM (SELECT DISTINCT year, month FROM {history}) AS r WHERE NOT EXISTS (SELECT 1 FROM {history} AS s WHERE s.count > 3 AND s.year = r.year AND s.month = r.month)",
    "s23_session_state": "SELECT user_id AS session_id, max_by(value, event_id) AS state, count(*) AS versions, max(event_id) AS version FROM {events} GROUP BY user_id",
}

TRUST = {
    "r02_pagination_floor": "SELECT pdf, greatest(1, count_if(curr = 1)) AS documents FROM {recovered} GROUP BY pdf",
    "r04_no_covers": "SELECT id, CAST(COALESCE(per_file, 0) AS INT) AS documents, pages > 1 AND COALESCE(per_file, 0) = 0 AS low_trust FROM {file_counts} WHERE method = 'header_band_anchors'",
    "r05_engine_failure": "SELECT id, CASE WHEN pages = 0 THEN 1 ELSE per_file END AS documents, pages = 0 AND method = 'pagination' AS low_trust FROM {file_counts} WHERE method IN ('pagination', 'header_band_anchors')",
}

SEQUENCES = {
    # the most frequent total within five pages, the first seen of equals, if 85 in 100 agree; else the file's
    "w09_local_total": """
        SELECT pdf, page, CAST(CASE WHEN near.most >= 0.85 * near.n THEN near.total ELSE COALESCE(usual, 2) END AS INT) AS total, COALESCE(near.most / CAST(near.n AS DOUBLE), 0) AS homogeneity
        FROM (SELECT pdf, page, usual, aggregate(near, CAST(NULL AS STRUCT<most: INT, n: INT, total: INT>), (best, t) -> CASE WHEN best IS NULL OR size(filter(near, x -> x = t)) > best.most THEN named_struct('most', size(filter(near, x -> x = t)), 'n', size(near), 'total', t) ELSE best END) AS near
          FROM (SELECT pdf, page, first_value(total) OVER (PARTITION BY pdf ORDER BY total IS NULL, n DESC, first_page ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS usual, collect_list(total) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near
            FROM (SELECT *, count(total) OVER (PARTITION BY pdf, total) AS n, min(page) OVER (PARTITION BY pdf, total) AS first_page FROM {page_reads}) AS a) AS w) AS x""",
    "t04_reader_rank": "SELECT sigla, exact, found, row_number() OVER (ORDER BY exact DESC, found DESC, latency, sigla) AS place FROM (SELECT sigla, count_if(per_file = pages) AS exact, count(per_file) AS found, CAST(sum(pages) AS BIGINT) AS latency FROM {file_counts} GROUP BY sigla) AS s",
    "t07_seeded_sample": "SELECT id, name FROM {files} ORDER BY md5(CAST(id AS STRING) || ':42'), id LIMIT 50",
    "u05_document_pages": "SELECT pdf, doc, count(*) AS found_total, CAST(min(page) AS INT) AS first_page, CAST(max(page) AS INT) AS last_page, count_if(status = 'recovered') AS inferred FROM {segmented} WHERE doc > 0 GROUP BY pdf, doc",
}

#: Texts for the oracle where they are not those of the operators.
ORACLE = {
    "s05_month_inventory": "SELECT hospital, count(*) AS categories, CAST(sum(n) AS BIGINT) AS pdfs, string_agg(host || ':' || n, ' ' ORDER BY host) AS inventory FROM (SELECT hospital, host, count(*) AS n FROM {files} WHERE lower(name) LIKE '%.pdf' GROUP BY hospital, host) AS f GROUP BY hospital",
    # by a band join of pages
    "w09_local_total": """
        SELECT r.pdf, r.page, CAST(CASE WHEN l.most >= 0.85 * l.n THEN l.total ELSE COALESCE(g.total, 2) END AS INT) AS total, COALESCE(l.most / CAST(l.n AS DOUBLE), 0) AS homogeneity
        FROM {page_reads} AS r
        LEFT JOIN (SELECT pdf, page, first(total ORDER BY k DESC, first_page) AS total, max(k) AS most, sum(k) AS n FROM (SELECT a.pdf, a.page, b.total, count(*) AS k, min(b.page) AS first_page FROM {page_reads} AS a JOIN {page_reads} AS b ON a.pdf = b.pdf AND b.page BETWEEN a.page - 5 AND a.page + 5 WHERE b.total IS NOT NULL GROUP BY a.pdf, a.page, b.total) AS c GROUP BY pdf, page) AS l ON l.pdf = r.pdf AND l.page = r.page
        LEFT JOIN (SELECT pdf, first(total ORDER BY k DESC, first_page) AS total FROM (SELECT pdf, total, count(*) AS k, min(page) AS first_page FROM {page_reads} WHERE total IS NOT NULL GROUP BY pdf, total) AS c GROUP BY pdf) AS g ON g.pdf = r.pdf""",
}

OPERATORS = STATE | TRUST | SEQUENCES
