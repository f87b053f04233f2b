"""Canonical relations over the given tables, and how a query names them.

A relation or query is one SQL text with {names} of what it reads. Spark plans it as a DataFrame over the
DataFrames of those names (nothing is registered); for an oracle the same names become common table
expressions. Where the two dialects differ, a query has a second text.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from ..sources.files import scratch
from . import anchors

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: The sites and the categories in order, with folder text, expected pages, what a cell counts,
#: pages per document where fixed, and how page text is counted.
HOSPITALS = ("HPV", "HRB", "HLU", "HLL")
SIGLAS = (
    ("reunion", "Reunion Prevencion", 4, "documents", None, "none"),
    ("irl", "Induccion IRL", 2, "documents", None, "pagination"),
    ("odi", "ODI Visitas", 2, "documents", None, "pagination"),
    ("charla", "Charlas", 3, "documents_workers", None, "anchors"),
    ("chintegral", "Charla Integral", 8, "documents_workers", None, "anchors"),
    ("dif_pts", "Difusion PTS", 3, "documents_workers", None, "anchors"),
    ("art", "ART", 10, "documents", None, "pagination"),
    ("insgral", "Inspecciones Generales", 3, "documents", None, "pagination"),
    ("bodega", "Inspeccion Bodega", 2, "documents", 1, "pagination"),
    ("maquinaria", "Inspeccion de Maquinaria", 2, "checks", None, "anchors"),
    ("ext", "Extintores", 2, "documents", 1, "pagination"),
    ("senal", "Senaleticas", 2, "documents", None, "anchors"),
    ("revdocmaq", "Revision Documentacion Maquinaria", 2, "documents", None, "none"),
    ("exc", "Excavaciones y Vanos", 2, "documents", 1, "pagination"),
    ("altura", "Trabajos en Altura", 2, "documents", None, "pagination"),
    ("caliente", "Inspeccion Trabajos en Caliente", 2, "documents", 1, "pagination"),
    ("espacios", "Espacios Confinados", 2, "documents", None, "pagination"),
    ("herramientas_elec", "Inspeccion Herramientas Electricas", 2, "documents", 1, "pagination"),
    ("andamios", "Andamios", 2, "documents", None, "pagination"),
    ("chps", "CHPS", 4, "documents", None, "anchors"),
)


def values(rows, names: str) -> str:
    """A constant table."""
    text = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


#: Ids in a range that one task numbers.
RANGE = 4096
#: Methods that read a page, and the most a count may be.
OCR_METHODS = "('header_detect', 'corner_count', 'header_band_anchors', 'v4', 'pagination')"
MOST_COUNT = 10000


def places(table: str, id: str) -> str:
    """Each row's place by id: its place in its range of ids, after the rows of all ranges before."""
    block = f"CAST(floor({id} / {RANGE}) AS BIGINT)"
    before = f"SELECT block, sum(n) OVER (ORDER BY block) - n AS before FROM (SELECT {block} AS block, count(*) AS n FROM {{{table}}} GROUP BY 1) AS c"
    return f"SELECT {id}, CAST(before + row_number() OVER (PARTITION BY b.block ORDER BY {id}) AS BIGINT) AS place FROM {{{table}}} AS r JOIN ({before}) AS b ON {block} = b.block"


def site(k: str) -> str:
    """The k-th site: the fixed ones first, then as many more as the data has."""
    return f"CASE {k} " + " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HOSPITALS)) + f" ELSE 'H' || CAST({k} AS STRING) END"


def matches(text: str) -> str:
    """SQL for a category's flavors with the anchors that a text has and lacks, and how many anti-anchors it has."""
    has = f"contains({text}, a)"
    return f"transform(flavors, f -> struct(f.flavor AS flavor, f.ord AS ord, f.least AS min_match, filter(f.anchors, a -> {has}) AS matched, filter(f.anchors, a -> NOT {has}) AS missing, size(filter(f.anti, a -> {has})) AS anti_hits))"


_OWNS = "x -> size(x.matched) >= x.min_match AND x.anti_hits = 0"
_NEARLY = "x -> size(x.matched) = x.min_match - 1 AND x.min_match > 1 AND x.anti_hits = 0"

def counts(text: str) -> str:
    """`matches` without the anchors' names."""
    has = f"contains({text}, a)"
    return f"transform(flavors, f -> struct(f.flavor AS flavor, f.least AS min_match, size(filter(f.anchors, a -> {has})) AS matched, size(filter(f.anti, a -> {has})) AS anti_hits))"


_COUNT_OWNS = "x -> x.matched >= x.min_match AND x.anti_hits = 0"
_COUNT_NEARLY = "x -> x.matched = x.min_match - 1 AND x.min_match > 1 AND x.anti_hits = 0"

#: Techniques of preparing a page, in the order in which they are used.
TECHNIQUES = ("spaced", "digits", "narrow")

#: Parts of a site, and what a cell's files are named after: the host category of a file, and a foreign one.
SITE_PARTS = 40
_HOSTS = ("odi", "irl", "art", "ext", "chps", "maquinaria", "charla", "dif_pts")
_OTHERS = ("irl", "art", "ext", "odi", "irl", "andamios", "art", "revdocmaq")
_pick = lambda of, names: f"CASE {of} " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names)) + " END"
_OF = "([0-9]{{1,3}})[ ]*de[ ]*([0-9]{{1,3}})"
_mode = lambda value, order: f"min_by({value}, struct({order}))"
_PRESENT = "EXISTS (SELECT 1 FROM {{file_counts}} AS f WHERE f.hospital = {t}.hospital AND f.sigla = {t}.sigla AND f.file = {t}.file)"
_RANGE_TEXT = "CASE WHEN page_from IS NULL THEN 'None' ELSE '(' || CAST(page_from AS STRING) || ', ' || CAST(page_to AS STRING) || ')' END"

RELATIONS = {
    "dim_hospital": f"SELECT {site('k')} AS hospital, k AS hospital_ord FROM (SELECT DISTINCT CAST(floor(p_partkey / {SITE_PARTS}) AS INT) AS k FROM {{part}}) AS p",
    "dim_sigla": values([(s, i, *x) for i, (s, *x) in enumerate(SIGLAS)], "sigla, ord, folder_text, expected, count_type, fixed_pages, strategy"),
    # some numbers are read wrongly, some totals are off by one, some pages are not read
    "page_reads": """
        SELECT pdf, CAST(page AS INT) AS page, CAST(CASE WHEN NOT failed THEN CASE WHEN partkey % 29 = 0 AND period > 1 THEN page % period + 1 ELSE (page - 1) % period + 1 END END AS INT) AS curr,
          CAST(CASE WHEN NOT failed THEN CASE WHEN partkey % 11 = 0 THEN period + 1 ELSE period END END AS INT) AS total,
          CASE WHEN NOT failed THEN CASE suppkey % 3 WHEN 0 THEN 'F-CRS-ART-01' WHEN 1 THEN 'F-CRS-ODI-03' ELSE 'F-CRS-IRL-01' END END AS code,
          CASE WHEN failed THEN 'failed' ELSE 'direct' END AS method, CAST(CASE WHEN failed THEN 0 ELSE 1 END AS DOUBLE) AS confidence, partkey, suppkey, period, CAST((page - 1) % period + 1 AS INT) AS true_curr
        FROM (SELECT *, 1 + pdf % 4 AS period, (partkey + 3 * suppkey) % 5 = 0 AS failed,
            row_number() OVER (PARTITION BY pdf ORDER BY l_orderkey, l_linenumber, partkey, suppkey, l_quantity, l_extendedprice) AS page
          FROM (SELECT *, CAST(floor(l_orderkey / 8) AS BIGINT) AS pdf, l_partkey AS partkey, l_suppkey AS suppkey FROM {lineitem}) AS l) AS p""",
    "page_text": """
        SELECT pdf, page, CASE WHEN curr IS NULL THEN '' ELSE
            CASE page % 3 WHEN 0 THEN 'Página ' WHEN 1 THEN 'Pagina ' ELSE 'PAGINA ' END
            || CASE WHEN partkey % 17 = 0 THEN '5 de 4' WHEN partkey % 19 = 0 THEN CAST(curr AS STRING)
               WHEN partkey % 13 = 0 THEN replace(CAST(curr AS STRING), '1', 'l') || ' de ' || CAST(total AS STRING)
               ELSE CAST(curr AS STRING) || ' de ' || CAST(total AS STRING) END
            || ' Codigo: ' || replace(code, 'CRS-', CASE WHEN suppkey % 2 = 0 THEN 'CRS ' ELSE 'crs-' END) END AS text FROM {page_reads}""",
    "files": f"""
        SELECT p_partkey AS id, host, {site("k")} AS hospital,
          '2026-04_' || CASE WHEN p_partkey % 7 = 0 THEN other WHEN p_partkey % 11 = 0 THEN 'titan' WHEN p_partkey % 13 = 0 THEN 'extra' WHEN p_partkey % 17 = 0 THEN other || '.' || host || '-' || other
              WHEN p_partkey % 19 = 0 THEN 'Revision_-documentacion' WHEN p_partkey % 41 = 0 THEN 'odi-art' WHEN host = 'chps' THEN 'acta_reunion' ELSE host END
            || '_' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 23 = 0 THEN '.txt' WHEN p_partkey % 5 = 1 THEN '.PDF' ELSE '.pdf' END AS name,
          CASE WHEN p_partkey % 31 = 0 THEN 0 ELSE 1 + p_size % 9 END AS pages, 'sub' || CAST(p_partkey % 6 AS STRING) AS folder
        FROM (SELECT *, CAST(floor(p_partkey / {SITE_PARTS}) AS INT) AS k, {_pick("p_partkey % 8", _HOSTS)} AS host, {_pick("p_partkey % 8", _OTHERS)} AS other FROM {{part}}) AS p""",
    # how people name a category's folder: with an index, a month's number, in passing, or wrongly
    "folder_names": """
        SELECT f.id, f.hospital, d.sigla, CASE f.id % 6 WHEN 0 THEN CAST(1 + d.ord AS STRING) || ' .- ' || d.folder_text WHEN 1 THEN '0' || CAST(1 + d.ord % 9 AS STRING) || '.' || d.folder_text || ' ' || CAST(f.id % 31 AS STRING)
          WHEN 2 THEN d.folder_text WHEN 3 THEN d.folder_text || 'x' WHEN 4 THEN '  7.-   ' || d.folder_text || '  ' ELSE d.folder_text || ' ' || f.folder END AS name
        FROM {files} AS f JOIN {dim_sigla} AS d ON d.ord = f.id % 20""",
    "files_dup": "SELECT * FROM {files} UNION ALL SELECT id, host, hospital, name, pages, 'copy' AS folder FROM {files} WHERE id % 29 = 0",
    # a token counts between separators only; the earliest wins, of equals the longest, then the category's order
    "dim_token": values([(s, i, s) for i, (s, *_) in enumerate(SIGLAS)] + [("chps", 19, "cphs"), ("revdocmaq", 12, "revision[_.-]+documentacion")], "sigla, ord, token"),
    # the stem's parts, pairs of parts around a "_", and the one token that is a pattern, each where it is first
    "name_tokens": """
        SELECT id, host, hospital, name, inline(filter(tokens, (x, i) -> array_position(transform(tokens, y -> y.token), x.token) = i + 1))
        FROM (SELECT *, concat(
              transform(parts, (p, i) -> struct(p AS token, starts[i] AS pos, length(p) AS len)),
              filter(transform(parts, (p, i) -> struct(concat(p, '_', get(parts, i + 1)) AS token, starts[i] AS pos, length(p) + 1 + length(get(parts, i + 1)) AS len)), x -> substr(stem, x.pos + 1, x.len) = x.token),
              CASE WHEN phrase <> '' THEN array(struct('revision[_.-]+documentacion' AS token, length(regexp_extract(stem, '^(|.*?[_.-])revision[_.-]+documentacion($|[_.-])', 1)) AS pos, length(phrase) AS len)) ELSE array() END) AS tokens
          FROM (SELECT *, transform(parts, (p, i) -> aggregate(slice(parts, 1, i), 0, (n, q) -> n + length(q) + 1)) AS starts,
              regexp_extract(stem, '(^|[_.-])(revision[_.-]+documentacion)($|[_.-])', 2) AS phrase
            FROM (SELECT *, split(stem, '[_.-]') AS parts FROM (SELECT *, substr(lower(name), 1, length(name) - 4) AS stem FROM {files} WHERE lower(name) LIKE '%.pdf') AS f) AS a) AS b) AS c""",
    "name_hits": "SELECT n.id, n.host, n.hospital, n.name, d.sigla, d.ord, n.pos, n.len FROM {name_tokens} AS n JOIN {dim_token} AS d ON n.token = d.token",
    "file_sigla": f"SELECT f.*, h.sigla FROM {{files}} AS f LEFT JOIN (SELECT id, {_mode('sigla', 'pos, -len, ord')} AS sigla FROM {{name_hits}} GROUP BY id) AS h ON f.id = h.id",
    "file_counts": """
        SELECT id, hospital, host AS sigla, name AS file, pages, CASE WHEN id % 3 > 0 THEN CAST(id % 7 AS INT) END AS per_file,
          CASE WHEN id % 9 = 0 THEN CAST(floor(id / 9) AS INT) % 4 END AS override,
          CASE id % 6 WHEN 0 THEN 'filename_glob' WHEN 1 THEN 'pagination' WHEN 2 THEN 'ratio_n' WHEN 3 THEN 'page_count_pure' WHEN 4 THEN 'header_band_anchors' END AS method FROM {files}""",
    # a month's cells: some were never opened
    "cells": """
        SELECT hospital, sigla, CASE WHEN n % 5 = 0 THEN n % 7 END AS user_override, CASE WHEN n % 3 = 0 THEN n % 4 END AS ocr_count, CASE WHEN n % 2 = 0 THEN n % 23 END AS filename_count,
          n % 4 - 2 AS reorg_delta, n % 3 - 1 AS worker_delta, n % 11 = 0 AS excluded, CASE WHEN n % 4 = 1 THEN 'nota' END AS note, CASE WHEN n % 4 = 1 THEN CASE WHEN n % 8 = 1 THEN 'por_resolver' ELSE 'resuelto' END END AS note_status,
          n % 7 = 0 AS confirmed, CASE WHEN n % 3 = 1 THEN 'terminado' WHEN n % 3 = 2 THEN 'en_curso' END AS worker_status, CASE n % 9 WHEN 0 THEN 'high' WHEN 4 THEN 'high' WHEN 1 THEN 'low' END AS confidence,
          CASE WHEN n % 37 = 0 THEN 1 ELSE 0 END AS errors, n % 10 < 7 AS migrated, CASE n % 6 WHEN 0 THEN 'pagination' WHEN 3 THEN 'filename_glob' END AS method
        FROM (SELECT hospital, sigla, CAST(hospital_ord * 20 + ord AS INT) AS n FROM {dim_hospital} CROSS JOIN {dim_sigla}) AS c WHERE n % 13 <> 12""",
    # marks of signers or checks on pages; some of files that are gone
    "marks": """
        SELECT e.event_id AS id, f.hospital, f.sigla, CASE WHEN e.event_id % 17 = 0 THEN 'gone_' || f.file ELSE f.file END AS file, CAST(1 + e.event_id % 6 AS INT) AS page, CAST(e.event_id % 4 AS INT) AS count
        FROM (SELECT event_id, event_id % (SELECT NULLIF(count(*), 0) FROM {part}) AS seq FROM {events}) AS e
        JOIN (SELECT * FROM {file_counts} WHERE sigla IN ('charla', 'dif_pts', 'maquinaria')) AS f ON f.id = e.seq""",
    "present_marks": f"SELECT m.* FROM {{marks}} AS m WHERE {_PRESENT.format(t='m').replace('{{', '{').replace('}}', '}')}",
    "marked_cells": "SELECT DISTINCT hospital, sigla FROM {marks}",
    # a file's chip
    "file_origin": f"""
        SELECT id, hospital, sigla, file, pages, per_file, override, CASE WHEN override IS NOT NULL THEN 'Manual' WHEN pages = 0 THEN 'Error' WHEN method IN {OCR_METHODS} THEN CASE WHEN per_file = 0 THEN 'Revisar' ELSE 'OCR' END
          WHEN method = 'ratio_n' THEN 'RN' WHEN method = 'page_count_pure' THEN 'R1' WHEN method = 'filename_glob' THEN CASE WHEN pages = 1 THEN 'R1' ELSE 'Pendiente' END ELSE 'R1' END AS origin
        FROM (SELECT f.id, f.hospital, f.sigla, f.file, f.pages, f.per_file, f.override, COALESCE(f.method, c.method, 'filename_glob') AS method FROM {{file_counts}} AS f LEFT JOIN {{cells}} AS c ON c.hospital = f.hospital AND c.sigla = f.sigla) AS x""",
    "cell_files": f"""
        SELECT hospital, sigla, count(*) AS files, count(per_file) AS scanned, CAST(sum(pages) AS BIGINT) AS pages, CAST(sum(CASE WHEN override IS NOT NULL OR per_file IS NOT NULL THEN COALESCE(override, per_file) END) AS BIGINT) AS documents,
          count_if(override IS NOT NULL) AS overrides, count_if(method <> '' AND method <> 'filename_glob') AS methods, count_if(method IN {OCR_METHODS} AND override IS NULL) AS uncertain FROM {{file_counts}} GROUP BY hospital, sigla""",
    "cell_marks": "SELECT hospital, sigla, CAST(sum(count) AS BIGINT) AS marks FROM {present_marks} GROUP BY hospital, sigla",
    # what a cell counts: a person's number, else checks by their marks, else its files, else readings, else names; moves come on top
    "cell_count": """
        SELECT c.hospital, c.sigla, s.count_type, CAST(greatest(0, COALESCE(c.user_override, CASE WHEN s.count_type = 'checks' THEN COALESCE(m.marks, 0) END, f.documents, c.ocr_count, c.filename_count, 0) + COALESCE(c.reorg_delta, 0)) AS BIGINT) AS count,
          CAST(greatest(0, COALESCE(m.marks, 0) + COALESCE(c.worker_delta, 0)) AS BIGINT) AS workers
        FROM {cells} AS c JOIN {dim_sigla} AS s ON c.sigla = s.sigla
        LEFT JOIN {cell_files} AS f ON f.hospital = c.hospital AND f.sigla = c.sigla LEFT JOIN {cell_marks} AS m ON m.hospital = c.hospital AND m.sigla = c.sigla""",
    # planned moves, from the files that are there (and some that are gone)
    "ops": f"""
        SELECT o_orderkey AS id, op_type, f.hospital AS src_hospital, f.sigla AS src_sigla, CASE WHEN o_orderkey % 5 < 3 THEN f.hospital ELSE {site("dst")} END AS dst_hospital,
          CASE o_orderkey % 3 WHEN 0 THEN 'odi' WHEN 1 THEN 'irl' ELSE 'ext' END AS dst_sigla, CASE WHEN o_orderkey % 41 = 0 THEN 'gone_' || f.file ELSE f.file END AS file,
          CASE WHEN ranged THEN CAST(1 + o_orderkey % 9 AS INT) END AS page_from, CASE WHEN ranged THEN CAST(1 + o_orderkey % 9 + o_orderkey % 4 - CASE WHEN o_orderkey % 53 = 0 THEN 3 ELSE 0 END AS INT) END AS page_to,
          CAST(CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 - CASE WHEN o_orderkey % 47 = 0 THEN 3 ELSE 0 END END AS INT) AS doc_count,
          CASE WHEN o_orderkey % 5 = 0 THEN 'applied' ELSE 'pending' END AS status, CAST(CASE WHEN o_orderkey % 59 = 0 THEN 45 ELSE 90 * (o_orderkey % 4) END AS INT) AS rotation
        FROM (SELECT *, CAST(o_orderkey % 4 AS INT) AS dst, op_type = 'extract_pages' AND o_orderkey % 37 > 0 OR o_orderkey % 43 = 0 AS ranged
          FROM (SELECT *, {_pick("o_orderkey % 9", ("move_file", "extract_pages", "rotate", "split_in_place", "extract_pages", "move_file", "extract_pages", "extract_pages", "bogus"))} AS op_type FROM {{orders}}) AS t) AS o
        JOIN {{file_counts}} AS f ON f.id = o.o_custkey""",
    # what an operation moves, where it does not say: a file's own count, one for an extract; and the marks on it
    "resolved_ops": """
        SELECT o.*, CAST(COALESCE(o.doc_count, CASE o.op_type WHEN 'move_file' THEN COALESCE(f.override, f.per_file, 1) WHEN 'extract_pages' THEN 1 ELSE 0 END) AS INT) AS documents, CAST(CASE o.op_type WHEN 'move_file' THEN COALESCE(m.n, 0) WHEN 'extract_pages' THEN COALESCE(m.n_in, 0) ELSE 0 END AS BIGINT) AS workers
        FROM {ops} AS o LEFT JOIN {file_counts} AS f ON f.hospital = o.src_hospital AND f.sigla = o.src_sigla AND f.file = o.file
        LEFT JOIN (SELECT x.id, sum(k.count) AS n, sum(CASE WHEN k.page BETWEEN x.page_from AND x.page_to THEN k.count END) AS n_in FROM {ops} AS x JOIN {marks} AS k ON k.hospital = x.src_hospital AND k.sigla = x.src_sigla AND k.file = x.file GROUP BY x.id) AS m ON m.id = o.id""",
    # a pending operation whose file is gone has been carried out
    "current_ops": f"SELECT o.*, CASE WHEN o.status = 'pending' AND NOT EXISTS (SELECT 1 FROM {{file_counts}} AS f WHERE f.hospital = o.src_hospital AND f.sigla = o.src_sigla AND f.file = o.file) THEN 'applied' ELSE o.status END AS now FROM {{resolved_ops}} AS o",
    "op_sides": """
        SELECT id, src_hospital AS hospital, src_sigla AS sigla, 'out' AS side, -documents AS documents, -workers AS workers FROM {current_ops} WHERE now = 'pending' AND op_type IN ('move_file', 'extract_pages')
        UNION ALL SELECT id, dst_hospital, dst_sigla, 'in', documents, workers FROM {current_ops} WHERE now = 'pending' AND op_type IN ('move_file', 'extract_pages')""",
    # files whose name speaks of other categories only; one of them is suggested
    "foreign_names": """
        SELECT host, hospital, name, CASE WHEN least_sigla = most_sigla THEN least_sigla END AS suggested FROM (SELECT host, hospital, name, min(sigla) AS least_sigla, max(sigla) AS most_sigla, count_if(sigla = host) AS own FROM {name_hits} GROUP BY host, hospital, name) AS s WHERE own = 0""",
    # suspects as stored: by name (a whole file) and by the codes on a range of pages; some files are gone meanwhile
    "stored_suspects": f"""
        SELECT id, kind, hospital, sigla, file, page_from, page_to, suggested, scanned_counted, 'cs_' || substr(sha1(kind || '|' || file || '|' || {_RANGE_TEXT} || '|' || COALESCE(suggested, 'None')), 1, 10) AS suspect_id
        FROM (SELECT f.id, 'filename' AS kind, n.hospital, n.host AS sigla, CASE WHEN f.id % 10 = 0 THEN 'gone_' || n.name ELSE n.name END AS file, CAST(NULL AS INT) AS page_from, CAST(NULL AS INT) AS page_to, n.suggested, false AS scanned_counted
            FROM {{foreign_names}} AS n JOIN {{file_counts}} AS f ON f.hospital = n.hospital AND f.sigla = n.host AND f.file = n.name
          UNION ALL SELECT id, 'code', hospital, sigla, file, CAST(1 + id % 5 AS INT), CAST(1 + id % 5 + id % 3 AS INT), 'irl', id % 3 = 0 FROM {{file_counts}} WHERE id % 4 = 1
          UNION ALL SELECT id, 'code', hospital, sigla, file, CAST(3 + id % 4 AS INT), CAST(5 + id % 4 AS INT), 'odi', true FROM {{file_counts}} WHERE id % 8 = 1) AS s""",
    # the names are read anew: what was stored by name goes, files that are gone go, a name overrides codes on the same file
    "suspects": f"""
        SELECT s.kind, s.hospital, s.sigla, s.file, s.page_from, s.page_to, s.suggested, s.suspect_id, CASE WHEN s.kind = 'filename' THEN COALESCE(f.override, f.per_file, 0) > 0 ELSE s.scanned_counted END AS counted
        FROM (SELECT kind, hospital, sigla, file, page_from, page_to, suggested, suspect_id, scanned_counted FROM {{stored_suspects}} WHERE kind <> 'filename'
          UNION ALL SELECT 'filename', hospital, host, name, CAST(NULL AS INT), CAST(NULL AS INT), suggested, 'cs_' || substr(sha1('filename|' || name || '|None|' || COALESCE(suggested, 'None')), 1, 10), false FROM {{foreign_names}}) AS s
        JOIN {{file_counts}} AS f ON f.hospital = s.hospital AND f.sigla = s.sigla AND f.file = s.file
        WHERE NOT (s.kind = 'code' AND EXISTS (SELECT 1 FROM {{foreign_names}} AS n WHERE n.hospital = s.hospital AND n.host = s.sigla AND n.name = s.file))""",
    # a pending operation on the same file covers a suspect: a move all of them, an extract those whose pages it meets
    "open_suspects": """
        SELECT s.* FROM {suspects} AS s WHERE NOT EXISTS (SELECT 1 FROM {ops} AS o WHERE o.status = 'pending' AND o.src_hospital = s.hospital AND o.src_sigla = s.sigla AND o.file = s.file
          AND (o.op_type = 'move_file' OR (o.op_type = 'extract_pages' AND o.page_from <= s.page_to AND s.page_from <= o.page_to)))""",
    "settled_cells": """
        SELECT c.hospital, c.sigla, COALESCE(CASE WHEN c.note_status = 'por_resolver' THEN false WHEN s.count_type = 'checks' THEN c.worker_status = 'terminado' ELSE o.reliable END, false) AS settled
        FROM {cells} AS c JOIN {dim_sigla} AS s ON c.sigla = s.sigla LEFT JOIN (SELECT hospital, sigla, bool_and(origin IN ('R1', 'RN', 'Manual')) AS reliable FROM {file_origin} GROUP BY hospital, sigla) AS o ON o.hospital = c.hospital AND o.sigla = c.sigla""",
    "reliable_cells": "SELECT c.hospital, c.sigla, c.settled AND NOT COALESCE(b.blocked, false) AS all_reliable FROM {settled_cells} AS c LEFT JOIN (SELECT hospital, sigla, bool_or(counted) AS blocked FROM {open_suspects} GROUP BY hospital, sigla) AS b ON b.hospital = c.hospital AND b.sigla = c.sigla",
    # cells stored before that gate existed fall back on their confidence and on files read without a person's correction
    "ready_cells": """
        SELECT c.hospital, c.sigla, c.errors, COALESCE(CASE WHEN c.note_status = 'por_resolver' THEN false WHEN c.confirmed OR c.user_override IS NOT NULL THEN true WHEN s.count_type = 'checks' THEN c.worker_status = 'terminado'
          WHEN c.migrated THEN r.all_reliable ELSE c.confidence = 'high' AND COALESCE(f.uncertain, 0) = 0 END, false) AS ready
        FROM {cells} AS c JOIN {dim_sigla} AS s ON c.sigla = s.sigla JOIN {reliable_cells} AS r ON r.hospital = c.hospital AND r.sigla = c.sigla LEFT JOIN {cell_files} AS f ON f.hospital = c.hospital AND f.sigla = c.sigla""",
    # a cell that a scan by names must leave alone
    "worked_cells": """
        SELECT c.hospital, c.sigla, c.ocr_count IS NOT NULL OR c.user_override IS NOT NULL OR c.confirmed OR COALESCE(f.overrides > 0 OR f.methods > 0, false) OR m.sigla IS NOT NULL AS has_work
        FROM {cells} AS c LEFT JOIN {cell_files} AS f ON f.hospital = c.hospital AND f.sigla = c.sigla LEFT JOIN {marked_cells} AS m ON m.hospital = c.hospital AND m.sigla = c.sigla""",
    "near_clearings": "SELECT DISTINCT pdf, CASE WHEN pdf % 3 = 0 THEN NULL ELSE page END AS page FROM {page_reads} WHERE pdf % 2 = 0 AND page % 4 = 1",
    "op_edits": "SELECT id, CASE WHEN id % 22 = 0 THEN 'apply' ELSE 'delete' END AS action FROM {ops} WHERE id % 11 = 0",
    "rescans": "SELECT id, CAST(1 + id % 3 AS INT) AS count FROM {file_counts} WHERE id % 25 = 0",
    "locked_cells": "SELECT hospital, sigla FROM {cells} WHERE worker_status = 'en_curso' AND errors = 0 AND sigla < 'd'",
    "dismissals": "SELECT hospital, sigla, suspect_id FROM {suspects} WHERE page_from = 3 OR suggested = 'art'",
    # new counts for a page's mark: none takes the mark away
    "mark_patches": "SELECT DISTINCT hospital, sigla, file, page, CAST((page * 5 + length(file)) % 4 AS INT) AS count FROM {present_marks} WHERE id % 7 = 0",
    # pages' texts after different preparations, read by the plain pattern; and by other patterns, the last by two in turn
    # every way to prepare a page's text by three techniques: separators mended, digits mended, blanks left out
    "dim_variant": values([("+".join(n for n, on in zip(TECHNIQUES, x, strict=True) if on) or "raw", *x) for x in product((0, 1), repeat=3)], "variant, spaced, digits, narrow"),
    "variant_reads": f"""
        SELECT pdf, page, variant, true_curr, CASE WHEN curr > 0 AND curr <= total THEN curr END AS curr, CASE WHEN curr > 0 AND curr <= total THEN total END AS total
        FROM (SELECT pdf, page, variant, true_curr, CAST(NULLIF(regexp_extract(x, '{_OF}', 1), '') AS INT) AS curr, CAST(NULLIF(regexp_extract(x, '{_OF}', 2), '') AS INT) AS total
          FROM (SELECT pdf, page, variant, true_curr, CASE WHEN narrow = 1 THEN replace(z, ' ', '') ELSE z END AS x
            FROM (SELECT pdf, page, variant, true_curr, narrow, CASE WHEN digits = 1 THEN translate(w, 'OolI|ZSB', '00111258') ELSE w END AS z
              FROM (SELECT t.pdf, t.page, t.true_curr, v.variant, v.digits, v.narrow, CASE WHEN v.spaced = 1 THEN replace(t.text, ' d e ', ' de ') ELSE t.text END AS w FROM {{noted_text}} AS t CROSS JOIN {{dim_variant}} AS v) AS a) AS b) AS c) AS d""",
    "noted_text": """
        SELECT t.pdf, t.page, r.true_curr, r.period, CASE r.partkey % 7 WHEN 0 THEN replace(t.text, ' de ', ' d e ') WHEN 1 THEN 'hoja 2 de 9 ' || t.text ELSE t.text END AS text FROM {page_text} AS t JOIN {page_reads} AS r ON r.pdf = t.pdf AND r.page = t.page""",
    "pattern_reads": f"""
        SELECT pdf, page, period, variant, CAST(NULLIF(CASE variant WHEN 'named' THEN named WHEN 'bare' THEN bare ELSE COALESCE(NULLIF(named, ''), bare) END, '') AS INT) AS total
        FROM (SELECT pdf, page, period, regexp_extract(text, '[Pp][AaÁá][Gg][A-Za-z]*[ ]*[0-9]{{{{1,3}}}}[ ]*de[ ]*([0-9]{{{{1,3}}}})', 1) AS named, regexp_extract(text, '{_OF}', 2) AS bare FROM {{noted_text}}) AS t CROSS JOIN (VALUES ('named'), ('bare'), ('named, else bare')) AS v(variant)""",
    # what each preparation gains over the plain one: rescued pages less three times those it spoils; and two together
    "variant_gains": """
        SELECT v.variant, count_if(b.curr IS NULL AND v.curr = v.true_curr) - 3 * count_if(b.curr = b.true_curr AND COALESCE(v.curr <> v.true_curr, true)) AS net_gain
        FROM {variant_reads} AS v JOIN (SELECT * FROM {variant_reads} WHERE variant = 'raw') AS b ON b.pdf = v.pdf AND b.page = v.page GROUP BY v.variant""",
    "technique_gains": "SELECT t.phase, t.label, COALESCE(g.net_gain, 0) AS net_gain FROM (" + values([(t, label, t if label == "on" else "raw") for t in TECHNIQUES for label in ("off", "on")], "phase, label, variant") + ") AS t LEFT JOIN {variant_gains} AS g ON g.variant = t.variant",
    # a grid over the techniques that gain by themselves, if there are two at least; all off is left out
    "combo_gains": """
        SELECT d.variant AS label, COALESCE(g.net_gain, 0) AS net_gain FROM (SELECT v.variant, v.spaced + v.digits + v.narrow AS used, count(w.phase) AS winning, max(w.all_winners) AS all_winners
            FROM {dim_variant} AS v CROSS JOIN (SELECT phase, net_gain, count_if(net_gain > 0) OVER (PARTITION BY 1) AS all_winners FROM {technique_gains} WHERE label = 'on') AS g
            LEFT JOIN (SELECT phase, count(*) OVER (PARTITION BY 1) AS all_winners FROM {technique_gains} WHERE label = 'on' AND net_gain > 0) AS w ON w.phase = g.phase AND contains('+' || v.variant || '+', '+' || w.phase || '+') GROUP BY v.variant, v.spaced, v.digits, v.narrow) AS d
        LEFT JOIN {variant_gains} AS g ON g.variant = d.variant WHERE d.used > 0 AND d.winning = d.used AND d.all_winners >= 2""",
    # every tenth of the pages that the plain preparation fails on, in a fixed order
    "screen_pages": "SELECT pdf, page FROM {variant_reads} WHERE variant = 'raw' AND curr IS NULL AND (pdf * 31 + page) % 10 = 0",
    "true_counts": "SELECT pdf, count_if(true_curr = 1) AS documents, count_if(method = 'failed') AS failed, count_if(true_curr = period) AS complete FROM {page_reads} GROUP BY pdf",
    # a file's documents by the reads alone, and after the cycle fill
    "config_counts": """
        SELECT 'recovered' AS config, r.pdf, r.documents, r.n_inferred, COALESCE(g.complete, 0) AS complete FROM (SELECT pdf, count_if(curr = 1) AS documents, count_if(status = 'recovered') AS n_inferred FROM {recovered} GROUP BY pdf) AS r
        LEFT JOIN (SELECT pdf, count_if(pages + inferred = declared_total AND sequence_ok) AS complete FROM {segments} GROUP BY pdf) AS g ON g.pdf = r.pdf
        UNION ALL SELECT 'direct', pdf, count_if(curr = 1), CAST(0 AS BIGINT), count_if(curr = total) FROM {page_reads} GROUP BY pdf""",
    # pages to be matched with their category's cover anchors: as read, and as read once more from a cleaned image
    "dim_anchor": values(anchors.anchor_rows(), "sigla, flavor, ord, min_match, place, anchor, is_anti"),
    "dim_flavors": anchors.flavor_arrays(),
    "dim_cover": values(anchors.cover_rows(), "k, variant, sigla, text"),
    "cover_text": f"""
        SELECT r.pdf, r.page, a.sigla, a.text AS raw, b.text AS cleaned FROM {{page_reads}} AS r JOIN {{dim_cover}} AS a ON a.k = r.pdf % {len(anchors.FLAVORS)} AND a.variant = (3 * r.partkey + r.page) % {anchors.VARIANTS}
        JOIN {{dim_cover}} AS b ON b.k = a.k AND b.variant = (r.partkey + r.suppkey) % {anchors.VARIANTS}""",
    "folded_covers": f"SELECT pdf, page, sigla, {anchors.folded('raw')} AS raw, {anchors.folded('cleaned')} AS cleaned FROM {{cover_text}}",
    # the cleaned text is matched only where the raw text has no owner; no flavor's match needs a shuffle
    "cover_matches": f"""
        SELECT pdf, page, sigla, raw, CASE WHEN NOT exists(raw, {_OWNS}) THEN {matches("cleaned")} END AS cleaned
        FROM (SELECT t.pdf, t.page, t.sigla, f.flavors, {matches("t.raw")} AS raw, t.cleaned FROM {{folded_covers}} AS t JOIN {{dim_flavors}} AS f ON f.sigla = t.sigla) AS m""",
    # only how many anchors a text has: of a page's flavors in order, the first that owns it and the first that nearly does
    "cover_pages": f"""
        SELECT pdf, page, sigla, raw_owner, raw_near, COALESCE(raw_owner, owner) AS owner, CASE WHEN raw_owner IS NULL AND owner IS NULL THEN near END AS near
        FROM (SELECT pdf, page, sigla, get(filter(raw, {_COUNT_OWNS}), 0).flavor AS raw_owner, CASE WHEN cleaned IS NOT NULL THEN get(filter(raw, {_COUNT_NEARLY}), 0).flavor END AS raw_near, get(filter(cleaned, {_COUNT_OWNS}), 0).flavor AS owner, get(filter(cleaned, {_COUNT_NEARLY}), 0).flavor AS near
          FROM (SELECT pdf, page, sigla, raw, CASE WHEN NOT exists(raw, {_COUNT_OWNS}) THEN {counts("cleaned")} END AS cleaned
            FROM (SELECT t.pdf, t.page, t.sigla, f.flavors, {counts("t.raw")} AS raw, t.cleaned FROM {{folded_covers}} AS t JOIN {{dim_flavors}} AS f ON f.sigla = t.sigla) AS m) AS n) AS c""",
    "raw_flavors": "SELECT pdf, page, sigla, inline(raw) FROM {cover_matches}",
    "history": f"""
        SELECT CAST(year(o_orderdate) AS INT) AS year, CAST(month(o_orderdate) AS INT) AS month, {site("k")} AS hospital, o_orderpriority AS sigla, count(*) AS count
        FROM (SELECT *, CAST(floor(o_custkey / 300) AS INT) AS k FROM {{orders}}) AS o GROUP BY 1, 2, 3, 4""",
    # the most frequent total, the smallest of equals; the reads with it, on the files' own partitioning
    "dominant": f"SELECT pdf, {_mode('total', '-n, total')} AS dom FROM (SELECT pdf, total, count(*) AS n FROM {{page_reads}} WHERE total > 0 GROUP BY pdf, total) AS t GROUP BY pdf",
    "page_modes": """
        SELECT *, first_value(CASE WHEN total > 0 THEN total END) OVER (PARTITION BY pdf ORDER BY CASE WHEN total > 0 THEN -n ELSE 1 END, total ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dom
        FROM (SELECT *, count(*) OVER (PARTITION BY pdf, total) AS n FROM {page_reads}) AS x""",
    # recovered reads: closed form of the cycle fill
    "recovered": """
        SELECT pdf, page, CAST(COALESCE(curr, rec) AS INT) AS curr, CAST(CASE WHEN curr IS NOT NULL THEN total WHEN rec IS NOT NULL THEN dom END AS INT) AS total, code,
          CASE WHEN curr IS NOT NULL THEN 'direct' WHEN rec IS NOT NULL THEN 'recovered' ELSE 'failed' END AS status, dom, method, true_curr
        FROM (SELECT *, CASE WHEN curr IS NULL AND dom IS NOT NULL THEN CASE WHEN before IS NOT NULL THEN (before.curr + page - before.page - 1) % dom + 1
              WHEN follows IS NOT NULL THEN (follows - 2 + dom) % dom + 1 END END AS rec
          FROM (SELECT *, max(CASE WHEN curr IS NOT NULL THEN struct(page, curr) END) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS before,
              lead(curr) OVER (PARTITION BY pdf ORDER BY page) AS follows FROM {page_modes}) AS x) AS y""",
    "segmented": """
        SELECT *, CASE WHEN doc > 0 THEN row_number() OVER (PARTITION BY pdf, doc ORDER BY page) END AS pos, first_value(total) OVER (PARTITION BY pdf, doc ORDER BY page) AS declared
        FROM (SELECT *, CAST(sum(CASE WHEN curr = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY pdf ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS doc FROM {recovered} WHERE curr IS NOT NULL) AS s""",
    "segments": """
        SELECT pdf, doc, CAST(min(page) AS INT) AS start_page, CAST(min(declared) AS INT) AS declared_total, count_if(status = 'direct') AS pages, count_if(status = 'recovered') AS inferred,
          bool_and(pos = 1 OR status = 'recovered' OR (curr = pos AND total = declared)) AS sequence_ok FROM {segmented} WHERE doc > 0 GROUP BY pdf, doc""",
}

#: Other texts of relations for the oracle: where a form suits Spark only, or to check it by a plainer one.
ORACLE = {
    # every page with every flavor of its category and every anchor
    "raw_flavors": f"""
        SELECT t.pdf, t.page, t.sigla, a.flavor, a.ord, a.min_match, list(a.anchor ORDER BY a.place) FILTER (a.is_anti = 0 AND contains(t.text, a.anchor)) AS matched, list(a.anchor ORDER BY a.place) FILTER (a.is_anti = 0 AND NOT contains(t.text, a.anchor)) AS missing, count_if(a.is_anti = 1 AND contains(t.text, a.anchor)) AS anti_hits
        FROM (SELECT pdf, page, sigla, {anchors.folded("", "strip_accents(raw)")} AS text FROM {{cover_text}}) AS t JOIN {{dim_anchor}} AS a ON a.sigla = t.sigla GROUP BY ALL""",
    "cover_pages": f"""
        SELECT pdf, page, sigla, raw_owner, CASE WHEN raw_owner IS NULL THEN raw_near END AS raw_near, COALESCE(raw_owner, owner) AS owner, CASE WHEN raw_owner IS NULL AND owner IS NULL THEN near END AS near
        FROM (SELECT pdf, page, sigla, first(flavor ORDER BY ord) FILTER (WHERE as_read AND owns) AS raw_owner, first(flavor ORDER BY ord) FILTER (WHERE as_read AND nearly) AS raw_near, first(flavor ORDER BY ord) FILTER (WHERE NOT as_read AND owns) AS owner, first(flavor ORDER BY ord) FILTER (WHERE NOT as_read AND nearly) AS near
          FROM (SELECT *, c >= min_match AND antis = 0 AS owns, c = min_match - 1 AND min_match > 1 AND antis = 0 AS nearly
            FROM (SELECT t.pdf, t.page, t.sigla, t.as_read, a.flavor, a.ord, a.min_match, count_if(a.is_anti = 0 AND contains(t.text, a.anchor)) AS c, count_if(a.is_anti = 1 AND contains(t.text, a.anchor)) AS antis
              FROM (SELECT pdf, page, sigla, true AS as_read, {anchors.folded("", "strip_accents(raw)")} AS text FROM {{cover_text}} UNION ALL SELECT pdf, page, sigla, false, {anchors.folded("", "strip_accents(cleaned)")} FROM {{cover_text}}) AS t
              JOIN {{dim_anchor}} AS a ON a.sigla = t.sigla GROUP BY ALL) AS g) AS h GROUP BY pdf, page, sigla) AS p""",
    "name_hits": """
        SELECT id, host, hospital, name, sigla, ord, length(regexp_extract(stem, '^(|.*?[_.-])' || token || '($|[_.-])', 1)) AS pos, length(regexp_extract(stem, '(^|[_.-])(' || token || ')($|[_.-])', 2)) AS len
        FROM (SELECT *, substr(lower(name), 1, length(name) - 4) AS stem FROM {files} WHERE lower(name) LIKE '%.pdf') AS f
        JOIN {dim_token} AS d ON regexp_extract(stem, '(^|[_.-])(' || token || ')($|[_.-])', 2) <> ''""",
    "file_sigla": "SELECT f.*, h.sigla FROM {files} AS f LEFT JOIN (SELECT id, first(sigla ORDER BY pos, len DESC, ord) AS sigla FROM {name_hits} GROUP BY id) AS h ON f.id = h.id",
    "dominant": "SELECT pdf, first(total ORDER BY n DESC, total) AS dom FROM (SELECT pdf, total, count(*) AS n FROM {page_reads} WHERE total > 0 GROUP BY pdf, total) AS t GROUP BY pdf",
    "recovered": """
        SELECT pdf, page, CAST(COALESCE(curr, rec) AS INT) AS curr, CAST(CASE WHEN curr IS NOT NULL THEN total WHEN rec IS NOT NULL THEN dom END AS INT) AS total, code,
          CASE WHEN curr IS NOT NULL THEN 'direct' WHEN rec IS NOT NULL THEN 'recovered' ELSE 'failed' END AS status, dom, method, true_curr
        FROM (SELECT r.*, d.dom, CASE WHEN r.curr IS NULL THEN CASE WHEN b.curr IS NOT NULL THEN (b.curr + r.page - b.page - 1) % d.dom + 1 WHEN n.curr IS NOT NULL THEN (n.curr - 2 + d.dom) % d.dom + 1 END END AS rec
          FROM {page_reads} AS r LEFT JOIN {dominant} AS d ON r.pdf = d.pdf ASOF LEFT JOIN (SELECT pdf, page, curr FROM {page_reads} WHERE curr IS NOT NULL) AS b ON b.pdf = r.pdf AND b.page <= r.page
          LEFT JOIN {page_reads} AS n ON n.pdf = r.pdf AND n.page = r.page + 1) AS y""",
}


def names_in(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


#: Relations that a query writes once if it reads them more than once: they cost more to make than to read. In this order,
#: each is made of those before it.
WRITTEN_ONCE = ("foreign_names", "suspects", "open_suspects")


def readings(text: str, name: str) -> int:
    """How often a query reads a relation, by itself and through others."""
    return sum(n == name or (n not in TABLES and n in RELATIONS and readings(RELATIONS[n], name)) for n in re.findall(r"\{(\w+)\}", text))


class Session:
    """DataFrames of one folder of tables, each planned once."""

    def __init__(self, spark: SparkSession, sf_dir: str, frames: dict[str, Callable[[Session], DataFrame]] | None = None):
        """frames: relations that are not SQL."""
        self.spark, self.dir, self.made, self.frames = spark, sf_dir, {}, frames or {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.made:
            self.made[name] = self.frames[name](self) if name in self.frames else self.spark.read.parquet(f"{self.dir}/{name}.parquet") if name in TABLES else self.sql(RELATIONS[name])
        return self.made[name]

    def query(self, text: str) -> DataFrame:
        """A registered query: what it reads more than once is written once, to the folder in spark.checkpoint.dir."""
        for name in WRITTEN_ONCE:
            if name not in self.made and readings(text, name) > 1:
                path = scratch(self.spark, name)
                self[name].write.parquet(path)
                self.made[name] = self.spark.read.schema(self[name].schema).parquet(path)
        return self.sql(text)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: self[n] for n in names_in(text)})


def duck(text: str) -> str:
    """The same text with its relations as common table expressions, for DuckDB."""
    order: list[str] = []

    of = {n: ORACLE.get(n, t) for n, t in RELATIONS.items()}

    def visit(body: str) -> None:
        for n in names_in(body):
            if n not in TABLES and n not in order:
                visit(of[n])
                order.append(n)

    visit(text)
    plain = lambda x: re.sub(r"\{(\w+)\}", r"\1", x).replace(" STRING)", " VARCHAR)").replace("bround(", "round_even(").replace("struct(", "row(").replace("/*all*/", ", 'g'").replace("{{", "{").replace("}}", "}")
    head = f"WITH {', '.join(f'{n} AS ({plain(of[n])})' for n in order)} " if order else ""
    return head + plain(text)
