"""Sources and sinks as queries: each writes what the tables hold in the form concerned and reads it back.

Files go to the shared folder of the session (`sources.files.scratch`); nothing passes the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import files, pdf

#: Fixtures in one JSON file.
BATCH = 64
_READS = "SELECT pdf, page, curr, total, method, confidence, CAST(floor(pdf / 64) AS BIGINT) AS batch FROM {page_reads}"
_CAPTURE = """
    SELECT CAST(a.pdf AS STRING) AS pdf_nickname, a.page AS page_num, COALESCE(CAST(a.curr AS STRING) || '/' || CAST(a.total AS STRING), '') AS tier1_parsed, COALESCE(CAST(b.curr AS STRING) || '/' || CAST(b.total AS STRING), '') AS tier2_parsed,
      'p' || CAST(a.page AS STRING) AS tier1_text, '' AS tier2_text, '' AS tier3_text, 'img_' || CAST(a.pdf AS STRING) || '_' || CAST(a.page AS STRING) || '.png' AS image_path
    FROM (SELECT * FROM {variant_reads} WHERE variant = 'raw') AS a JOIN (SELECT * FROM {variant_reads} WHERE variant = 'digits') AS b ON b.pdf = a.pdf AND b.page = a.page"""


def _folders(s) -> str:
    """All files of a month in a folder a cell, as PDF files of as many pages; those without pages cannot be read."""
    path = files.scratch(s.spark, "folders")
    rows = s.sql("SELECT hospital || '/' || sigla || '/' || CAST(id AS STRING) || '_' || file AS path, pages FROM {file_counts}")
    pdf.write_pdfs(rows, path).write.format("noop").mode("overwrite").save()
    return path


def s01_list_files(s) -> DataFrame:
    """A folder per cell: every file of one ending, at any depth, with its length."""
    found = files.listed_by_tasks(s.spark, _folders(s)).filter(F.lower("path").endswith(".pdf"))
    part = lambda k: F.element_at(F.split("path", "/"), k)
    return found.select(part(-3).alias("hospital"), part(-2).alias("sigla"), part(-1).alias("file"), (F.col("length") > 20).alias("whole"))


def s06_page_counts(s) -> DataFrame:
    """Pages of files by their page trees; none, or 0, where a file cannot be read."""
    folder = _folders(s)
    found = pdf.pages_of(files.listed_by_tasks(s.spark, folder), folder)
    id = F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("_"), F.lit(1)).cast("bigint")
    return found.select(id.alias("id"), F.col("pages").alias("page_count"), F.coalesce("pages", F.lit(0)).alias("page_count_or_zero"))


_LISTED = "SELECT file || '#' || CAST(id AS STRING) AS path, CAST(id * 1000 AS BIGINT) AS modified, CAST(pages * 4096 + id AS BIGINT) AS length, pages FROM {file_counts}"
_CACHED = "SELECT path, CASE WHEN length % 5 = 0 THEN modified + 1 ELSE modified END AS modified, length, pages FROM (SELECT file || '#' || CAST(id AS STRING) AS path, CAST(id * 1000 AS BIGINT) AS modified, CAST(pages * 4096 + id AS BIGINT) AS length, pages, id FROM {file_counts}) AS c WHERE id % 3 > 0 AND pages > 0"


def s07_page_count_cache(s) -> DataFrame:
    """Cached page counts of files that have neither changed in time nor length; the others, and unreadable ones, are to be read."""
    listed, cache = s.sql(_LISTED).drop("pages"), s.sql(_CACHED)
    stale = files.stale_files(listed, cache).select("path", F.lit(True).alias("stale"))
    return files.page_counts(listed, cache).join(stale, "path", "left").select("path", "pages", F.coalesce("stale", F.lit(False)).alias("stale"))


def s11_fixture_reads(s) -> DataFrame:
    """Page reads as JSON fixtures (a name and its reads), many in a file."""
    path = files.scratch(s.spark, "fixtures")
    reads = s.sql(_READS).groupBy("batch", "pdf").agg(F.sort_array(F.collect_list(F.struct(F.col("page").alias("pdf_page"), "curr", "total", "method", "confidence"))).alias("reads"))
    fixture = F.struct(F.col("pdf").cast("string").alias("name"), F.when(F.col("pdf") % 3 == 0, "real").otherwise("synthetic").alias("source"), "reads")
    arrays = reads.groupBy("batch").agg(F.to_json(F.collect_list(fixture)).alias("value"))
    arrays.repartition("batch").write.partitionBy("batch").text(path)
    return files.fixture_reads(s.spark, path, "*.txt").select("name", "source", "pdf_page", "curr", "total", "method", "confidence")


def s12_truth(s) -> DataFrame:
    """True counts as JSON maps of names."""
    path = files.scratch(s.spark, "truth")
    counts = s["true_counts"].select(F.floor(F.col("pdf") / BATCH).alias("batch"), F.col("pdf").cast("string").alias("name"), F.struct(F.col("documents").cast("int").alias("doc_count"), F.col("complete").cast("int").alias("complete_count"), F.col("failed").cast("int").alias("inferred_count")).alias("v"))
    maps = counts.groupBy("batch").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("name", "v")))).alias("value"))
    maps.repartition("batch").write.partitionBy("batch").text(path)
    return files.truth(s.spark, path)


def s13_capture_index(s) -> DataFrame:
    """A CSV index of captured pages: those that a tier read, and the others."""
    path = files.scratch(s.spark, "index")
    files.write_capture(s.sql(_CAPTURE), path)
    found, missed = files.capture_index(s.spark, path)
    return found.unionByName(missed).select("pdf_nickname", "page_num", "parsed")


def s14_range_values(s) -> DataFrame:
    """Values of named ranges, replaced as a whole and read back; a name without a range is left out with a warning."""
    path = files.scratch(s.spark, "ranges")
    values = s.sql("SELECT n.hospital || '_' || n.sigla || '_count' AS range_name, n.count AS value FROM {cell_count} AS n JOIN {cells} AS c ON c.hospital = n.hospital AND c.sigla = n.sigla WHERE NOT c.excluded")
    ranges = s.sql("SELECT h.hospital || '_' || d.sigla || '_count' AS range_name FROM {dim_hospital} AS h CROSS JOIN {dim_sigla} AS d WHERE d.sigla <> 'chps'")
    files.write_range_values(values.withColumn("value", F.lit(-1)), ranges, path)
    unknown = files.write_range_values(values, ranges, path)
    none = F.lit(None).cast("bigint")
    return s.spark.read.parquet(path).select("range_name", "value", F.lit(None).cast("string").alias("warning")).unionByName(unknown.select("range_name", none.alias("value"), F.lit("named range not found").alias("warning")))


def s15_outputs(s) -> DataFrame:
    """A month's output each, listed by the time it was written, the last one first."""
    path = files.scratch(s.spark, "outputs")
    months = s.sql("SELECT lpad(CAST(year AS STRING), 4, '0') || '-' || lpad(CAST(month AS STRING), 2, '0') AS session_id, hospital, sigla, count, month FROM {history}")
    months.repartition("session_id").write.partitionBy("session_id").json(path)
    for r in files.list_files(s.spark, path, "*.json").collect():  # a file a month
        year, month = map(int, r.path.partition("session_id=")[2][:7].split("-"))
        files.set_time(s.spark, r.path, 86400 * (31 * month + 372 * (year - 1970)))
    listed = files.list_files(s.spark, path, "*.json").select(F.regexp_extract("path", "session_id=([^/]+)/", 1).alias("session_id"), "modified", "length")
    order = F.row_number().over(Window.orderBy(F.desc("modified"), "session_id"))  # a row a month
    return listed.select("session_id", F.unix_seconds("modified").alias("modified"), (F.col("length") > 0).alias("filled"), order.alias("place"))


def s17_capture_csv(s) -> DataFrame:
    """Captured pages as CSV with every tier's text, as they are read back."""
    path = files.scratch(s.spark, "capture")
    files.write_capture(s.sql(_CAPTURE), path)
    return s.spark.read.schema(files.INDEX).option("header", True).csv(path).select("pdf_nickname", "page_num", "tier1_parsed", "tier2_parsed", "tier1_text", "image_path")


def s16_manifest_file(s) -> DataFrame:
    """Pending operations as JSON lines."""
    path = files.scratch(s.spark, "manifest")
    ops = s["resolved_ops"]
    files.write_manifest(ops, path)
    return s.spark.read.schema(ops.schema).json(path).select("id", "op_type", "file", "page_from", "page_to", "documents", "workers")


def s18_partitioned_history(s) -> DataFrame:
    """The history as a table partitioned by year and month; what breaks its rules (a key twice, a negative count) stays out."""
    path, name = files.scratch(s.spark, "history"), f"history_{files.unique()}"
    s.spark.sql(f"CREATE TABLE {name} (hospital STRING NOT NULL, sigla STRING NOT NULL, count BIGINT NOT NULL, year INT, month INT) USING parquet PARTITIONED BY (year, month) LOCATION '{path}'")
    kept = s["history"].filter("count >= 0 AND month BETWEEN 1 AND 12").dropDuplicates(["year", "month", "hospital", "sigla"])
    kept.select("hospital", "sigla", "count", "year", "month").repartition("year", "month").write.insertInto(name)
    s.spark.sql(f"DROP TABLE {name}")  # of the catalog: the files stay where they were put
    return s.spark.read.schema("hospital string, sigla string, count bigint, year int, month int").parquet(path).select("year", "month", "hospital", "sigla", "count")


#: Every 31st page's content is no text, every 37th is missing.
_CONTENTS = "SELECT t.pdf, t.page, t.text, r.partkey % 31 = 3 AS bad, r.partkey % 37 = 5 AS gone FROM {page_text} AS t JOIN {page_reads} AS r ON r.pdf = t.pdf AND r.page = t.page"


def s27_extracted_reads(s) -> DataFrame:
    """Page reads from pages' bytes, written as JSON rows; a page that cannot be read is a row that failed, with its error."""
    path, out = files.scratch(s.spark, "contents"), files.scratch(s.spark, "reads")
    text = F.col("text").cast("binary")
    contents = s.sql(_CONTENTS).select("pdf", "page", F.when(F.col("bad"), F.concat(F.lit(b"\xff\xfe"), text)).when(~F.col("gone"), text).alias("content"))
    contents.write.parquet(path)
    rows = files.page_numbers(s.spark.read.parquet(path))
    rows.write.json(out)
    return s.spark.read.schema(rows.schema).json(out)


def s28_sweep_results(s) -> DataFrame:
    """Scores of a sweep: JSON by variant, a summary as CSV, read back together."""
    path = files.scratch(s.spark, "sweep")
    scores = s.sql("SELECT variant, count_if(curr IS NULL) AS failed, count_if(curr = true_curr) AS correct, count_if(curr <> true_curr) AS wrong FROM {variant_reads} GROUP BY variant")
    scores.write.partitionBy("variant").json(f"{path}/configs")
    detail = s.spark.read.schema("failed bigint, correct bigint, wrong bigint, variant string").json(f"{path}/configs")
    detail.select("variant", (F.col("correct") - F.col("wrong")).alias("score")).write.option("header", True).csv(f"{path}/summary")
    return detail.join(s.spark.read.schema("variant string, score bigint").option("header", True).csv(f"{path}/summary"), "variant")


def s29_latest_result(s) -> DataFrame:
    """Of results written run by run, the last run's."""
    path = files.scratch(s.spark, "runs")
    s.sql("SELECT DISTINCT CAST(year AS STRING) || '-' || lpad(CAST(month AS STRING), 2, '0') AS run, sigla, hospital, count FROM {history}").write.partitionBy("run").json(path)
    return files.latest_run(s.spark, path, "sigla string, hospital string, count bigint, run string")


OPERATORS: dict[str, Callable] = {f.__name__: f for f in (s01_list_files, s06_page_counts, s07_page_count_cache, s11_fixture_reads, s12_truth, s13_capture_index, s14_range_values, s15_outputs, s16_manifest_file, s17_capture_csv, s18_partitioned_history, s27_extracted_reads, s28_sweep_results, s29_latest_result)}
_SCORES = "SELECT variant, count_if(curr IS NULL) AS failed, count_if(curr = true_curr) AS correct, count_if(curr <> true_curr) AS wrong FROM {variant_reads} GROUP BY variant"
SQL: dict[str, str] = {
    "s01_list_files": "SELECT hospital, sigla, CAST(id AS STRING) || '_' || file AS file, pages > 0 AS whole FROM {file_counts} WHERE lower(file) LIKE '%.pdf'",
    "s06_page_counts": "SELECT id, CASE WHEN pages > 0 THEN pages END AS page_count, pages AS page_count_or_zero FROM {files}",
    "s07_page_count_cache": f"SELECT l.path, c.pages, c.path IS NULL AS stale FROM ({_LISTED}) AS l LEFT JOIN ({_CACHED}) AS c ON c.path = l.path AND c.modified = l.modified AND c.length = l.length",
    "s11_fixture_reads": "SELECT CAST(pdf AS STRING) AS name, CASE WHEN pdf % 3 = 0 THEN 'real' ELSE 'synthetic' END AS source, page AS pdf_page, curr, total, method, confidence FROM {page_reads}",
    "s12_truth": "SELECT CAST(pdf AS STRING) AS name, CAST(documents AS INT) AS doc_count, CAST(complete AS INT) AS complete_count, CAST(failed AS INT) AS inferred_count FROM {true_counts}",
    "s13_capture_index": f"SELECT pdf_nickname, page_num, COALESCE(NULLIF(tier1_parsed, ''), NULLIF(tier2_parsed, '')) AS parsed FROM ({_CAPTURE}) AS c",
    "s14_range_values": "SELECT n.hospital || '_' || n.sigla || '_count' AS range_name, CASE WHEN n.sigla <> 'chps' THEN n.count END AS value, CASE WHEN n.sigla = 'chps' THEN 'named range not found' END AS warning FROM {cell_count} AS n JOIN {cells} AS c ON c.hospital = n.hospital AND c.sigla = n.sigla WHERE NOT c.excluded",
    "s15_outputs": "SELECT session_id, CAST(86400 * (31 * month + 372 * (year - 1970)) AS BIGINT) AS modified, true AS filled, CAST(row_number() OVER (ORDER BY year DESC, month DESC) AS INT) AS place FROM (SELECT DISTINCT year, month, lpad(CAST(year AS STRING), 4, '0') || '-' || lpad(CAST(month AS STRING), 2, '0') AS session_id FROM {history}) AS h",
    "s17_capture_csv": f"SELECT pdf_nickname, page_num, NULLIF(tier1_parsed, '') AS tier1_parsed, NULLIF(tier2_parsed, '') AS tier2_parsed, tier1_text, image_path FROM ({_CAPTURE}) AS c",
    "s16_manifest_file": "SELECT id, op_type, file, page_from, page_to, documents, workers FROM {resolved_ops} WHERE status = 'pending'",
    "s18_partitioned_history": "SELECT year, month, hospital, sigla, count FROM {history} WHERE count >= 0",
    "s27_extracted_reads": f"""
        SELECT pdf, page, CASE WHEN error IS NULL THEN curr END AS curr, CASE WHEN error IS NULL THEN total END AS total, CASE WHEN error IS NULL THEN 'direct' ELSE 'failed' END AS method, error
        FROM (SELECT *, CASE WHEN bad THEN 'bad bytes' WHEN gone THEN 'no content' WHEN curr IS NULL THEN 'no number' WHEN curr < 1 OR curr > total THEN CAST(curr AS STRING) || ' of ' || CAST(total AS STRING) END AS error
          FROM (SELECT *, TRY_CAST(regexp_extract(text, '([0-9]{{{{1,3}}}}) *de *([0-9]{{{{1,3}}}})', 1) AS INT) AS curr, TRY_CAST(regexp_extract(text, '([0-9]{{{{1,3}}}}) *de *([0-9]{{{{1,3}}}})', 2) AS INT) AS total FROM ({_CONTENTS}) AS c) AS d) AS e""",
    "s28_sweep_results": f"SELECT variant, failed, correct, wrong, correct - wrong AS score FROM ({_SCORES}) AS s",
    "s29_latest_result": "SELECT DISTINCT sigla, hospital, count, CAST(year AS STRING) || '-' || lpad(CAST(month AS STRING), 2, '0') AS run FROM {history} WHERE year * 12 + month = (SELECT max(year * 12 + month) FROM {history})",
}
