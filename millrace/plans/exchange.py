"""Queries of sources, sinks and builders: tables written to the shared folder in a format and read back from it.

Each query writes a driver table (or files made of its rows) through a sink, reads what stands there through a source,
and returns what a user of the two would see; its oracle is SQL over the table itself.
"""

from __future__ import annotations

import functools
import io
import tarfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import boxes as B
from millrace.functions import hashing as H
from millrace.functions import images
from millrace.functions import pixels as PX
from millrace.functions import text as X
from millrace.functions import vectors as V
from millrace.operators import audit, dedup, graph, metrics, sampling
from millrace.plans import builders
from millrace.plans.catalog import ALLOCATE, LINK, RATIOS, SIM, P, _hashed, _links, _r, predictions, query
from millrace.sources import files, remote, tables
from millrace.sources.storage import cut, fresh_path, table, write_text
from millrace.sources.tables import LABELS
from millrace.streaming import scoring

# ---------------------------------------------------------------- tables of text


@query("SELECT doc_id::VARCHAR AS doc_id, lang, ' ' || lang || '  ' AS raw, sha256(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS sha, '' AS nothing FROM documents")
def csv_cells(spark, sf_dir):
    """Cells with quotes, commas and line breaks, padded ones, empty ones; trimmed and as they are."""
    d = table(spark, sf_dir, "documents")
    path = fresh_path(spark, "csv")
    tables.write_csv(d.select("doc_id", F.concat(F.lit(" "), "lang", F.lit("  ")).alias("lang"), "text"), path, ["doc_id", "lang", "text", "nothing"])
    trimmed, raw = tables.read_csv(spark, path), tables.read_csv(spark, path, trim=False)
    both = trimmed.join(raw.select("doc_id", F.col("lang").alias("raw")), "doc_id")
    return both.select("doc_id", "lang", "raw", F.sha2("text", 256).alias("sha"), "nothing")


@query("""SELECT row_number() OVER (ORDER BY p_partkey) + 1 AS row, p_partkey::VARCHAR AS p_partkey, p_name, '' AS grade, 'grade' AS missing, 'p_size' AS extra FROM part""")
def csv_numbered(spark, sf_dir):
    """Rows by their line in the file, with what the header lacks and what it has too much."""
    path = fresh_path(spark, "numbered")
    tables.write_csv(table(spark, sf_dir, "part").orderBy("p_partkey"), path, ["p_partkey", "p_name", "p_size"], single_file=True)
    rows, missing, extra = tables.read_numbered_csv(spark, path, ["p_partkey", "p_name", "grade"])
    return rows.select("row", "p_partkey", "p_name", "grade", F.lit("|".join(missing)).alias("missing"), F.lit("|".join(extra)).alias("extra"))


def _prediction_rows(spark, sf_dir) -> DataFrame:
    names = F.array(*[F.lit(x) for x in LABELS])
    p = predictions(spark, sf_dir)
    split = F.when(F.col("vec_id") % 2 == 0, "val_cal").otherwise("val_select")
    ps = [F.get("p", F.lit(i)).alias(f"p_{x}") for i, x in enumerate(LABELS)]
    return p.select(F.concat(F.lit("i"), F.col("vec_id").cast("string")).alias("image_id"), split.alias("split"), F.get(names, F.col("truth")).alias("true_label"), *ps, F.lit("m1").alias("model_id"), F.lit("a" * 64).alias("dataset_sha256"), F.lit("b" * 64).alias("checkpoint_sha256"), F.lit("g").alias("source_group_id"))


@query(f"WITH {P} SELECT 'i' || vec_id AS image_id, CASE WHEN vec_id % 2 = 0 THEN 'val_cal' ELSE 'val_select' END AS split, truth, round(p[1], 6) AS first, round(list_max(p), 6) AS largest, 'm1' AS model_id FROM p")
def prediction_table(spark, sf_dir):
    path = fresh_path(spark, "predictions")
    tables.write_csv(_prediction_rows(spark, sf_dir), path, tables.PREDICTION_COLUMNS)
    rows = tables.read_predictions(spark, path)
    return rows.select("image_id", "split", "truth", _r(F.get("p", F.lit(0))).alias("first"), _r(F.array_max("p")).alias("largest"), "model_id")


@query("""SELECT 'i' || vec_id AS image_id, concat_ws('|', CASE WHEN vec_id % 7 = 0 THEN 'split' END, CASE WHEN vec_id % 5 = 0 THEN 'true_label' END, CASE WHEN vec_id % 3 = 0 THEN 'probabilities' END, CASE WHEN vec_id % 11 = 0 THEN 'checkpoint_sha256' END) AS errors FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 3 = 0 OR vec_id % 11 = 0""")
def prediction_refusals(spark, sf_dir):
    """Broken prediction rows with all rules they break."""
    i = F.regexp_extract("image_id", "([0-9]+)", 1).cast("long")
    rows = project_text(_prediction_rows(spark, sf_dir))
    broken = rows.withColumns({"split": F.when(i % 7 == 0, "train").otherwise(F.col("split")), "true_label": F.when(i % 5 == 0, "dog").otherwise(F.col("true_label")), "p_sphynx": F.when(i % 3 == 0, "nan").otherwise(F.col("p_sphynx")), "checkpoint_sha256": F.when(i % 11 == 0, "B" * 64).otherwise(F.col("checkpoint_sha256"))})
    return tables.prediction_violations(broken).select("image_id", F.array_join("errors", "|").alias("errors"))


def project_text(rows: DataFrame) -> DataFrame:
    return tables.project(rows, rows.columns)


@query("SELECT CASE quality WHEN 1 THEN 'accepted' ELSE 'rejected' END AS decision, count(*)::BIGINT AS n, count(*) FILTER (doc_id % 10 = 0)::BIGINT AS unsigned FROM labels GROUP BY 1")
def review_queue(spark, sf_dir):
    """A queue file that must have its required fields; others are welcome."""
    path = fresh_path(spark, "queue")
    q = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("image_id"), F.when(F.col("quality") == 1, "accepted").otherwise("rejected").alias("decision"), F.when(F.col("doc_id") % 10 == 0, "").otherwise("r1").alias("reviewer"), F.lit("n").alias("notes"))
    tables.write_csv(q, path, q.columns)
    rows = tables.read_required(spark, path, ["image_id", "decision", "reviewer"])
    return rows.groupBy("decision").agg(F.count("*").alias("n"), F.count_if(F.col("reviewer") == "").alias("unsigned"))


@query("SELECT s_suppkey, s_name AS author, 'https://example.test/' || s_suppkey AS page FROM supplier")
def unique_provenance(spark, sf_dir):
    path = fresh_path(spark, "provenance")
    s = table(spark, sf_dir, "supplier")
    tables.write_csv(s.select("s_suppkey", F.col("s_name").alias("author"), F.concat(F.lit("https://example.test/"), F.col("s_suppkey").cast("string")).alias("page")), path, ["s_suppkey", "author", "page"])
    return tables.read_unique(spark, path, "s_suppkey").select("s_suppkey", "author", "page")


@query("""SELECT 'documents' AS name, count(*)::BIGINT AS total, count(*) FILTER (lang = 'en')::BIGINT AS en, count(DISTINCT source)::BIGINT AS sources, '{"lang":"en","seed":7}' AS recipe FROM documents""")
def report_document(spark, sf_dir):
    """A report with sorted keys, written once and read back; its recipe is one compact JSON text."""
    d = table(spark, sf_dir, "documents")
    counts = d.agg(F.count("*").alias("total"), F.count_if(F.col("lang") == "en").alias("en"), F.countDistinct("source").alias("sources")).first()
    path = fresh_path(spark, "report") + ".json"
    tables.write_report(spark, {"total": counts.total, "per_label": {"en": counts.en}, "name": "documents", "sources": counts.sources}, path)
    recipe = tables.report_column(F.lit("en").alias("lang"), F.lit(7).alias("seed"))
    return tables.read_json_document(spark, path).select("name", "total", F.col("per_label.en").alias("en"), "sources", recipe.alias("recipe"))


CONFIG = """schema_version = 1
[screen]
min_chars = 400
labels = ["en", "fr"]
share = 0.25
"""


@query("SELECT lang, count(*)::BIGINT AS n, floor(count(*) * 0.25)::BIGINT AS share FROM documents WHERE n_chars >= 400 AND lang IN ('en', 'fr') GROUP BY 1")
def configured_screen(spark, sf_dir):
    """A job whose numbers come from a validated configuration file."""
    path = fresh_path(spark, "config") + ".toml"
    write_text(spark, path, CONFIG)
    c = tables.load_toml(spark, path, rules={"screen.min_chars": (int, 1, 10_000), "screen.share": (float, 0.0, 1.0)})["screen"]
    d = table(spark, sf_dir, "documents").where((F.col("n_chars") >= c["min_chars"]) & F.col("lang").isin(*c["labels"]))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.floor(F.count("*") * c["share"]).alias("share"))


@query("SELECT 'models/' || lower(replace(n_name, ' ', '_')) || '.pt' AS path FROM nation")
def model_registry(spark, sf_dir):
    """Paths of a YAML registry, quoted or not, with remarks behind them."""
    n = table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # the nations are a closed domain
    lines = ["assets:"]
    for r in n:
        p = f"models/{r.n_name.lower().replace(' ', '_')}.pt"
        lines += [f"  - id: m{r.n_nationkey}", f"    path: {p}  # the model" if r.n_nationkey % 3 == 0 else f'    path: "{p}"' if r.n_nationkey % 3 == 1 else f"    path: '{p}'"]
    path = fresh_path(spark, "registry") + ".yaml"
    write_text(spark, path, "\n".join(lines) + "\n")
    return tables.registry_paths(spark, path)


@query("SELECT p_partkey AS epoch, round((p_partkey % 1000) / 1000.0, 6) AS accuracy FROM part")
def training_log(spark, sf_dir):
    """A results file with padded headers."""
    path = fresh_path(spark, "results")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("   epoch"), ((F.col("p_partkey") % 1000) / 1000).cast("string").alias("  metrics/accuracy_top1"), F.lit(" 0.1").alias(" train/loss "))
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return tables.read_results(spark, path).select(F.col("epoch").cast("long").alias("epoch"), _r("accuracy").alias("accuracy"))


@query("SELECT true AS refused, count(*)::BIGINT AS n FROM region")
def existing_output_is_refused(spark, sf_dir):
    """A second write to one path is refused and leaves the first."""
    path, r = fresh_path(spark, "once"), table(spark, sf_dir, "region")
    tables.write_csv(r, path, ["r_regionkey", "r_name"])
    try:
        tables.write_csv(r.limit(0), path, ["r_regionkey"])
        refused = False
    except Exception as e:
        refused = "already exists" in str(e).lower()
    return tables.read_csv(spark, path).agg(F.lit(refused).alias("refused"), F.count("*").alias("n"))


@query("""SELECT doc_id, source, CASE WHEN source = 'src1' THEN 'fetched again' ELSE lang END AS v FROM documents WHERE NOT (source = 'src1' AND doc_id % 2 = 1)""")
def source_replaced(spark, sf_dir):
    """All rows of one source replaced by a new delivery, in a table written beside the old one."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("lang").alias("v"))
    new = d.where("source = 'src1' and doc_id % 2 = 0").withColumn("v", F.lit("fetched again"))
    path = fresh_path(spark, "replaced")
    tables.replace_source(d, new, "source", "src1").write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def last_of_each_key(spark, sf_dir):
    return tables.keep_last(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_id", "event_type")


# ---------------------------------------------------------------- folders, images, archives


def _supplier_files(spark, sf_dir) -> tuple[DataFrame, DataFrame, str]:
    """Rows of the supplier table as files split/label/name under a new folder: (rows, what was written, folder)."""
    i = F.col("s_suppkey")
    split = F.when(i % 5 == 0, "val_cal").when(i % 5 == 1, "val_select").otherwise("train")
    label = F.concat(F.lit("Label"), (F.col("s_nationkey") % 4).cast("string"))
    rows = table(spark, sf_dir, "supplier").select(split.alias("split"), label.alias("label"), F.concat(F.lit("s_"), i.cast("string"), F.when(i % 3 == 0, ".jpg").otherwise(".txt")).alias("file"), F.encode("s_name", "UTF-8").alias("content"))
    rows = rows.withColumn("name", F.concat_ws("/", "split", "label", "file"))
    root = fresh_path(spark, "files")
    return rows, files.write_contents(rows, root), root


SUPPLIER = """f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 5 = 0 THEN 'val_cal' WHEN s_suppkey % 5 = 1 THEN 'val_select' ELSE 'train' END AS split, 'Label' || (s_nationkey % 4) AS label, 's_' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN '.jpg' ELSE '.txt' END AS name, sha256(s_name) AS sha, strlen(s_name)::BIGINT AS length FROM supplier)"""


@query(f"WITH {SUPPLIER} SELECT split, label, name, regexp_replace(name, '[.].*', '') AS stem, length, sha AS sha256, 'class' || right(label, 1) AS mapped FROM f WHERE name LIKE '%.txt'")
def file_tree(spark, sf_dir):
    """Files of one kind in class folders, their content hashes, and the label that each folder's prefix stands for."""
    _, _, root = _supplier_files(spark, sf_dir)
    found = files.class_folders(files.inventory(spark, root, ["txt"], content=True))
    mapped = files.map_folders(found.select(F.col("label").alias("folder")), {f"label{i}": f"class{i}" for i in range(4)})
    return found.join(mapped.select("folder", F.col("label").alias("mapped")), found["label"] == F.col("folder")).select("split", found["label"], "name", "stem", "length", "sha256", "mapped")


@query(f"WITH {SUPPLIER} SELECT split AS directory, count(*)::BIGINT AS files, sum(length)::BIGINT AS bytes, 0::BIGINT AS empty_files, CASE WHEN sum(length) > 200 THEN 'large' ELSE '' END AS warnings FROM f WHERE label <> 'Label3' GROUP BY 1")
def storage_summary(spark, sf_dir):
    """Files and bytes per directory without an excluded folder, with warnings."""
    _, _, root = _supplier_files(spark, sf_dir)
    found = files.inventory(spark, root, exclude=["Label3"])
    return builders.storage_inventory(found, root.split("://")[-1].removeprefix("file:"), 200)


@query(f"WITH {SUPPLIER} SELECT split || '/' || label || '/' || name AS target, true AS ok, sha AS sha256 FROM f")
def materialized_view(spark, sf_dir):
    """Files brought to another folder, twice; the second time all stand. Nothing else stands there."""
    rows, written, root = _supplier_files(spark, sf_dir)
    target = fresh_path(spark, "view")
    plan = written.select(F.col("name").alias("source"), F.col("name").alias("target"), "sha256")
    for _ in range(2):
        done = cut(files.materialize(plan, root, target))
    audit.require_empty(done.where("method <> 'kept'"), "a file was written twice")
    found = files.inventory(spark, target, content=True)
    audit.require_empty(files.unexpected_files(found, rows.select(F.col("file").alias("name"))), "files that no row asks for")
    return done.join(found.select(F.regexp_extract("path", r"([^/]+/[^/]+/[^/]+)$", 1).alias("target"), "sha256"), "target").select("target", "ok", "sha256")


@query(f"WITH {SUPPLIER} SELECT name, label, CASE WHEN k % 10 = 1 THEN 'missing_file' WHEN k % 10 = 2 THEN 'hash_mismatch' ELSE 'ok' END AS status, CASE WHEN k % 10 NOT IN (1, 2, 3) THEN printf('%s-%03d', label, ((row_number() OVER (PARTITION BY label, k % 10 IN (1, 2, 3) ORDER BY name) - 1) // 8 + 1)::INT) END AS batch FROM f WHERE k % 10 <> 3 UNION ALL SELECT name, NULL, 'unlisted_file', NULL FROM f WHERE k % 10 = 3")
def handoff_batches(spark, sf_dir):
    """A manifest reconciled with the files on disk; what is in order is dealt to review batches."""
    rows, written, root = _supplier_files(spark, sf_dir)
    k = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    disk = files.inventory(spark, root, content=True).where(F.regexp_extract("name", "([0-9]+)", 1).cast("long") % 10 != 1)
    listed = rows.where(k % 10 != 3).select(F.col("file").alias("name"), "label", F.when(k % 10 == 2, F.lit("0" * 64)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return builders.handoff_rows(disk, listed, size=8).select("name", "label", "status", "batch")


@query(f"WITH {SUPPLIER} SELECT name, sha AS sha256, sha256('x') AS expected FROM f WHERE k % 4 = 0")
def hash_mismatch_rejects(spark, sf_dir):
    rows, _, root = _supplier_files(spark, sf_dir)
    k = F.regexp_extract("file", "([0-9]+)", 1).cast("long")
    expected = rows.select(F.col("file").alias("name"), F.when(k % 4 == 0, F.sha2(F.encode(F.lit("x"), "UTF-8"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return files.hash_mismatches(files.inventory(spark, root, content=True), expected)


PART_BOXES = """b AS (SELECT p_partkey, (p_partkey % 40)::DOUBLE AS x, (p_partkey % 30)::DOUBLE AS y, (20 + p_size)::DOUBLE AS w, (30 + p_size)::DOUBLE AS h FROM part)"""


@query(f"""WITH {PART_BOXES}, l AS (SELECT *, printf('%.6f', (x + w / 2) / 200)::DOUBLE AS cx, printf('%.6f', (y + h / 2) / 200)::DOUBLE AS cy, printf('%.6f', CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE w / 200 END)::DOUBLE AS bw, printf('%.6f', h / 200)::DOUBLE AS bh FROM b)
SELECT 'p' || p_partkey AS sample, (p_partkey % 6)::INT AS class_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round((cx - bw / 2) * 200, 4) AS x1, round((cy + bh / 2) * 200, 4) AS y2, p_partkey % 9 <> 0 AS ok FROM l""")
def box_labels(spark, sf_dir):
    """Images and label files paired by stem; each label line parsed, checked and turned into pixel corners."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    x, y, w, h = (k % 40).cast("double"), (k % 30).cast("double"), 20 + s, 30 + s
    line = F.format_string("%d %.6f %.6f %.6f %.6f", (k % 6).cast("int"), (x + w / 2) / 200, (y + h / 2) / 200, F.when(k % 9 == 0, F.lit(0.0)).otherwise(w / 200), h / 200)
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("stem"), line.alias("line"), F.floor(k / 50).cast("long").alias("folder"))
    root = fresh_path(spark, "labels")
    named = rows.select(F.concat_ws("/", F.lit("labels"), F.col("folder").cast("string"), F.concat("stem", F.lit(".txt"))).alias("name"), F.encode(F.concat(F.lit("\n"), "line", F.lit("\n \n")), "UTF-8").alias("content"))
    files.write_contents(named, root)
    texts = files.inventory(spark, root, ["txt"], content=True)
    pairs = files.paired(rows.select("stem", F.concat(F.lit("/images/"), "stem", F.lit(".png")).alias("path")), texts)
    lines = pairs.join(texts.select("stem", "content"), "stem").select(F.col("stem").alias("sample"), F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    parsed = files.box_lines(lines)
    box = B.from_center_form(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), F.lit(200.0), F.lit(200.0))
    return parsed.select("sample", "class_id", _r("cx").alias("cx"), _r("cy").alias("cy"), F.round(box["x1"], 4).alias("x1"), F.round(box["y2"], 4).alias("y2"), "ok")


def _number(c, size: int):
    return F.unhex(F.lpad(F.hex(c), 2 * size, "0"))


@query("""SELECT p_partkey::VARCHAR AS path, CASE p_partkey % 4 WHEN 0 THEN 'png' WHEN 3 THEN NULL ELSE 'jpeg' END AS format, CASE WHEN p_partkey % 4 < 3 THEN 300 + p_size ELSE 0 END::INT AS width, CASE WHEN p_partkey % 4 < 3 THEN 200 + p_size ELSE 0 END::INT AS height FROM part""")
def image_headers(spark, sf_dir):
    """Sizes from the headers of PNG and JPEG bytes, JPEG with stray bytes between segments too; others have none."""
    k, w, h = F.col("p_partkey"), F.col("p_size") + 300, F.col("p_size") + 200
    raw = lambda s: F.unhex(F.lit(s))
    png = F.concat(raw("89504E470D0A1A0A0000000D49484452"), _number(w, 4), _number(h, 4), raw("0802000000"))
    segment = F.concat(raw("FFC0000B08"), _number(h, 2), _number(w, 2), raw("0101110000"))
    jpeg, stray = F.concat(raw("FFD8FFE000046162"), segment), F.concat(raw("FFD8FFE000046162000011FFFF"), F.substring(segment, 2, 99))
    content = F.when(k % 4 == 0, png).when(k % 4 == 1, jpeg).when(k % 4 == 2, stray).otherwise(raw("474946383961"))
    return files.image_sizes(table(spark, sf_dir, "part").select(k.cast("string").alias("path"), content.alias("content"))).na.fill(0, ["width", "height"])


def _tar(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(archive, names) as gzipped archives of small members."""
    for pdf in batches:
        out = []
        for archive, names in zip(pdf["archive"], pdf["names"], strict=True):
            buf = io.BytesIO()
            with tarfile.open(fileobj=buf, mode="w:gz") as t:
                for n in names:
                    info = tarfile.TarInfo(n)
                    info.size = len(n)
                    t.addfile(info, io.BytesIO(n.encode()))
            out.append((archive, buf.getvalue()))
        yield pd.DataFrame(out, columns=["name", "content"])


@query("""WITH m AS (SELECT c_custkey, 'Seg' || left(c_mktsegment, 4) AS label, c_custkey AS number FROM customer WHERE c_custkey % 10 <> 0), o AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY number) AS k FROM m)
SELECT 'images/' || label || '_' || number || '.jpg' AS name, label, number::INT AS number FROM o WHERE k <= 20""")
def archive_members(spark, sf_dir):
    """Members of archives that are safe and named by the rule, the first of each label by number."""
    c = table(spark, sf_dir, "customer")
    label = F.concat(F.lit("Seg"), F.substring("c_mktsegment", 1, 4))
    name = F.concat(F.when(F.col("c_custkey") % 10 == 0, "../").otherwise("images/"), label, F.lit("_"), F.col("c_custkey").cast("string"), F.lit(".jpg"))
    packed = c.groupBy(F.concat(F.lit("a"), (F.col("c_custkey") % 3).cast("string"), F.lit(".tgz")).alias("archive")).agg(F.sort_array(F.collect_list(name)).alias("names")).mapInPandas(_tar, "name string, content binary")
    root = fresh_path(spark, "archives")
    files.write_contents(packed, root)
    return files.tar_members(spark, root, r"^images/([A-Za-z]+)_(\d+)\.jpg$", 20).select("name", "label", "number")


@query("SELECT 'r' || n_regionkey || '.zip' AS archive, n_nationkey || '/' || n_name || '.txt' AS name, strlen(n_name)::BIGINT AS bytes, sha256(n_name) AS sha256, true AS same FROM nation")
def archive_handoff(spark, sf_dir):
    """Reproducible ZIP files: written twice to the same digest, and the inventory read back from them."""
    n = table(spark, sf_dir, "nation")
    rows = n.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string"), F.lit(".zip")).alias("archive"), F.concat(F.col("n_nationkey").cast("string"), F.lit("/"), "n_name", F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("content"))
    first, again = (files.write_zips(rows.orderBy(*o), fresh_path(spark, "zip")).select("archive", F.col("sha256").alias(s)) for o, s in ((["name"], "a"), ([F.desc("name")], "b")))
    root = fresh_path(spark, "zip")
    files.write_zips(rows, root)
    same = first.join(again, "archive").select("archive", (F.col("a") == F.col("b")).alias("same"))
    return files.zip_inventory(spark, root).join(same, "archive")


@query("""WITH w AS (SELECT 'n' || n_nationkey || '.png' AS name FROM nation), f AS (SELECT name, CASE n_nationkey % 4 WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END AS matches, n_nationkey AS k FROM w JOIN nation ON name = 'n' || n_nationkey || '.png')
SELECT name, matches::BIGINT AS matches, CASE WHEN matches = 1 THEN CASE WHEN k % 4 = 2 THEN '/b/' ELSE '/a/' END || name END AS only, CASE k % 4 WHEN 0 THEN NULL WHEN 2 THEN '/b/' || name ELSE '/a/' || name END AS first, CASE k % 3 WHEN 0 THEN '/crops/' WHEN 1 THEN '/web/' ELSE '/raw/' END || name AS by_kind FROM f""")
def path_resolution(spark, sf_dir):
    """The only file of a name, the file in the first root that has it, and the root that a kind of source stands for."""
    k = F.col("n_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit("n"), k.cast("string"), F.lit(".png")).alias("name"))
    at = lambda root, where: n.where(where).select("name", F.concat(F.lit(root), "name").alias("path"))
    disk = at("/a/", (k % 4 == 1) | (k % 4 == 3)).unionAll(at("/b/", (k % 4 == 2) | (k % 4 == 3)))
    one = files.resolve_exactly_one(n.select("name"), disk).select("name", "matches", F.col("path").alias("only"))
    first = files.resolve_first_root(n.select("name"), disk, ["/a/", "/b/"]).select("name", F.col("path").alias("first"))
    kinds = n.select("name", F.concat(builders.source_root((k % 3).cast("string"), {"0": "/crops/", "1": "/web/"}, "/raw/"), "name").alias("by_kind"))
    return one.join(first, "name").join(kinds, "name")


# ---------------------------------------------------------------- services


def _paged(rows: DataFrame, kind: str, size: int, root: str) -> None:
    """Rows (nth from 0, item struct) as the JSON pages of a service, one file for each request that it answers."""
    n = rows.count()
    page = F.floor(F.col("nth") / size)
    held = rows.groupBy(page.alias("page")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("nth", "item"))), lambda s: s["item"])).alias("items"))
    last = -(-n // size) - 1
    if kind == "number":
        name, body = F.format_string("page=%d&per_page=%d", F.col("page") + 1, F.lit(size)), F.concat(F.lit('{"results": '), "items", F.lit("}"))
    elif kind == "offset":
        name = F.format_string("offset=%d&limit=%d", F.col("page") * size, F.lit(size))
        body = F.concat(F.lit('{"results": '), "items", F.lit(', "endOfRecords": '), (F.col("page") == last).cast("string"), F.lit("}"))
    else:
        name = F.when(F.col("page") == 0, "first").otherwise(F.format_string("from=%d", F.col("page")))
        more = F.when(F.col("page") < last, F.format_string(', "continue": {"from": "%d"}', F.col("page") + 1)).otherwise("")
        body = F.concat(F.lit('{"query": {"pages": '), "items", F.lit("}"), more, F.lit("}"))
    pages = held.select(F.concat(name, F.lit(".json")).alias("name"), F.encode(body, "UTF-8").alias("content"))
    if kind == "number" and n % size == 0:  # a service answers the page behind a full last one, with nothing
        pages = pages.unionAll(pages.sparkSession.range(1).select(F.lit(f"page={n // size + 1}&per_page={size}.json"), F.encode(F.lit('{"results": []}'), "UTF-8")))
    files.write_contents(pages, root)


@query("SELECT kind, c_custkey::VARCHAR AS item_id, c_name AS name, (row_number() OVER (PARTITION BY kind ORDER BY c_custkey) - 1) // 40 + CASE kind WHEN 'number' THEN 1 ELSE 0 END AS page FROM customer CROSS JOIN (VALUES ('number'), ('offset'), ('token')) t(kind)")
def service_harvest(spark, sf_dir):
    """All customers from services that page by number, by offset and by a continuation token."""
    spark.dataSource.register(remote.JsonPages)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.struct(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).alias("item"))
    rows = cut(tables.ordinals(cut(c.orderBy("c_custkey")), "nth").select("nth", "item"))
    out = None
    for kind in ("number", "offset", "token"):
        root = fresh_path(spark, f"service-{kind}")
        _paged(rows, kind, 40, root)
        got = spark.read.format("json_pages").options(urls=root, paging=kind, items="query.pages" if kind == "token" else "results", pagesize="40", opener="millrace.sources.remote:open_file").load()
        part = got.select(F.lit(kind).alias("kind"), "item_id", X.json_path(F.col("payload"), "$.name").alias("name"), F.col("page").cast("long").alias("page"))
        out = part if out is None else out.unionAll(part)
    return out


@query("""WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
w AS (SELECT 'r0' AS node, 0 AS depth UNION SELECT e.child, w.depth + 1 FROM w JOIN e ON e.parent = w.node WHERE w.depth < 3) SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")
def category_walk(spark, sf_dir):
    """Categories and items reached from one root, each once, though the tree has ways back."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child")).unionAll(c.select(name("n", "c_nationkey"), name("c", "c_custkey"))).unionAll(n.select(name("n", "n_nationkey"), name("r", "n_regionkey")))
    return graph.reachable(edges, ["r0"], 3)


def _titles(keys: list[str]) -> dict[str, dict]:
    """A lookup service that knows all keys but those that end in 7; it refuses requests of over 40 keys."""
    if len(keys) > 40:
        raise ValueError("too many keys in a request")
    return {k: {"title": f"File {k}", "length": len(k)} for k in keys if not k.endswith("7")}


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 10 <> 7 THEN 'File ' || o_orderkey ELSE '' END AS title FROM orders")
def batched_metadata(spark, sf_dir):
    found = remote.batched_lookup(table(spark, sf_dir, "orders"), "o_orderkey", 40, _titles)
    return found.select("o_orderkey", X.json_path(F.col("payload"), "$.title").alias("title"))


def _body(url: str) -> bytes:
    return f"body of {url}".encode()


@query("SELECT 'd/' || s_suppkey || '.bin' AS target, 'kept' AS method, strlen('body of https://h.test/' || s_suppkey)::BIGINT AS length, sha256('body of https://h.test/' || s_suppkey) AS sha256 FROM supplier")
def download_cache(spark, sf_dir):
    """Files fetched once; asked for again they stand."""
    k = F.col("s_suppkey").cast("string")
    rows, root = table(spark, sf_dir, "supplier").select(F.concat(F.lit("https://h.test/"), k).alias("url"), F.concat(F.lit("d/"), k, F.lit(".bin")).alias("target")), fresh_path(spark, "cache")
    first = remote.cached_download(rows, root, _body)
    audit.require_empty(first.where("method <> 'fetched'"), "files that stood before")
    return remote.cached_download(rows, root, _body)


@query("""WITH m AS (SELECT page_id, (page_id % 7)::VARCHAR AS category, CASE WHEN page_id % 5 = 0 THEN 'unsupported_media_type' WHEN page_id % 3 = 0 THEN 'license_not_allowed' END AS r FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY category, r IS NULL ORDER BY page_id) AS k FROM m)
SELECT page_id, coalesce(r, CASE WHEN k > 30 THEN 'over_limit' END) AS reason, CASE WHEN page_id % 2 = 0 THEN 'b' WHEN page_id % 3 = 0 THEN NULL ELSE 'a' END AS media FROM n""")
def media_intake(spark, sf_dir):
    """Remote files with the reason for which each is refused, and the first media item whose license is allowed."""
    i = F.col("page_id")
    licenses = ("https://creativecommons.org/licenses/by-nc-sa/4.0/", "https://creativecommons.org/licenses/by/4.0/")
    lic = F.when(i % 3 == 0, licenses[0]).otherwise(licenses[1])
    media = F.array(F.struct(F.lit("a").alias("name"), F.when(i % 2 == 0, licenses[0]).otherwise(lic).alias("license")), F.struct(F.lit("b").alias("name"), F.when(i % 2 == 0, licenses[1]).otherwise(licenses[0]).alias("license")))
    rows = table(spark, sf_dir, "pages").select("page_id", (i % 7).cast("string").alias("category"), F.when(i % 5 == 0, "video/mp4").otherwise("image/jpeg").alias("mime"), lic.alias("license_url"), builders.first_licensed(media, ["cc-by", "cc0"])["name"].alias("media"))
    return builders.accept_media(rows, ["image/jpeg"], ["cc-by", "cc0"], 30, "page_id").select("page_id", "reason", "media")


# ---------------------------------------------------------------- rows and columns


@query("""SELECT 'd' || doc_id AS image_id, lang AS label, source AS source_dataset, 'quarantine' AS review_status, '' AS reviewer, 'staging' AS split, '' AS author, n_chars::VARCHAR AS width, 'pages/' || source || '/' || doc_id || '.txt' AS original_url FROM documents
UNION ALL SELECT 'p' || page_id, 'page', 'crawl', 'quarantine', '', 'staging', 'site', '', url FROM pages""")
def manifest_constructor(spark, sf_dir):
    """Two sources as manifest rows at the start of their life, in one schema; what a source lacks is empty."""
    d = table(spark, sf_dir, "documents").withColumnRenamed("text", "body")
    a = builders.manifest_rows(d, image_id=F.concat(F.lit("d"), F.col("doc_id").cast("string")), label=F.col("lang"), source_dataset=F.col("source"), width=F.col("n_chars"), original_url=X.path_of(F.lit("pages"), F.col("source"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("image_id"), F.col("url").alias("original_url"))
    b = builders.reset_lifecycle(builders.with_defaults(p, {"label": "page", "source_dataset": "crawl", "author": "site"}))
    columns = ["image_id", "label", "source_dataset", "review_status", "reviewer", "split", "author", "width", "original_url"]
    return builders.split_rows(a, b, columns)


@query("""SELECT 'v--' || p_partkey AS view_id, 'v' AS parent_id, CASE WHEN p_partkey % 4 = 0 THEN 'original' ELSE 'crop' END AS kind, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE printf('%.8f', (p_partkey % 40)::DOUBLE) END AS x1, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE printf('%.8f', (p_partkey % 100) / 128.0) END AS confidence, CASE WHEN p_partkey % 3 = 0 THEN 'small|dark' ELSE '' END AS flags, CASE WHEN p_partkey % 3 = 0 THEN 'small+dark' ELSE '' END AS unpacked FROM part""")
def view_table(spark, sf_dir):
    """Rows of derived views: numbers with eight decimals, packed lists, the parent by the view's name."""
    k = F.col("p_partkey")
    box = F.when(k % 4 != 0, F.struct((k % 40).cast("double").alias("x1"), F.lit(1.0).alias("y1"), F.lit(99.5).alias("x2"), F.lit(98.0).alias("y2"), ((k % 100) / 128).alias("confidence")))
    v = table(spark, sf_dir, "part").select(F.concat(F.lit("v--"), k.cast("string")).alias("view_id"), X.parent_id(F.concat(F.lit("v--"), k.cast("string"), F.lit("--1"))).alias("parent_id"), F.when(k % 4 == 0, "original").otherwise("crop").alias("kind"), box.alias("box"), F.when(k % 3 == 0, F.array(F.lit("small"), F.lit("dark"))).alias("flags"))
    return builders.view_rows(v).select("view_id", "parent_id", "kind", "x1", "confidence", "flags", F.array_join(X.split_list(F.col("flags")), "+").alias("unpacked"))


@query("""SELECT doc_id, CASE WHEN quality = 0 THEN 'junk' ELSE lang END AS label, CASE WHEN quality = 0 THEN lang ELSE '' END AS was, CASE WHEN quality = 0 THEN 'moved by review' ELSE '' END AS note, CASE WHEN doc_id % 4 = 3 THEN '' ELSE d.source END AS source_dataset FROM documents d LEFT JOIN labels USING (doc_id)""")
def relabelled_rows(spark, sf_dir):
    """Survivors with the label that a review gave them and the source of their parent, empty where there is none."""
    d = table(spark, sf_dir, "documents")
    changes = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit("junk").alias("label"), F.lit("moved by review").alias("note"))
    rows = builders.relabelled(d.select("doc_id", F.col("lang").alias("label"), F.col("doc_id").alias("parent_id")), changes, "doc_id")
    parents = d.where("doc_id % 4 <> 3").select(F.col("doc_id").alias("parent_id"), F.col("source").alias("source_dataset"))
    return builders.with_parent_source(rows, parents).select("doc_id", "label", "was", "note", "source_dataset")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'https://h.test/l' WHEN doc_id % 3 = 1 THEN 'https://creativecommons.org/publicdomain/mark/1.0/' ELSE '' END AS license, 'model-' || lang AS name, CASE WHEN doc_id % 2 = 0 THEN '/w/' || doc_id || '=x.pt' END AS path, doc_id % 4 = 0 AS safe,
('0x' || substr(sha256('7:' || doc_id), 1, 16))::UBIGINT::VARCHAR AS seed, strftime(to_timestamp(doc_id * 3600), '%Y-%m-%dT%H:%M:%S+00:00') AS at, concat_ws(',', round_even(n_chars * 0.85::DOUBLE, 0)::BIGINT, round_even(n_chars * 0.10::DOUBLE, 0)::BIGINT, (n_chars - round_even(n_chars * 0.85::DOUBLE, 0) - round_even(n_chars * 0.10::DOUBLE, 0))::BIGINT) AS targets FROM documents""")
def scalar_forms(spark, sf_dir):
    """License addresses, NAME=PATH pairs, safe member names, seeds, times and rounded targets."""
    i, n = F.col("doc_id"), F.col("n_chars").cast("double")
    text = i.cast("string")
    lic = X.canonical_license_url(F.when(i % 3 == 1, "Public domain").otherwise("CC"), F.when(i % 3 == 0, "https://h.test/l").otherwise(F.lit(None).cast("string")))
    name, path = X.split_pair(F.concat(F.lit("model-"), "lang", F.when(i % 2 == 0, F.concat(F.lit(" = /w/"), text, F.lit("=x.pt"))).otherwise("")))
    member = F.when(i % 4 == 0, F.concat(F.lit("a/"), text)).when(i % 4 == 1, F.concat(F.lit("a/../"), text)).when(i % 4 == 2, F.concat(F.lit("/"), text)).otherwise(F.concat(F.lit("C:\\"), text))
    return table(spark, sf_dir, "documents").select("doc_id", lic.alias("license"), name.alias("name"), path.alias("path"), X.safe_member_path(member).alias("safe"), H.seed_number(F.concat(F.lit("7:"), text)).alias("seed"), X.iso_of_nanos(i * 3_600_000_000_000).alias("at"), F.array_join(F.transform(sampling.rounded_shares(n, RATIOS), lambda x: x.cast("string")), ",").alias("targets"))


@query(f"""WITH {P} SELECT vec_id, concat_ws('|', CASE WHEN vec_id % 13 = 0 THEN 'frame_id' END, CASE WHEN vec_id % 11 = 0 THEN 'time_order' END, CASE WHEN vec_id % 7 = 0 THEN 'probability_count' END, CASE WHEN vec_id % 7 = 0 AND vec_id % 5 <> 0 THEN 'probability_sum' END, CASE WHEN vec_id % 5 = 0 AND vec_id % 2 = 0 THEN 'reason' END) AS errors FROM p""")
def observation_checks(spark, sf_dir):
    """Every rule that an observation breaks."""
    i = F.col("vec_id")
    rows = predictions(spark, sf_dir).select("vec_id", F.when(i % 13 == 0, -1).otherwise(i).alias("frame_id"), F.lit(100).alias("captured_at_ns"), F.when(i % 11 == 0, 99).otherwise(100).alias("inferred_at_ns"), F.when(i % 7 == 0, F.slice("p", 2, 2)).otherwise(F.col("p")).alias("probabilities"), (i % 5 != 0).alias("valid"), F.when((i % 5 == 0) & (i % 2 == 1), "blur").otherwise(F.lit(None).cast("string")).alias("reason"))
    return rows.select("vec_id", F.array_join(audit.observation_violations(), "|").alias("errors"))


@query("""WITH b AS (SELECT p_partkey, unnest([1, 2, 3]) AS i, p_partkey::DOUBLE AS k, p_size::DOUBLE AS s FROM part), x AS (SELECT p_partkey, i, CASE WHEN i < 3 THEN 20 + s ELSE 10 + s END * CASE WHEN i < 3 THEN 30 + s ELSE 10 + s END AS area, (k % (110 - 10 * i)) / 100 AS conf FROM b),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i) AS r FROM x WHERE conf >= 0.2 AND area >= 900) SELECT p.p_partkey, count(i)::INT AS n, round(max(conf) FILTER (r = 1), 6) AS first FROM part p LEFT JOIN o ON o.p_partkey = p.p_partkey AND r <= 2 GROUP BY 1""")
def kept_boxes(spark, sf_dir):
    """Boxes over the least confidence and area, at most two."""
    from millrace.plans.catalog import _boxes

    kept = B.keep_boxes(F.col("boxes"), 0.2, 900.0, 2)
    return _boxes(spark, sf_dir).select("p_partkey", F.size(kept).alias("n"), _r(F.get(kept, F.lit(0))["confidence"]).alias("first"))


HOMOGRAPHY = [[1.0, 0.1, 5.0], [0.05, 0.9, -2.0], [0.0, 0.001, 1.0]]


@query(f"""WITH {PART_BOXES}, c AS (SELECT p_partkey, unnest([x, x, x + w, x + w]) AS px, unnest([y, y + h, y, y + h]) AS py FROM b), t AS (SELECT p_partkey, (px + 0.1 * py + 5) / (0.001 * py + 1) AS qx, (0.05 * px + 0.9 * py - 2) / (0.001 * py + 1) AS qy FROM c)
SELECT p_partkey, round(greatest(0, min(qx)), 6) AS x1, round(greatest(0, min(qy)), 6) AS y1, round(least(96, max(qx)), 6) AS x2, round(least(96, max(qy)), 6) AS y2 FROM t GROUP BY 1""")
def projected_boxes(spark, sf_dir):
    """The hull of a box's corners under a homography, within the frame."""
    from millrace.plans.catalog import _boxes

    b = B.project_corners(F.get("boxes", F.lit(0)), HOMOGRAPHY, F.lit(96.0), F.lit(96.0))
    return _boxes(spark, sf_dir).select("p_partkey", *[_r(b[c]).alias(c) for c in ("x1", "y1", "x2", "y2")])


MODEL_NAMES = ("pallas", "not_target", "ragdoll", "sphynx", "persian", "singapura")


@query(f"WITH {P} SELECT vec_id, round(p[1], 6) AS ragdoll, round(p[6], 6) AS not_target, 3 AS persian_class, round(list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN -v * ln(v) ELSE 0 END)), 6) AS entropy FROM p")
def canonical_vectors(spark, sf_dir):
    """A model's own class order brought to the fixed labels, one class found by name, and the entropy."""
    back = V.index_mapping(LABELS, MODEL_NAMES)  # where the model's names stand among the labels
    native = predictions(spark, sf_dir).select("vec_id", V.permute(F.col("p"), back).alias("native"))
    p = V.permute(F.col("native"), V.index_mapping(MODEL_NAMES, LABELS))
    n = V.exactly_one(["cat", "dog", "fish", "persian"], "persian")
    return native.select("vec_id", _r(F.get(p, F.lit(0))).alias("ragdoll"), _r(F.get(p, F.lit(5))).alias("not_target"), F.lit(n).alias("persian_class"), _r(V.entropy(p)).alias("entropy"))


@query("""WITH g AS (SELECT vec_id, list_transform(range(72), lambda i: embedding[1 + i % 64]::DOUBLE) AS px FROM embeddings), b AS (SELECT vec_id, list_transform(range(64), lambda i: px[i // 8 * 9 + i % 8 + 1] > px[i // 8 * 9 + i % 8 + 2]) AS b FROM g)
SELECT vec_id, printf('%016x', list_sum(list_transform(range(64), lambda i: CASE WHEN b[i + 1] THEN 1::UBIGINT << (63 - i) ELSE 0::UBIGINT END))::UBIGINT) AS hash FROM b""")
def pixel_hash(spark, sf_dir):
    """Difference hash of 8 rows of 9 gray values."""
    px = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.get(F.col("embedding"), (i % 64).cast("int")).cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", H.difference_hash(px).alias("hash"))


@query("""WITH g AS (SELECT vec_id, list_transform(embedding, lambda v: least(255, greatest(0, v::DOUBLE * 200 + 100))) AS px FROM embeddings), m AS (SELECT vec_id, list_transform(range(64), lambda i: list_avg(px[greatest(i // 8 * 8, i - 2) + 1:i + 1])) AS blur, px FROM g)
SELECT vec_id, round(blur[1], 5) AS b0, round(blur[10], 5) AS b9, round(list_sum(blur), 4) AS total, round(px[1], 5) AS corner, 144 AS framed, round(list_sum(px) + 80 * 7, 4) AS framed_sum, round(CASE WHEN vec_id % 8 <= 1 THEN -1 ELSE px[2] END, 5) AS pasted FROM m""")
def image_arithmetic(spark, sf_dir):
    """Contrast, motion blur, a frame and a pasted panel on 8 by 8 gray images."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", PX.contrast(F.transform("embedding", lambda v: v.cast("double")), 200.0, 100.0).alias("px"))
    blur = PX.motion_blur(F.col("px"), 8, 3)
    framed = PX.framed(F.col("px"), 8, 8, 2, 7.0)
    panel = F.array(*[F.lit(-1.0)] * 4)
    pasted = PX.composite(F.col("px"), 8, panel, 2, 2, F.col("vec_id") % 8, F.lit(0))
    add = lambda a, v: a + v
    return rows.select("vec_id", F.round(F.get(blur, F.lit(0)), 5).alias("b0"), F.round(F.get(blur, F.lit(9)), 5).alias("b9"), F.round(F.aggregate(blur, F.lit(0.0), add), 4).alias("total"), F.round(F.get("px", F.lit(0)), 5).alias("corner"), F.size(framed).alias("framed"), F.round(F.aggregate(framed, F.lit(0.0), add), 4).alias("framed_sum"), F.round(F.get(pasted, F.lit(1)), 5).alias("pasted"))


QUAD = """q AS (SELECT vec_id, embedding AS e, [3.0 + vec_id % 3, 9.0 + vec_id % 2, 8.0, 2.0]::DOUBLE[] AS x, [2.0, 3.0 + vec_id % 2, 9.0, 8.0 - vec_id % 3]::DOUBLE[] AS y FROM embeddings),
d AS (SELECT *, x[2] - x[3] AS dx1, x[4] - x[3] AS dx2, x[1] - x[2] + x[3] - x[4] AS sx, y[2] - y[3] AS dy1, y[4] - y[3] AS dy2, y[1] - y[2] + y[3] - y[4] AS sy FROM q),
g AS (SELECT *, (sx * dy2 - dx2 * sy) / (dx1 * dy2 - dx2 * dy1) AS g, (dx1 * sy - sx * dy1) / (dx1 * dy2 - dx2 * dy1) AS h FROM d),
m AS (SELECT vec_id, e, x, y, (x[2] - x[1] + g * x[2]) / 7 AS a, (x[4] - x[1] + h * x[4]) / 7 AS b, x[1] AS c, (y[2] - y[1] + g * y[2]) / 7 AS d, (y[4] - y[1] + h * y[4]) / 7 AS k, y[1] AS f, g / 7 AS g, h / 7 AS h FROM g),
t AS (SELECT vec_id, e, i % 12 AS tx, i // 12 AS ty, (k - f * h) AS i1, (c * h - b) AS i2, (b * f - c * k) AS i3, (f * g - d) AS i4, (a - c * g) AS i5, (c * d - a * f) AS i6, (d * h - k * g) AS i7, (b * g - a * h) AS i8, (a * k - b * d) AS i9, a, b, c, d, k, f, g, h FROM m, range(144) r(i)),
u AS (SELECT *, (i1 * tx + i2 * ty + i3) / (i7 * tx + i8 * ty + i9) AS px, (i4 * tx + i5 * ty + i6) / (i7 * tx + i8 * ty + i9) AS py FROM t),
c AS (SELECT vec_id, tx, ty, sum(w * greatest(0, least(255, e[((fy + dy) * 8 + fx + dx)::INT + 1]::DOUBLE * 200 + 100))) AS v, sum(w) AS cover FROM (SELECT *, CASE WHEN dx = 1 THEN px - fx ELSE 1 - (px - fx) END * CASE WHEN dy = 1 THEN py - fy ELSE 1 - (py - fy) END AS w
FROM (SELECT vec_id, e, tx, ty, px, py, floor(px) AS fx, floor(py) AS fy, dx, dy FROM u, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) s(dx, dy)) WHERE fx + dx BETWEEN 0 AND 7 AND fy + dy BETWEEN 0 AND 7) GROUP BY ALL),
o AS (SELECT t.vec_id, t.tx, t.ty, coalesce(v * cover, 0) + 50 * (1 - coalesce(cover, 0)) AS v FROM t LEFT JOIN c USING (vec_id, tx, ty))"""


@query(f"WITH {QUAD} SELECT vec_id, round(sum(v), 3) AS total, round(max(v) FILTER (tx = 6 AND ty = 5), 4) AS inner_, round(max(v) FILTER (tx = 0 AND ty = 0), 4) AS outer_, 0.0::DOUBLE AS off FROM o GROUP BY 1")
def panel_perspective(spark, sf_dir):
    """Panels of 8 by 8 laid into backgrounds of 12 by 12 as quads: a solved perspective, its inverse, sampling between pixels, mixed by cover. off: how far corners miss theirs."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", PX.contrast(F.transform("embedding", lambda v: v.cast("double")), 200.0, 100.0).alias("px"))
    k = F.col("vec_id")
    corners = [(3.0 + k % 3, F.lit(2.0)), (9.0 + k % 2, 3.0 + k % 2), (F.lit(8.0), F.lit(9.0)), (F.lit(2.0), 8.0 - k % 3)]
    rows = rows.withColumn("quad", F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in corners]))
    rows = rows.withColumn("m", PX.quad_homography(F.lit(7.0), F.lit(7.0), F.col("quad")))
    put = [PX.mapped(F.col("m"), F.lit(x), F.lit(y)) for x, y in ((0.0, 0.0), (7.0, 0.0), (7.0, 7.0), (0.0, 7.0))]
    off = F.greatest(*[F.abs(p[c] - F.get("quad", F.lit(i))[c]) for i, p in enumerate(put) for c in ("x", "y")])
    ground = F.transform(F.sequence(F.lit(0), F.lit(143)), lambda i: F.lit(50.0))
    out = rows.withColumn("o", PX.panel_composite(ground, 12, F.col("px"), 8, 8, PX.inverse_homography(F.col("m")))).withColumn("off", off)
    return out.select("vec_id", F.round(F.aggregate("o", F.lit(0.0), lambda a, v: a + v), 3).alias("total"), F.round(F.get("o", F.lit(66)), 4).alias("inner_"), F.round(F.get("o", F.lit(0)), 4).alias("outer_"), F.round("off", 9).alias("off"))


@query("""WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: greatest(0, least(255, v::DOUBLE * 200 + 100))) AS px, 4 + vec_id % 9 AS fw, 5 + vec_id % 4 AS fh FROM embeddings), s AS (SELECT *, greatest(1, round_even(8 * least(fw / 8.0, fh / 8.0), 0))::INT AS w FROM p),
t AS (SELECT vec_id, px, w, i, greatest(0, least(7, (i % w + 0.5) * 8 / w - 0.5)) AS x, greatest(0, least(7, (i // w + 0.5) * 8 / w - 0.5)) AS y FROM s, range(64) r(i) WHERE i < w * w),
b AS (SELECT *, floor(x)::INT AS l, floor(y)::INT AS u, x - floor(x) AS a, y - floor(y) AS c FROM t),
v AS (SELECT vec_id, w, i, (1 - a) * (1 - c) * px[u * 8 + l + 1] + a * (1 - c) * px[u * 8 + least(7, l + 1) + 1] + (1 - a) * c * px[least(7, u + 1) * 8 + l + 1] + a * c * px[least(7, u + 1) * 8 + least(7, l + 1) + 1] + ((('0x' || substr(sha256('paper:' || vec_id || ':' || i), 1, 8))::BIGINT / 4294967295.0::DOUBLE) * 2 - 1) * 3 AS v FROM b)
SELECT vec_id, w AS width, w AS height, round(sum(greatest(0, least(255, v))), 3) AS ink FROM v GROUP BY ALL""")
def printed_page(spark, sf_dir):
    """Images fitted into frames of their own size and printed: resampled between pixels, with a paper grain that depends on seed, image and place alone."""
    k = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").select("vec_id", PX.contrast(F.transform("embedding", lambda v: v.cast("double")), 200.0, 100.0).alias("px"), F.least(4 + k % 9, 5 + k % 4).cast("int").alias("frame"))
    side = F.greatest(F.lit(1), F.rint(8 * F.col("frame") / 8).cast("int"))
    rows = rows.withColumn("width", side).withColumn("height", side)
    page = PX.resized_bilinear(F.col("px"), 8, 8, F.col("width"), F.col("height"))
    grain = PX.stable_noise(k, "paper", F.col("width") * F.col("height"), 3.0)
    ink = PX.contrast(F.zip_with(page, grain, lambda a, b: a + b), 1.0, 0.0)
    return rows.select("vec_id", "width", "height", F.round(F.aggregate(ink, F.lit(0.0), lambda a, v: a + v), 3).alias("ink"))


def _reduced(n: int, to: int) -> str:
    """SQL rows (i, j, k): weight k, in units of 2**-22, of value j of n in place i of `to` under the bicubic kernel."""
    return f"""(SELECT i, j, trunc(w / sum(w) OVER (PARTITION BY i) * 4194304 + CASE WHEN w < 0 THEN -0.5 ELSE 0.5 END)::BIGINT AS k FROM (SELECT i, j, CASE WHEN x < 1 THEN (1.5 * x - 2.5) * x * x + 1 WHEN x < 2 THEN ((-0.5 * x + 2.5) * x - 4) * x + 2 ELSE 0 END AS w
FROM (SELECT i, j, abs((j - (i + 0.5) * {n}::DOUBLE / {to} + 0.5) / ({n}::DOUBLE / {to})) AS x FROM range({to}) a(i), range({n}) b(j)
WHERE j >= trunc(greatest(0, (i + 0.5) * {n}::DOUBLE / {to} - 2 * {n}::DOUBLE / {to} + 0.5)) AND j < least({n}, trunc((i + 0.5) * {n}::DOUBLE / {to} + 2 * {n}::DOUBLE / {to} + 0.5)))))"""


GRAY = "greatest(0, least(255, round(e[(y * 18 + x) % 64 + 1]::DOUBLE * 200 + 100)))::BIGINT"


@query(f"""WITH s AS (SELECT vec_id, vec_id % 8 + 1 AS o, x, y, {GRAY} AS v FROM (SELECT vec_id, embedding AS e FROM embeddings), range(18) a(x), range(16) b(y)),
d AS (SELECT vec_id, o >= 5 AS turned, CASE o WHEN 1 THEN x WHEN 2 THEN 17 - x WHEN 3 THEN 17 - x WHEN 4 THEN x WHEN 5 THEN y WHEN 6 THEN 15 - y WHEN 7 THEN 15 - y ELSE y END AS x, CASE o WHEN 1 THEN y WHEN 2 THEN y WHEN 3 THEN 15 - y WHEN 4 THEN 15 - y WHEN 5 THEN x WHEN 6 THEN x WHEN 7 THEN 17 - x ELSE 17 - x END AS y, v FROM s),
wx AS (SELECT false AS turned, * FROM {_reduced(18, 9)} UNION ALL SELECT true, * FROM {_reduced(16, 9)}), wy AS (SELECT false AS turned, * FROM {_reduced(16, 8)} UNION ALL SELECT true, * FROM {_reduced(18, 8)}),
h AS (SELECT vec_id, d.turned, wx.i AS x, d.y, greatest(0, least(255, (sum(v * k) + 2097152) >> 22)) AS v FROM d JOIN wx ON wx.turned = d.turned AND wx.j = d.x GROUP BY 1, 2, 3, 4),
g AS (SELECT vec_id, h.x, wy.i AS y, greatest(0, least(255, (sum(v * k) + 2097152) >> 22)) AS v FROM h JOIN wy ON wy.turned = h.turned AND wy.j = h.y GROUP BY 1, 2, 3),
b AS (SELECT l.vec_id, 63 - (l.y * 8 + l.x) AS bit, l.v > r.v AS on_ FROM g l JOIN g r ON r.vec_id = l.vec_id AND r.y = l.y AND r.x = l.x + 1)
SELECT vec_id, printf('%016x', sum(CASE WHEN on_ THEN 1::UBIGINT << bit ELSE 0::UBIGINT END)::UBIGINT) AS hash FROM b GROUP BY 1""")
def image_file_hash(spark, sf_dir):
    """Difference hashes of whole PNG files: every line filter, eight orientations, bicubic resampling."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")

    def files_of(batches):
        for batch in batches:
            at = np.arange(18 * 16) % 64
            made = [images.encode_png(np.clip(np.rint(np.asarray(e, np.float32)[at].astype(float) * 200 + 100), 0, 255).astype(np.uint8).reshape(16, 18, 1), i % 8 + 1, range(5)) for i, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["vec_id", "content"])

    return images.file_hashes(rows.mapInArrow(files_of, "vec_id long, content binary"), "vec_id", "content").select("vec_id", "hash")


@query("""WITH f AS (SELECT 'c' || c_custkey AS node, n_nationkey, c_custkey FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT node, row_number() OVER (ORDER BY n_nationkey % 7, n_nationkey, c_custkey) AS place, 1 AS depth FROM f QUALIFY place <= 40""")
def limited_walk(spark, sf_dir):
    """The first forty items of a walk through categories, in the order in which a queue finds them."""
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    at = lambda *k: F.struct(*[x.cast("long") for x in k])
    down = n.select(F.lit("root").alias("parent"), at(F.col("n_nationkey") % 7, F.col("n_nationkey")).alias("at"), name("n", "n_nationkey").alias("child"), F.lit(False).alias("leaf"))
    back = n.select(name("n", "n_nationkey").alias("parent"), at(F.lit(-1), F.lit(0)).alias("at"), F.lit("root").alias("child"), F.lit(False).alias("leaf"))
    items = c.select(name("n", "c_nationkey").alias("parent"), at(F.lit(0), F.col("c_custkey")).alias("at"), name("c", "c_custkey").alias("child"), F.lit(True).alias("leaf"))
    return graph.first_reached(down.unionAll(back).unionAll(items), "root", 3, 40)


@query("""WITH l AS (SELECT 'p' || p_partkey AS sample, unnest([1, 2]) AS line_no, p_partkey AS k, p_size FROM part)
SELECT sample, line_no::BIGINT AS line_no, CASE WHEN line_no = 1 THEN (k % 6)::INT ELSE -1 END AS class_id, CASE WHEN line_no = 1 THEN (k % 10) / 10.0 END::DOUBLE AS cx, CASE WHEN line_no = 1 THEN p_size / 100.0 END::DOUBLE AS w, line_no = 1 AND p_size > 0 AS ok FROM l""")
def label_table_function(spark, sf_dir):
    """Label lines parsed by a table function that SQL calls for each sample's partition."""
    k = F.col("p_partkey")
    good = F.format_string("%d %.1f 0.5 %.2f 0.25", (k % 6).cast("int"), (k % 10) / 10, F.col("p_size") / 100)
    texts = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), k.cast("string")).alias("sample"), F.concat(good, F.lit("\n \nbroken line\n")).alias("text"))
    files.register_label_lines(spark)
    return spark.sql("SELECT sample, line_no, coalesce(class_id, -1) AS class_id, cx, w, ok FROM label_lines(TABLE({texts}) PARTITION BY sample)", texts=texts)


# ---------------------------------------------------------------- counts, guards, differences


@query("SELECT source, lang, doc_id % 2 AS variant, n_chars // 4000 AS kind, count(*)::BIGINT AS n FROM documents GROUP BY ALL")
def four_key_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", (F.col("doc_id") % 2).alias("variant"), F.floor(F.col("n_chars") / 4000).alias("kind"))
    return d.groupBy("source", "lang", "variant", "kind").agg(F.count("*").alias("n")).orderBy("source", "lang", "variant", "kind")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS sha, left(sha256(text), 1) AS label FROM documents GROUP BY 2, 3")
def content_survivors(spark, sf_dir):
    """One row of each content; contents that stand under several labels would stop the build (here none can)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")).withColumn("label", F.substring("sha", 1, 1))
    return builders.exact_survivors(rows, "sha", "label", "doc_id").select("doc_id", "sha", "label")


@query("""WITH l AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) AS nth, doc_id::VARCHAR || chr(0) || sha256(text) AS line FROM documents),
a AS (SELECT nth // 1000 AS nth, count(*) AS files, sha256(string_agg(line, chr(10) ORDER BY nth)) AS line FROM l GROUP BY nth // 1000), b AS (SELECT nth // 1000 AS nth, sum(files) AS files, sha256(string_agg(line, chr(10) ORDER BY nth)) AS line FROM a GROUP BY nth // 1000)
SELECT sum(files)::BIGINT AS files, sha256(string_agg(line, chr(10) ORDER BY nth)) AS digest FROM b""")
def whole_snapshot_digest(spark, sf_dir):
    """A digest of the whole table as a tree of digests, a thousand lines or nodes in each."""
    return metrics.tree_digest(table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha")), "doc_id", "sha")


@query("SELECT doc_id AS parent_id FROM documents WHERE doc_id % 10 IN (0, 7)")
def selected_view_rule(spark, sf_dir):
    """Parents without exactly one selected view: those with none and those with two."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"))
    views = d.select("parent_id", (F.col("parent_id") % 10 != 0).alias("selected")).unionAll(d.select("parent_id", (F.col("parent_id") % 10 == 7).alias("selected")))
    return builders.view_violations(views, d).select("parent_id")


@query("""WITH a AS (SELECT source AS split, lang AS label, count(*)::BIGINT AS n FROM documents GROUP BY ALL), b AS (SELECT source AS split, lang AS label, count(*)::BIGINT AS n FROM documents WHERE doc_id % 997 <> 5 GROUP BY ALL)
SELECT *, 'found' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'expected' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def layout_gate(spark, sf_dir):
    """Counts of a layout that differ from those of a report."""
    count = lambda d: d.groupBy(F.col("source").alias("split"), F.col("lang").alias("label")).agg(F.count("*").alias("n"))
    d = table(spark, sf_dir, "documents")
    return builders.layout_differences(count(d), count(d.where("doc_id % 997 <> 5")))


@query(f"WITH RECURSIVE {LINK}, s AS (SELECT label, component, count(*) AS n FROM k JOIN t USING (doc_id) GROUP BY ALL) SELECT label, count(*)::BIGINT AS groups, max(n)::BIGINT AS largest, sum(n)::BIGINT AS rows FROM s GROUP BY 1")
def component_sizes(spark, sf_dir):
    rows = graph.link_components(_links(spark, sf_dir), "doc_id", ["group_token", "content_token"], within="label")
    return metrics.group_sizes(rows, "label", "component")


@query("SELECT lang AS value, 'found' AS side FROM (SELECT DISTINCT lang FROM documents) WHERE lang NOT IN ('en', 'fr', 'it') UNION ALL SELECT 'it', 'expected'")
def label_set_gate(spark, sf_dir):
    """Labels of a table against the labels of a model."""
    found = table(spark, sf_dir, "documents").select(F.col("lang").alias("value"))
    return builders.set_differences(found, spark.createDataFrame([("en",), ("fr",), ("it",)], "value string"), "value")


@query("""SELECT 'unknown_split' AS code, 'archive' AS detail UNION ALL SELECT 'empty_split', 'val_cal' UNION ALL SELECT 'mixed_provenance', 'source' UNION ALL SELECT 'missing_provenance', 'note'""")
def provenance_guard(spark, sf_dir):
    """What stands against a finished split."""
    d = table(spark, sf_dir, "documents")
    split = F.when(F.col("doc_id") % 50 == 0, "archive").when(F.col("doc_id") % 2 == 0, "train").otherwise("val_select")
    rows = d.select(split.alias("split"), "source", F.lit("m1").alias("model"), F.lit("").alias("note"))
    return builders.split_guard(rows, ["train", "val_select", "val_cal"], ["source", "model", "note"])


@query(f"""WITH {P}, f AS (SELECT vec_id, CASE WHEN vec_id % 101 = 0 THEN (pred + 1) % 6 ELSE pred END::INT AS frozen, pred::INT AS now FROM q WHERE vec_id % 211 <> 3) SELECT coalesce(f.vec_id, q.vec_id) AS vec_id, coalesce(f.frozen, -1)::INT AS frozen, CASE WHEN q.vec_id % 307 = 4 THEN -1 ELSE q.pred END::INT AS now FROM q LEFT JOIN f USING (vec_id)
WHERE f.frozen IS DISTINCT FROM CASE WHEN q.vec_id % 307 = 4 THEN NULL ELSE q.pred END AND NOT (f.vec_id IS NULL AND q.vec_id % 307 = 4)""")
def frozen_reproduction(spark, sf_dir):
    """Frozen predictions that a new run does not reproduce, and rows that only one of the two has."""
    p = metrics.predicted(predictions(spark, sf_dir)).select("vec_id", "pred")
    i = F.col("vec_id")
    frozen = p.where(i % 211 != 3).withColumn("pred", F.when(i % 101 == 0, (F.col("pred") + 1) % 6).otherwise(F.col("pred")).cast("int"))
    return metrics.reproduction_differences(frozen, p.where(i % 307 != 4), "vec_id", "pred").na.fill(-1, ["frozen", "now"])


@query("SELECT event_id FROM events WHERE value > 50 AND event_id % 3 = 0 ORDER BY event_id LIMIT 32")
def recovered_head(spark, sf_dir):
    """The first 32 recovered samples of a comparison, as examples for its report."""
    e = table(spark, sf_dir, "events")
    return metrics.head_of(e.where("value > 50 and event_id % 3 = 0").select("event_id"), "event_id")


@query(f"WITH RECURSIVE {SIM}, e AS (SELECT a, b FROM np UNION SELECT b, a FROM np UNION SELECT id, id FROM r), cc AS (SELECT a, b FROM e UNION SELECT cc.a, e.b FROM cc JOIN e ON cc.b = e.a), k AS (SELECT a AS id, min(b) AS root FROM cc GROUP BY 1), m AS (SELECT k.root, count(*) AS n FROM s JOIN r ON s.lang = r.lang AND s.h = r.h JOIN k ON k.id = r.id GROUP BY 1) SELECT (SELECT count(*) FROM r)::BIGINT AS hashes, (SELECT count(*) FROM np)::BIGINT AS edges, (SELECT count(*) FROM m WHERE n > 1)::BIGINT AS clusters, (SELECT coalesce(sum(n), 0) FROM m WHERE n > 1)::BIGINT AS clustered")
def near_edge_counts(spark, sf_dir):
    """How many pairs of hashes are near, and what they cluster."""
    return dedup.near_edges(cut(_hashed(spark, sf_dir)), "doc_id", "simhash", 4, within="lang")


# ---------------------------------------------------------------- samples and builds


@query("""SELECT o_orderkey, ((row_number() OVER (ORDER BY sha256('5:' || o_orderkey), o_orderkey) - 1) % 4)::INT AS slice FROM orders""")
def even_slices(spark, sf_dir):
    """Four slices of nearly equal size, in stable order instead of a shuffle's."""
    return sampling.hash_slices(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 4, 5)


@query("""WITH o AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY sha256('9:' || p_partkey), p_partkey) AS nth, count(*) OVER (PARTITION BY p_brand) AS size FROM part) SELECT p_brand, p_partkey, (floor((greatest(size, 120 - size) - nth) / size::DOUBLE) + 1)::BIGINT AS times FROM o""")
def round_robin_augmentation(spark, sf_dir):
    """How often each parent is augmented until its class is full, once at least."""
    return sampling.augmentation_plan(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey", 120, 9)


@query("""WITH b AS (SELECT 'bg/' || n_name AS path, row_number() OVER (ORDER BY 'bg/' || n_name) - 1 AS slot FROM nation), p AS (SELECT p_partkey::VARCHAR AS item, 'positive' AS kind FROM part UNION ALL SELECT 'blank-' || i, 'blank' FROM range(40) r(i)),
h AS (SELECT *, ('0x' || substr(sha256('3:' || kind || ':' || item), 1, 15))::BIGINT % 25 AS slot FROM p) SELECT item, kind, path AS background FROM h JOIN b USING (slot)""")
def panel_composition(spark, sf_dir):
    """One positive panel for each original and some without, each on a background by stable hash."""
    n, p = table(spark, sf_dir, "nation"), table(spark, sf_dir, "part")
    return builders.panel_plan(p.select(F.col("p_partkey").alias("id")), n.select(F.concat(F.lit("bg/"), "n_name").alias("path")), 40, 3)


_FOLD = "og AS" + ALLOCATE.split("og AS", 1)[1].replace("20260715:", "7:")
_SPLIT = "['train', 'val_select', 'val_cal'][s + 1] AS split"
_ACCEPTED = LINK.replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))").replace("sha256(text)", "sha256(coalesce(text, ''))")


@query(f"WITH RECURSIVE {_ACCEPTED}, gr AS (SELECT label, component AS grp, count(*) AS size FROM k JOIN t USING (doc_id) GROUP BY ALL), {_FOLD} SELECT doc_id AS image_id, t.label, component, {_SPLIT} FROM k JOIN t USING (doc_id) JOIN fold ON fold.label = t.label AND grp = component WHERE nth > 0")
def frozen_split_build(spark, sf_dir):
    """Reviewed documents to a split that cuts no group of a source or of equal contents."""
    d = table(spark, sf_dir, "documents")
    bad = table(spark, sf_dir, "labels").where("quality = 0").select("doc_id", F.lit(True).alias("bad"))
    rows = d.join(bad, "doc_id", "left").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("label"), F.concat("lang", (F.col("doc_id") % 331).cast("string")).alias("source_group_id"), F.lit("").alias("duplicate_cluster_id"), F.concat("lang", F.sha2(F.coalesce("text", F.lit("")), 256)).alias("exact_sha256"), F.when(F.col("bad"), "rejected").otherwise("accepted").alias("decision"))
    rows = cut(rows)
    queue = rows.select(F.col("image_id").alias("row"), "image_id", "decision", F.lit("r1").alias("reviewer"), F.col("decision").alias("second_decision"), F.lit("r2").alias("second_reviewer"))
    out = cut(builders.frozen_split(rows.drop("decision"), queue, second_labels=("es",), floor=1, reject_label="es", reject_floor=1, ratios=RATIOS, seed=7))
    return out.select("image_id", "label", "component", "split")


@query(f"""WITH RECURSIVE x AS (SELECT min(doc_id) AS id, lang, sha256(text) AS sha FROM documents GROUP BY 2, 3), n AS (SELECT sha FROM x GROUP BY 1 HAVING count(*) = 1),
gr AS (SELECT lang AS label, id AS grp, 1 AS size FROM x JOIN n USING (sha)), {_FOLD} SELECT grp AS sample, label, {_SPLIT} FROM fold WHERE nth > 0""")
def provisional_split_build(spark, sf_dir):
    """One row of each content that one label holds, dealt to splits by label."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample"), F.col("lang").alias("label"), F.sha2("text", 256).alias("sha"))
    single = d.groupBy("sha").agg(F.countDistinct("label").alias("n")).where("n = 1").select("sha")
    rows = cut(builders.exact_survivors(cut(d.join(single, "sha", "left_semi")), "sha", "label", "sample"))
    out = builders.split_components(rows.withColumn("group", F.col("sha")), "sample", ["group"], RATIOS, 7)
    return out.select("sample", "label", "split")


@query("""WITH u AS (SELECT 'a' || p_partkey AS sample, 'train' AS split, p_partkey % 4 AS boxes FROM part UNION ALL SELECT 'b' || s_suppkey, 'val', s_suppkey % 3 FROM supplier) SELECT split, count(*)::BIGINT AS images, sum(boxes)::BIGINT AS boxes, count(*) FILTER (boxes > 1)::BIGINT AS multi_box, count(*) FILTER (boxes = 0)::BIGINT AS without FROM u GROUP BY 1""")
def detector_dataset(spark, sf_dir):
    """Two detector sources as one, without repeated samples or names, and its box counts."""
    p, s = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    a = p.select(F.concat(F.lit("a"), F.col("p_partkey").cast("string")).alias("sample"), F.lit("train").alias("split"), (F.col("p_partkey") % 4).alias("box_count"), F.lit("x").alias("only_here"))
    b = s.select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("sample"), F.lit("val").alias("split"), (F.col("s_suppkey") % 3).alias("box_count"))
    both = builders.detector_rows(a.withColumn("name", F.concat("sample", F.lit(".jpg"))), b.withColumn("name", F.concat("sample", F.lit(".jpg"))))
    return builders.box_counts(both, ["split"])


# ---------------------------------------------------------------- models


class ParityRunner:
    """A model for the contract's sake: even numbers are one class, odd ones the other, multiples of 17 break it."""

    def __init__(self, share: float = 0.75):
        self.share, self.ready = share, False

    def load(self) -> None:
        self.ready = True

    def warmup(self) -> None:
        self.infer([2])

    def infer(self, items: list) -> list[list[float]]:
        if not self.ready or any(i % 17 == 0 for i in items):
            raise ArithmeticError("a broken item")
        return [[self.share, 1 - self.share] if i % 2 == 0 else [1 - self.share, self.share] for i in items]

    def health(self) -> dict:
        return {"ready": self.ready}

    def close(self) -> None:
        self.ready = False


def _broken_runner():
    raise FileNotFoundError("no such model")


@query("""SELECT event_id AS item_id, event_id % 17 <> 0 AS valid, CASE WHEN event_id % 17 = 0 THEN 'infer: ArithmeticError' END AS reason, CASE WHEN event_id % 17 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 0.75 ELSE 0.25 END END AS first FROM events""")
def model_observations(spark, sf_dir):
    """Every row through a model that is loaded once for a partition; what breaks it becomes an invalid row."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("event_id").alias("x"))
    out = scoring.score(rows, ParityRunner, "x", batch=1)
    return out.select("item_id", "valid", "reason", F.get("p", F.lit(0)).alias("first"))


@query("""SELECT 'served' AS model, 'ok' AS status, count(*) FILTER (event_id % 17 <> 0)::BIGINT AS n FROM events UNION ALL SELECT 'served', 'infer: ArithmeticError', count(*) FILTER (event_id % 17 = 0)::BIGINT FROM events UNION ALL SELECT 'missing', 'load: FileNotFoundError', count(*)::BIGINT FROM events""")
def model_health(spark, sf_dir):
    """Counters of what models gave and why they failed, taken while the observations are written: nothing is read or scored again."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("item_id"), F.col("event_id").alias("x"))
    factories = {"served": functools.partial(ParityRunner, 0.6), "missing": _broken_runner}
    reasons, found = ("infer: ArithmeticError", "load: FileNotFoundError"), []
    for name, factory in factories.items():
        out, seen = scoring.observed(scoring.score(rows, factory, "x", batch=1), reasons, name)
        out.write.parquet(fresh_path(spark, f"observations-{name}"))
        found += [(name, status, n) for status, n in scoring.health_of(seen.get, reasons)]
    return spark.createDataFrame(found, "model string, status string, n long")
