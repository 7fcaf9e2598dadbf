"""SC1-SC24: tables written to a store and read back, snapshots, and the sources of benchmark items."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from packmill.functions import governance as G
from packmill.operators import evaluate as E
from packmill.plans.engine import Engine
from packmill.queries.base import BENCH, EDGES, MCELLS, bench_rows, pack_cells, pack_edges, query, table, turns
from packmill.sources import datasets, store as ST
from packmill.sources.shared import hadoop, new_dir


def filled(spark, d) -> ST.Store:
    """A store of the packs, their layers and texts; packs whose number is a multiple of 3 are deleted."""
    s = ST.Store(spark, new_dir(spark, "store"))
    c = pack_cells(spark, d)
    g = G.written((F.col("pack_id") * 37 % 61 + 20).cast("double"))
    s.append("packs", c.select("pack_id", "owner", g["importance"].alias("importance"), g["tier"].alias("tier")))
    s.append("layers", c.select("pack_id", F.posexplode("tokens").alias("layer_idx", "data")))
    t = table(spark, d, "documents").filter("text is not null").select(F.col("doc_id").alias("pack_id"), "text", F.lit(0).alias("seq"))
    s.append("texts", t)
    s.append("texts", t.filter("pack_id % 2 = 0").select("pack_id", F.concat(F.lit("again "), "text").alias("text"), F.lit(1).alias("seq")))
    s.append("deletions", c.filter("pack_id % 3 = 0").select("pack_id", F.lit(0).alias("seq")))
    return s


@query("SC1_SC6_append_and_scan", f"WITH {MCELLS} SELECT cell_id + 1 AS pack_id, owner FROM mcells")
def append(spark, d):
    return filled(spark, d).read("packs").select("pack_id", "owner")


@query("SC3_point_read", f"WITH {MCELLS} SELECT generate_subscripts(tokens, 1) - 1 AS layer_idx, round(unnest(tokens)[1], 6) + 0.0::DOUBLE AS first FROM mcells WHERE cell_id = 6")
def point(spark, d):
    got = filled(spark, d).read("layers").filter("pack_id = 7")
    return got.select(F.col("layer_idx").cast("long").alias("layer_idx"), F.round(F.element_at("data", 1), 6).alias("first"))


@query("SC4_SC5_files", f"WITH {MCELLS} SELECT count(*) AS n, count(*) FILTER ((cell_id + 1) % 3 <> 0) AS live FROM mcells")
def files(spark, d):
    return filled(spark, d).files("packs").agg(F.sum("rows").alias("n"), F.sum("live").alias("live"))


@query("SC9_compaction", f"WITH {MCELLS} SELECT cell_id + 1 AS pack_id, generate_subscripts(tokens, 1) - 1 AS layer_idx FROM mcells WHERE (cell_id + 1) % 3 <> 0")
def compaction(spark, d):
    s = filled(spark, d)
    s.compact("layers", 0.99)
    return s.read("layers").select("pack_id", F.col("layer_idx").cast("long").alias("layer_idx"))


@query("SC10_latest_texts", "SELECT doc_id AS pack_id, CASE WHEN doc_id % 2 = 0 THEN 'again ' || text ELSE text END AS text FROM documents WHERE doc_id % 3 <> 0 AND text IS NOT NULL UNION ALL SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'again ' || text ELSE text END FROM documents WHERE doc_id % 3 = 0 AND text IS NOT NULL AND doc_id NOT IN (SELECT vec_id // 5 + 1 FROM embeddings)")
def latest_texts(spark, d):
    return filled(spark, d).texts()


@query("SC11_deletion_log", f"WITH {MCELLS} SELECT cell_id + 1 AS pack_id, owner FROM mcells WHERE (cell_id + 1) % 3 <> 0")
def deletion_log(spark, d):
    return filled(spark, d).live("packs").select("pack_id", "owner")


@query("SC12_W13_synapses", "SELECT vec_id AS id, label::BIGINT AS owner, 2 AS rank FROM embeddings WHERE label = 4")
def synapses(spark, d):
    s = ST.Store(spark, new_dir(spark, "store"))
    e = table(spark, d, "embeddings")
    s.append("synapses", e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("owner"), F.slice("embedding", 1, 8).alias("lora_a"), F.slice("embedding", 9, 8).alias("lora_b"), F.lit(0.5).alias("scale"), F.lit(2).alias("rank"), F.lit(4).alias("d_model")))
    return s.read("synapses").filter("owner = 4").select("id", "owner", "rank")


@query("SC16_SC19_snapshot_restore", f"WITH {MCELLS} SELECT count(*) FILTER ((cell_id + 1) % 3 <> 0) AS packs, count(DISTINCT owner) FILTER ((cell_id + 1) % 3 <> 0) AS owners, 1 AS seq FROM mcells")
def snapshot(spark, d):
    s = filled(spark, d)
    points = ST.Checkpoints(spark, new_dir(spark, "checkpoints"))
    points.save(s, "daily")
    _, seq, _ = points.save(s, "daily")
    restored = points.restore_latest("daily", new_dir(spark, "restored"))
    return restored.live("packs").agg(F.count("*").alias("packs"), F.countDistinct("owner").alias("owners")).withColumn("seq", F.lit(seq))


@query("SC20_jsonl_items", "SELECT 'q' || item_id AS id, 'bench' AS dataset, 'unknown' AS category, text AS question FROM benchmark")
def jsonl(spark, d):
    path = new_dir(spark, "jsonl")
    b = table(spark, d, "benchmark")
    b.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("id"), F.lit("bench").alias("dataset"), F.lit("").alias("context"), F.col("text").alias("question"), F.lit("").alias("ground_truth")).write.json(path)
    return datasets.jsonl(spark, path).select("id", "dataset", "category", "question")


@query("SC21_conversation_items")
def conversation_items(spark, d):
    """Each conversation is a sample of one session; every user turn asks for the turn after it."""
    t = turns(spark, d).filter("text is not null")
    dia = F.concat(F.lit("D1:"), F.col("turn").cast("string"))
    one = t.groupBy(F.col("conv_id").cast("string").alias("sample_id")).agg(
        F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), dia.alias("dia_id"), "text"))).alias("ts"),
    )
    sessions = F.array(F.struct(F.lit(1).alias("session"), F.lit("1 May").alias("date"), F.transform("ts", lambda x: F.struct(x["speaker"].alias("speaker"), x["dia_id"].alias("dia_id"), x["text"].alias("text"))).alias("turns")))
    asks = F.filter("ts", lambda x: x["speaker"] == "user")
    qa = F.transform(asks, lambda x: F.struct(x["text"].alias("question"), x["dia_id"].alias("answer"), F.lit(4).alias("category"), F.array(F.concat(F.lit("D1:"), (x["turn"] + 1).cast("string"))).alias("evidence")))
    return datasets.conversations_qa(one.select("sample_id", sessions.alias("sessions"), qa.alias("qa"))).select("id", "category", "context", "question", "ground_truth")


@query("SC22_haystack_items")
def haystack_items(spark, d):
    """Three conversations are the haystack of a question; the middle one answers it."""
    t = turns(spark, d).filter("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("ts"))
    c = t.select((F.expr("conv_id div 3")).alias("q"), "conv_id", F.transform("ts", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("turns"))
    e = c.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("conv_id", "turns"))).alias("cs"))
    ids = F.transform("cs", lambda x: x["conv_id"].cast("string"))
    entry = e.select(F.col("q").cast("string").alias("question_id"), F.lit("what?").alias("question"), F.lit("that").alias("answer"), F.lit("single").alias("question_type"), ids.alias("haystack_session_ids"), F.filter(ids, lambda i: F.pmod(i.cast("long"), F.lit(3)) == 1).alias("answer_session_ids"), F.transform("cs", lambda x: x["turns"]).alias("haystack_sessions"))
    return datasets.haystack_qa(entry).select("id", "category", F.md5(F.col("context").cast("binary")).alias("context_md5"), F.size("gold_evidence").cast("long").alias("n_gold"))


@query("SC23_text_files", "SELECT 'item-' || item_id || '.txt' AS document_id, text FROM benchmark")
def text_files(spark, d):
    folder = new_dir(spark, "texts")
    for r in table(spark, d, "benchmark").collect():  # a fixture of few small files
        fs, p = hadoop(spark, f"{folder}/item-{r['item_id']}.txt")
        out = fs.create(p)
        out.write(bytearray(r["text"].encode()))
        out.close()
    return datasets.text_files(spark, folder)


@query("SC24_run_report", f"WITH {BENCH} SELECT system, count(*) AS n FROM rows_ GROUP BY system")
def run_report(spark, d):
    """A run's aggregates as JSON, read back."""
    path = new_dir(spark, "report")
    E.run_aggregates(bench_rows(spark, d)).withColumn("n", F.col("ok") + F.col("skipped") + F.col("failed")).write.json(path)
    return spark.read.schema("system string, n bigint").json(path)


@query("SC2_batch_append", f"WITH {MCELLS} SELECT count(*) AS layers, count(DISTINCT cell_id) AS packs, 1 AS commits FROM (SELECT cell_id, unnest(tokens) FROM mcells)")
def batch_append(spark, d):
    """All layers of all packs in one commit."""
    s = ST.Store(spark, new_dir(spark, "store"))
    s.append("layers", pack_cells(spark, d).select("pack_id", F.posexplode("tokens").alias("layer_idx", "data")))
    fs, folder = hadoop(spark, s.table_path("layers"))
    commits = sum(f.getPath().getName() == "_SUCCESS" for f in fs.listStatus(folder))
    return s.read("layers").agg(F.count("*").alias("layers"), F.count_distinct("pack_id").alias("packs")).withColumn("commits", F.lit(commits))


@query("SC7_rollover", f"WITH {MCELLS} SELECT count(*) AS rows, true AS bounded FROM mcells")
def rollover(spark, d):
    """Files end at a number of bytes; no file holds more than that and one row group besides."""
    s = ST.Store(spark, new_dir(spark, "store"))
    s.append("packs", pack_cells(spark, d).select("pack_id", "owner"), bytes_of=1000)
    fs, folder = hadoop(spark, s.table_path("packs"))
    sizes = [f.getLen() for f in fs.listStatus(folder) if f.getPath().getName().endswith(".parquet")]
    return s.read("packs").agg(F.count("*").alias("rows")).withColumn("bounded", F.lit(len(sizes) > 1 and max(sizes) < 16_000))


@query("SC8_refresh", f"WITH {MCELLS} SELECT cell_id + 1 AS pack_id FROM mcells")
def refresh(spark, d):
    """What another writer appends is seen by a store that was opened before."""
    path = new_dir(spark, "store")
    reader, writer = ST.Store(spark, path), ST.Store(spark, path)
    c = pack_cells(spark, d)
    writer.append("packs", c.filter("pack_id % 2 = 0"))
    reader.read("packs").count()
    writer.append("packs", c.filter("pack_id % 2 = 1"))
    return reader.read("packs").select("pack_id")


@query("SC13_edge_log", f"WITH {EDGES} SELECT DISTINCT src, dst, edge_type FROM edges")
def edge_log(spark, d):
    """Edges are appended twice, replayed as a set and checkpointed; what is appended after the checkpoint counts too."""
    s = ST.Store(spark, new_dir(spark, "store"))
    e = pack_edges(spark, d)
    s.append("edges", e)
    s.append("edges", e.filter("src % 2 = 0"))
    s.checkpoint_edges()
    s.append("edges", e.filter("src % 3 = 0"))
    return s.edges().select("src", "dst", "edge_type")


@query("SC15_schedule_file", "SELECT i AS id, 1000 - 10 * i AS fires_at, 'evict_draft' AS action FROM range(1, 6) t(i) WHERE i <> 3")
def schedule_file(spark, d):
    """A schedule written, cancelled in part and read back by another engine."""
    path = new_dir(spark, "store")
    e = Engine(spark, path)
    for i in range(1, 6):
        e.schedule_evict_drafts(1000 - 10 * i)
    e.cancel_scheduled(3)
    return Engine(spark, path).list_scheduled().select("id", "fires_at", "action")


@query("SC17_restore_refusals", "SELECT * FROM (VALUES ('another version', 'ValueError'), ('damaged manifest', 'ValueError'), ('exists', 'FileExistsError'), ('lost file', 'ValueError'), ('nothing there', 'FileNotFoundError'), ('other codec', 'ValueError'), ('other magic', 'ValueError'), ('sound', 'none')) t(what, error)")
def refusals(spark, d):
    """Each way in which a snapshot is not one, and the error it meets."""
    s = ST.Store(spark, new_dir(spark, "store"))
    s.append("packs", pack_cells(spark, d).select("pack_id", "owner"))
    out = new_dir(spark, "snapshot")
    good = ST.snapshot(s, out)

    def manifest(text: str) -> None:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/manifest.json")

    def tried(into=None, path=out) -> str:
        try:
            ST.restore(spark, path, into or new_dir(spark, "restored"))
            return "none"
        except (ValueError, FileNotFoundError, FileExistsError) as e:
            return type(e).__name__

    rows = [("sound", tried()), ("exists", tried(s.path)), ("nothing there", tried(path=new_dir(spark, "empty")))]
    for what, change in (("other magic", {"magic": "X"}), ("another version", {"format_version": 99}), ("other codec", {"codecs": {"table": "x"}}), ("lost file", {"sha256": "0"})):
        manifest(json.dumps(good | change))
        rows.append((what, tried()))
    manifest("{not json")
    rows.append(("damaged manifest", tried()))
    return spark.createDataFrame(rows, "what string, error string")


@query("SC18_manifest", f"WITH {MCELLS} SELECT count(*) AS packs, count(DISTINCT owner) AS owners, 'parquet' AS codec, 1 AS format_version FROM mcells")
def manifest_only(spark, d):
    s = ST.Store(spark, new_dir(spark, "store"))
    s.append("packs", pack_cells(spark, d).select("pack_id", "owner"))
    out = new_dir(spark, "snapshot")
    ST.snapshot(s, out)
    m = ST.read_manifest(spark, out)
    return spark.createDataFrame([(m["stats"]["pack_count"], m["stats"]["owner_count"], m["codecs"]["table"], m["format_version"])], "packs bigint, owners bigint, codec string, format_version int")
