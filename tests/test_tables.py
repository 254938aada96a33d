import datetime as dt
import json
from urllib.parse import unquote

import pytest

from riskloom.plans import lineage
from riskloom.plans.lineage import clear_scratch, materialise, scratch_path
from riskloom.plans.numbering import running_total
from riskloom.plans.pipelines import MARTS, TOPS, write_marts
from riskloom.operators import graph, marts
from riskloom.operators.enrich import enrich
from riskloom.sources import corpus, tables, tpch, versions
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def test_month_folders_and_replacement(spark, tmp_path):
    df = spark.createDataFrame(
        [(f"t{i}", dt.datetime(2025, 1 + i % 3, 5)) for i in range(30)], "transaction_id string, timestamp timestamp")
    path = str(tmp_path / "out")
    for _ in range(2):
        tables.write_by_month(df, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 30
    assert sorted(p.name for p in (tmp_path / "out").glob("month=*")) == [f"month=2025-0{m}" for m in (1, 2, 3)]


def test_named_tables(spark, tmp_path):
    tables.create_namespace(spark, "riskloom_test")
    tables.create_namespace(spark, "riskloom_test")
    name, path = "riskloom_test.chunks", str(tmp_path / "chunks")
    tables.create_table(spark, name, tables.CHUNK_SCHEMA, path)
    assert spark.table(name).count() == 0 and spark.table(name).columns == ["chunk_id", "content", "filename"]
    tables.replace_table(spark.createDataFrame([("c", "x", "f")], tables.CHUNK_SCHEMA), name, path)
    assert [tuple(r) for r in spark.table(name).collect()] == [("c", "x", "f")]
    spark.sql(f"DROP TABLE {name}")
    spark.sql("DROP DATABASE riskloom_test")


def test_named_table_is_replaced_from_itself_and_keeps_its_rows_on_failure(spark, tmp_path):
    name, path = "kept_numbers", str(tmp_path / "numbers")
    tables.replace_table(spark.range(10), name, path)
    held = spark.table(name)
    tables.replace_table(spark.table(name).where("id > 6"), name, path)
    assert sorted(r["id"] for r in spark.table(name).collect()) == [7, 8, 9]
    assert held.count() in (3, 10)  # old files are still there for whoever reads them
    with pytest.raises(Exception, match="refused"):
        tables.replace_table(spark.range(5).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("refused"))).alias("id")), name, path)
    assert spark.table(name).count() == 3
    tables.replace_table(spark.range(2).select(F.col("id").cast("string").alias("other")), name, path)
    assert [r["other"] for r in spark.table(name).collect()] == ["0", "1"]
    spark.sql(f"DROP TABLE {name}")


def test_tables_switch_together(spark, tmp_path):
    folder = str(tmp_path / "set")
    assert versions.manifest(spark, folder) == {}
    report = versions.write_tables({"a": spark.range(5), "b": spark.range(0)}, folder).collect()
    assert [tuple(r) for r in report] == [("a", 5, "id"), ("b", 0, "id")]
    first = versions.read_tables(spark, folder)
    versions.write_tables({"a": first["a"].where("id > 1"), "c": spark.range(3)}, folder)
    now = {n: df.count() for n, df in versions.read_tables(spark, folder).items()}
    assert now == {"a": 3, "b": 0, "c": 3} and first["a"].count() == 5
    broken = spark.range(5).select(F.when(F.col("id") >= 0, F.raise_error(F.lit("refused"))).alias("x"))
    with pytest.raises(Exception, match="refused"):
        versions.write_tables({"a": spark.range(1), "c": broken}, folder)
    assert {n: df.count() for n, df in versions.read_tables(spark, folder).items()} == now
    with pytest.raises(KeyError):
        versions.read_tables(spark, folder, "missing")
    assert versions.drop_old(spark, folder) == 1  # the failed write; a and b of the first write are in one folder that is in use
    assert {n: df.count() for n, df in versions.read_tables(spark, folder).items()} == now


def test_records_keep_nulls(spark):
    df = spark.createDataFrame([(1, dt.datetime(2025, 6, 5, 9, 7), None)], "a int, t timestamp, s string")
    assert json.loads(tables.records(df).first()[0]) == {"a": 1, "t": "2025-06-05 09:07:00", "s": None}


def test_corpus_keeps_line_ends_and_paths(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "a.txt").write_bytes("é\r\n\n two\n".encode())
    (tmp_path / "x" / "a.txt").write_text("three")
    (tmp_path / "b.md").write_text("no")
    rows = corpus.read_text_corpus(spark, str(tmp_path)).collect()
    assert sorted((r["filename"], r["content"]) for r in rows) == [("a.txt", "three"), ("a.txt", "é\r\n\n two\n")]
    assert len({r["path"] for r in rows}) == 2


def test_written_corpus_is_read_back(spark, tmp_path):
    """A file per name, in few folders whatever the number of texts; rows of one name in a task share its file."""
    texts = [(f"n{i}", f"text {i}\n\né") for i in range(300)] + [("a/b c%", ""), (None, "x"), ("", None), ("n7", "again")]
    frame = spark.createDataFrame(texts, "name string, content string").coalesce(1)
    assert corpus.write_text_corpus(frame, str(tmp_path / "texts"), 8) == 302
    rows = corpus.read_text_corpus(spark, str(tmp_path / "texts")).collect()
    assert len(list((tmp_path / "texts").iterdir())) <= 8 and len({r["path"] for r in rows}) == len(rows) == 302
    found = {unquote(unquote(r["filename"])).removeprefix("doc=").rsplit(".", 2)[0]: r["content"] for r in rows}
    assert found["n8"] == "text 8\n\né\n" and found["a/b c%"] == "\n"
    assert sorted(found["n7"].splitlines()) == sorted(["again", "text 7", "", "é"])
    assert sorted(found["__HIVE_DEFAULT_PARTITION__"].split("\n")) == ["", "", "x"]
    assert corpus.write_text_corpus(frame.limit(0), str(tmp_path / "none")) == 0
    assert corpus.read_text_corpus(spark, str(tmp_path / "none")).count() == 0


def test_corpus_is_listed_by_tasks(spark, tmp_path):
    """As Spark's own reader, but the driver holds no list of the files."""
    names = ["plain", "a b", "100%", "x%20y", "é ü", "日本", "a#b", "q?r", "e+f;g,h@i=j&k", "(p)!~*'$", "[r]{s}", 'u"v<w>|^`', "n\u00a0m", "_hidden",
             "_kept=1", ".dot"]
    for at in (".", "deep/er", "sp ace/é%", "_skipped", "_in=1", ".git"):
        (tmp_path / at).mkdir(parents=True, exist_ok=True)
        for i, name in enumerate(names):
            (tmp_path / at / f"{name}.txt").write_bytes(f"\ufeff{at}\r\n{name}\n".encode() if i else b"\xff\x00bytes")
        (tmp_path / at / "empty.txt").write_text("")
        (tmp_path / at / "other.md").write_text("no")
    for i in range(300):
        (tmp_path / f"n{i}.txt").write_text(f"{i}")
    for folder in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/", f"{tmp_path}/sp ace"):
        whole = spark.read.text(folder, wholetext=True, pathGlobFilter="*.txt", recursiveFileLookup=True).select(
            "_metadata.file_path", "_metadata.file_name", F.col("value").cast("binary"))
        read = corpus.read_text_corpus(spark, folder)
        assert sorted(map(tuple, read.withColumn("content", F.col("content").cast("binary")).collect())) == sorted(map(tuple, whole.collect()))
        assert read.columns == ["path", "filename", "content"] and len(read.inputFiles()) < 20
    assert corpus.read_text_corpus(spark, f"{tmp_path}/d*").count() == 14
    with pytest.raises(AnalysisException):
        corpus.read_text_corpus(spark, f"{tmp_path}/none").count()


def test_running_total_is_exact(spark):
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("k")).repartition(7)
    rows = running_total(df, [F.desc("k")], F.col("k"), "before").collect()
    total, expected = 0, {}
    for k in range(4999, -1, -1):
        expected[k] = total
        total += k
    assert {r["k"]: r["before"] for r in rows} == expected


def test_written_marts_equal_their_builders(spark, tmp_path):
    enriched = enrich(tpch.transactions(spark, SMALL), tpch.account_rows(spark, SMALL)).cache()
    write_marts(enriched, str(tmp_path))
    builders = {"metrics": marts.kpi_summary, "risk_by_channel": marts.risk_by_channel,
                "temporal_risk": marts.monthly_trend, "geographical_risk": marts.country_risk,
                "risk_distribution": marts.risk_distribution, "critical_events": marts.critical_events,
                "graph_pull": lambda e: graph.graph_pull(e).drop("volatility_index")}
    assert list(builders) == MARTS
    for name, build in builders.items():
        written = versions.read_tables(spark, str(tmp_path))[name]
        wanted = build(enriched)
        assert written.columns == wanted.columns
        assert sorted(map(str, written.collect())) == sorted(map(str, wanted.collect())), name


def test_ledger_ranks_every_row(spark):
    enriched = enrich(tpch.transactions(spark, SMALL), tpch.account_rows(spark, SMALL))
    rows = marts.critical_ledger(enriched).select("rank", "transaction_id").collect()
    wanted = [r["transaction_id"] for r in marts.riskiest(enriched, None).collect()]
    assert [r["transaction_id"] for r in sorted(rows)] == wanted
    assert sorted(r["rank"] for r in rows) == list(range(1, len(wanted) + 1))


def test_scratch_is_cleared(spark):
    stored = materialise(spark.range(5), "five")
    assert stored.count() == 5 and scratch_path(spark, "x").startswith(lineage.shared_folder(spark))
    clear_scratch(spark)
    with pytest.raises(Exception, match="(?i)not.*(exist|found)"):
        stored.collect()


def test_all_marts_are_written(spark, tmp_path):
    enriched = enrich(tpch.transactions(spark, SMALL), tpch.account_rows(spark, SMALL))
    report = {r["mart"]: r["num_rows"] for r in write_marts(enriched.cache(), str(tmp_path)).collect()}
    assert list(report) == MARTS and report["metrics"] == 1 and report["graph_pull"] == 300


def test_top_marts_keep_their_rows_only(spark):
    """A task keeps the rows of the mart, and does not sort all of its own."""
    for build in TOPS.values():
        plan = build(materialise(enrich(tpch.transactions(spark, SMALL)), "enriched"))._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrderedAndProject" in plan and "Window" not in plan and "Sort " not in plan


def test_ranks_need_no_second_shuffle(spark):
    """Ranked rows are stored sorted; only a row per range is exchanged after that, and only columns that are shown are sorted."""
    enriched = materialise(enrich(tpch.transactions(spark, SMALL)), "enriched")
    ledger = marts.critical_ledger(enriched.unionByName(enriched))
    assert sorted(r["rank"] for r in ledger.select("rank").collect()) == list(range(1, 2 * enriched.count() + 1))
    stored = spark.read.parquet(*ledger.inputFiles())
    assert set(stored.columns) == {"transaction_id", "timestamp", "amount", "transaction_type", "country", "risk_score", "_at"}
    plan = ledger._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 1 and "risk_score" not in windows[0]
    assert marts.critical_ledger(enriched.limit(0)).count() == 0


def test_months_are_added_behind_the_shuffle(spark, tmp_path, monkeypatch):
    seen, write = [], tables.write_files
    monkeypatch.setattr(tables, "write_files", lambda df, *rest: seen.append(df) or write(df, *rest))
    rows = spark.sql("SELECT string(id) transaction_id, timestamp_seconds(id * 1000000) timestamp FROM range(40)")
    tables.write_by_month(rows, str(tmp_path / "months"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("yyyy-MM") < plan.index("RepartitionByExpression")
    back = spark.read.parquet(str(tmp_path / "months"))
    assert back.count() == 40 and back.where("month <> date_format(timestamp, 'yyyy-MM')").count() == 0
