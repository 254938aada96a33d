import pytest
from pyspark.sql import functions as F

from riskloom.operators import knowledge, routing
from riskloom.plans.pipelines import ask


def questions(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "query_id string, query string")


def test_routes(spark):
    asked = questions(
        spark, "Which accounts have the highest risk score?", "Why do wire payments fail?",
        "Our accounting listings", "  SHOW ME the money ", "", "Which countries matter?", "Which nations matter?")
    classes = [r["model_class"] for r in routing.route_queries(asked).orderBy("query_id").collect()]
    assert classes == ["flash", "pro", "flash", "flash", "pro", "flash", "pro"]


@pytest.mark.parametrize("query,topic", [
    ("International WIRE and KYC", "wire"), ("how to escalate credit", "kyc"), ("Early warning signs", "credit"),
    ("Anything else", "other"), (None, "other")])
def test_topics(spark, query, topic):
    assert routing.answer_topic(questions(spark, query)).first()["topic"] == topic


def test_badges(spark):
    df = spark.createDataFrame([("Gemini Flash (x)",), ("Gemini Pro (x)",), ("Simulated answer",)], "m string")
    new = [r[0] for r in df.select(routing.label_class(F.col("m"))).collect()]
    old = [r[0] for r in df.select(routing.label_class(F.col("m"), ["Flash"])).collect()]
    assert (new, old) == (["flash", "pro", "flash"], ["flash", "pro", "pro"])


def test_ask(spark):
    chunks = spark.createDataFrame(
        [("c1", "wire transfers cross borders", "wire.txt"), ("c2", "credit falls", "credit.txt")],
        "chunk_id string, content string, filename string")
    embedded = knowledge.embed(chunks)
    asked = questions(spark, "Explain wire transfers", "total volume")
    rows = {r["query_id"]: r for r in ask(asked, embedded, top_k=1, system_text="SYSTEM", closing="END").collect()}
    deep = rows["0"]["prompt"]
    assert deep.startswith("SYSTEM\n\n") and "[Source: wire.txt]\nwire transfers cross borders" in deep
    assert "Source documents used: wire.txt\n\nUser Question: Explain wire transfers" in deep
    assert deep.endswith("wire transfers\n\nEND") and rows["1"]["prompt"] == "SYSTEM\n\nUser Question: total volume"
    assert rows["1"]["context"] is None and rows["1"]["model"].startswith("Gemini Flash")
