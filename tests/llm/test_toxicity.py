import random

from pyspark.sql import functions as F

from tideline.llm import queries, toxicity

KIND = "doc_id long, text string, score string, lang string"


def corpus(n=400):
    r = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        text = [f"w{r.randrange(300)}" for _ in range(r.randrange(5, 60))]
        toxic = int(r.random() < .25)
        for _ in range(2 * toxic):
            text.insert(r.randrange(len(text)), r.choice(["Gr0bian", "grobian", "vilek" + r.choice("abcdef"), "you"]))
        if toxic:
            text.append("grobian!")
        rows.append((i, " ".join(text), "x", "y"))
        labels.append((i, toxic))
    return rows, labels


def auc(rows):
    good = sorted((r.score, r.toxic) for r in rows)
    below, wins, pos = 0, 0, 0
    for s, t in good:
        if t:
            wins, pos = wins + below, pos + 1
        else:
            below += 1
    return wins / (pos * below)


def test_held_out_rows_are_ranked(spark):
    rows, labels = corpus()
    docs, marks = spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, toxic int")
    scored = toxicity.toxicity(docs, marks)
    assert scored.columns == ["doc_id", "text", "lang", "held_out", "score", "predicted"]
    both = scored.join(marks, "doc_id").where("held_out").collect()
    assert auc(both) > .95
    assert sum(r.predicted == r.toxic for r in both) / len(both) > .9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= .3) for r in both)


def test_held_out_labels_are_not_read(spark):
    rows, labels = corpus(200)
    docs, marks = spark.createDataFrame(rows, KIND), spark.createDataFrame(labels, "doc_id long, toxic int")
    turned = marks.withColumn("toxic", F.when(toxicity.trainable(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (sorted(toxicity.toxicity(docs, m).select("doc_id", "score").collect()) for m in (marks, turned))
    assert one == two


def test_table_held_out(spark):
    root = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{root}/labels.parquet").select("doc_id", "toxic")
    rows = queries.QUERIES["op7_toxicity"](spark, root).join(labels, "doc_id").where("held_out").collect()
    assert auc(rows) > .95
    assert sum(r.predicted == r.toxic for r in rows) / len(rows) > .97


def test_small_tables(spark):
    docs = spark.createDataFrame([(None, None, "x", "y"), (1, "", "x", "y"), (1, "a", "x", "y")], KIND)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert [(r.score, r.predicted) for r in got] == [(0.0, 0)] * 3
    assert {str(r.doc_id): r.held_out for r in got}["None"] is True
    one = spark.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id long, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.toxicity(docs, one).collect())
    assert toxicity.toxicity(docs.limit(0), one).collect() == []
