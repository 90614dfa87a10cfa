import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import block, decide, metrics, validate
from tessera.plans.views import vectors
from tessera.sources import io


def test_worked_f05(spark):
    pairs = spark.createDataFrame([(1, 47), (1, 193), (1, 812), (3, 9)], "qi long, pj long")
    owners = spark.createDataFrame([(47, 1), (812, 1), (9, 7)], "pj long, owner long")
    e = spark.createDataFrame([(1, 2), (2, 0), (3, 0), (4, 1)], "qi long, k int")
    got = {r["qi"]: round(r["f05"], 3) for r in metrics.per_entity(pairs, owners, e).collect()}
    assert got == {1: 0.714, 2: 1.0, 3: 0.0, 4: 0.0}


def test_rules(spark):
    d = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.4), (2, 1, 0.8), (2, 3, 0.1)], "qi long, pj long, p double")
    prep = decide.prepare_rules(d)
    kept = lambda x: sorted((r["qi"], r["pj"]) for r in x.collect())
    assert kept(decide.one_to_one(d)) == [(1, 1), (1, 2), (2, 3)]
    assert kept(prep.where(decide.relative(0.05, 0.5))) == [(1, 1), (2, 3)]
    assert kept(prep.where(decide.top1_plus(0.1, 0.3))) == [(1, 1), (1, 2), (2, 3)]
    assert kept(decide.expected_f(prep)) == [(1, 1)]
    assert {k: len(g) for k, g in decide.GRIDS.items()} == {"threshold": 27, "top1_plus": 64, "relative": 39, "expected_f": 4, "gated": 270}


def test_knn_forms_agree(spark, sf):
    q, p = vectors(spark, sf)
    plain = block.ranked(block.scored_pairs(q, p), "qi", "pj", 10, "fwd_rank")
    for rows in (7, 1000):
        got = block.forward_topk(q, p, 10, rows)
        assert got.exceptAll(plain).isEmpty() and plain.exceptAll(got).isEmpty()


def test_ivf_recall(spark, sf):
    """Most of the true neighbours are found in half of the lists, and nearly all in four fifths."""
    q, p = vectors(spark, sf)
    exact = block.forward_topk(q, p, 10).select("qi", "pj")
    n = exact.count()
    assert block.knn_ivf(q, p, 10, lists=20, probes=10).select("qi", "pj").join(exact, ["qi", "pj"]).count() >= 0.6 * n
    assert block.knn_ivf(q, p, 10, lists=20, probes=16).select("qi", "pj").join(exact, ["qi", "pj"]).count() >= 0.9 * n


def test_files(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t "Acme" \t\tUS\nS1-2\tNA\t1 "x\tIN\n')
    df = io.read_source(spark, str(p))
    assert [tuple(r) for r in df.orderBy("entity_id").collect()] == [("S1-1", '"Acme"', "", "US"), ("S1-2", "NA", '1 "x', "IN")]
    assert io.lost_lines(spark, str(p), df) == 0
    pairs = spark.createDataFrame([("S1-1", "S2-9", 2), ("S1-1", "S3-1", 1)], "s1 string, id string, rank int")
    out = io.write_lists(df, pairs, str(tmp_path / "out"))
    assert sorted(map(tuple, out.collect())) == [("S1-1", "S3-1,S2-9"), ("S1-2", "")]
    lines = spark.read.text(str(tmp_path / "out")).where("value not like 'source1%'")
    found = validate.validate(lines, lines, df.select(F.col("entity_id").alias("id")))
    assert validate.passed(found)


def test_validation_finds(spark):
    lines = spark.createDataFrame([("S1-1\tS2-1,S2-1",), ("S1-1\tS1-2",), ("bad",), ("",), ("S1-3\t",)], "value string")
    ids = spark.createDataFrame([("S1-1",), ("S1-2",)], "id string")
    n = {r["rule"]: r["n"] for r in validate.validate(lines, lines, ids, ids).collect()}
    assert n == {"malformed row": 1, "duplicate row": 1, "repeated id": 1, "self match": 1, "wrong prefix": 0, "missing id": 1, "extra id": 1, "match is no candidate": 0, "unknown id": 1}


def test_stream(spark, sf, tmp_path):
    from tessera.streaming.incremental import resolve_stream

    pool = spark.readStream.schema(spark.read.parquet(f"{sf}/supplier.parquet").schema).parquet(f"{sf}/supplier.parquet/../suppl*.parquet")
    s1 = spark.read.parquet(f"{sf}/nation.parquet")
    match = lambda s1, new: new.join(s1, new["s_nationkey"] == s1["n_nationkey"]).select("s_suppkey", "n_name")
    resolve_stream(pool, s1, match, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_stores(spark, tmp_path):
    path = str(tmp_path)
    assert io.load_json(spark, f"{path}/none.json", 7) == 7
    io.save_json(spark, {"a": [1, "é"]}, f"{path}/x.json")
    io.save_json(spark, {"a": 2}, f"{path}/x.json")
    assert io.load_json(spark, f"{path}/x.json") == {"a": 2}
    for v in (0.5, float("nan")):
        io.log_result(spark, f"{path}/log", "e", "v", f05=v)
    assert sorted((r["f05"] for r in io.read_log(spark, f"{path}/log").collect()), key=str) == [0.5, None]
    made = []
    make = lambda: made.append(1) or spark.createDataFrame([("name", "क", "ka", 2.0), ("name", "क", "kb", 1.0)], "field string, native string, latin string, score double")
    for _ in range(2):
        words = io.load_table(spark, f"{path}/dictionary", make)
    assert made == [1] and io.dictionary_map(words, "name").first()[0] == {"क": "ka"}
    with io.run_log(spark, f"{path}/run.txt") as log:
        log("began", 1)
    assert io.read_text(spark, f"{path}/run.txt").endswith("began 1\n")
    assert io.find_data_dir(spark, ["/nowhere", path], needs="x.json") == path
    assert "| 2 |" in io.report({"numbers": spark.createDataFrame([(2,)], "n int")})


def test_tsv_by_header(spark, tmp_path):
    p = tmp_path / "s.tsv"
    p.write_text("country\t business_name \tentity_id\tbusiness_address\nUS\tAcme\tS1-1\tx\n")
    assert [tuple(r) for r in io.read_source(spark, str(p)).collect()] == [("S1-1", "Acme", "x", "US")]
    bad = tmp_path / "bad.tsv"
    bad.write_bytes(b"a\tb\n\xff\n")
    files = spark.read.format("binaryFile").load([str(p), str(bad)]).select("path", "content")
    assert tuple(validate.encoding_errors(files).first())[2:] == (1, "bad.tsv")


def test_models_and_split(spark, tmp_path):
    from tessera.operators import prepare, score

    d = spark.createDataFrame([(i, i % 7 / 7, int(i % 7 > 3)) for i in range(200)], "qi long, x double, label int")
    model = score.fit(d, ["x"], kind="logistic")
    io.save_models(spark, {"stage1": model}, {"rule": "threshold"}, str(tmp_path / "models"))
    models, decision = io.load_models(spark, str(tmp_path / "models"))
    assert decision["rule"] == "threshold" and score.predict(models["stage1"], d, ["x"]).exceptAll(score.predict(model, d, ["x"])).isEmpty()
    s = lambda *ids: spark.createDataFrame([(i,) for i in ids], "entity_id string")
    truth = spark.createDataFrame([("a", "x, y"), ("b", "")], "source1_entity_id string, matched_entity_ids string")
    s1, pool = prepare.build_split({"S1": s("a", "b"), "S2": s("x"), "S3": s("y", "z")}, truth, str(tmp_path / "split"))
    assert {r["entity_id"]: r["k"] for r in s1.collect()} == {"a": 2, "b": 0}
    prio = {r["entity_id"]: r["prio"] for r in s1.collect()}
    assert {r["entity_id"]: (r["src"], r["owner"], r["prio"] == prio["a"]) for r in pool.collect()} == {"x": ("S2", "a", True), "y": ("S3", "a", True), "z": ("S3", "", False)}


def test_stage_selection(spark):
    row = lambda f: spark.createDataFrame([("relative", "0.5", f, 0.9), ("threshold", "0.5", f - 0.1, 0.8)], "rule string, params string, f05_tune double, f05 double")
    assert decide.stage(row(0.8), row(0.8)).first()["stage"] == 2 and decide.stage(row(0.8), row(0.7)).first()["stage"] == 1


def counted(spark, d):
    """d with a column x that counts how often rows are made."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def x(i):
        made.add(1)
        return i % 7 / 7

    return d.withColumn("x", x.asNondeterministic()("qi")), made


def test_score_gbt_makes_rows_once(spark, sf, monkeypatch):
    """The features behind a fit are windows and joins over all pairs: they are made once, not for each read of the fit."""
    from tessera import queries

    d, made = counted(spark, spark.createDataFrame([(i, i, int(i % 7 > 3)) for i in range(100)], "qi long, pj long, label int"))
    monkeypatch.setattr(queries, "_labelled", lambda *_: (d, ["x"]))
    got = {r["qi"]: r["p2"] for r in queries.QUERIES["score_gbt"](spark, sf).collect()}
    assert len(got) == 100 and all((p > 0.5) == (i % 7 > 3) for i, p in got.items())
    assert made.value == 100


def test_out_of_fold_makes_rows_once(spark):
    from tessera.operators import score

    d, made = counted(spark, spark.createDataFrame([(i, i % 2, int(i % 7 > 3)) for i in range(100)], "qi long, fold int, label int"))
    got = {r["qi"]: r["p"] for r in score.out_of_fold(d, ["x"], n=2, kind="logistic").collect()}
    assert len(got) == 100 and all(got[i] > got[j] for i in range(4, 100, 7) for j in range(3, 100, 7))
    assert made.value == 100


def test_trigram_search_counts_once(spark, sf, monkeypatch):
    """The records' trigrams are made once however many blocks of queries there are, and blocks find what the relational form finds."""
    from tessera import queries
    from tessera.functions import text as T

    d, made = queries.V.named(spark, sf), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def same(t):
        made.add(1)
        return t

    monkeypatch.setattr(queries.V, "named", lambda *_: d.withColumn("name", same.asNondeterministic()("name")))
    shown = lambda x: sorted(map(tuple, x.select("qi", "fwd_rank", "cos").collect()))
    got = shown(queries.QUERIES["tfidf_trigram_topk"](spark, sf))
    assert made.value == d.count()
    monkeypatch.setattr(block, "HELD", 1)
    monkeypatch.setattr(block, "ROWS", 7)
    assert shown(queries.QUERIES["tfidf_trigram_topk"](spark, sf)) == got
    words = F.array_join(queries.V.words(F.col("name")), " ")
    v = block.sparse_vectors(d.withColumn("terms", T.word_grams(words)), "doc_id", "terms").withColumnRenamed("doc_id", "pj")
    plain = block.sparse_topk(v.where("pj % 20 = 0").withColumnRenamed("pj", "qi"), v, 6)
    found = block.gram_topk(block.gram_counts(d, "doc_id", words), F.col("doc") % 20 == 0, 6)
    assert shown(found) == shown(plain) and len(got) > 0


@pytest.mark.parametrize("dense", [0, 9, 1024])
def test_trigram_search_asks_every_record(spark, tmp_path, monkeypatch, dense):
    """Every row is a query, not every hundredth; terms in lists and pairs of blocks give what all pairs give. Copies, empty and missing texts, no country."""
    import math
    import random
    from collections import Counter, defaultdict

    from tessera import queries

    r = random.Random(1)
    words = ["".join(r.choices("abcd1", k=r.randint(1, 4))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 9))) for _ in range(150)] + ["ab cd ab"] * 9 + ["", None, "é—", "zz9 zz9"]
    docs = [(i + 1, t, (None, "en", "de", "en", "fr")[i % 5], "web", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    tf = {i: Counter(f" {w} "[a : a + 3] for w in re.findall("[a-z0-9]+", t or "") for a in range(len(w))) for i, t, *_ in docs}
    df = Counter(g for c in tf.values() for g in c)
    v = {i: {g: (1 + math.log(n)) * (math.log((1 + len(docs)) / (1 + df[g])) + 1) for g, n in c.items() if df[g] > 1} for i, c in tf.items()}
    v = {i: {g: w / math.sqrt(sum(x * x for x in c.values())) for g, w in c.items()} for i, c in v.items()}
    want, country = defaultdict(list), {i: c for i, _, c, *_ in docs}
    for i in v:
        for j in v:
            if i != j and country[i] is not None and country[i] == country[j] and v[i].keys() & v[j].keys():
                want[i].append((-round(sum(w * v[j].get(g, 0) for g, w in v[i].items()), 6), j))
    monkeypatch.setattr(block, "DENSE", dense)
    monkeypatch.setattr(block, "LISTED", 1e9 if dense else 0)
    monkeypatch.setattr(block, "HELD", 1)
    got = queries.QUERIES["tfidf_trigram_topk"](spark, str(tmp_path)).collect()
    assert len(want) > 100
    assert {(x["qi"], x["fwd_rank"]): x["cos"] for x in got} == {(i, n): pytest.approx(-c, abs=6e-5) for i, x in want.items() for n, (c, _) in enumerate(sorted(x)[:5])}
    top = block.gram_topk(block.gram_counts(queries.V.named(spark, str(tmp_path)), "doc_id", F.array_join(queries.V.words(F.col("name")), " ")), F.lit(True), 6).where("qi <> pj")
    first = {x["qi"]: x["pj"] for x in block.ranked(top.drop("fwd_rank"), "qi", "pj", 1, "fwd_rank").collect()}
    assert first == {i: min(x)[1] for i, x in want.items()}


def pairs_to_score(spark, parts=3):
    rows = [(i, (i * 37 % 101) / 101, None if i % 7 == 0 else float(i % 4), int((i * 37 % 101 > 60) != (i % 4 == 2)), i // 3 % 5) for i in range(3000)]
    return spark.createDataFrame(rows, "qi long, x double, z double, label int, fold int").repartition(parts)


def test_boosted_trees_send_no_rows_to_the_driver(spark):
    """A fit is a few jobs, whatever the rounds, keeps no rows in Spark's storage, and does not depend on how rows lie."""
    from tessera.operators import score

    d, sc = pairs_to_score(spark), spark.sparkContext
    sc.setJobGroup("fit", "fit")
    model = score.fit(d, ["x", "z"])
    sc.setJobGroup("other", "other")
    assert len(sc.statusTracker().getJobIdsForGroup("fit")) < 10
    assert len(model.trees) > 5 and score.fit(pairs_to_score(spark, 1), ["x", "z"]).trees == model.trees
    assert abs(sum(v for _, v in score.importances(model, ["x", "z"])) - 1) < 1e-9


def test_boosted_trees_by_brute_force(spark):
    """The first tree's splits and leaves are those of plain search, and a probability is its trees' sum."""
    import numpy as np

    from tessera.operators import score

    d = pairs_to_score(spark)
    model, t = score.fit(d, ["x", "z"], maxIter=1, maxDepth=2), d.toPandas()
    known, y = t[t.qi % 10 != 0], lambda rows: 2 * rows.label - 1
    columns = {0: known.x, 1: known.z.fillna(-1.0), 2: known.x.isna() * 1.0, 3: known.z.isna() * 1.0}

    def best(at):
        loss = lambda rows: ((y(rows) - y(rows).mean()) ** 2).sum()
        return min(((loss(known[at & (columns[i] <= c)]) + loss(known[at & (columns[i] > c)]), i, c) for i in columns for c in model.thresholds[i] if (at & (columns[i] <= c)).any() and (at & (columns[i] > c)).any()), key=lambda r: r[0])

    (weight, feature, upto, leaves), everything = model.trees[0], known.x > -1
    _, i, cut = best(everything)
    assert weight == 1 and (feature[0], model.thresholds[i][upto[0]]) == (i, cut)
    for side, at in enumerate((columns[i] <= cut, columns[i] > cut)):
        _, j, c = best(at)
        assert (feature[1 + side], model.thresholds[j][upto[1 + side]]) == (j, c)
        assert np.allclose(leaves[2 * side : 2 * side + 2], [y(known[at & (columns[j] <= c)]).mean(), y(known[at & (columns[j] > c)]).mean()], atol=1e-4)
    got = {r["qi"]: r["p"] for r in score.predict(model, d, ["x", "z"]).collect()}
    assert len(got) == 3000 and all(any(abs(p - 1 / (1 + np.exp(-2 * v))) < 1e-9 for v in leaves) for p in got.values())


def test_boosted_trees_of_odd_tables(spark, tmp_path):
    """No rows, one value, one class: a score for each row; and trees come back from a file."""
    from tessera.operators import score

    for rows in ([], [(1, 0.5, 1)], [(i, 0.5, 1) for i in range(30)], [(i, None, i % 2) for i in range(30)]):
        d = spark.createDataFrame(rows, "qi long, x double, label int")
        got = [r["p"] for r in score.predict(score.fit(d, ["x"]), d, ["x"]).collect()]
        assert len(got) == len(rows) and all(0 < p < 1 for p in got)
    d = pairs_to_score(spark)
    model = score.fit(d, ["x", "z"], maxIter=3)
    io.save_models(spark, {"a": model, "b": score.fit(d, ["x"], kind="logistic")}, {}, str(tmp_path / "m"))
    models, _ = io.load_models(spark, str(tmp_path / "m"))
    assert score.predict(models["a"], d, ["x", "z"]).exceptAll(score.predict(model, d, ["x", "z"])).isEmpty()


def test_score_features_deal_pairs_twice(spark, sf):
    from tessera import queries

    plan = queries._labelled(spark, sf)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_partkey") == 1 and plan.count("Exchange hashpartitioning(qi") == 1 and plan.count("Exchange hashpartitioning") <= 3


def test_out_of_fold_is_a_fit_without_the_fold(spark):
    """All folds are fitted in one go, as fits of the other rows would be; rows in none of the folds are trained on only."""
    from tessera.operators import score

    d = pairs_to_score(spark).withColumn("fold", F.when(F.col("qi") % 50 == 3, 9).otherwise(F.col("fold")))
    sc = spark.sparkContext
    sc.setJobGroup("folds", "folds")
    got = {r["qi"]: r["s"] for r in score.out_of_fold(d, ["x", "z"], p="s", keep=["qi"]).collect()}
    sc.setJobGroup("other", "other")
    assert len(sc.statusTracker().getJobIdsForGroup("folds")) < 15 and len(got) == 3000 - 60
    for i in (0, 4):
        alone = score.predict(score.fit(d.where(F.col("fold") != i), ["x", "z"]), d.where(F.col("fold") == i), ["x", "z"], "s").collect()
        assert sum(abs(got[r["qi"]] - r["s"]) for r in alone) / len(alone) < 0.05  # thresholds are of all rows there, of the others here
