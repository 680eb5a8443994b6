import pytest
from pyspark.sql import functions as F

from corpusmill.plans import catalog, corpus, sft, validation


@pytest.fixture(scope="module")
def domains(spark):
    return catalog.domains(spark, 30).cache()


@pytest.fixture(scope="module")
def v1(domains):
    return corpus.corpus(domains, "v1").cache()


@pytest.fixture(scope="module")
def v3(domains):
    return corpus.corpus(domains, "v3").cache()


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_sizes_and_splits(domains, v1, v3):
    assert counts(v1, "split") == {"train": 140, "validation": 30, "test": 30}
    assert set(counts(v1, "category").values()) == {20} and len(counts(v1, "category")) == 10
    assert counts(v3, "split") == {"train": 224, "validation": 48, "test": 48}
    assert counts(v3, "category")["conversational_intent"] == 120
    v4 = corpus.corpus(domains, "v4")
    assert v4.count() == 420 and counts(v4, "split")["test"] == 48


def test_chat_records(v1, v3):
    for scenarios, tasks, splits in ((v1, {"extract": 187, "ask": 136}, {"train": 266, "validation": 57}), (v3, {"extract": 289, "ask": 221}, {"train": 420, "validation": 90})):
        records = sft.chat(scenarios).cache()
        assert counts(records, "metadata.task") == tasks and counts(records, "metadata.split") == splits
    last = sft.split_last(records).first()
    assert [m["role"] for m in last["prompt"]] == ["system", "user"] and [m["role"] for m in last["completion"]] == ["assistant"]


def test_prompt_completion_records(domains, v3):
    records = sft.prompt_completion(v3, domains).cache()
    assert records.count() == 1049
    assert counts(records, "metadata.split") == {"train": 865, "validation": 184}
    assert counts(records, "metadata.variant") == {"reviewed_base": 233, "selected_short": 272, "selected_sentence": 272, "selected_non_answer": 272}
    assert {r["name"]: r["violations"] for r in validation.validate_records(records).collect()} == dict.fromkeys(["no test split", "extraction only", "prompt roles", "completion roles", "grounded evidence", "selected slot", "no exact duplicates", "required slots covered"], 0)
    doubled = records.unionByName(records.limit(3))
    assert {r["violations"] for r in validation.validate_records(doubled).where("name = 'no exact duplicates'").collect()} == {3}


def test_extended_records(spark, domains):
    v4 = corpus.corpus(domains, "v4").cache()
    texts = v4.where("split <> 'test'").select(F.explode("turns.message").alias("message")).distinct()
    cache = texts.limit(5).select("message", F.array(F.concat(F.lit("So: "), "message")).alias("paraphrases"))
    paraphrases = sft.with_paraphrase_cache(texts, cache, 2)
    records = sft.prompt_completion(v4, domains, "v4", paraphrases).cache()
    variants = counts(records, "metadata.variant")
    assert variants["cluster_answer"] == 27 * 5 and variants["selected_roman_urdu"] == 27 * 16 == variants["selected_short"]
    assert variants["selected_multi_slot"] == 27 * 14
    assert {r["violations"] for r in validation.validate_records(records).collect()} == {0}


def test_validation(domains, v1):
    checks = {r["name"]: r["violations"] for r in validation.validate_corpus(v1, 200).collect()}
    assert set(checks.values()) == {0} and len(checks) == 8
    broken = v1.withColumn("split", F.when(F.col("category") == "complete", "test").otherwise(F.col("split")))
    broken = broken.withColumn("must_not_infer", F.array(F.lit("nothing")))
    broken = broken.unionByName(broken.limit(1))
    checks = {r["name"]: r["violations"] for r in validation.validate_corpus(broken, 200).collect()}
    assert checks["size"] == 1 and checks["unique ids"] == 1 and checks["disjoint domains"] == 17 and checks["known forbidden slots"] == 200 + 1


def test_turns(v1):
    correction = v1.where("category = 'correction' and domain_index = 19").first()
    assert [t["message"] for t in correction["turns"]] == ["Forecast demand of region 00 from series_19.csv.", "Correction: use demand of region 19, not demand of region 00."]
    assert correction["turns"][1]["context_slots"] == {"target_description": "demand of region 00"}
    assert [t["gold_extraction"]["correction_detected"] for t in correction["turns"]] == [False, True]
    unclear = v1.where("category = 'ambiguous'").first()["turns"][0]["gold_extraction"]["updates"][-1]
    assert (unclear["status"], unclear["confidence"], unclear["candidate_value"]) == ("ambiguous", 0.55, '"regularly"')
