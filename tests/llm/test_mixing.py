from pyspark.sql import functions as F

from tokenweave.llm.mixing import TOKENIZER, mix, rates, reached, with_tokens


def counted(spark):
    rows = [(i, "hot" if i % 3 else "small" if i % 2 else None, 50 + i % 100) for i in range(6000)] + [(9001, "unlisted", 1000), (9002, "hot", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_shares_caps_and_repeats(spark):
    df = counted(spark)
    targets = spark.createDataFrame([("hot", 0.5, 2), ("small", 0.4, 2), ("none", 0.1, None)], "source string, target_share double, max_repeats int")
    rated = rates(df, targets)
    by = {r.source: r for r in rated.collect()}
    assert by["none"].rate == 0 and by["small"].rate == 2.0 and 0 < by["hot"].rate < 1
    out = mix(df, rated)
    again = mix(df.repartition(7), rated)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    uses = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy").alias("c"))
    assert uses.where("n > 2 or n <> c").count() == 0
    assert out.where("source is null or source = 'unlisted'").count() == 0
    final = {r.source: r for r in reached(out, rated).collect()}
    assert abs(final["hot"].actual_share - 0.5) < 0.02 and final["none"].used_tokens == 0
    assert final["small"].used_documents == by["small"].documents and abs(sum(r.mix_share for r in final.values()) - 1) < 1e-9


def test_tokens_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["A small text.", "", None, "naïve Ünïcode 42", "<|endoftext|>", "word " * 20000, " " * 200_000, "a" + "\n" * 30_000 + " b", "it's  we'll \t\n x\u00a0\u3000y", "😀" * 300, "a" * 50_000]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, __text string")
    t = Tokenizer.from_file(TOKENIZER)
    t.encode_special_tokens = True
    got = {r.doc_id: r.tokens for r in with_tokens(df, "text").collect()}
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in enumerate(texts)}


def test_empty(spark):
    df = counted(spark).limit(0)
    targets = spark.createDataFrame([("hot", 1.0, 2)], "source string, target_share double, max_repeats int")
    rated = rates(df, targets)
    assert mix(df, rated).count() == 0
    row = reached(mix(df, rated), rated).first()
    assert (row.rate, row.actual_share, row.mix_share) == (0, 0, 0)
    assert rates(counted(spark), targets.limit(0)).count() == 0


def test_a_tokenizer_without_ranks(spark, tmp_path):
    import shutil

    alone = shutil.copy(TOKENIZER, tmp_path / "alone.json")
    df = spark.createDataFrame([(1, "A small text."), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, with_tokens(df, "text", str(alone)).collect())) == sorted(map(tuple, with_tokens(df, "text").collect())) == [(1, 4), (2, 0)]
