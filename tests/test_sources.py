import datetime
import io
import json
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tests.helpers import NOM, facts, rows
from tokenweave.operators import chapters, export, lexicon
from tokenweave.sources import docx, lists, sinks, store, text
from tokenweave.sources.store import FEATURES, RunStore, migrate
from tokenweave.streaming import appearances


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "t string").select(fn(F.col("t")).alias("x")).first().x


def test_clean(spark):
    raw = "α [note\nover lines] β\n\n ΜΕΡΟΣ\nμέρος Α\n  μέρος β\n \nγ"
    assert one(spark, raw, text.clean) == "α  β\n\n ΜΕΡΟΣ\n\nγ"
    assert one(spark, "", text.clean) == "" and one(spark, None, text.clean) is None


def greedy(items, joiner, limit):
    out = []
    for x in items:
        if out and len(out[-1]) + len(joiner) + len(x) <= limit:
            out[-1] += joiner + x
        else:
            out.append(x)
    return out


def pieces(paragraph, limit):
    if len(paragraph) <= limit:
        return [paragraph]
    out, run = [], []
    for s in re.split(r"(?<=[.·;!?])\s+", paragraph):
        if len(s) > limit:
            out += greedy(run, " ", limit) + [s[i : i + limit] for i in range(0, len(s), limit)]
            run = []
        else:
            run.append(s)
    return out + greedy(run, " ", limit)


def test_chunks_against_brute_force(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["word ", "end. ", "στοπ· ", "\n\n", "x" * rng.randrange(60), " "]) for _ in range(rng.randrange(120))) for _ in range(60)] + ["", " \n\n "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", text.chunks(F.col("t"), 50).alias("c")).collect():
        paragraphs = [p.strip() for p in re.split(r"\n\s*\n+", texts[r.i].strip()) if p.strip()]
        expected = greedy([x for p in paragraphs for x in pieces(p, 50)], "\n\n", 50)
        assert r.c == expected and all(len(c) <= 50 for c in r.c)


def test_order_ids_and_titles(spark):
    sections = spark.createDataFrame([("r", "Chapter 10.docx", 0, "Document", "x"), ("r", "Chapter 2.docx", 0, "Alpha Beta!", "y"), ("r", "Chapter 2.docx", 1, "Λόγος", "z"), ("r", "B.docx", 0, "Document", "w"), ("r", "B.docx", 1, "C" * 80, "v")], "run_id string, filename string, section_no int, title string, text string")
    got = rows(text.arrange(sections), "chapter_index", "filename", "chapter_id", "title")
    assert got == [(0, "B.docx", "1-document", "Document"), (1, "B.docx", "2-" + "c" * 62, "C" * 80), (2, "Chapter 2.docx", "3-alpha-beta", "Alpha Beta!"), (3, "Chapter 2.docx", "4-ch-4", "Λόγος"), (4, "Chapter 10.docx", "5-chapter-10", "Chapter 10")]


def test_natural_order_of_digits_of_any_length(spark):
    names = ["a" + "9" * 30, "a1" + "0" * 30, "a10", "A2", "a007", "a!", "a", "a2b", "a2b1"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    key = lambda n: [int(x) if x.isdigit() else x.lower() for x in re.split(r"(\d+)", n)]
    assert [r.n for r in df.orderBy(text.natural_key(F.col("n"))).collect()] == sorted(names, key=key)


def test_docx_to_facts(spark, tmp_path):
    (tmp_path / "A.docx").write_bytes(docx.write_docx([(None, "before"), ("One", "οὐ οὐκ, οὐ.\n\n[note] end"), ("Empty", ""), (" ", "more")]))
    (tmp_path / "Chapter 4.docx").write_bytes(docx.write_docx([(None, "solo text")]))
    (tmp_path / "Void.docx").write_bytes(docx.write_docx([]))
    sections = docx.sections(docx.read_paragraphs(spark, str(tmp_path)))
    assert rows(sections, "filename", "section_no", "title", "text") == [("A.docx", 0, "Document", "before"), ("A.docx", 1, "One", "οὐ οὐκ, οὐ.\n[note] end"), ("A.docx", 2, "Empty", "more"), ("Chapter 4.docx", 0, "Document", "solo text"), ("Void.docx", 0, "Document", "")]
    placed = text.arrange(sections.withColumn("run_id", F.lit("r")))
    cleaned = placed.withColumn("text", text.clean(F.col("text")))
    got = text.locate(text.word_provider(cleaned, {"οὐκ": "οὐ"})).where("chapter_index = 1").orderBy("position").collect()
    assert [(r.lemma, r.form, r.position, r.chapter_title) for r in got] == [("οὐ", "οὐ", 0, "One"), ("οὐ", "οὐκ", 1, "One"), ("οὐ", "οὐ", 2, "One"), ("end", "end", 3, "One")]
    row = chapters.rows(text.locate(text.word_provider(cleaned, {"οὐκ": "οὐ"}))).where("lemma = 'οὐ'").first()
    assert [(f.form, f.occ) for f in row.forms] == [("οὐ", 2), ("οὐκ", 1)]
    other = text.locate(text.provide(cleaned, lambda t, title: [("noun", w, w, "-") for w in t.split()]))
    assert other.count() == 1 + 4 + 1 + 2
    with pytest.raises(Exception):
        (tmp_path / "bad.docx").write_bytes(b"no zip")
        docx.read_paragraphs(spark, str(tmp_path)).count()


def test_heading_levels(spark):
    df = spark.createDataFrame([(s,) for s in ("Heading 1", "heading1", "HEADING 12", "My Heading 1", "Normal", "", None)], "s string")
    assert [r.x for r in df.select(docx.heading_level(F.col("s")).alias("x")).collect()] == [1, 1, 12, None, None, None, None]


def test_json_from_a_model(spark):
    token = '{"type":"noun","lemma":"λόγος","form":"λόγου","parse":"gen. sg."}'
    for raw, n in ((f"```json\n[{token}]\n```", 1), (f"Sure: [{token},{token}] done ]", 2), ("no array", None), (f"[{token}", None), ('[{"type":"noun"}]', None), ("x [] y", 0), (f'[{{"type":"]","lemma":"a","form":"b","parse":"c"}}]', 1)):
        df = spark.createDataFrame([(raw,)], "t string").select(text.json_tokens(text.json_array(F.col("t"))).alias("x"))
        got = df.first().x
        assert (None if got is None else len(got)) == n, raw


def test_lists(spark, tmp_path):
    (tmp_path / "a.csv").write_text('rank,lemma,gloss,kind,ref_count,ref_coverage\n2,λόγος,"a ""word""\nor two",L,5,10.5\n1, καί ,and,F,,\n3,  ,x,L,1,1\n', encoding="utf-8")
    (tmp_path / "al.csv").write_text("variant,lemma,kind,note\nθέλω,ἐθέλω,o,n\n,x,,\n", encoding="utf-8")
    manifest = {"lexicons": [{"id": "b", "name": "B", "entries_file": "missing.csv"}, {"id": "z", "name": "Z", "entries_file": "a.csv"}, {"id": "a", "name": "A", "entries_file": "a.csv", "aliases_file": "al.csv", "reference_tokens": 100, "default": True}, {"name": "no id"}]}
    (tmp_path / "manifest.json").write_text(json.dumps(manifest), encoding="utf-8")
    registry = lists.ListRegistry(spark, str(tmp_path))
    assert [(m.id, m.entry_count) for m in registry.available()] == [("a", 2), ("z", 2)] and registry.default_id() == "a"
    meta, entries, aliases = registry.load()
    assert meta.id == "a" and registry.load("a")[1] is entries and registry.load("nope") is None and registry.load("z")[2] is None
    assert [tuple(r) for r in entries.collect()] == [(1, "καί", "and", "F", 0, 0.0), (2, "λόγος", 'a "word"\nor two', "L", 5, 10.5)]
    assert rows(aliases, "variant", "lemma") == [("θέλω", "ἐθέλω")]
    registry.clear()
    (tmp_path / "manifest.json").write_text("{", encoding="utf-8")
    assert registry.available() == [] and registry.default_id() is None
    (tmp_path / "bad.csv").write_text("rank,lemma\nx,a\n")
    with pytest.raises(Exception):
        lists.read_entries(spark, str(tmp_path / "bad.csv")).collect()


def test_store(spark, tmp_path):
    store = RunStore(spark, "file://" + str(tmp_path / "store"))
    assert store.count() == 0 and store.facts("x") is None and store.get("x") is None and store.delete(["x"]) == []
    f = facts(spark, [("λέγω", "λέγει", "pres. act. ind. 3sg", 0, "verb"), ("λέγω", "λέγει", "pres. ind. 3sg", 0, "verb"), ("λύω", "ἔλυσε", "aor. ind. 3sg deponent", 1, "verb")])
    a = store.save(f, "m", ["a.docx", "β.docx"], "note")
    b = store.save(f.limit(0), "m", [])
    assert store.count() == 2 and store.latest().id == b and [r.id for r in store.page(1, 1).collect()] == [a]
    run = store.get(a)
    assert (run.chapter_count, run.token_count, run.filenames, run.note) == (2, 3, ["a.docx", "β.docx"], "note")
    back = store.facts(a)
    assert [(r.chapter_index, r.position, r.form) for r in back.collect()] == [(0, 0, "λέγει"), (0, 1, "λέγει"), (1, 0, "ἔλυσε")] and store.facts(a) is back
    assert not set(FEATURES) & set(back.columns)
    store.table().createOrReplaceTempView("stored")
    assert {r.feat_tense: r.n for r in spark.sql("SELECT feat_tense, count(*) AS n FROM stored GROUP BY 1").collect()} == {"pres": 2, "aor": 1}
    assert rows(store.table(), "feat_voice", "feat_deponent") == [("act", 0), ("mid", 1), (None, 0)]
    assert store.reindex(a) == 3 and store.reindex("x") == 0 and store.facts(a).count() == 3
    assert store.save_safely(f.select("lemma"), "m", []) is None
    assert store.delete([a, a, "x"]) == [a] and store.count() == 1 and store.facts(a) is None
    assert set(FEATURES) <= set(migrate(f).columns)


def test_sinks(spark):
    r = chapters.rows(facts(spark, [("ὁ", "Ὁ", NOM, 0), ("λόγος", "<λόγος> & \x01", NOM, 0)]))
    ch = spark.createDataFrame([("r", 0, "1-ch", "T", "a.docx")], "run_id string, chapter_index int, id string, title string, filename string")
    data = sinks.export_workbook(export.row_sheet(r, ch), export.new_lemma_sheet(r, ch), export.ROW_COLUMNS, export.NEW_LEMMA_COLUMNS)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert "New lemmas by chapter" in z.read("xl/workbook.xml").decode()
    assert sheet.count("<row ") == 3 and "&lt;λόγος&gt; &amp; " in sheet and 'state="frozen"' in sheet and '<autoFilter ref="A1:S3"/>' in sheet
    with pytest.raises(ValueError):
        sinks.export_workbook(export.row_sheet(r.limit(0), ch), export.new_lemma_sheet(r, ch), export.ROW_COLUMNS, export.NEW_LEMMA_COLUMNS)
    now = datetime.datetime(2025, 1, 2, 3, 4)
    assert sinks.export_name(["Chapter 1 (x).docx"], now) == "tokenweave-Chapter-1-x-20250102-0304.xlsx" and sinks.export_name(["a", "b"], now) == "tokenweave-2-files-20250102-0304.xlsx"
    assert json.loads(sinks.to_json(spark.createDataFrame([("r", 1, None)], "run_id string, n int, x string"), ["run_id"]).first().json) == {"run_id": "r", "n": 1, "x": None}


def test_stream(spark, tmp_path):
    f = facts(spark, [("λέγω", "λέγει", "pres. act. ind. 3sg", 0), ("καί", "καί", "-", 0)]).withColumn("loaded_at", F.to_timestamp(F.lit("2025-01-06 10:00:00")))
    f.write.parquet(str(tmp_path / "in"))
    f.withColumn("loaded_at", F.col("loaded_at") + F.expr("interval 1 hour")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = appearances.read_facts(spark, str(tmp_path / "in"), f.schema, 1)
    q = appearances.decoded(appearances.once(stream)).writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("once"), "lemma", "tense", "status") == [("καί", None, "not_applicable"), ("λέγω", "pres", "ok")]
    q = appearances.arrivals(stream).writeStream.outputMode("update").format("memory").queryName("arrivals").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert max(r.facts for r in spark.table("arrivals").collect()) == 4


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder, body in (("x", "from x"), ("y", "from y"), (".", "from above")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / "Chapter 1.docx").write_bytes(docx.write_docx([(None, body)]))
    sections = docx.sections(docx.read_paragraphs(spark, str(tmp_path)))
    assert rows(sections, "filename", "text") == [("Chapter 1.docx", "from above"), ("x/Chapter 1.docx", "from x"), ("y/Chapter 1.docx", "from y")]
    assert rows(text.arrange(sections.withColumn("run_id", F.lit("r"))), "chapter_index", "title", "text") == [(0, "Chapter 1", "from above"), (1, "Chapter 1", "from x"), (2, "Chapter 1", "from y")]
    one = docx.read_paragraphs(spark, str(tmp_path / "x" / "Chapter 1.docx"))
    assert rows(one, "filename") == [("Chapter 1.docx",)]


def test_many_runs_added_at_once(spark, tmp_path):
    made = [(run, "a.docx", 0, "1-a", "A", p, kind, "λόγος", "λόγος", parse) for run in ("r1", "r 2:é") for p, (kind, parse) in enumerate([("noun", "nom. sg."), (None, None)])]
    facts_ = spark.createDataFrame(made, "run_id string, filename string, chapter_index int, chapter_id string, chapter_title string, position int, type string, lemma string, form string, parse string")
    runs = spark.createDataFrame([("r1", "2024-01-01", "m", ["a.docx"], 1, 2, None), ("r 2:é", "2024-01-02", "m", ["a.docx"], 1, 2, "n")], store.RUNS)
    kept = store.RunStore(spark, str(tmp_path / "s"))
    kept.add(runs, facts_)
    assert kept.count() == 2 and kept.latest().id == "r 2:é" and kept.get("r1").note is None
    assert [r.parse for r in kept.facts("r 2:é").collect()] == ["nom. sg.", ""] and kept.table().where("feat_status = 'ok'").count() == 2
    assert kept.delete(["r 2:é", "nope"]) == ["r 2:é"] and kept.count() == 1 and rows(kept.table(), "run_id", "position") == [("r1", 0), ("r1", 1)]
    one = kept.save(facts_.where("run_id = 'r1'"), "m", ["a.docx"])
    assert kept.count() == 2 and kept.facts(one).count() == 2


def test_first_appearances_in_a_stream(spark, tmp_path):
    schema = "run_id string, chapter_index int, position int, lemma string"
    for n, batch in enumerate(([("r", 0, 0, "a"), ("r", 0, 1, "b")], [("r", 5, 0, "a"), ("s", 0, 0, "a"), ("r", 5, 1, "c")])):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = appearances.first_appearances(appearances.read_facts(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1))
    told = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    told.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")), "run_id", "lemma") == [("r", "a"), ("r", "b"), ("r", "c"), ("s", "a")]


def test_sound_lists_only(spark):
    good = spark.createDataFrame([(1, "α", "g", "L", 1, 1.0), (2, "β", None, "", 1, 1.0), (3, "γ", None, "F", 1, 1.0)], "rank int, lemma string, gloss string, kind string, ref_count long, ref_coverage double")
    assert rows(lexicon.core_list(good), "rank", "gloss") == [(1, "g"), (3, "")]
    for bad in (good.where("rank <> 2"), good.union(good.where("rank = 3").selectExpr("4", "lemma", "gloss", "kind", "ref_count", "ref_coverage"))):
        with pytest.raises(Exception, match="holes|twice"):
            lexicon.core_list(bad).collect()


def test_a_provider_that_fails_or_breaks_off(spark):
    asked = []

    def flaky(t, title):
        asked.append(t)
        if len(asked) % 2:
            raise OSError("busy")
        if len(t) > 30:
            raise text.CutOff
        return t.split()

    body = "One two three. Four five six.\n\nSeven eight nine ten eleven twelve thirteen. Fourteen"
    assert text.persistent(flaky)(body, "") == body.split() and text.halves(body)[0] == "One two three. Four five six."
    assert text.halves("word") is None and text.halves("a b") == ("a", "b") and text.halves(" ab ") is None
    with pytest.raises(text.CutOff):
        text.persistent(lambda t, title: (_ for _ in ()).throw(text.CutOff()), depth=2)("a b c d e", "")
    with pytest.raises(OSError):
        text.persistent(lambda t, title: (_ for _ in ()).throw(OSError()), tries=2)("a", "")
