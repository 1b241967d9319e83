"""Small fact tables: rows are (lemma, form, parse, chapter) or with the type as a fifth part."""

NOM, GEN, VOC = "nom. sg.", "gen. sg.", "voc. pl."
SCHEMA = "run_id string, filename string, chapter_index int, chapter_id string, chapter_title string, position int, type string, lemma string, form string, parse string"


def facts(spark, rows, run="r", filename="a.docx"):
    at, out = {}, []
    for lemma, form, parse, chapter, *kind in rows:
        n = at.get(chapter, 0)
        at[chapter] = n + 1
        out.append((run, filename, chapter, f"{chapter + 1}-ch", f"Chapter {chapter + 1}", n, kind[0] if kind else "noun", lemma, form, parse))
    return spark.createDataFrame(out, SCHEMA)


def refs(spark, n, run="r"):
    return spark.createDataFrame([(run, i, f"{i + 1}-ch", f"Chapter {i + 1}", "a.docx") for i in range(n)], "run_id string, chapter_index int, id string, title string, filename string")


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
