import pytest

pytest.importorskip("ledgerfen.llm")
from ledgerfen.llm import language as L
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.01/documents.parquet"


@pytest.fixture(scope="module")
def model(spark):
    return L.Discriminator(L.sample(spark.read.parquet(DATA)))


def test_labels():
    named = {"en-GB": "en", " EN": "en", "Deutsch": "de", "fr_BE": "fr", "por": "pt", "Dutch": "nl", "es-MX": "es", "ger": "de"}
    assert {k: L.label_code(k) for k in named} == named
    assert [L.label_code(x) for x in (None, "", " ", "-", "??", "xx", "und", "unknown", "n/a", "it")] == [None] * 10


def test_held_out_documents(spark, model):
    """On rows that weren't fitted on, the machines and the correct labels agree but for the labels that are wrong themselves."""
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("length(text) > 200")
    found = L.languages(rows, model).where("seg_no = 0").select("lang", "seg_lang").collect()
    named = [(L.label_code(r.lang), r.seg_lang) for r in found if L.label_code(r.lang)]
    assert sum(a == b for a, b in named) / len(named) > 0.9


def test_held_out_lines(model):
    """Sentences that none of the texts has."""
    lines = {
        "en": "Nobody in the village had ever seen such a heavy storm before that night.",
        "de": "Niemand im Dorf hatte jemals zuvor einen so heftigen Sturm in der Nacht gesehen.",
        "nl": "Niemand in het dorp had ooit eerder zo een zware storm in de nacht gezien.",
        "fr": "Personne dans le village n'avait jamais vu une tempête aussi forte avant cette nuit.",
        "es": "Nadie en el pueblo había visto nunca una tormenta tan fuerte antes de esa noche.",
        "pt": "Ninguém na aldeia tinha visto uma tempestade tão forte antes daquela noite.",
    }
    scorer = L.Scorer(model)
    assert {k: scorer.lines([v])[0][0] for k, v in lines.items()} == {k: k for k in lines}
    shouted = {k: scorer.lines([v.upper()])[0][0] for k, v in lines.items()}
    assert shouted == {k: k for k in lines}
    assert all(0 <= c <= 1 for _, c in scorer.lines(list(lines.values())))
    assert scorer.lines(["", "1234 567 --", " "]) == [None, None, None]
    assert scorer.lines([]) == []


def test_cases(spark, model):
    en = "The committee will now discuss the report on the new railway timetable."
    de = "Der Ausschuss wird nun den Bericht über den neuen Fahrplan der Eisenbahn beraten."
    data = [
        (1, "en-GB", en), (2, "fr", en), (3, None, en), (4, "de", f"{de}\n\n{de}\n{en}"), (5, "en", f"{de}\n{de}\n{en}"), (6, "de", None), (7, "de", ""), (8, "de", "12 34 56 78 9 10 11 12 13"),
        (9, "fr", "too short to count"), (None, "xx", en), (10, "en", f"{en} {en}\nWir beraten nun."),
    ]
    docs = spark.createDataFrame(data, "doc_id long, lang string, text string").withColumn("main", F.lit("clash"))
    every = L.languages(docs, model)
    found = {(r.doc_id, r.seg_no, r.seg_lang) for r in L.wrong_labels(every).collect()}
    assert found == {(2, 0, "en"), (3, 0, "en"), (4, 4, "en"), (5, 0, "de"), (5, 3, "en"), (None, 0, "en")}
    assert every.where("seg_no = 0").count() == len(data)
    assert every.where("doc_id IN (6, 7, 8) AND (seg_no = 0 AND seg_lang IS NOT NULL)").count() == 0
    assert L.languages(docs.limit(0), model).count() == 0


def test_without_usable_rows(spark):
    docs = spark.createDataFrame([(1, None, "some text"), (2, "en", None)], "doc_id long, lang string, text string")
    assert [(r.doc_id, r.seg_lang) for r in L.languages(docs).orderBy("doc_id").collect()] == [(1, None), (2, None)]


def test_a_corpus_of_long_texts_gets_its_languages(spark):
    en = "The committee will now discuss the report on the new railway timetable and the weather at sea. "
    nl = "De commissie bespreekt nu het verslag over de nieuwe dienstregeling en het weer op zee. "
    docs = spark.createDataFrame([(i, *(("en", en * 400) if i % 2 else ("nl", nl * 400))) for i in range(8)], "doc_id long, lang string, text string")
    lines = L.sample(docs)
    assert {lang for _, lang in lines} == {"en", "nl"} and all(len(line) <= L.SAMPLE_CHARS for line, _ in lines)
    assert {(r.doc_id % 2, r.seg_lang) for r in L.languages(docs).where("seg_no = 0").collect()} == {(1, "en"), (0, "nl")}


def test_rows_that_cannot_be_fitted_on_do_not_crowd_out_the_others(spark):
    en = "The committee will now discuss the report on the new railway timetable."
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.when(F.col("id") < 20, F.lit(en)).otherwise(F.lit("short")).alias("text"))
    assert len(L.sample(docs, rows=15)) == 15


def test_the_fit_repeats(spark):
    lines = L.sample(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), rows=10)
    a, b = L.Discriminator(lines), L.Discriminator(lines)
    assert (a.weights == b.weights).all()
