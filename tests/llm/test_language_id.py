from pyspark.sql import functions as F

from salesledger.llm import langid, queries
from tests.llm.data import FOLDER

BIG = "/root/testdata/sf0.01"


def test_query(spark, rows):
    out = queries.op4_language(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in out) == [r[0] for r in rows]
    assert sum(r["kept"] for r in out) >= 0.99 * len(out)
    assert sum(r["language"] == r["lang"] for r in out) >= 0.99 * len(out)


def test_held_out_accuracy_of_text_alone(spark):
    docs = spark.read.parquet(f"{BIG}/documents.parquet")
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    model = langid.fit(docs.where(train))
    rest = docs.where(~train & (F.length("text") > 40))
    out = langid.identify(rest, model, lang=None, host=None)
    right = out.agg(F.avg((F.col("language") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.97


def test_evidence_is_weighed(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    known = docs.where("lang in ('en', 'fr')").select("text", F.col("lang").alias("declared"), F.concat(F.lit("www.site."), "lang").alias("host"))
    short = [("la", "fr", "www.site.fr"), ("la", None, "new.fr"), ("a", None, "other.en"), ('<html lang="fr"> de', "en", "new.fr"), ("of", "zz", None)]
    frame = known.unionByName(spark.createDataFrame(short, "text string, declared string, host string"))
    out = langid.identify(frame, model, lang="declared", host="host")
    got = {(r["text"], r["host"]): r["language"] for r in out.collect() if len(r["text"]) < 30}
    assert got["la", "www.site.fr"] == "fr" and got["la", "new.fr"] == "fr" and got['<html lang="fr"> de', "new.fr"] == "fr"


def test_shuffled_priors_agree(spark, monkeypatch):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(docs)
    key = lambda f: sorted((r["doc_id"], r["language"], round(r["posterior"], 9)) for r in f.collect())
    small = key(langid.identify(docs, model))
    monkeypatch.setattr(langid, "MAX_HOSTS", 3)
    assert key(langid.identify(docs, model)) == small


def test_odd_rows(spark, odd):
    model = langid.fit(odd)
    out = langid.identify(odd, model).collect()
    assert len(out) == odd.count()
    for r in out:
        if not any(c.isalpha() for c in r["text"] or ""):
            assert not r["kept"] and r["language"] is None
        assert r["kept"] in (True, False) and r["spans"] is not None
    assert langid.identify(odd.limit(0), model).count() == 0
    assert langid.identify(odd, langid.fit(odd.limit(0))).where("kept").count() == 0


def test_every_label_is_a_language(spark):
    names = [a + b + c for a in "abcde" for b in "aeiou" for c in "klm"]  # 75
    word = lambda x: " ".join([x * 3, x + x[::-1], x[0] + x * 2] * 3)
    rows = [(f"{word(x)} {k}", x, f"www.{x}.{x}") for x in names for k in range(3 if x == names[-1] else 5)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    model = langid.fit(docs)
    assert model.languages == sorted(names)
    out = langid.identify(docs, model, lang=None).collect()
    assert all(r["kept"] and r["language"] == r["text_language"] == r["lang"] for r in out)


def test_rare_languages_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 20_000)
    rows = [(f"the on er in at {k}", "en") for k in range(3000)] + [("ou es la " * 20_000 + str(k), "fr") for k in range(2)] + [("zu xo qi", "xx")]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), sample=200)
    assert model.languages == ["en", "fr", "xx"] and all(len(set(t.tolist())) > 1 for t in model.table)
    short = spark.createDataFrame([("zu xo qi", "xx"), ("ou es la", "fr"), ("the on er", "en")], "text string, lang string")
    assert all(r["text_language"] == r["lang"] for r in langid.identify(short, model, lang=None, host=None).collect())


def test_pages_by_all_evidence(spark):
    """Held out: paths of the pages tell their language and are no evidence, and the tables come from documents."""
    out = queries.page_language(spark, BIG).collect()
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{BIG}/pages.parquet").select("page_id", F.regexp_extract("url", r"/(de|en|es|fr)/", 1).alias("path")).collect()}
    assert sorted(r["page_id"] for r in out) == sorted(pages)
    truth = [(r, pages[r["page_id"]]["path"]) for r in out if pages[r["page_id"]]["path"]]
    assert len(truth) > 0.9 * len(out)
    assert sum(r["text_language"] == t for r, t in truth) >= 0.95 * len(truth)
    assert sum(r["language"] == t for r, t in truth) >= 0.99 * len(truth)
    assert all(r["host"] and "/" not in r["host"] for r in out)


def test_html_tags_are_read_whole(spark):
    tags = [
        (f'<html class="{"x " * 5000}" lang="FR-ca">', "fr"), ("<html\n\tdata-lang=de lang = 'en'><html lang=es>", "en"), ("<HTML xml:lang=es>", "es"),
        ("<html class=a><p lang=de>", None), ("<html lang=english>", None), ("<htmlx lang=de>", None), ("", None), (None, None), ("<html " * 50_000, None),
    ]
    frame = spark.createDataFrame([(k, page, tag) for k, (page, tag) in enumerate(tags)], "k int, page string, tag string")
    for r in frame.withColumn("found", langid.declared(F.col("page"))).collect():
        assert r["found"] == r["tag"], r["k"]


def test_odd_pages(spark, odd):
    model = langid.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = [(1, "http://a.b.fr:80/x", "<p>the one and other", "clash", 1.0), (1, "http://a.b.fr:80/x", "<p>the one and other", "clash", 1.0), (None, None, None, None, None),
            (2, "no address", "", None, None), (3, "x://", "<html lang=fr>", None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, host string, posterior double")
    out = langid.identify_pages(frame, model).collect()
    assert sorted((r["page_id"] or 0, r["host"], r["declared"]) for r in out if r["page_id"] != 2 and r["page_id"]) == [(1, "a.b.fr", None)] * 2 + [(3, None, "fr")]
    assert all(r["text_language"] is None and not r["kept"] for r in out if r["page_id"] != 1) and len(out) == 5
    assert langid.identify_pages(frame.limit(0), model).count() == 0
