from pyspark.sql import functions as F

from citeweave.functions import text as T
from citeweave.plans.verification import run_stages
from citeweave.sources import readers


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_rules(spark):
    lit = F.lit
    assert one(spark, T.query_words(lit("What is it in the end?"), 8)) == ["what", "is", "it", "in", "the", "end?"]
    assert one(spark, T.query_words(lit("On 3D map of AI x2"), 8)) == ["3d", "map", "x2"]
    for name, key in [("van Dyk, Q. R.", "q van dyk"), ("Quim van der Lor", "q van der lor"), ("Ann Bell Jr.", "a bell"), ("", "")]:
        assert one(spark, T.author_key(lit(name))) == key
    assert one(spark, T.normalize_doi(lit("https://dx.doi.org/10.1234/AbC.,"))) == "10.1234/abc"
    assert one(spark, T.extract_arxiv_id(lit("arXiv: 2301.12345v2"))) == "2301.12345v2"
    assert one(spark, T.extract_year(lit("arXiv:2001.08361, 2020"))) == 2001
    assert one(spark, T.citation_ids(lit("x [1, 3-5] y [3] [7-6] [a]"))) == [1, 3, 4, 5]
    assert one(spark, T.round_half_even(lit(3.125), 2)) == 3.12
    assert one(spark, T.author_overlap(F.array(lit("A A"), lit("B B")), F.array(lit("A A"), lit("C C"), lit("D D")))) == 0.5


def test_readers_and_plan(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        "<r><record><header><identifier>oai:1</identifier></header><metadata><arXivRaw><id>2001.00001</id><title>Deep  Nets &amp; Things We Know</title><authors>A Bell and B Chen</authors>"
        "<abstract>x</abstract><version><date>Mon, 1 Jan 2020</date></version></arXivRaw></metadata></record><record><header/></record></r>"
    )
    from citeweave.operators.catalog import candidates

    rows = candidates(readers.read_arxiv(spark, str(tmp_path / "a.xml")), "arxiv")
    assert [(r.record_id, r.title, r.authors, r.year) for r in rows.collect()] == [("2001.00001", "Deep Nets & Things We Know", ["A Bell", "B Chen"], 2020)]
    (tmp_path / "w.json").write_text('{"id":"W1","display_name":"T","authorships":[{"author":{"display_name":"A B"}},{"raw_author_name":"C"}]}\n\nbroken\n')
    assert [(r.record_id, r.title, r.authors) for r in readers.read_works(spark, str(tmp_path / "w.json")).collect()] == [("W1", "T", "A B; C")]
    (tmp_path / "d.xml").write_text('<dblp><article key="k/1"><author>A B</author><title>On <i>x</i> Y.</title><year>2001</year><ee>https://doi.org/10.1234/Ab</ee></article></dblp>')
    assert [(r.record_id, r.title, r.doi) for r in readers.read_dblp(spark, str(tmp_path / "d.xml"), ["article"]).collect()] == [("k/1", "On x Y.", "10.1234/ab")]
    cites = spark.createDataFrame(
        [(1, "Deep nets and things we know", ["Bell, A."], 2020, "", "raw", None, None, None), (2, "x", [], 2020, "", "arXiv:2001.00001", None, None, "2001.00001"), (3, "Nothing like it at all", [], None, "", "r", None, None, None)],
        "citation_id int, title string, authors array<string>, year int, venue string, raw string, doi string, url string, arxiv_id string",
    )
    stages = run_stages(cites, rows)
    got = {r.citation_id: (r.selected_source, r.selected_match_type) for r in stages["verify"].collect()}
    assert got == {1: ("lexical", "lexical_top_1"), 2: ("exact", "arxiv_id_exact"), 3: (None, None)}
    assert {r.citation_id: (r.match_type, r.confidence) for r in stages["exact"].collect()} == {1: ("skipped", 0.55), 2: ("arxiv_id_exact", 0.99), 3: ("skipped", 0.55)}
    assert {r.citation_id: (r.skip_reason, r.effective_db_priority) for r in stages["lexical"].collect()} == {1: (None, ["arxiv"]), 2: ("exact_match_found:arxiv_id_exact", []), 3: (None, ["arxiv", "dblp", "openalex"])}
    assert {r.citation_id: r.skip_reason for r in stages["semantic"].collect()} == {1: "no_expanded_context", 2: "no_expanded_context", 3: "no_selected_candidate"}
    assert {r.citation_id: r.combined_label for r in stages["report"].collect()}[3] == "likely_problematic" and set(run_stages(cites, rows, upto="exact")) == {"route", "exact"}


def test_a_scorer_is_asked_by_the_batch(spark):
    from citeweave.operators import report

    rows = spark.createDataFrame([(i, True, "An abstract", ["Line one."] if i != 3 else [], f"bad {i}" if i in (1, 2) else "t") for i in range(6)], "citation_id int, has_candidate boolean, abstract string, lines array<string>, title string").coalesce(1)

    def scorer(prompts):
        assert len(prompts) == 1 or not prompts.str.contains("bad").any()  # a failing batch is asked again row by row
        if prompts.iloc[0].find("bad 1") >= 0:
            raise ValueError
        return prompts.map(lambda p: 'So: {"support_label": "Supported", "support_score": 7, "explanation": " x "}')

    got = {r.citation_id: (r.skip_reason, r.support_label, r.support_score) for r in report.judge(rows, scorer).collect()}
    assert got == {**{i: (None, "supported", 1.0) for i in (0, 2, 4, 5)}, 1: ("semantic_error", "unclear", 0.0), 3: ("no_expanded_context", "unclear", 0.0)}


def test_dump_path(spark, tmp_path):
    base = str(tmp_path / "dump")
    try:
        readers.dump_path(spark, base)
        raise AssertionError
    except FileNotFoundError:
        pass
    (tmp_path / "dump.xml.gz").write_text("")
    assert readers.dump_path(spark, base) == base + ".xml.gz"
    (tmp_path / "dump.xml").write_text("")
    assert readers.dump_path(spark, base) == base + ".xml"


def test_stream_keeps_the_latest(spark, tmp_path):
    from citeweave.streaming.upsert import latest

    def step(name, rows):
        spark.createDataFrame(rows, "k int, t int, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("k int, t int, v string").parquet(str(tmp_path / "in"))
        latest(stream, "k", "t", str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
        return sorted(tuple(r) for r in readers.latest_version(spark, str(tmp_path / "out")).collect())

    assert step("a", [(1, 1, "a"), (2, 5, "b"), (1, 2, "c")]) == [(1, 2, "c"), (2, 5, "b")]
    assert step("b", [(1, 1, "old"), (2, 6, "new"), (3, 1, None)]) == [(1, 2, "c"), (2, 6, "new"), (3, 1, None)]
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.startswith("v=")]) <= 2


def test_a_cut_reference_is_text_where_the_references_are_known(spark):
    from citeweave import registry

    for title, known, every in [("Nets&amp;&amp", "netsamp", "nets"), ("A &lt;b&#39;&AMP c&eacute;", "abampceacute", "abc"), ("&amp;lt; x&am", "ltxam", "ltxam"), (None, "", "")]:
        assert one(spark, T.normalize_title(F.lit(title).cast("string"), registry.ENTITIES)) == known and one(spark, T.normalize_title(F.lit(title).cast("string"))) == every


def test_the_exact_search_is_that_of_all_pairs(spark):
    """Years and authors that are unknown, several authors, and keys that all have: what comparing each citation with each record gives."""
    import random

    from citeweave.operators.catalog import best_exact

    rng = random.Random(5)
    names = lambda: rng.choice([None, [], *(rng.sample([f"{x} {x}" for x in "ABCDEF"], rng.randint(1, 4)) for _ in range(6))])
    year, doi, title = (lambda: rng.choice([None, 2000, 2001, 2002])), (lambda: rng.choice([None, "", "10.1/a"])), (lambda: rng.choice(["One", "one!", "Two", "", None]))
    records = [(rng.choice(["arxiv", "dblp", "openalex"]), f"r{k}", names(), year(), doi() if k % 9 == 0 else None, title()) for k in range(150)]
    cites = [(k, rng.sample(["arxiv", "dblp", "openalex"], rng.randint(0, 3)), k % 11 > 0, f"r{k}" if k % 7 == 0 else None, doi() if k % 4 == 0 else None, title(), names(), year()) for k in range(120)]
    r = spark.createDataFrame(records, "db string, record_id string, authors array<string>, year int, doi string, title string").withColumn("title_normalized", T.normalize_title(F.col("title")))
    c = spark.createDataFrame(cites, "citation_id int, db_priority array<string>, run_exact_match boolean, arxiv_id string, doi string, title string, authors array<string>, year int")
    plain = lambda x: "".join(ch for ch in (x or "").lower() if ch.isalnum())

    def best(priority, arxiv_id, doi, title, authors, year):
        for db in priority:
            mine = [x for x in records if x[0] == db]
            for kind, hits in (("arxiv_id_exact", [x for x in mine if db == "arxiv" and x[1] == arxiv_id]), ("doi_exact", [x for x in mine if doi and x[4] == doi]), (None, [x for x in mine if plain(title) and plain(x[5]) == plain(title)])):
                if hits:
                    x = min(hits, key=lambda x: (year is None or x[3] != year, -len({*(authors or ())} & {*(x[2] or ())}), year is not None and x[3] is not None, x[1]))
                    return db, x[1], kind or ("title_year_exact" if year is not None and x[3] == year else "title_exact")
        return None

    expected = {k: found for k, priority, run, *rest in cites if run and (found := best(priority, *rest))}
    assert len(expected) > 50 and {x.citation_id: (x.db, x.record_id, x.match_type) for x in best_exact(c, r).collect()} == expected


def test_sentences_keep_their_digits_and_are_split_once(spark):
    """transform gives a two-place trim the place as what to trim: sentences lost digits at their ends. Each text is split, and each marker read, once a row."""
    from citeweave import registry

    assert one(spark, T.split_sentences(F.lit("0 is [1]. Next is 1! [2] See 0"))) == ["0 is [1].", "Next is 1!", "[2]", "See 0"]
    assert one(spark, T.split_sentences(F.lit(" \n"))) == [] and one(spark, T.split_sentences(F.lit(None).cast("string"))) == []
    for given, made in [("[ 2 - 4 ,1,][x] [7]", [1, 2, 3, 4, 7]), ("[1-2-3, 5–6]", [5, 6]), ("[6-5, 99999999999, 03, 3]", [3]), ("none", [])]:
        assert one(spark, T.citation_ids(F.lit(given))) == made
    plan = registry.sentence_contexts(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(?U)") == 1 and plan.count("regexp_extract_all(x#") == 1
