"""Reference lists: styles of lists, formats of references, and their parts."""

import pytest

from citeweave.functions import references as P

LISTS = {
    "bracketed": ("\n[1] First one here.\n[2] Second\none.\n[4] Fourth.", ["First one here.", "Second\none.", "Fourth."]),
    "alphabetic": ("x\n[AB20] First one.\n[CDE+19a] Second.\n[Fg2021] Third.", ["First one.", "Second.", "Third."]),
    "numbered": ("1. First one.\n2. Second.\n3. Third in 2019. And more.", ["First one.", "Second.", "Third in 2019. And more."]),
    "surname first": (
        "Avalle, M.; and Bo, C. 2020. Some title of it. Venue 12.\nCamacho-Ed, J. 2021. Another of it. CHI.\n12\nDel Vicario, M. 2019. Third of them (x).\nEuropean Union. 2022a. A law of it. Online.",
        ["Avalle, M.; and Bo, C. 2020. Some title of it. Venue 12", "Camacho-Ed, J. 2021. Another of it. CHI", "Del Vicario, M. 2019. Third of them (x)", "European Union. 2022a. A law of it. Online."],
    ),
    "year in the line": ("\n".join(f"{x} S, Other T (20{10 + k}) A title that is long\nand goes on" for k, x in enumerate("ABCDE")) + "\n99", [f"{x} S, Other T (20{10 + k}) A title that is long\nand goes on" for k, x in enumerate("ABCDE")]),
    "year last": ("\n".join(f"{x}aron Bell, Ced Dyk. A title of it, pages 1-2, 201{k}." for k, x in enumerate("ABCDEF")), [f"{x}aron Bell, Ced Dyk. A title of it, pages 1-2, 201{k}." for k, x in enumerate("ABCDEF")]),
    "initials first": ("\n".join(f"{x}. D. Bell and K. Chen. A long title {x}. Venue, pp. 2." for x in "ABCDEF"), [f"{x}. D. Bell and K. Chen. A long title {x}. Venue, pp. 2." for x in "ABCDEF"]),
    "paragraphs": ("One reference that is long enough\nto stay.\n\nshort\n\nAnother reference, long enough too.", ["One reference that is long enough\nto stay.", "Another reference, long enough too."]),
}


@pytest.mark.parametrize("style", LISTS)
def test_lists(style):
    text, expected = LISTS[style]
    assert P.segments(text) == expected


def test_sections():
    text = "Body\nREFERENCES\n[1] A.\nASIA CCS \u201926, June 01\u201305, 2026, Bangalore, India\n12\nTHE THEORY OF THINGS WE KNOW\nA. Bell, B. Chen, and C. Dyk\n[2] B.\nAcknowledgments\nWe thank."
    assert P.references_section(text) == "[1] A.\n[2] B."
    assert P.references_section("abcdefghij") == "hij"
    assert P.references_section("x\nReferences\n[1] A.\nB Methods of proof\nmore") == "[1] A."
    long = "\n".join(f"[{k}] " + "word " * 40 for k in range(1, 5))
    assert len(P.segments(long + "\nAppendix A\n[9] none")) == 4


@pytest.mark.parametrize("text, expected", [
    ("detec-\ntion of human- centered GPT-4- turbo state- of-the-art", "detection of human-centered GPT-4-turbo state-of-the-art"), ("a- b- c", "abc"), ("well-known x", "well-known x"),
])
def test_hyphens(text, expected):
    assert P.join_hyphens(text) == expected


@pytest.mark.parametrize("text, expected", [
    ("see https://doi.org/10.1145/3442381.\n3450048.", "10.1145/3442381.3450048"), ("10.1016/0021-9681(87)90171-8).", "10.1016/0021-9681(87)90171-8"), ("doi:10.2478/popets-\n2019-0037, x", "10.2478/popets-2019-0037"),
    ("10.1109/SP40000.20\n20.00038", "10.1109/SP40000.2020.00038"), ("10.1/x none", None), ("(10.1234/a[b]]", "10.1234/a[b"), ("a 10.1111/one b https://dx.doi.org/10.2222/two)", "10.2222/two"),
])
def test_dois(text, expected):
    assert P.doi_of(text) == expected


@pytest.mark.parametrize("text, expected", [
    ("arXiv:2301.\n12345v2", "2301.12345v2"), ("http://arxiv.org/abs/hep-th/9901001", "hep-th/9901001"), ("arXiv preprint arXiv:2301.1234", "2301.1234"), ("2301.12345 alone", None), ("arXiv hep-th/9901001v1", "hep-th/9901001v1"),
])
def test_arxiv_ids(text, expected):
    assert P.arxiv_of(text) == expected


@pytest.mark.parametrize("ref, title", [
    ('[3] A. Bell, "Safe, "proof-carrying" code in use," in Proc. X, 2020.', 'Safe, "proof-carrying" code in use'),
    ("A. Bell. \u201cQuoted part\u201d: the rest of a title. In Proc. X.", "Quoted part: the rest of a title"),
    ("A. Bell. \u201cAn inner quote\u201d IEEE Journal 2020", "An inner quote"),
    ("Allix, K., Bissyand\u00e9, T.F.: Androzoo: collecting millions. In: Proceedings of MSR", "Androzoo: collecting millions"),
    ("Android Developer: Define custom permissions (2024), https://x.org", "Define custom permissions"),
    ("L. et al. Chai. What makes fake images detectable? In European conference on vision, 2020.", "What makes fake images detectable?"),
    ("Al Madi N (2023) How readable is this code? In: Proceedings of X", "How readable is this code?"),
    ("Ann Bell, Bo Chen. 2021. A title of some words. In Proceedings of X.", "A title of some words"),
    ("C. D. Ali and K. C. Border. Infinite dimensional things. In Advances in Y, 2020.", "Infinite dimensional things"),
    ("Narouei M, Takabi H. Title of a thing here. IEEE Trans Dependable Secure Comput 2018;17(3):506-17", "Title of a thing here"),
    ("SMITH, F., AND JONES, G. A title of capitals here. In USENIX Security (2012).", "A title of capitals here"),
    ("Aaron Bertram, Moduli of rank-2 vector bundles, J. Differential Geom. 35 (1992), 429", "Moduli of rank-2 vector bundles"),
    ("Alex Bell, and Ofer Gabber, Faisceaux pervers, Ast\u00e9risque 100 (1983)", "Faisceaux pervers"),
    ("J. Fan, F. Vercauteren, Somewhat practical fully homomorphic encryption, Cryptology ePrint Archive, Report 2012/144 (2012).", "Somewhat practical fully homomorphic encryption"),
    ("CAO X, YANG B, WANG K, et al. Control of many agents. Automatica 2024", "Control of many agents"),
    ("Ann Bell and Bo Chen. A plain title of things. Springer", "A plain title of things"),
    ("", ""),
])
def test_titles(ref, title):
    assert P.title_of(ref) == title


@pytest.mark.parametrize("title, expected", [
    ("A study of U.S. law. More text", "A study of U.S. law"), ("Running big.LITTLE and Node.js well", "Running big.LITTLE and Node.js well"), ("Flux. 1 and more", "Flux. 1 and more"), ("Is it safe? In Proceedings of X", "Is it safe?"),
    ("A title, volume 15, 2020", "A title"), ("A title arXiv preprint arXiv:1", "A title"), ("A title, 280-289", "A title"), ("A title, June 2024", "A title"),
])
def test_clean_titles(title, expected):
    assert P.clean_title(title, False) == expected


@pytest.mark.parametrize("ref, authors", [
    ('J. Smith, A. Jones, and C. Williams, "Title"', ["J. Smith", "A. Jones", "C. Williams"]), ("Bail, C. A.; Argyle, L.; and Bo, T. 2018. Title.", ["Bail, C. A.", "Argyle, L.", "Bo, T"]),
    ("Ann Bell & Bo Chen et al. Title of it.", ["Ann Bell", "Bo Chen"]), ("\u2014\u2014, Title", None), ("", []), (", ".join(f"A. Name{c}" for c in "abcdefghijklmnopqrst") + ". Title.", [f"A. Name{c}" for c in "abcdefghijklmno"]),
])
def test_authors(ref, authors):
    assert P.authors_of(ref) == authors


def test_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x\nReferences\n1. A. Bell. We know of four words. In Proc. X, 2020.\n2. https://x.org\n3. Journal of many things we know, 2020.\n")], "k int, text string")
    rows = P.parse_references(docs, "k", "text").collect()
    assert [(r.k, r.citation_id, r.parsed_title, r.parsed_authors, r.parsed_venue, r.parsed_year) for r in rows] == [(3, 1, "We know of four words", ["A. Bell"], "Proc. X", 2020)]
    assert P.parse(None) == []


def test_a_small_file_is_read_by_many_tasks(spark, tmp_path):
    """The customers of a file of one row group would all be parsed by one task."""
    from citeweave import registry

    spark.range(1, 10_001).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    sizes = [n for n in registry.paper_view(spark, str(tmp_path)).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 10_000 and len(sizes) == 5 and max(sizes) <= P.ROWS_PER_TASK


@pytest.mark.parametrize("x, text, expected", [("a Title", "A. B. A TITLE. Venue a title", ". Venue a title"), ("none", "a", None), ("straße k", "x Straße K, y", ", y"), ("a.b", "axb a.b c", " c")])
def test_tails(x, text, expected):
    assert P.tail_after(x, text) == expected
