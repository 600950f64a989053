from pyspark.sql import functions as F

from foliant.llm import scans

CLEAN = [
    "The steady-state pressure depends on the membrane more than on the reaction rate of the sample.",
    "A larger coefficient need not mean a larger productivity; the sample follows the membrane.",
    "Students often confuse the long-term coefficient with the well-defined membrane of the sample.",
]


def scan(index, head, body, foot):
    return "\n".join([x for x in (head, *body, foot) if x is not None])


BODY = [
    "The steady-state pressure depends on the membrane",
    "more than on the reac-",
    "tion rate. A larger coefficient need not mean a",
    "larger producfivity; the samplc follows the well-",
    "defined membrane of the sample and the reaction.",
]


def tables(spark):
    rows = [(i, "clean", i, (t + " ") * 40) for i, t in enumerate(CLEAN)]
    rows += [(100, "b", 0, scan(0, "Pressure and membrane", BODY, "1"))]
    rows += [(100 + i, "b", i, scan(i, f"Pressure and membrane   {i + 1}", BODY, None)) for i in range(1, 5)]
    rows += [(200, "b", 9, None), (201, "b", 10, ""), (202, None, None, "  \n ")]
    pages = spark.createDataFrame(rows, "page_id long, book string, page_index int, text string").withColumn("key", F.lit("clash")).withColumn("title", F.lit(1))
    books = spark.createDataFrame([("b", "Samples", "en")], "book string, title string, lang string")
    return pages, books


def test_defects_of_scans(spark):
    pages, books = tables(spark)
    got = {(r.page_id, r.line_no, r.defect) for r in scans.defects(pages, books).collect()}
    assert {(101, 0, "running"), (104, 0, "running"), (100, 2, "hyphen"), (102, 2, "hyphen"), (101, 4, "misread")} <= got
    assert (100, 0, "running") not in got  # the heading that opens the chapter
    assert not any(d == "hyphen" and line == 4 for _, line, d in got)  # well-defined keeps its hyphen
    assert not any(p < 100 or p >= 200 for p, _, _ in got)
    words = {r.meant for r in scans.defects(pages, books).where("defect = 'misread'").collect()}
    assert words == {"productivity", "sample"}


def test_repeated_rows_and_empty_tables(spark):
    pages, books = tables(spark)
    again = pages.unionByName(pages.where("page_id = 103").withColumn("page_id", F.lit(999).cast("long")))
    got = {(r.page_id, r.line_no, r.defect) for r in scans.defects(again, None).collect()}
    assert {(line, d) for p, line, d in got if p == 103} == {(line, d) for p, line, d in got if p == 999}
    assert scans.defects(pages.where(F.lit(False)), books).count() == 0


def test_paragraphs_are_continuous(spark):
    pages, books = tables(spark)
    got = [r.text for r in scans.paragraphs(pages, books).where("page_id = 102").orderBy("para_no").collect()]
    assert got == [
        "The steady-state pressure depends on the membrane more than on the reaction rate. A larger coefficient need not mean a larger productivity; the sample follows the well-defined membrane of the sample and the reaction."
    ]


def test_scans_with_few_wrapped_lines(spark):
    pages, books = tables(spark)
    short = ["Pressure and membrane   {}", "pV = nRT   (3.25)", "The samplc follows it.", "– {} –"]
    by_flag, by_book = ("\n".join(short).format(i, i) for i in (7, 8))
    wide = "学生常把大气压力和通货膨胀混为一谈。从1774年到1779年，高温区域逐渐下降。请勿把样品加热到3度以上！"
    rows = [(300, "alone", 7, ["ocr"], by_flag), (301, "b", 8, None, by_book), (302, "b", 9, [], "q = m * c * dT   (6.8)"), (303, "alone", 8, ["ocr"], wide), (304, "other", 8, [], by_book)]
    more = spark.createDataFrame(rows, "page_id long, book string, page_index int, flags array<string>, text string")
    every = pages.unionByName(more, allowMissingColumns=True)
    got = {(r.page_id, r.line_no, r.defect) for r in scans.defects(every, books).collect() if r.page_id >= 300}
    both = {(p, n, d) for p in (300, 301) for n, d in ((0, "running"), (2, "misread"), (3, "running"))}
    assert got == both
    lines = {p: [r.text for r in scans.paragraphs(every, books).where(f"page_id = {p}").orderBy("para_no").collect()] for p in (301, 304)}
    assert "The sample follows it." in " ".join(lines[301]) and "– 8 –" in lines[304]


def test_known_misreadings_are_looked_up(spark):
    pages, books = tables(spark)
    # stray copies of misreadings on pages that are no scans: far rarer than the words they come from
    stray = "The sarnple and the productiviiy, the rneinbrane and the mernbrane of it, as it follows from what was said long before this was written. "
    plain = "The membrane and the sample and the pressure follow the class and the dass of it, as was said long before this was written here. "
    body = ["The mernbrane of the sample follows from the reac-", "tion and more than once, it depends on the mern-", "brane and the class of the sample and the membrane", "of the pressure and the reaction that follows it."]
    rows = [(400, "clean", 400, stray * 2), (401, "clean", 401, plain * 300), (402, "c", 1, "\n".join(body))]
    more = spark.createDataFrame(rows, "page_id long, book string, page_index int, text string")
    got = {(r.line_no, r.defect, r.meant) for r in scans.defects(pages.unionByName(more, allowMissingColumns=True), books).where("page_id = 402").collect()}
    assert {(0, "misread", "membrane"), (1, "misread", "membrane"), (1, "hyphen", "membrane")} <= got
    assert not any(line == 2 for line, _, _ in got)  # class is as frequent as dass


def test_trie_finds_all_candidates_within_the_bound():
    words = ["marginal", "margin", "cache", "specific", "internal", "sample", "shared", "the"]
    trie = scans.Trie((w, 50) for w in words)

    def brute(read):
        out = set()
        for w in words:
            reach = {w}
            seen = {w}
            for _ in range(scans.MOST_CONFUSIONS):
                new = set()
                for x in reach:
                    for a, b in scans.CONFUSIONS:
                        i = x.find(a)
                        while i >= 0:
                            new.add(x[:i] + b + x[i + len(a) :])
                            i = x.find(a, i + 1)
                seen |= new
                reach = new
            if read in seen and read != w:
                out.add(w)
        return out

    for read in ("marglnal", "margirial", "cacbe", "specihc", "infernal", "sarnple", "sharecl", "tbe", "nothing", "rnarglnal"):
        assert set(trie.within(read)) == brute(read), read


def test_numbers_of_pages():
    assert [scans.number_of(x) for x in ("12", "l2", "lO", "iv", "xii", "l")] == [12, 12, 10, 4, 12, 1] or scans.number_of("l") in (1, 50)
    assert scans.edge_of("– 12 –", "", "end.", False)[0] == "folio"
    assert scans.edge_of("Page 15 / 97  ,", "", "end.", False) == ("folio", None, 15)
    assert scans.edge_of("pV = nRT   (3.29)", "", "", True) is None
    assert scans.edge_of("Il suffit de connaître la mémoire", "pour répondre", "", True) is None


def test_long_page_is_taken_whole():
    text = "\n".join(BODY * 3000)
    assert scans.is_scan(text)
    assert len(scans.take_apart(text)) == len(BODY) * 3000


def cheapest_script(printed, read):
    """(cost, not all known confusions, no sure one) of the best edit script by the whole table of edits, for words that differ."""
    known = set(scans.CONFUSIONS)
    cells = {(0, 0): {(0, True, False)}}
    for i in range(len(printed) + 1):
        for j in range(len(read) + 1):
            for cost, listed, sure in list(cells.get((i, j), ())):
                steps = [(a, b, scans.CONFUSION, listed, sure or (printed[i : i + a], read[j : j + b]) not in scans.DOUBTFUL) for a in (1, 2) for b in (1, 2) if (printed[i : i + a], read[j : j + b]) in known and i + a <= len(printed) and j + b <= len(read)]
                steps += [(a, b, scans.OTHER_EDIT, False, sure) for a, b in ((1, 0), (0, 1), (1, 1), (1, 2), (2, 1))]
                steps += [(1, 1, 0, listed, sure)] if printed[i : i + 1] and printed[i : i + 1] == read[j : j + 1] else []
                for a, b, more, k, s in steps:
                    if cost + more <= scans.MOST_COST and i + a <= len(printed) and j + b <= len(read):
                        cells.setdefault((i + a, j + b), set()).add((cost + more, k, s))
    ends = [(c, not k, not s) for c, k, s in cells.get((len(printed), len(read)), ()) if c]
    return min(ends) if ends and printed != read else None


def test_automaton_finds_every_word_within_the_bound():
    import random

    rng = random.Random(4)
    make = lambda: "".join(rng.choices("eclirnmuhdt", k=rng.randint(1, 6)))
    vocabulary = list({make() for _ in range(200)})
    trie = scans.Trie((w, i + 1) for i, w in enumerate(vocabulary))
    for _ in range(80):
        read = make()
        got = {w: (x[0], not x[3], not x[2]) for w, x in trie.within(read, others=True).items()}
        assert got == {w: best for w in vocabulary if (best := cheapest_script(w, read))}


def test_the_words_beside_decide(spark):
    scans.ensure_checkpoint_dir(spark)
    answers = spark.createDataFrame(
        [("cat", "eat", 1, 90, True), ("cat", "oat", 1, 500, True), ("membrxne", "membrane", 2, 50, False), ("polaxity", "polarity", 2, 50, False), ("flnx", "flux", 1, 9, True)],
        "word string, meant string, confusions int, frequency long, listed boolean",
    )
    lines = [["They", "cat", "bread"], ["they", "eat", "bread"], ["the", "Membrxne", "lets"], ["the", "membrane", "lets"], ["a", "polaxity", "b"], ["flnx"], None]
    content = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "line_no int, words array<string>")
    got = {r.word: r.meant for r in scans.chosen(answers, content).collect()}
    assert got == {"cat": "eat", "membrxne": "membrane", "flnx": "flux"}
    assert scans.chosen(answers.where(F.lit(False)), content).count() == 0
