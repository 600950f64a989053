import datetime as dt

import pytest
from pyspark.sql import functions as F

from foliant.operators import evidence, integrity, inventory, notes, practice, ranking, structure, verification
from foliant.plans import shapes

PAGES = "page_id long, book string, page_index int, label string, text string, flags array<string>, images array<array<double>>, width double, height double, two_column boolean"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, b, n, lab, t, None, None, 100.0, 100.0, None) for i, b, n, lab, t in rows], PAGES)


def test_running_lines_and_clean_text(spark):
    rows = [(i, "b", i, str(i + 3), f"Heat and flow\nbody text {i} goes on\nPage {i}") for i in range(6)] + [(9, "b", 9, None, None), (10, "c", 0, "1", ""), (11, None, None, None, "x")]
    pages = pages_of(spark, rows)
    found = {(r.core, r.pages) for r in structure.running_lines(pages).collect()}
    assert found == {("Heat and flow", 6), ("Page #", 6)}
    clean = {r.page_id: r.text for r in structure.clean_text(pages, structure.running_lines(pages)).collect()}
    assert clean[2] == "body text 2 goes on" and clean[10] == ""
    assert structure.running_lines(pages.where(F.lit(False))).count() == 0


def test_labels_ties_and_thresholds(spark):
    pages = pages_of(spark, [(i, "b", i, str(i + 2), "") for i in range(4)] + [(9, "b", 9, "iv", ""), (5, "c", 0, "1", ""), (6, "c", 1, "3", "")])
    assert [(r.book, r.offset, r.votes, r.numbered) for r in structure.label_offsets(pages).collect()] == [("b", 2, 4, 4)]


def test_outline_and_sections(spark):
    pages = pages_of(spark, [(1, "b", 0, None, "1.1 Heat\ntext"), (2, "b", 1, None, "more"), (3, "b", 2, None, "1.2 Flow of ions"), (4, "b", 3, None, "1.1 Heat"), (5, "b", None, None, "1.3 Lost")])
    got = {(r.section, r.first_page, r.last_page) for r in structure.outline(pages).collect()}
    assert got == {("1.1", 0, 2), ("1.2", 2, 3)}
    inside = {(r.page_id, r.section) for r in structure.section_pages(pages, structure.outline(pages)).collect()}
    assert inside == {(1, "1.1"), (2, "1.1"), (3, "1.1"), (3, "1.2"), (4, "1.2")}


def test_range_join_equals_brute_force(spark):
    points = spark.range(200).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("p"))
    ranges = spark.createDataFrame([("k", a, a + w) for a in range(-5, 200, 7) for w in (0, 3, 40)], "k string, lo int, hi int")
    got = {(r.p, r.lo, r.hi) for r in shapes.range_join(points, ranges, ["k"], "p", "lo", "hi").collect()}
    assert got == {(p, a, a + w) for p in range(200) for a in range(-5, 200, 7) for w in (0, 3, 40) if a <= p <= a + w}


def test_islands_and_merged_ranges(spark):
    df = spark.createDataFrame([("b", x) for x in (1, 2, 2, 3, 7, 9, 10, None)], "b string, n int")
    assert sorted((r.first, r.last, r.size) for r in shapes.islands(df, ["b"], "n").collect()) == [(1, 3, 3), (7, 7, 1), (9, 10, 2)]
    ranges = spark.createDataFrame([("b", 1, 4), ("b", 2, 3), ("b", 5, 6), ("b", 9, 12), ("b", 11, 20), ("b", 8, 2)], "b string, lo int, hi int")
    assert sorted((r.first, r.last) for r in shapes.merged_ranges(ranges, ["b"], "lo", "hi").collect()) == [(1, 6), (9, 20)]


def test_reading_order_of_two_columns(spark):
    rows = [("p", 100.0, 5.0, 95.0, 0.0, "head")] + [("p", 100.0, 5.0, 45.0, 10.0 * i, f"l{i}") for i in range(1, 10)] + [("p", 100.0, 55.0, 95.0, 10.0 * i, f"r{i}") for i in range(1, 10)]
    got = structure.reading_order(spark.createDataFrame(rows, "page string, width double, x0 double, x1 double, y0 double, t string"), ["page"]).orderBy("place").collect()
    assert [r.t for r in got] == ["head"] + [f"l{i}" for i in range(1, 10)] + [f"r{i}" for i in range(1, 10)]


def quotes(spark, rows):
    return spark.createDataFrame(rows, "check_id long, book string, page_index int, quote string")


def test_quote_status(spark):
    first, second = "The membrane lets ions pass and the pressure", "falls at once. Another sentence stands on this page."
    pages = pages_of(spark, [(1, "b", 0, "1", first), (2, "b", 1, "2", second), (3, "c", 0, "1", "nothing here"), (4, "b", 2, "3", None)])
    rows = [(1, "b", 0, "membrane LETS ions pass"), (2, "b", 0, "the pressure falls at once"), (3, "b", 0, "another sentence stands on this"), (4, "b", 0, "no such words are anywhere"), (5, "b", 77, "membrane lets ions pass"), (6, "b", 0, "the membrane"), (7, "b", 0, None), (8, "c", 0, "membrane lets ions pass"), (9, None, 0, "membrane lets ions pass")]
    got = {r.check_id: r.status for r in evidence.quote_status(quotes(spark, rows), pages).collect()}
    assert got == {1: "exact", 2: "exact", 3: "wrong-page", 4: "not-found", 5: "bad-page", 6: "too-short", 7: "too-short", 8: "not-found", 9: "bad-page"}


def test_both_containment_plans_agree(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcdefghijklmnopqrstuvwxyz"), (2, "zyxabcdefghijklmnop"), (3, ""), (4, None)], "t long, key string")
    probes = spark.createDataFrame([(1, "cdefghijklmno"), (2, "abcdefghijklmnop"), (3, "short"), (4, "mnopqrstuvwxyz"), (5, "cdefghijklmnx"), (6, "cdefghijklmno")], "p long, probe string")
    one = {(r.t, r.p) for r in shapes.contained_pairs(texts, "t", "key", probes, "p", "probe").collect()}
    monkeypatch.setattr(shapes, "AUTOMATON_PROBES", 1)
    two = {(r.t, r.p) for r in shapes.contained_pairs(texts, "t", "key", probes, "p", "probe").collect()}
    assert one == two == {(1, 1), (2, 1), (1, 2), (2, 2), (1, 4), (1, 6), (2, 6)}


def test_best_window():
    page = "themembraneletsionspassandthepressurefalls" * 3
    assert evidence.best_window(page, "membraneletsionspass") > 0.94
    assert 0.9 < evidence.best_window(page, "membraneletsi0nspass") < 1.0
    assert evidence.best_window("", "x") == evidence.best_window(None, "x") == 0.0


def test_ranking_of_pages(spark):
    pages = pages_of(spark, [(1, "b", 0, None, "heat heat flow"), (2, "b", 1, None, "flow of ions"), (3, "b", 2, None, "ions and salts"), (4, "b", 3, None, None), (5, "b", 4, None, "flow of ions")])
    q = spark.createDataFrame([(7, "heat"), (8, "ions flow"), (9, None), (10, "zzz")], "q long, text string")
    got = [(r.q, r.page_id) for r in evidence.rank_pages(q, "q", "text", pages, 2).orderBy("q", "rank").collect()]
    assert got == [(7, 1), (8, 2), (8, 5)]


def test_accepting_numbers_in_order(spark):
    df = spark.createDataFrame([([1, 2, 5, 3, 3, 4],), ([2, 3],), ([],)], "n array<int>")
    assert [r.x for r in df.select(inventory.accept_in_order(F.col("n")).alias("x")).collect()] == [[1, 2, 3, 4], [], []]


BLOCKS = "block_no long, kind string, id string, fields array<struct<key: string, value: string, line: int, raw: string>>"


def test_note_rules(spark):
    f = lambda *kv: [(k, v, 1, "") for k, v in kv]
    rows = [
        (1, "concept", "a", f(("Term", "Heat"), ("definition", "word " * 70), ("colour", "red"), ("TERM", "again"))), (2, "question", "b", f(("type", "mcq"), ("bloom", "apply"), ("ask", "?"), ("answer", "B"), ("option a", "x"), ("option b", "y"))),
        (3, "question", "c", f(("type", "tf"), ("bloom", " "), ("ask", "?"), ("answer", "maybe"))), (4, "other", "d", f(("x", "y"))), (5, "concept", None, None), (6, None, None, []),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    got = {(r.block_no, r.key, r.code) for r in notes.issues(blocks).collect()}
    assert got == {(1, "term", "too-many"), (1, "definition", "too-long"), (1, "colour", "unknown"), (3, "bloom", "empty"), (5, "term", "missing"), (5, "definition", "missing")}
    assert {(r.block_no, r.valid) for r in notes.answer_issues(blocks).collect()} == {(2, True), (3, False)}


def test_notes_round_trip(spark):
    fields = [("term", "Heat", 1, ""), ("why", "It falls: so\nit is", 2, "")]
    blocks = spark.createDataFrame([(1, "concept", "T-1", fields)], BLOCKS)
    text = notes.render_blocks(blocks).select(F.lit("f").alias("file"), F.concat(F.lit("<!-- x: y -->\n"), F.col("text"), F.lit("\nstray: line\n")).alias("text"))
    got = [(r.kind, r.id, r.field_no, r.key, r.value) for r in notes.parse_notes(text).orderBy("field_no").collect()]
    assert got == [("concept", "T-1", 0, "term", "Heat"), ("concept", "T-1", 1, "why", "It falls: so\nit is")]


def test_scores_with_idle_signals(spark):
    df = spark.createDataFrame([("a", 4, 0), ("b", 2, 0), ("c", 0, 0)], "k string, x int, y int")
    scored = ranking.weighted_score(df, {"x": 2.0, "y": 1.0})
    assert [(r.k, r.score) for r in scored.orderBy("k").collect()] == [("a", 2.0), ("b", 1.0), ("c", 0.0)]
    assert [r.stars for r in ranking.stars(scored, [F.desc("score"), F.col("k")]).orderBy("rank").collect()] == [3, 2, 1]


def test_false_numbers(spark):
    df = spark.createDataFrame([(1, "It is 4.18 J", "4.18"), (2, "In 1899 it", "x"), (3, "At 12 V", "21 too"), (4, "no number", ""), (5, None, ""), (6, "9 units", None), (7, "77 units", "")], "i long, t string, c string")
    got = {r.i: (r.changed, r.mutated) for r in verification.false_numbers(df, "i", "t", "c").collect()}
    assert got == {1: ("5", "It is 5.18 J"), 2: ("1898", "In 1898 it"), 6: ("8", "8 units"), 7: ("78", "78 units")}


def test_false_words(spark):
    df = spark.createDataFrame([(1, "It always rises"), (2, "Quand elle augmente"), (3, "nothing"), (4, None)], "i long, t string")
    assert {r.i: r.mutated for r in verification.false_words(df, "i", "t").collect()} == {1: "It never rises", 2: "Quand elle diminue"}


def test_batches_and_scores(spark):
    df = spark.range(25).select("id", F.lit("b").alias("b"))
    b = verification.batches(df, ["b"], [F.col("id")], 12)
    assert [r["count"] for r in b.groupBy("batch").count().orderBy("batch").collect()] == [12, 12, 1]
    judged = b.withColumn("planted", F.col("id") % 10 == 0).withColumn("verdict_true", F.col("id") == 20)
    got = [(r.planted, r.caught, r.rejected) for r in verification.batch_scores(judged, ["batch"]).orderBy("batch").collect()]
    assert got == [(2, 2, False), (1, 0, True), (0, 0, False)]


RESULTS = "result_no long, course string, id string, correct boolean, at timestamp_ntz"


def results_of(spark, answers):
    day = dt.datetime(2026, 9, 27, 10)
    return spark.createDataFrame([(i, "c", "q", ok, day + dt.timedelta(days=d)) for i, (d, ok) in enumerate(answers)], RESULTS)


def test_relearning(spark):
    state = lambda answers: practice.relearning(results_of(spark, answers), ["course", "id"]).first()
    first = state([(0, False)])
    assert (first.box, first.due, first.learned) == (0, dt.date(2026, 9, 28), False)
    done = state([(0, False), (1, True), (2, True), (3, True)])
    assert (done.due, done.learned, done.streak) == (None, True, 3)
    assert state([(0, True), (1, True)]).due is None  # nothing was due, so nothing counts
    assert state([(0, False), (1, True), (2, False)]).box == 0


def test_distinct_results_and_streaks(spark):
    r = results_of(spark, [(0, True), (1, True), (2, False), (3, None), (4, True)])
    clean = practice.distinct_results(r.unionByName(r))
    assert clean.count() == 4
    assert [(x.correct, x.answers) for x in practice.streaks(clean, ["course", "id"]).orderBy("run").collect()] == [(True, 2), (False, 1), (True, 1)]


def test_samples(spark):
    pool = spark.range(1000).withColumn("w", F.when(F.col("id") < 100, 10.0).otherwise(1.0)).withColumn("draw", F.lit("clash"))
    a = practice.weighted_sample(pool.drop("draw"), "id", F.col("w"), 50, seed=1)
    assert a.count() == 50 and a.select("id").distinct().count() == 50
    assert a.where("id < 100").count() > 15
    assert {r.id for r in a.collect()} == {r.id for r in practice.weighted_sample(pool.drop("draw").repartition(5), "id", F.col("w"), 50, seed=1).collect()}
    spread = practice.interleaved(spark.range(12).withColumn("g", F.col("id") % 3), "g", "id").orderBy("place").collect()
    assert all({x.g for x in spread[i : i + 3]} == {0, 1, 2} for i in range(0, 12, 3))


def test_days_of_work(spark):
    work = spark.createDataFrame([("a", 100, 1), ("b", 200, 2), ("c", 0, 3)], "k string, m long, o int")
    assert sorted((r.k, r.day, r.minutes) for r in practice.fill_days(work, ["k"], "m", [F.col("o")]).collect()) == [("a", 1, 100), ("b", 1, 20), ("b", 2, 120), ("b", 3, 60)]


def test_changes(spark):
    old = integrity.digests(spark.createDataFrame([(1, "a"), (2, "b\r\n"), (3, "c"), (5, None)], "k long, t string"), ["k"], "t")
    new = integrity.digests(spark.createDataFrame([(1, "a"), (2, "b\n"), (3, "x"), (4, "d"), (5, None)], "k long, t string"), ["k"], "t")
    assert {(r.k, r.change) for r in integrity.changes(old, new, ["k"]).collect()} == {(3, "changed"), (4, "added")}


@pytest.mark.parametrize("text", ["", None, "   ", "x" * 100_000])
def test_extreme_texts(spark, text):
    pages = pages_of(spark, [(1, "b", 0, None, text)])
    for df in (structure.running_lines(pages), structure.page_lines(pages), structure.captions(pages), structure.outline(pages), structure.joined_line_ends(pages), structure.page_flags(pages), inventory.exercises(pages), inventory.defined_terms(pages)):
        df.collect()


def test_empty_tables(spark):
    pages = pages_of(spark, [(1, "b", 0, None, "x")]).where(F.lit(False))
    q = quotes(spark, [(1, "b", 0, "x")]).where(F.lit(False))
    assert evidence.quote_status(q, pages).count() == evidence.number_support(q, pages).count() == structure.label_offsets(pages).count() == 0
    assert practice.relearning(results_of(spark, [(0, True)]).where(F.lit(False)), ["id"]).count() == 0


def test_every_claim_gets_a_context_that_does_not_fit(spark):
    same = "the pressure of the sample depends on the membrane"
    contexts = spark.createDataFrame([(i, "zzzzzz" if i == 777 else same) for i in range(2000)], "page long, text string")
    claims = spark.createDataFrame([(i, same[i:]) for i in range(20)] + [(90, "zzzz"), (91, "ze"), (92, None)], "claim long, key string")
    got = {r.claim: (r.page, r.shared) for r in verification.mismatched(claims, "claim", "key", contexts, "page", "text").collect()}
    assert {c: got[c] for c in range(20)} == {c: (777, 0.0) for c in range(20)}
    assert got[90][0] != 777 and got.keys() == {*range(20), 90}
    nowhere = verification.mismatched(claims, "claim", "key", contexts.where("page != 777"), "page", "text")
    assert [r.claim for r in nowhere.collect()] == [90]
    assert verification.mismatched(claims, "claim", "key", contexts.limit(0), "page", "text").count() == 0


def test_least_edits_equals_the_whole_table():
    import random

    def table(text, pattern):
        row = list(range(len(pattern) + 1))
        best = row[-1]
        for c in text:
            now = [0]
            for j, d in enumerate(pattern, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (c != d)))
            row, best = now, min(best, now[-1])
        return best

    rng = random.Random(5)
    for _ in range(2000):
        text, pattern = ("".join(rng.choices("abc", k=rng.randint(0, n))) for n in (25, 9))
        assert evidence.least_edits(text, pattern) == table(text, pattern)
    assert evidence.least_edits("x" * 5000 + "membrane" + "y" * 5000, "mambrane") == 1


def test_quotes_that_run_on_far(spark):
    long = "the membrane lets ions pass and the pressure falls at once " * 20
    pages = pages_of(spark, [(1, "b", 0, None, "It is said that " + long[:40]), (2, "b", 1, None, long[40:] + "the end"), (3, "c", 0, None, long)])
    checks = spark.createDataFrame([(1, "b", 0, long.strip()), (2, "c", 0, long.strip()), (3, "c", 0, "the pressure falls at first")], "check_id long, book string, page_index int, quote string")
    got = {r.check_id: (r.status, r.pages) for r in evidence.quote_status(checks, pages).collect()}
    assert got == {1: ("exact", []), 2: ("exact", []), 3: ("not-found", [])}


def test_pairs_stay_within_their_group(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "abcdefghijklmnop", "x"), (2, "zzabcdefghijklmn", "y"), (3, "abcdefghijklmnop", None)], "t long, key string, g string")
    probes = spark.createDataFrame([(1, "abcdefghijkl", "x"), (2, "abcdefghijkl", "y"), (3, "bcdefghijklm", "y"), (4, "abcdefghijklq", "x")], "p long, probe string, g string")
    for most in (50_000, 1):
        monkeypatch.setattr(shapes, "AUTOMATON_PROBES", most)
        got = {(r.t, r.p, r.g) for r in shapes.contained_pairs(texts, "t", "key", probes, "p", "probe", group="g").collect()}
        assert got == {(1, 1, "x"), (2, 2, "y"), (2, 3, "y")}


def test_calculations_of_a_block_share_their_names(spark):
    schema = "block_no long, fields array<struct<key: string, value: string, line: int, raw: string>>"
    lines = ["m = 250[g]", "dT = 40[degC] - 25[degC]", "q = m * 4.184[J/(g*degC)] * dT => 15690[J]", "q / m => 62.8[J/g]", "q / m => 61.8[J/g]", None, "x + 1"]
    rows = [(1, [("Calc", v, 1, "") for v in lines] + [("why", "2", 2, "")]), (2, [("calc", "q => 15690[J]", 1, "")]), (3, None), (4, []), (5, [("why", "x", 1, "")])]
    got = {(r.block_no, r.field_no): (r.ok, r.problem) for r in notes.calculations(spark.createDataFrame(rows, schema)).collect()}
    assert [got[1, i][0] for i in (0, 1, 2, 3, 4, 6)] == [True, True, True, True, False, False]
    assert got[1, 4][1] == "the calculation gives 62.76" and got[2, 0] == (False, "unknown name q") and len(got) == 7


def test_split_row_numbers_equal_whole_ones(spark):
    from pyspark.sql import Window

    df = spark.createDataFrame([(None if i % 11 == 0 else i % 3, None if i % 13 == 0 else (i * 37) % 50, i) for i in range(200)], "k int, v int, i int")
    whole = F.row_number().over(Window.partitionBy("k").orderBy("v", "i"))
    got = shapes.split_row_number(df, ["k"], F.floor(F.col("v") / 7), [F.col("v"), F.col("i")], "n").withColumn("want", F.lit(0)).select("i", "n")
    assert {(r.i, r.n) for r in got.collect()} == {(r.i, r.w) for r in df.select("i", whole.alias("w")).collect()}
    none = shapes.split_row_number(df.where("i < 0"), [], F.col("v"), [F.col("v")], "n")
    assert none.columns == ["k", "v", "i", "n"] and none.count() == 0


def test_sessions_over_midnight(spark):
    at = [dt.datetime(2026, 3, 1, 23, 10), dt.datetime(2026, 3, 1, 23, 39), dt.datetime(2026, 3, 2, 0, 8), dt.datetime(2026, 3, 2, 0, 38), dt.datetime(2026, 3, 2, 9, 0)]
    df = spark.createDataFrame([("c", t, True) for t in at] + [(None, at[0], False)], "course string, at timestamp_ntz, correct boolean")
    got = sorted((str(r.course), r.answers, r.right, r.first_at) for r in practice.sessions(df, ["course"]).collect())
    assert got == [("None", 1, 0, at[0]), ("c", 1, 1, at[4]), ("c", 4, 4, at[0])]


def test_broadcasts_are_bounded_in_rows_and_bytes(spark, monkeypatch):
    from foliant import session

    df = spark.createDataFrame([(1, "word " * 100, [1, 2]), (2, None, None)], "i int, text string, a array<int>")
    assert session.broadcast_if_small(df) is not df
    assert session.broadcast_if_small(df, rows=1) is df
    monkeypatch.setattr(session, "BROADCAST_BYTES", 400)
    assert session.broadcast_if_small(df) is df
    empty = df.where("i > 5")
    assert session.broadcast_if_small(empty) is not empty


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_many_probes_are_found_without_exploding_the_texts(spark, monkeypatch):
    import random

    rng = random.Random(3)
    texts = [(i, "".join(rng.choices("ab𝔞", k=rng.randint(0, 400))), rng.choice(["x", "y", None])) for i in range(60)]
    probes = [(i, (t := rng.choice(texts)[1])[(a := rng.randint(0, max(0, len(t) - 12))) : a + rng.choice([11, 12, 13, 24, 60, 200])], rng.choice(["x", "y", None])) for i in range(300)]
    want = {(t, p, g) for t, text, g in texts for p, probe, h in probes if g == h and len(probe) >= 12 and probe in text}
    monkeypatch.setattr(shapes, "AUTOMATON_PROBES", 1)
    pairs = shapes.contained_pairs(spark.createDataFrame(texts, "t long, key string, g string"), "t", "key", spark.createDataFrame(probes, "p long, probe string, g string"), "p", "probe", group="g")
    assert "Generate" not in plan_of(pairs)  # no row for each stretch of a text, which took more disk than there is
    got = [(r.t, r.p, r.g) for r in pairs.collect()]
    assert len(got) == len(want) and set(got) == want and len(want) > 50


def test_quote_status_with_many_places(spark, monkeypatch):
    pages = pages_of(spark, [(i, "b", i, None, f"page {i} tells of membranes and of ions that pass number {i} at once") for i in range(40)] + [(40, "b", 40, None, " .. ")])
    checks = quotes(spark, [(i, "b", i, f"ions that pass number {i} at once" if i % 3 else f"tells of membranes and of ions that pass number {39 - i} at") for i in range(40)] + [(40, "b", 40, "tells of membranes and nothing"), (41, "b", 3, "number 3 at once page 4 tells of membranes")])
    few = sorted((r.check_id, r.status, r.pages) for r in evidence.quote_status(checks, pages).collect())
    monkeypatch.setattr(shapes, "AUTOMATON_PROBES", 1)
    monkeypatch.setattr(evidence, "broadcast_if_small", lambda df: df)
    status = evidence.quote_status(checks, pages)
    assert sorted((r.check_id, r.status, r.pages) for r in status.collect()) == few
    assert {s for _, s, _ in few} == {"exact", "wrong-page", "not-found"} and few[41][1] == "exact"


def test_fuzzy_quotes_key_cited_pages_only(spark, monkeypatch):
    pages = pages_of(spark, [(i, "b", i, None, f"page {i} tells of membranes and of ions that pass number {i} at once") for i in range(20)] + [(20, "b", 3, None, "tells of membrames and of ions"), (21, "b", 4, None, None)])
    checks = quotes(spark, [(1, "b", 3, "tells of membrames and of ionz"), (2, "b", 4, "tells of nembranes and of ions"), (3, "b", 5, "page 5 tells of membranes"), (4, "b", 6, "zzzz yyyy xxxx wwww vvvv")])
    few = sorted(tuple(r) for r in evidence.fuzzy_quotes(checks, pages, evidence.quote_status(checks, pages)).collect())
    assert [(i, a) for i, _, a in few] == [(1, True), (2, True), (4, False)] and few[0][1] == few[1][1] == 0.96
    monkeypatch.setattr(shapes, "AUTOMATON_PROBES", 1)
    monkeypatch.setattr(evidence, "broadcast_if_small", lambda df: df)
    many = evidence.fuzzy_quotes(checks, pages, evidence.quote_status(checks, pages))
    plan = plan_of(many)
    assert "Generate" not in plan and "ArrowEvalPython" not in plan[plan.index("Join") :]
    assert sorted(tuple(r) for r in many.collect()) == few


def test_ranking_shuffles_no_words(spark, monkeypatch):
    import math
    import random

    rng = random.Random(7)
    lexicon = [f"w{i:02d}" for i in range(40)]
    texts = [(i // 2 if i < 20 else i, " ".join(rng.choices(lexicon, k=rng.randint(0, 12)))) for i in range(300)] + [(None, "w01 w02"), (None, "w01"), (900, None)]
    asked = [(i, " ".join(rng.choices(lexicon, k=rng.randint(1, 5)))) for i in range(30)] + [(30, "w01"), (31, "none here"), (32, None), (33, ""), (7, "w03 w04")]
    tf: dict = {}
    for i, text in texts:
        for w in (text or "").split():
            tf[i, w] = tf.get((i, w), 0) + 1
    df = {w: sum(1 for _, v in tf if v == w) for w in lexicon}
    n = sum(1 for _, text in texts if text is not None)
    want = []
    for q in {q for q, _ in asked}:
        words = {w for i, text in asked if i == q for w in (text or "").split()}
        scores: dict = {}
        for (i, w), count in sorted(tf.items(), key=str):
            if w in words:
                scores[i] = scores.get(i, 0) + (1 + math.log(count)) * math.log(1 + n / (1 + df[w]))
        best = sorted(((round(s, 6), i) for i, s in scores.items()), key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:5]
        want += [(q, i, s, r) for r, (s, i) in enumerate(best, 1)]
    pages = spark.createDataFrame(texts, "page_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "q long, text string")
    for most in (16_384, 50):
        monkeypatch.setattr(evidence, "RANKED_PAGES", most)
        ranked = evidence.rank_pages(queries, "q", "text", pages)
        assert "Generate" not in plan_of(ranked)  # neither words of pages nor pairs that share one are rows
        got = [(r.q, r.page_id, r.score, r["rank"]) for r in ranked.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and len(got) > 140
    assert evidence.rank_pages(queries.limit(0), "q", "text", pages).count() == evidence.rank_pages(queries, "q", "text", pages.limit(0)).count() == 0
